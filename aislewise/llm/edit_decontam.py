"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may be found with up to ``e = floor(max_error * m)`` edits. Cut into
``e + 1`` pieces, at least one piece must stand unchanged in any such occurrence. An Aho-Corasick
automaton finds all exact pieces in one pass over a text; around each hit, Myers' bit-parallel
algorithm computes the least edit distance of the whole item.

Texts and items are compared in lower case with runs of white space as one blank; ``begin`` and
``end`` count characters of the text in that form.

The items are a query set held against all rows. They are sent to the tasks in blocks of about
``block_bytes`` bytes of text, one narrow pass over the documents for each block. With several blocks
each pass's result is written before the next block is collected, so neither the driver nor a task
holds more than one, and no row is shuffled.

Defined cases: null or empty texts hold no item; null or blank items are found nowhere; repeated
rows give their findings once each; items with equal texts are all reported; of several occurrences
of an item in a text, the one with the least distance, then the first, is reported; very long texts are
searched whole, distances only around exact pieces; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import arrow_schema, columns_of, written

MAX_ERROR = 0.08
BLOCK_BYTES = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Pattern:
    """An item as bit masks for Myers' algorithm, on whole texts and backwards from an end."""

    def __init__(self, text: str, errors: int):
        self.text, self.size, self.errors = text, len(text), errors
        self.forward, self.backward = self._masks(text), self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return masks

    def distances(self, text: str, masks: dict[str, int], anchored: bool) -> Iterator[int]:
        """The distance of the item to the best part of ``text`` that ends after each character, or,
        if anchored, to all of the text up to there."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score = full, 0, self.size
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            yield score

    def search(self, text: str) -> tuple[int, int, int] | None:
        """Least distance within the errors allowed, and begin and end of the first such part."""
        at = text.find(self.text)
        if at >= 0:
            return 0, at, at + self.size
        best, end = min(((d, i) for i, d in enumerate(self.distances(text, self.forward, False))), default=(self.size, 0))
        if best > self.errors:
            return None
        back = text[max(0, end + 1 - self.size - self.errors) : end + 1][::-1]
        length = next(i for i, d in enumerate(self.distances(back, self.backward, True), 1) if d == best)
        return best, end + 1 - length, end + 1


class Matcher:
    """Finds a block of items, given as (id, text), in texts."""

    def __init__(self, items: list[tuple], max_error: float):
        import ahocorasick

        by_text: dict[str, list] = {}
        for key, text in items:
            if text and (t := normal(text)):
                by_text.setdefault(t, []).append(key)
        self.patterns = [Pattern(t, int(max_error * len(t))) for t in by_text]
        self.keys = list(by_text.values())
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            cuts = [p.size * i // (p.errors + 1) for i in range(p.errors + 2)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(p.text[begin:end], []).append((n, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """``(item id, begin, end, distance)`` of every item that the text holds."""
        if not self.patterns or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                p = self.patterns[n]
                begin = max(0, last + 1 - size - offset - p.errors)
                end = last + 1 - size - offset + p.size + p.errors
                known = windows.setdefault(n, [])
                if known and begin <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], end)
                    known[-1][0] = min(known[-1][0], begin)
                else:
                    known.append([begin, end])
        out = []
        for n in sorted(windows):
            found = [(d, b + begin, e + begin) for begin, end in windows[n] if (hit := self.patterns[n].search(text[begin:end])) for d, b, e in [hit]]
            if found:
                d, b, e = min(found)
                out += [(key, b, e, d) for key in self.keys[n]]
        return out


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and the blocks, each collected when it is asked for."""
    items = items.select(items[item_id].alias("k"), items[item_text].alias("t")).where("t IS NOT NULL")
    n = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes)
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) for i in range(n))
    return n, ([(r["k"], r["t"]) for r in part.collect()] for part in parts)  # about block_bytes each


def find_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df`` and item found in it: ``id``, ``item_id``, ``begin``, ``end``, ``distance``."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, begin long, end long, distance long"
    arrow = arrow_schema(df.sparkSession, schema)
    docs = columns_of(df, id_col, text_col)

    def finder(block: list[tuple]) -> Callable:
        def run(batches):
            matcher = Matcher(block, max_error)
            for batch in batches:
                rows = [(key.as_py(), *hit) for key, text in zip(batch.column(0), batch.column(1), strict=True) for hit in matcher.find(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

        return run

    out = None
    n, blocks = _blocks(items, item_id, item_text, block_bytes)
    for block in blocks:
        found = docs.mapInArrow(finder(block), schema)
        if n > 1:  # written before the next block is collected
            found = written(found, "found-items")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def keep_clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that hold no item, with all their columns. A narrow pass for each block."""
    at = df.columns.index(text_col)

    def cleaner(block: list[tuple]) -> Callable:
        def run(batches):
            matcher = Matcher(block, max_error)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return run

    n, blocks = _blocks(items, item_id, item_text, block_bytes)
    for block in blocks:
        df = df.mapInArrow(cleaner(block), df.schema)
        if n > 1:
            df = written(df, "clean")
    return df
