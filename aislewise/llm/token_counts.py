"""Token counts with a sentencepiece BPE model, huge documents by overlap resynchronisation.

A place between two characters is a *proven boundary* if that pair of characters stands inside no
piece of the vocabulary: merges only ever make pieces, so none can cross it, and what is on one side
is encoded the same whatever is on the other.

Texts up to ``chunk_chars`` are cut before each run of blanks, where the vocabulary proves a
boundary, and each distinct part is encoded once a task. Longer texts are encoded as overlapping
chunks with offsets. Two neighbours are spliced at a proven boundary inside their overlap, at which
both have the end of a token; where there is none, the overlap is doubled, in the end to the whole
text. Both ways give exactly the number of tokens of the whole text.

Defined cases: a null or empty text has 0 bytes and 0 tokens; every row gives one row, whatever its
id; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from aislewise.llm.common import columns_of, map_texts

BLANK = "▁"  # a blank inside pieces
_PARTS = re.compile(r" *[^ ]+| +$")


class PieceCounter:
    """Counts tokens; keeps at most ``memo_size`` counts of parts."""

    def __init__(self, model_file: str, chunk_chars: int = 32_768, overlap: int = 256, memo_size: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size, self.overlap, self.memo_size = chunk_chars, overlap, memo_size
        self.inside: set[str] = set()  # pairs of characters that stand inside a piece
        self.known: set[str] = set()  # characters that need no byte fallback
        m = self.model
        self.opens = np.array([m.id_to_piece(i).startswith(BLANK) for i in range(m.get_piece_size())])
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                p = m.id_to_piece(i)
                self.inside.update(p[k : k + 2] for k in range(len(p) - 1))
                if len(p) == 1:
                    self.known.add(p)
        self.parts_proven = all(p[1] != BLANK or p[0] == BLANK for p in self.inside)
        self.memo: dict[str, int] = {"": 1 if BLANK in self.known else len(BLANK.encode())}

    def count_all(self, texts: list[str]) -> list[int]:
        texts = [t.replace(BLANK, " ") for t in texts]  # the model writes blanks so itself
        if not self.parts_proven:
            return [self.count_long(t) if len(t) > self.size else self._whole(t) for t in texts]
        parts = [_parts(t) if len(t) <= self.size else None for t in texts]
        if len(self.memo) > self.memo_size:
            self.memo = {"": self.memo[""]}
        self._learn({p for x in parts if x for p in x if p not in self.memo})
        get = self.memo.__getitem__
        return [self.count_long(t) if x is None else sum(map(get, x)) for t, x in zip(texts, parts, strict=True)]

    def _learn(self, parts: set[str]) -> None:
        """Count the tokens of parts not yet known. Parts without blanks go as lines of many: a piece
        that starts with a blank starts the next part, as merges cannot cross the place before it."""
        plain = [p for p in parts if " " not in p]
        lines = [" ".join(plain[i : i + 200]) for i in range(0, len(plain), 200)]
        if lines:
            ids = np.concatenate(self.model.encode(lines, return_type="numpy", num_threads=1))
            starts = np.flatnonzero(self.opens[ids])
            self.memo.update(zip(plain, np.diff(starts, append=len(ids)).tolist(), strict=True))
        other = [p for p in parts if " " in p]
        self.memo.update(zip(other, map(len, self.model.encode(other, return_type="numpy", num_threads=1)), strict=True))

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, return_type="numpy", num_threads=1))

    def _offsets(self, text: str) -> tuple[list[int], list[int]]:
        spans = self.model.encode(text, return_type="offset_mapping", num_threads=1)["offsets"]
        return [b for b, _ in spans], [e for _, e in spans]

    def _proven(self, text: str, at: int) -> bool:
        a, b = (BLANK if c == " " else c for c in text[at - 1 : at + 1])
        return a + b not in self.inside and a in self.known and b in self.known

    def count_long(self, text: str) -> int:
        """Tokens of a text of any length, encoded in overlapping chunks."""
        n, total, start, done = len(text), 0, 0, 0  # tokens before the place `done` are counted
        end = min(n, self.size)
        begins, ends = self._offsets(text[:end])
        while end < n:
            overlap = min(self.overlap, (end - done) // 2)
            while True:
                nxt = max(end - overlap, done)
                stop = min(n, max(nxt + self.size, end + 1))
                begins2, ends2 = self._offsets(text[nxt:stop])
                left = {start + b for b in begins} & {start + e for e in ends}
                right = {nxt + b for b in begins2} & {nxt + e for e in ends2}
                common = [q for q in left & right if max(nxt, done) < q < end and self._proven(text, q)]
                if common:
                    at = max(common)
                    total += sum(done <= start + b < at for b in begins)
                    start, end, begins, ends, done = nxt, stop, begins2, ends2, at
                    break
                if nxt > done:
                    overlap *= 2
                    continue
                end = min(n, start + 2 * (end - start))  # no boundary in the whole chunk: a longer chunk
                begins, ends = self._offsets(text[start:end])
                break
        return total + sum(done <= start + b for b in begins)


def _parts(text: str) -> list[str]:
    """The parts between proven boundaries, each without the blank that the model puts before a text."""
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [p[1:] for p in _PARTS.findall(" " + text)]


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = 32_768, overlap: int = 256) -> DataFrame:
    """One row per input row: ``id``, ``n_bytes``, ``n_tokens`` and ``over_limit``. Narrow: no shuffle."""

    def make():
        counter = PieceCounter(model_file, chunk_chars, overlap)

        def work(ids, texts):
            tokens = counter.count_all(texts)
            return {"id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [k > limit for k in tokens]}

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(columns_of(df, id_col, text_col), make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
