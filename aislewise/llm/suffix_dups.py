"""Removal of repeated strings by longest-previous-factor arrays.

Strings of ``length`` bytes that start at more than one place of the corpus are found, and the bytes
they cover removed: all of them (``keep="none"``) or all but those of first occurrences
(``keep="first"``; places are ordered by id, then offset).

One suffix array of a whole corpus fits no machine. Its order is only needed among suffixes that may
agree for ``length`` bytes, so the starts are dealt into buckets by their anchors (see ``anchors``):

1. Each run of starts with one anchor gives a row: the anchor's hash and a digest of the run's whole
   surroundings (from its first start to the end of its last string). Most rows have an anchor like
   no other and end here.
2. Runs with equal digests repeat each other as a whole: counted, with the first place. Equal
   passages and copies of documents, however many, are settled by this aggregate.
3. Anchors with several different surroundings get one representative of each. In each such bucket
   the starts, as suffixes cut after ``length`` bytes, are sorted; neighbours in that order give the
   common prefixes; and previous and next smaller positions give each start's longest previous
   factor, with its source. A factor of ``length`` bytes marks the start as later copy, and its source
   as having one.
4. A bucket of more than ``bucket_rows`` surroundings (a frequent passage, where it begins and ends
   differently in each document) is not collected: its starts go by a digest of their strings into
   an aggregate that combines equal ones before the shuffle. Nothing is capped.

Defined cases: null or empty texts, and texts shorter than ``length``, lose nothing; very long texts are
searched for anchors in overlapping stretches of a megabyte; repeated rows of
one id are copies of each other under ``"none"``, and as one under ``"first"``; null ids are ids like
any other and come first; empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.anchors import anchors, stretches
from aislewise.llm.common import arrow_schema, maybe_in, slices, written

#: Rows of windows that are sorted at a time.
SORTED_ROWS = 20_000


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors from a suffix order. ``order[r]`` is the position of the suffix of rank
    ``r``, ``lcp[r]`` its common prefix with rank ``r - 1``. Returns, by rank, the length of the longest
    prefix that a suffix of a smaller position has too, and that position (-1 if none).

    The previous and the next rank with a smaller position are found with one stack; the common
    prefix with them is the least ``lcp`` on the way."""
    n = len(order)
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for ranks, shift in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        stack: list[tuple[int, int]] = []  # position, common prefix with the entry below
        for r in ranks:
            common = int(lcp[r + shift]) if 0 <= r + shift < n and (shift or r) else 0
            while stack and stack[-1][0] > order[r]:
                common = min(common, stack.pop()[1])
            if stack and common > best[r]:
                best[r], source[r] = common, stack[-1][0]
            stack.append((int(order[r]), common if stack else 0))
    return best, source


def repeated_starts(contexts: list[bytes], before: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of surroundings with a common anchor, in order of position, ``before[i]`` bytes before the anchor
    of context ``i``: which starts have an earlier copy, and which have a copy at all. Both are boolean
    matrices by context and start (places behind the last start are false)."""
    runs = [len(c) - length + 1 for c in contexts]
    widest = max(runs)
    earlier, copied = np.zeros((len(contexts), widest), bool), np.zeros((len(contexts), widest), bool)
    # A row for each start: its offset to the anchor, then the string. Starts at different offsets
    # cannot be equal, so the offset in front keeps the order and parts it.
    who = np.repeat(np.arange(len(contexts)), runs)
    start = np.concatenate([np.arange(n) for n in runs])
    offset = np.array(before)[who] - start
    by = np.lexsort((who, offset))
    who, start, offset = who[by], start[by], offset[by]
    cuts = np.flatnonzero(np.diff(offset, prepend=offset[0] - 1))
    begin = 0
    while begin < len(who):
        end = next((int(c) for c in cuts[::-1] if begin < c <= begin + SORTED_ROWS), None) or next((int(c) for c in cuts if c > begin), len(who))
        if len(who) - begin <= SORTED_ROWS:
            end = len(who)
        w, s = who[begin:end], start[begin:end]
        rows = np.empty((len(w), length + 4), np.uint8)
        rows[:, :4] = (offset[begin:end] + (1 << 30)).astype(">u4").view(np.uint8).reshape(-1, 4)
        for i in np.unique(w).tolist():
            mine = np.flatnonzero(w == i)
            data = np.frombuffer(contexts[i], np.uint8)
            rows[mine, 4:] = np.lib.stride_tricks.sliding_window_view(data, length)[s[mine]]
        order = np.argsort(rows.view(f"S{length + 4}").ravel(), kind="stable")
        ranked = rows[order]
        differ = ranked[1:] != ranked[:-1]
        lcp = np.zeros(len(order), np.int64)
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length + 4) - 4
        long = lcp >= length
        if long.any():  # elsewhere no factor reaches the length
            inside = long | np.append(long[1:], False)
            ranks = np.flatnonzero(inside)
            part = np.where(long, lcp, 0)[ranks]
            factor, source = longest_previous(order[ranks], part)
            later = ranks[factor >= length]
            places, sources = order[later], source[factor >= length]
            earlier[w[places], s[places]] = True
            copied[w[places], s[places]] = True
            copied[w[sources], s[sources]] = True
        begin = end
    return earlier, copied


def _runs(row: np.ndarray) -> list[dict]:
    """Maximal runs of true values as first and last."""
    edge = np.diff(row.astype(np.int8), prepend=0, append=0)
    return [{"first": int(b), "last": int(e) - 1} for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, t long, h long, around long, at int, first int, last int"
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            held, size = [], 0  # row, place and bytes of stretches, about a megabyte at a time
            for i in range(batch.num_rows):
                for at, part in stretches(batch.column(2)[i].as_py().encode(), length):
                    held.append((i, at, part))
                    size += len(part)
                    if size >= 1 << 20:
                        yield found(batch, held)
                        held, size = [], 0
            if held:
                yield found(batch, held)

    def found(batch, held):
        owner, h, at, first, last = anchors([p for _, _, p in held], length, gram)
        digests = [int.from_bytes(hashlib.blake2b(held[o][2][f : e + length], digest_size=8).digest(), "little", signed=True) for o, f, e in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)]
        take, shift = (np.array([x[i] for x in held], np.int64)[owner] for i in (0, 1))
        places = [pa.array((x + shift).astype(np.int32)) for x in (at, first, last)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(h), pa.array(digests, pa.int64()), *places], schema=arrow)

    return rows.mapInArrow(run, schema)


def _in_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Factors within buckets: ``h``, ``around`` and the runs of starts with an ``earlier`` or any copy."""
    schema = "h long, around long, earlier array<struct<first:int,last:int>>, copied array<struct<first:int,last:int>>"
    arrow = arrow_schema(contexts.sparkSession, schema)
    dealt = contexts.select("h", "around", "id", "first", "before", "bytes").repartition(F.col("h")).sortWithinPartitions("h", "id", "first", "around")

    def run(batches):
        rows = ((h, a, b, c) for batch in batches for h, a, b, c in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True))
        out = []
        for h, bucket in groupby(rows, key=lambda r: r[0]):
            bucket = list(bucket)
            earlier, copied = repeated_starts([r[3] for r in bucket], [r[2] for r in bucket], length)
            for i in np.flatnonzero(copied.any(axis=1)).tolist():
                out.append({"h": h, "around": bucket[i][1], "earlier": _runs(earlier[i]), "copied": _runs(copied[i])})
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _by_digest(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: starts with equal digests of their strings are copies."""
    schema = f"h long, around long, id {contexts.schema['id'].dataType.simpleString()}, first int, start int, digest binary"
    arrow = arrow_schema(contexts.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in batch.select(["h", "around", "id", "first", "bytes"]).to_pylist():
                data = row.pop("bytes")
                yield pa.RecordBatch.from_pylist([row | {"start": i, "digest": hashlib.blake2b(data[i : i + length], digest_size=16).digest()} for i in range(len(data) - length + 1)], schema=arrow)

    starts = contexts.mapInArrow(run, schema)
    place = F.struct("id", (F.col("first") + F.col("start")).alias("place"))
    found = starts.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    mine = starts.join(found, "digest").withColumn("later", F.col("least") != place)
    one = F.struct(F.col("start").alias("first"), F.col("start").alias("last"))
    return mine.groupBy("h", "around").agg(F.collect_list(F.when(F.col("later"), one)).alias("earlier"), F.collect_list(one).alias("copied"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", gram: int | None = None, bucket_rows: int = 2000) -> DataFrame:
    """``id``, ``t`` (xxhash64 of the text) and ``cover``, the runs of starts (first, last) whose strings
    are to be removed, for every text that has some. ``gram`` is the size of anchors in bytes, by
    default a third of ``length`` and 128 at most."""
    gram = gram or max(1, min(128, length // 3))
    if keep not in ("none", "first"):
        raise ValueError(keep)
    rows = _rows(df, id_col, text_col)
    runs = written(_anchor_rows(rows.where(F.octet_length("text") >= length), length, gram), "anchors")
    place = F.struct("id", "first")
    least = F.min(F.struct("id", "first", "t", "at", "last")).alias("rep")
    classes = runs.groupBy("h", "around").agg(F.count("*").alias("n"), least)
    classes = written(classes, "classes")
    buckets = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = written(classes.join(buckets, "h").select("h", "around", "kinds", "rep.*"), "mixed")

    # One text for each representative, fetched by the texts' hashes, then cut.
    wanted = mixed.groupBy("id", "t").agg(F.collect_list(F.struct("h", "around", "kinds", "at", "first", "last")).alias("cuts"))
    texts = maybe_in(rows, "t", mixed.select("t")).where("maybe").drop("maybe").withColumnRenamed("id", "text_id").withColumnRenamed("t", "text_t")
    met = texts.join(wanted, F.col("text_id").eqNullSafe(F.col("id")) & (F.col("text_t") == F.col("t"))).select("id", "t", F.expr("encode(text, 'UTF-8')").alias("data"), F.explode("cuts").alias("c"))
    contexts = met.select("c.h", "c.around", "c.kinds", "id", "c.first", (F.col("c.at") - F.col("c.first")).alias("before"), F.expr(f"substring(data, c.first + 1, c.last - c.first + {length})").alias("bytes"))
    contexts = written(contexts.dropDuplicates(["h", "around"]), "contexts")
    small = _in_buckets(contexts.where(F.col("kinds") <= bucket_rows), length)
    large = _by_digest(contexts.where(F.col("kinds") > bucket_rows), length)
    factors = written(small.unionByName(large), "factors")

    part = "earlier" if keep == "first" else "copied"
    verdicts = classes.where("n > 1").select("h", "around", F.col("rep").alias("rep")).join(factors, ["h", "around"], "full").select("h", "around", F.struct(F.col("rep.id").alias("id"), F.col("rep.first").alias("first")).alias("least"), F.col("rep").isNotNull().alias("whole"), F.col(part).alias("some"))
    verdicts = written(verdicts, "verdicts")
    some = maybe_in(runs, "around", verdicts.select("around")).where("maybe").drop("maybe").join(verdicts, ["h", "around"])
    whole = F.col("whole") if keep == "none" else F.col("whole") & ~place.eqNullSafe(F.col("least"))
    all_of = F.array(F.struct(F.lit(0).alias("first"), (F.col("last") - F.col("first")).alias("last")))
    cover = F.explode(F.when(whole, all_of).otherwise(F.coalesce("some", F.expr("cast(array() AS array<struct<first:int,last:int>>)"))))
    covered = some.select("id", "t", F.col("first").alias("base"), cover.alias("c")).select("id", "t", F.struct((F.col("base") + F.col("c.first")).alias("first"), (F.col("base") + F.col("c.last")).alias("last")).alias("c"))
    return written(covered.groupBy("id", "t").agg(F.collect_set("c").alias("cover")), "cover")  # runs of one text


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", **settings) -> DataFrame:
    """One row per input row: ``id``, ``n_bytes``, ``n_removed``, the removed ``spans`` (begin, end) in
    bytes, and ``kept``, the remaining bytes joined."""
    found = repeats(df, id_col, text_col, length, keep, **settings)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                out = []
                for row in part.to_pylist():
                    data, kept, spans, end = row["text"].encode(), [], [], 0
                    for c in sorted((c["first"], c["last"] + length) for c in row["cover"] or ()):
                        if spans and c[0] <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], c[1])
                        else:
                            spans.append({"begin": c[0], "end": c[1]})
                    for s in spans:
                        kept.append(data[end : s["begin"]])
                        end = s["end"]
                    kept.append(data[end:])
                    out.append({"id": row["id"], "n_bytes": len(data), "n_removed": sum(s["end"] - s["begin"] for s in spans), "spans": spans, "kept": b"".join(kept)})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    marked = maybe_in(_rows(df, id_col, text_col), "t", found.select("t"))
    bytes_of = F.expr("encode(text, 'UTF-8')")
    no_spans = F.expr("cast(array() AS array<struct<begin:bigint,end:bigint>>)")
    plain = marked.where("NOT maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), no_spans.alias("spans"), bytes_of.alias("kept"))
    other = marked.where("maybe").select(F.col("id").alias("text_id"), F.col("t").alias("text_t"), "text")
    other = other.join(found, F.col("text_id").eqNullSafe(F.col("id")) & (F.col("text_t") == F.col("t")), "left").select(F.col("text_id").alias("id"), "text", "cover")
    return plain.unionByName(other.mapInArrow(run, schema))
