"""Near duplicates by MinHash: many universal hash minima, banding, verification, star components.

1. Each text becomes the set of its word shingles, and the set a signature of ``bands * rows`` minima
   under hash functions ``(a*x + b) mod 2**64``. Equal sets have equal fingerprints: one class each.
2. Classes whose minima agree in all rows of a band share a bucket. A pair at the threshold misses all
   buckets with probability ``(1 - s**rows)**bands``: 5e-11 at 0.85 and 5e-8 at 0.8 by default.
3. Classes that share a bucket, directly or over others, form a candidate group (components by
   alternating large-star and small-star over one edge to the least class of each bucket); all links
   are inside groups. A group of up to ``group_rows`` classes and ``group_items`` shingles is linked
   in one task: from a class, those not yet reached are tested, by the agreement of signatures
   first and by the full sets then; those linked are reached, and tested from in turn. Only the
   links that reach a class are given out, fewer than classes.
   A larger group is linked by rounds over all machines: a few pivots of each bucket are compared
   with the bucket's other members, unless both are in one component already; then the pivots leave
   the bucket, and a bucket whose members are all in one component is done. So no member is capped
   and no link between components is skipped.
4. Links become components by alternating large-star and small-star.

Copies are never paired: they share a class. Nothing of the documents goes to the driver but counts.

Defined cases: null or empty texts have an empty set, are linked with nothing and are their own
component; very long texts are hashed in stretches of a megabyte; rows with null ids link like all others, but a null id names no component and is not
``kept``; repeated rows are copies: they share a component, and a repeated id is ``kept`` in each of its
rows if it names the component; empty input gives no rows; extra columns are ignored. ``keep_one``
decides by id and text, and keeps one row of each component whatever its ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import arrow_schema, columns_of, maybe_in, slices, written
from aislewise.llm.components import connected_components
from aislewise.llm.shingles import U64, shingle_sets

#: How far the signatures' agreement may lie below the threshold: over six standard deviations.
SLACK = 0.2


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 64, n, dtype=U64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The minima's upper halves, as 32-bit integers."""
    least = np.full(len(a), ~U64(0), U64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048]
        np.minimum(least, (a[:, None] * x + b[:, None]).min(axis=1), out=least)
    return (least >> U64(32)).astype("<u4").tobytes()


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def _row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text: rows that share it are repeated rows."""
    return F.expr(f"unhex(md5(concat(md5(coalesce(`{text_col}`, '')), if(`{id_col}` IS NULL, '', concat('=', cast(`{id_col}` AS string))))))")


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, n_hashes: int) -> DataFrame:
    """``id``, ``row_key``, ``n_shingles``, ``fp`` (null for an empty set) and ``sig`` of each row."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, row_key binary, n_shingles long, fp binary, sig binary"
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_functions(n_hashes)
        for batch in batches:
            for part in slices(batch, 128):
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()], shingle)
                yield pa.RecordBatch.from_pydict({"id": part.column(0).to_pylist(), "row_key": part.column(2).to_pylist(), "n_shingles": [len(s) for s in sets], "fp": [_fingerprint(s) if len(s) else None for s in sets], "sig": [signature(s, a, b) if len(s) else None for s in sets]}, schema=arrow)

    return columns_of(df, id_col, text_col).withColumn("row_key", _row_key("id", "c0")).mapInArrow(run, schema)


def candidate_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``fp`` and ``items`` (the shingle hashes) of the classes in ``wanted`` (``fp``, ``rep``: an id
    that has it, or null). Texts are read again, and only those whose id is null or passes a bit map of
    the wanted ids are hashed; so no text is shuffled. Of classes without an id the sets are found by
    their fingerprints, one of each task."""
    kind = df.schema[id_col].dataType.simpleString()
    arrow = arrow_schema(df.sparkSession, f"id {kind}, fp binary, items binary")
    texts = maybe_in(columns_of(df, id_col, text_col), "id", wanted.select("rep")).where("maybe OR id IS NULL").select("id", "c0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()], shingle)
                yield pa.RecordBatch.from_pydict({"id": part.column(0).to_pylist(), "fp": [_fingerprint(s) for s in sets], "items": [s.tobytes() for s in sets]}, schema=arrow)

    made = texts.mapInArrow(run, f"id {kind}, fp binary, items binary")
    exact = made.join(wanted.withColumnRenamed("fp", "w_fp"), (made["fp"] == F.col("w_fp")) & (made["id"] == F.col("rep"))).select("fp", "items")
    nameless = wanted.where("rep IS NULL").select("fp")
    loose = maybe_in(made.where("id IS NULL"), "fp", nameless).where("maybe").groupBy("fp").agg(F.first("items").alias("items"))
    return exact.dropDuplicates(["fp"]).unionByName(loose.join(nameless, "fp", "left_semi"))  # of repeated rows one


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: float, n_hashes: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``least`` of all places."""
    arrow = arrow_schema(pairs.sparkSession, "pivot binary, node binary")
    both = pairs.join(sigs.select(F.col("fp").alias("node"), F.col("sig").alias("s1")), "node").join(sigs.select(F.col("fp").alias("pivot"), F.col("sig").alias("s2")), "pivot").select("pivot", "node", "s1", "s2")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, n_hashes) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array((x == y).mean(axis=1) >= least)) for c in batch.columns[:2]], schema=arrow)

    return both.mapInArrow(run, "pivot binary, node binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` of their full sets."""
    arrow = arrow_schema(pairs.sparkSession, "u binary, v binary")
    both = pairs.join(sets.select(F.col("fp").alias("node"), F.col("items").alias("s1")), "node").join(sets.select(F.col("fp").alias("pivot"), F.col("items").alias("s2")), "pivot").select("pivot", "node", "s1", "s2")

    def run(batches):
        for batch in batches:
            keep = []
            for s1, s2 in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (s1, s2))
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=arrow)

    return both.mapInArrow(run, "u binary, v binary")


def reach(sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the members of a group that are connected: a spanning forest of the graph whose
    edges are all pairs at the threshold."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    least = percent / 100 - SLACK
    left, found = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = left[(sigs[left] == sigs[i]).mean(axis=1) >= least]
            if not len(near):
                continue
            items = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], items), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == items).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            new = near[100 * both >= percent * (sizes[i] + sizes[near] - both)]
            found += [(i, j) for j in new.tolist()]
            queue += new.tolist()
            left = np.setdiff1d(left, new, assume_unique=True)
    return found


def _links_in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``u``, ``v`` within groups: rows of ``component``, ``fp``, ``sig``, ``items``."""
    arrow = arrow_schema(rows.sparkSession, "u binary, v binary")
    dealt = rows.select("component", "fp", "sig", "items").repartition(F.col("component")).sortWithinPartitions("component", "fp")

    def run(batches):
        members = ((c, fp, sig, items) for batch in batches for c, fp, sig, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for _, group in groupby(members, key=lambda r: r[0]):
            group = list(group)
            sigs = np.frombuffer(b"".join(r[2] for r in group), "<u4").reshape(len(group), -1)
            found = reach(sigs, [np.frombuffer(r[3], "<u8") for r in group], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([group[i][1] for i, _ in found], pa.binary()), pa.array([group[j][1] for _, j in found], pa.binary())], schema=arrow)

    return dealt.mapInArrow(run, "u binary, v binary")


def _links_by_pivots(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, n_hashes: int) -> DataFrame | None:
    """Links among ``members`` (``bucket``, ``node``) of any size, in rounds of pivots."""
    labels, edges, pivots_of = None, None, 1
    while True:
        now = members.withColumn("comp", F.col("node")) if labels is None else members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        now = written(now.join(mixed, "bucket"), "members")
        if now.isEmpty():
            return edges
        ranked = now.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("node"))).where(F.col("rank") <= pivots_of)
        pivots = written(ranked.select("bucket", F.col("node").alias("pivot"), F.col("comp").alias("p_comp")), "pivots")
        pairs = now.join(pivots, "bucket").where("comp <> p_comp").select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
        found = _linked(_agreeing(pairs, sigs, percent / 100 - SLACK, n_hashes), sets, percent)
        edges = written(found if edges is None else found.unionByName(edges), "links")
        labels = connected_components(edges)
        members = now.join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti").select("bucket", "node")
        pivots_of *= 4


def _classes(df: DataFrame, id_col: str, text_col: str, percent: int, shingle: int = 5, bands: int = 32, rows: int = 4, group_rows: int = 5000, group_items: int = 8_000_000) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and ``fp``, ``component`` and ``component_id`` of all classes that are not a
    component of one row by themselves."""
    n_hashes = bands * rows
    base = written(sketches(df, id_col, text_col, shingle, n_hashes), "sketches")
    full = base.where("fp IS NOT NULL")
    classes = full.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = written(classes, "classes")
    banded = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "sig")
    banded = banded.select(F.expr(f"xxhash64(band, substring(sig, {4 * rows} * band + 1, {4 * rows}))").alias("bucket"), F.col("fp").alias("node"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("bucket", "v")
    groups = connected_components(banded.join(shared, "bucket").select(F.col("node").alias("u"), "v").where("u <> v").distinct())
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    groups = written(groups.withColumnRenamed("node", "fp").join(classes, "fp").select("component", "fp", "rep", "n", "sig"), "groups")
    sizes = groups.groupBy("component").agg((F.count("*") > group_rows).alias("long"), (F.sum("n") > group_items).alias("wide")).where("long OR wide").select("component")
    sets = written(candidate_sets(df, id_col, text_col, shingle, groups.select("fp", "rep")), "sets")

    large = written(groups.join(sizes, "component", "left_semi"), "large-groups")
    small = groups.join(large.select("component").distinct(), "component", "left_anti").join(sets, "fp")
    edges = written(_links_in_groups(small, percent), "links")
    if not large.isEmpty():
        nodes = large.select(F.col("fp").alias("node"))
        more = _links_by_pivots(banded.join(nodes, "node", "left_semi"), large, sets, percent, n_hashes)
        edges = edges if more is None else edges.unionByName(more)
    labels = connected_components(edges)

    known = classes.select("fp", "rep", "copies").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    return base, known.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **settings) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (the least id of all rows that
    links lead to) and ``kept`` (it is the row's own id). Rows link if their shingle sets' similarity
    is ``percent`` or more of 100. ``settings`` are those of ``_classes``."""
    base, moved = _classes(df, id_col, text_col, percent, **settings)
    out = base.join(moved.drop("component"), "fp", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **settings) -> DataFrame:
    """One row of each component, that of the least id (null ids come last), and all rows with an empty
    set; all columns. Rows are told apart by id and text; of repeated rows any one stays. Only rows
    that a bit map of the keys finds are shuffled."""
    base, moved = _classes(df, id_col, text_col, percent, **settings)
    rows = written(base.join(moved.select("fp", "component"), "fp").groupBy("component", "row_key").agg(F.min("id").alias("id"), F.count("*").alias("n")), "rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("best")).select(F.col("best.row_key").alias("row_key"), F.lit(True).alias("stays"))
    marks = rows.join(best, "row_key", "left").where("stays IS NULL OR n > 1")
    marks = written(marks.select(F.col("row_key").alias("mark_key"), F.coalesce("stays", F.lit(False)).alias("stays")), "dropped")
    names = df.columns
    inner = [f"in_{i}" for i in range(len(names))]
    renamed = df.toDF(*inner)
    renamed = renamed.withColumn("row_key", _row_key(inner[names.index(id_col)], inner[names.index(text_col)]))
    found = maybe_in(renamed, "row_key", marks.select("mark_key"))
    risky = found.where("maybe").join(marks, F.col("row_key") == F.col("mark_key"), "left")
    repeated = risky.where("stays").groupBy("row_key").agg(F.first(F.struct(*inner)).alias("row")).select("row.*")
    parts = found.where("NOT maybe").select(*inner).unionByName(risky.where("stays IS NULL").select(*inner))
    return parts.unionByName(repeated).toDF(*names)
