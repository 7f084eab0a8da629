"""Merkle manifest of a table: digests of rows, a tree per source, a root over sources, and proofs.

H is the lowercase hex SHA-256 of its inputs, concatenated as text. A row's leaf is H of its fields.
Leaves of one source ascend by id; while several nodes remain, every three consecutive ones (the last
run may have fewer, even one) become their H. What remains is the source's ``subroot``; subroots in
order of their sources become the ``root`` in the same way.

Method, a rollup of nested structs. A node's rank within its group, written in base 3, says where it
stands at every level. The columns of digits are grouped away one after the other, least first, within
blocks of ``3**digits`` consecutive nodes: each ``groupBy`` collects at most three structs under their
parent's, so a block ends as one row that nests all its levels. All those aggregates share one shuffle,
by group and block. The blocks' digests are the nodes of the next round, until one is left. On the way
back ``transform`` and ``explode`` unnest the blocks, each node handing its path (what stands to its left
and right at every level) to its children; a block meets the path of its own root by a union and a
``groupBy`` on the same key, so nothing is joined to leaves.

Ranks: nodes are range-partitioned and sorted by group and id, so a hot source spreads over many
tasks; counts of each partition and group (at most partitions plus groups rows) give the offsets. No
task holds more than a block of a group, and texts are hashed in the scan: only digests are shuffled.

Defined cases: a null field counts as ``-``; a null source is a source, the first; a null id is the first
of its source and is never tampered with in the query; rows with one id are ordered by leaf, and
repeated rows are leaves of their own; empty texts have length 0; very long texts are hashed in place;
empty input gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.llm.common import written

#: Levels of a block: 3**6 = 729 nodes.
DIGITS = 6
_PATH = "array<struct<l:string,r:string>>"


def field(column: Column) -> Column:
    """A value as a leaf has it: its length in bytes, a colon and itself; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (``grp``, never null, and others) with ``rank`` within ``grp`` by ``order`` and ``n``, the
    group's size. The last key parts equal rows, so that no number of them needs one task."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "tie"]
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(at, 33)")), "sorted")
    parts = rows.groupBy("part", "grp").agg(F.min("at").alias("begin"), F.count("*").alias("size"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", "grp", "begin", before.alias("before"), F.sum("size").over(whole).alias("n"))
    return rows.join(parts, ["part", "grp"]).withColumn("rank", F.expr("at - begin + before")).drop("part", "at", "begin", "before")


def _roll(nodes: DataFrame, keep: list[str], digits: int) -> DataFrame:
    """``grp``, ``n``, ``block``, ``kids`` (nested) and ``h`` of each block of ``nodes`` (``grp``, ``n``,
    ``rank``, ``h`` and ``keep``). Where a group has one node left, it passes unchanged."""
    place = [f"cast(rank div {3**j} % 3 AS int) AS d{j}" for j in range(digits)]
    rows = nodes.selectExpr("grp", "n", f"rank div {3**digits} AS block", *place, "h", *[f"`{c}`" for c in keep])
    rows, held = rows.repartition("grp", "block"), ["h", *keep]
    for j in range(digits):
        above = [f"d{i}" for i in range(digits - 1, j, -1)]
        rows = rows.groupBy("grp", "n", "block", *above).agg(F.array_sort(F.collect_list(F.struct(f"d{j}", *held))).alias("kids"))
        rows = rows.withColumn("h", F.expr(f"if(n > {3**j}, sha2(array_join(kids.h, ''), 256), kids[0].h)"))
        held = ["h", "kids"]
    return rows


def climb(nodes: DataFrame, keep: list[str], digits: int = DIGITS) -> list[DataFrame]:
    """The blocks of each round, written, the nodes' own first. The last has one block a group."""
    rounds = []
    while True:
        rounds.append(written(_roll(nodes, keep if not rounds else [], digits), "blocks"))
        if not rounds[-1].agg(F.max("block")).first()[0]:
            return rounds
        nodes = rounds[-1].selectExpr("grp", f"(n + {3**digits - 1}) div {3**digits} AS n", "block AS rank", "h")


def descend(rounds: list[DataFrame], above: DataFrame | None, keep: list[str], digits: int = DIGITS) -> DataFrame:
    """``grp``, ``h``, ``keep``, ``path`` (from the node up), ``top`` (the group's last digest) and ``root``
    of every node. ``above`` gives each group's ``path`` and ``root`` beyond its top; without it the
    only group's top is the root."""
    last = rounds[-1].withColumn("top", F.col("h"))
    if above is None:
        rows = last.withColumn("path", F.expr(f"cast(array() AS {_PATH})")).withColumn("root", F.col("h"))
    else:
        rows = _met(last, above.withColumn("block", F.lit(0).cast("long")))
    rows = _unnested(rows, [] if len(rounds) > 1 else keep, digits)
    for i in range(len(rounds) - 2, -1, -1):
        ups = rows.selectExpr("grp", "rank AS block", "path", "root", "top")
        rows = _unnested(_met(rounds[i], ups), keep if i == 0 else [], digits)
    return rows


def _met(blocks: DataFrame, ups: DataFrame) -> DataFrame:
    """Each block beside the row of ``ups`` that has its group and number."""
    both = blocks.unionByName(ups, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("grp", "block")]
    return both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])


def _unnested(rows: DataFrame, keep: list[str], digits: int) -> DataFrame:
    """The nodes of blocks, each with its rank and path."""
    rows = rows.selectExpr("grp", "n", "block AS rank", "kids", "path", "root", "top")
    for j in range(digits - 1, -1, -1):
        held = ["k.h", *[f"k.`{c}`" for c in keep]] if j == 0 else ["k.kids"]
        beside = "transform(kids, (k, i) -> struct(k, array_join(slice(kids, 1, i).h, '') AS l, array_join(slice(kids, i + 2, 3).h, '') AS r))"
        rows = rows.select("grp", "n", "rank", "path", "root", "top", F.expr(f"inline({beside})"))
        path = f"if(n > {3**j}, concat(array(named_struct('l', l, 'r', r)), path), path) AS path"
        rows = rows.selectExpr("grp", "n", f"rank * 3 + k.d{j} AS rank", *held, path, "root", "top")
    return rows


def manifest(df: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", changed: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """One row per input row: ``id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings to the left and
    right, from the leaf's level up) and ``seen``: the digest ``changed`` gives, to be verified against
    the manifest (by default the leaf itself)."""
    made = leaf([df[c] for c in fields])
    # A null source is '', any other begins with '=': so null comes first and is a group like others.
    rows = df.select(F.coalesce(F.concat(F.lit("="), df[source_col].cast("string")), F.lit("")).alias("grp"), df[id_col].alias("id"), made.alias("h"), (made if changed is None else changed).alias("seen"))
    blocks = climb(_ranked(rows, ["id", "h"]), ["id", "seen"], digits)
    sources = blocks[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h")
    over = descend(climb(_ranked(sources, ["name"]), ["name"], digits), None, ["name"], digits)
    out = descend(blocks, over.selectExpr("name AS grp", "path", "root"), ["id", "seen"], digits)
    return out.selectExpr("id", "h AS leaf", "top AS subroot", "root", "path", "seen")


def proof_text(path: str = "path") -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.expr(f"array_join(transform({path}, p -> concat(p.l, p.r)), '')")


def folded(digest: str = "seen", path: str = "path") -> Column:
    """The root that a digest and the siblings of its path give."""
    return F.expr(f"aggregate({path}, {digest}, (h, p) -> sha2(concat(p.l, h, p.r), 256))")
