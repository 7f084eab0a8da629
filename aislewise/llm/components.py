"""Connected components by alternating large-star and small-star (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import written

#: A node with more than one in so many of all links has its minimum broadcast: there are fewer such nodes.
HUBS = 10_000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """``links`` (``u``, ``v``; about ``total`` rows) with ``m``, the least ``v`` of their ``u``. Minima are
    aggregated before the shuffle. Those of hubs are broadcast to where the hubs' links are, so that no task
    gets a hub's links; the other nodes have at most ``total / HUBS`` each."""
    found = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total < HUBS:
        return links.join(F.broadcast(found.drop("n")), "u")
    hub = F.col("n") * HUBS > total
    near = links.join(F.broadcast(found.where(hub).drop("n")), "u", "left")
    far = near.where("m IS NULL").drop("m").join(found.where(~hub).drop("n"), "u")
    return near.where("m IS NOT NULL").unionByName(far)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return found.where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` has columns ``u`` and ``v`` of one ordered type, no nulls. Returns ``node`` and
    ``component``, the least node reachable, for every node that some edge joins to a lesser one.

    Each round is written to the checkpoint folder. The rows never exceed twice the edges."""
    edges = written(edges.where("u <> v").distinct(), "edges")
    total, before = edges.count(), None
    for _ in range(max_rounds):
        # The large star's links are as many as the edges or fewer.
        edges = written(_small_star(_large_star(edges, total), total), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        total, before = state[0], state
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
