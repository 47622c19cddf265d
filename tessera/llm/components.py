"""Connected components of an edge table by alternating stars.

Large-star: every neighbour larger than a node moves to the node's smallest
neighbour; small-star: a node's smaller neighbours move to the smallest of them.
Both are one aggregation and one join; the join has plain shuffles on both sides
so adaptive execution splits a hot node.  Rounds repeat until no edge changes,
about log(n) times, after each partition has thinned its own edges to a forest;
every round is a written table, so nothing is recomputed.

At most ``SMALL`` edges (counted first, a few megabytes) are united in one task
instead, which gives the same rows with fewer rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle


SMALL = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


class _Union:
    """Sets of ids, each known by its smallest."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, u, v) -> bool:
        """Whether the edge connects two sets."""
        a, b = self.root(u), self.root(v)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _forest(edges: DataFrame) -> DataFrame:
    """Edges enough to connect what each partition's edges connect."""

    def run(batches):
        sets = _Union()
        for batch in batches:
            keep = [sets.join(u, v) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _united(edges: DataFrame) -> DataFrame:
    """(u, v): v the smallest id reachable from u, in one task."""

    def run(batches):
        sets, kind = _Union(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.join(u, v)
        out = [(x, r) for x in list(sets.parent) if (r := sets.root(x)) != x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out)], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def components(edges: DataFrame, label: str = "components", small: int = SMALL) -> DataFrame:
    """(u, v) edges between comparable ids -> (node, component), component the
    smallest id reachable.  Nodes that are smallest themselves are left out."""
    placed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = settle(_forest(placed).distinct(), label)
    if now.count() <= small:
        return _united(now).select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        now = settle(_small_star(_large_star(now)).distinct(), label)
        # stars only: every edge points at a root that has no smaller neighbour
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
