"""Connected components of a link table, distributed.

Each input partition first contracts its links to a forest (a union-find over one partition's rows), then large-star
and small-star steps alternate until every node hangs on the least node of its component. All steps are joins and
minima over link tables in the cluster; the driver sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.session import saved, ship


class Forest:
    """Union-find with the least member as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        if len(forest.up) > 1_000_000:  # bounded memory: hand on what there is
            yield _stars(forest)
            forest = Forest()
    yield _stars(forest)


def _stars(forest: Forest) -> pa.RecordBatch:
    nodes = list(forest.up)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: two long columns. Returns node, root for every linked node; root: the least node of its component. Raises if
    the stars still change after most_rounds rounds."""
    ship(links.sparkSession)
    stars = saved(links.toDF("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct())  # a > b
    state = lambda: tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
    before = state()
    for _ in range(most_rounds if before[0] else 1):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        stars = saved(small)
        if (after := state()) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named_roots(rooted: DataFrame, value: str, shares: int = 16) -> DataFrame:
    """rooted (key, root, value): key, component, the least value of its root. A root's keys are dealt over shares, so that
    those of a large component meet in no single task; least values, one for each share, are not broadcast."""
    least = rooted.groupBy("root").agg(F.min(value).alias("component"))
    dealt = least.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return rooted.select("key", "root", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share")).join(dealt.hint("merge"), ["root", "share"]).select("key", "component")
