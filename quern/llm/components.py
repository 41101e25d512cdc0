"""Connected components of a table of links, without collecting any of it.

Each partition first contracts its own links with a union-find forest; what is
left goes through alternating large-star and small-star steps, each a grouped
minimum and a join, until nothing changes. Every step ends in a table in the
shared folder, so that no lineage grows and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


class Forest:
    """Union-find with path halving; the least member is a set's root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


_SPILL = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(forest: Forest) -> pa.RecordBatch:
        pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(u, v)
        if len(forest.parent) > _SPILL:  # bounded memory: the stars so far are links as well
            yield stars(forest)
            forest = Forest()
    yield stars(forest)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node and component (least node) of all nodes of ``links`` (u, v) but the roots.

    Loops and repeated links do no harm; no links give no rows.
    """
    links = links.where("u <> v").select("u", "v")
    now = materialize(links.mapInArrow(_contract, "u long, v long").distinct(), label)
    seen = _mark(now)
    while seen[0]:
        after = materialize(_small_star(_large_star(now)), label)
        found = _mark(after)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
