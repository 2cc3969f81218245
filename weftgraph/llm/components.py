"""Connected components over an edge table of any size.

Alternates the large-star and small-star steps: each node points its larger
neighbours, then its smaller ones, to the least node it knows, until nothing
changes; every component is then a star around its least node.  Minima are partial
aggregates and the joins are on freshly dealt tables, so a node with very many
neighbours is split by adaptive execution.  First each partition replaces its own
edges by a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import lean, staged


def least_labels(a: Iterable[int], b: Iterable[int]) -> dict[int, int]:
    """Each node of the edges with the least node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(hi, lo): a forest with the components of the edges (a, b) of each partition."""

    def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) > 1_000_000:  # keep to what the forest needs
                labels = least_labels(a, b)
                a, b = list(labels), list(labels.values())
        pairs = [(x, y) for x, y in least_labels(a, b).items() if x != y]
        for i in range(0, len(pairs), 100_000):
            hi, lo = zip(*pairs[i : i + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(contract), "hi long, lo long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the
    least node.  ``edges`` has columns a and b, in any direction, repeats allowed."""
    stars = staged(spanning_forest(edges.filter("a <> b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    seen, now = None, mark(stars)
    while now != seen and now[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = staged(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star"
        )
        lowest = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        rest = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = staged(rest.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        seen, now = now, mark(stars)
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
