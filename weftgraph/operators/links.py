"""Links between nodes: call sites folded to pairs, all links, adjacency, fan-out guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import DATA_CHANNELS


def call_pairs(calls: DataFrame) -> DataFrame:
    """(src, dst, sites, first_line, guess): a pair is a guess only if every site is."""
    return calls.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("sites"),
        F.min("site_start").alias("first_line"),
        F.bool_and(F.col("precision_") == "guess").alias("guess"),
    )


def all_links(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(kind, src, dst): typed edges and calls, each pair of a kind once."""
    return edges.select("kind", "src", "dst").unionByName(calls.select(F.lit("calls").alias("kind"), "src", "dst")).distinct()


def reverse_adjacency(calls: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(at, to): from a node to those that a change of it reaches. Callers and senders
    come before, an overriding method is reached by callers of the base; data channels
    run from writer to reader."""
    out = calls.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    if edges is not None:
        channel = F.col("channel").isin(*DATA_CHANNELS)
        sent = edges.filter("kind = 'communicates'")
        out = (
            out.unionByName(sent.filter(~channel).select(F.col("dst").alias("at"), F.col("src").alias("to")))
            .unionByName(sent.filter(channel).select(F.col("src").alias("at"), F.col("dst").alias("to")))
            .unionByName(edges.filter("kind = 'overrides'").select(F.col("src").alias("at"), F.col("dst").alias("to")))
        )
    return out.filter("at <> to").distinct()


def fan_out_guard(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """The pairs whose key has at most so many of them. Keys are counted by partial
    aggregates, so that a key with very many pairs is gathered nowhere."""
    few = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select(key)
    return pairs.join(few, key, "left_semi")


def guarded_join(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
    """left joined with right on key, without the keys that would give more than ``most``
    pairs: these are told by the counts of either side, before the join expands them."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    few = a.join(b, key).filter(F.col("_a") * F.col("_b") <= most).select(key)
    return left.join(few, key, "left_semi").join(right, key)
