"""Statements about nodes: evidence hashes, staleness, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import first_per


def evidence_hash(evidence: DataFrame, key: str, node: str, content: str) -> DataFrame:
    """(key, h): sha1 over the sorted distinct node:hash entries of each key."""
    entry = F.concat(F.col(node).cast("string"), F.lit(":"), F.col(content).cast("string"))
    return evidence.groupBy(key).agg(F.sha1(F.array_join(F.array_sort(F.collect_set(entry)), "|").cast("binary")).alias("h"))


def refresh_stale(annotations: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(node_id, key, stale): the node is gone, or there is evidence and its hash changed.

    annotations: node_id, key, evidence_hash (null without evidence); hashes: node_id, h."""
    return (
        annotations.join(nodes.select(F.col("id").alias("node_id")).distinct().withColumn("_there", F.lit(True)), "node_id", "left")
        .join(hashes, "node_id", "left")
        .select(
            "node_id",
            "key",
            (
                F.col("_there").isNull()
                | (F.col("evidence_hash").isNotNull() & ~F.col("evidence_hash").eqNullSafe(F.col("h")))
            ).alias("stale"),
        )
    )


def refused(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inferred statements without evidence, or with evidence that is no known node."""
    inferred = annotations.filter("layer = 'inferred'")
    bare = inferred.filter(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select("node_id", "key")
    unknown = (
        inferred.select("node_id", "key", F.explode("evidence").alias("id"))
        .join(nodes.select("id"), "id", "left_anti")
        .select("node_id", "key")
    )
    return bare.unionByName(unknown).distinct()


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several new rows with
    the same keys the greatest in ``order`` counts, without an order any one."""
    one = first_per(new, keys, [F.desc(order)]).drop("_rank") if order else new.dropDuplicates(keys)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one.select(*old.columns))


def notes(annotations: DataFrame) -> DataFrame:
    """(node_id, key, value): intent before inferred, what is stale left out."""
    rank = F.when(F.col("layer") == "intent", 0).otherwise(1)
    own = annotations.filter("layer = 'intent' or not stale")
    k = F.row_number().over(Window.partitionBy("node_id", "key").orderBy(rank, F.desc("confidence"), "value"))
    return own.withColumn("k", k).filter("k = 1").select("node_id", "key", "value")
