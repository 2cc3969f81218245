"""Engine assets: scene files that name scripts, scenes and signal handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def godot_scenes(lines: DataFrame) -> DataFrame:
    """(path, what, target, owner) of scene lines (path, line_no, text): scripts and scenes
    used, and methods that signals call. A running window holds the current node."""
    order = Window.partitionBy("path").orderBy("line_no")
    take = lambda p: F.regexp_extract("text", p, 1)
    node = F.last(F.when(F.col("text").rlike(r"^\[node "), take(r'name="([^"]*)"')), ignorenulls=True).over(order)
    res = F.when(F.col("text").rlike(r"^\[ext_resource "), take(r'path="res://([^"]*)"'))
    signal = F.when(F.col("text").rlike(r"^\[connection "), take(r'method="([^"]*)"'))
    what = (
        F.when(res.isNotNull() & F.col("text").contains('type="Script"'), "script")
        .when(res.isNotNull() & F.col("text").contains('type="PackedScene"'), "scene")
        .when(res.isNotNull(), "resource")
        .when(signal.isNotNull(), "signal")
    )
    to = F.regexp_extract("text", r' to="([^"]*)"', 1)
    return lines.select(
        "path", what.alias("what"), F.coalesce(res, signal).alias("target"), F.when(signal.isNotNull(), to).otherwise(node).alias("owner")
    ).filter("what is not null")


def unity_guids(lines: DataFrame) -> DataFrame:
    """(path, guid) of .meta lines: the asset that each describes."""
    return lines.filter(F.endswith("path", F.lit(".meta")) & F.col("text").rlike("^guid: [0-9a-f]{32}")).select(
        F.regexp_replace("path", r"\.meta$", "").alias("path"), F.regexp_extract("text", r"^guid: ([0-9a-f]{32})", 1).alias("guid")
    )


def unity_uses(lines: DataFrame) -> DataFrame:
    """(path, guid) that asset lines refer to."""
    found = F.regexp_extract_all("text", F.lit(r"guid: ([0-9a-f]{32})"), F.lit(1))
    return lines.filter(~F.endswith("path", F.lit(".meta"))).select("path", F.explode(found).alias("guid")).distinct()


def asset_links(uses: DataFrame, guids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) by GUID, and (guid, n) of those that nothing has."""
    links = uses.join(guids.withColumnRenamed("path", "dst"), "guid").select(F.col("path").alias("src"), "dst").filter("src <> dst").distinct()
    missing = uses.join(guids, "guid", "left_anti").groupBy("guid").agg(F.count(F.lit(1)).alias("n"))
    return links, missing
