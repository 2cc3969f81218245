"""Communities of units inside modules, their quality, and outlines of large modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.traverse import label_rounds
from weftgraph.schema import CLUSTER_MODULARITY, CLUSTER_UNITS, OUTLINE_PARTS


def unit_graph(calls: DataFrame, functions: DataFrame, unit: str = "type_id") -> DataFrame:
    """(a, b, w), a < b: weights between units, a call site counting 1."""
    f = functions.select("id", F.col(unit).alias("u"))
    pairs = calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    return (
        pairs.join(f.select(F.col("id").alias("src"), F.col("u").alias("a")), "src")
        .join(f.select(F.col("id").alias("dst"), F.col("u").alias("b")), "dst")
        .filter("a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.sum("w").cast("double").alias("w"))
    )


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of labels (id, label) over undirected edges (a, b, w)."""
    marked = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"
    )
    ends = marked.select(F.col("la").alias("label"), "w").unionByName(marked.select(F.col("lb").alias("label"), "w"))
    degree = ends.groupBy("label").agg(F.sum("w").alias("d"))
    inside = marked.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("i"))
    m = F.sum("d") / 2
    return (
        degree.join(inside, "label", "left")
        .agg(m.alias("m"), F.sum(F.coalesce("i", F.lit(0.0))).alias("i"), F.sum(F.col("d") * F.col("d")).alias("d2"))
        .select((F.col("i") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
    )


def communities(edges: DataFrame, units: DataFrame, rounds: int = 5, least: int = CLUSTER_UNITS, floor: float = CLUSTER_MODULARITY) -> DataFrame:
    """(id, module_id, label) of units (id, module_id) in modules of at least ``least`` units
    whose labelling reaches the modularity floor; groups of one are dropped."""
    own = edges.join(units.select(F.col("id").alias("a"), F.col("module_id").alias("ma")), "a").join(
        units.select(F.col("id").alias("b"), F.col("module_id").alias("mb")), "b"
    ).filter("ma = mb")
    labels = label_rounds(own.select("a", "b", "w"), rounds).join(units, "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("module_id"))
    group = F.count(F.lit(1)).over(Window.partitionBy("module_id", "label"))
    kept = labels.withColumn("_n", size).filter(F.col("_n") >= least)
    quality = _by_module(own, kept)
    return (
        kept.join(quality.filter(F.col("q") >= floor).select("module_id"), "module_id", "left_semi")
        .withColumn("_g", group)
        .filter("_g > 1")
        .select("id", "module_id", "label")
    )


def _by_module(edges: DataFrame, labels: DataFrame) -> DataFrame:
    marked = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"
    )
    ends = marked.select(F.col("ma").alias("module_id"), F.col("la").alias("label"), "w").unionByName(
        marked.select(F.col("ma").alias("module_id"), F.col("lb").alias("label"), "w")
    )
    degree = ends.groupBy("module_id", "label").agg(F.sum("w").alias("d")).groupBy("module_id").agg(
        (F.sum("d") / 2).alias("m"), F.sum(F.col("d") * F.col("d")).alias("d2")
    )
    inside = marked.groupBy(F.col("ma").alias("module_id")).agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("i"))
    q = F.col("i") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m"))
    return degree.join(inside, "module_id").select("module_id", q.alias("q"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, cohesion): links inside a group over links that touch it."""
    marked = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"
    )
    rows = marked.select(F.col("la").alias("label"), "w", (F.col("la") == F.col("lb")).alias("inside")).unionByName(
        marked.filter("la <> lb").select(F.col("lb").alias("label"), "w", F.lit(False).alias("inside"))
    )
    total = rows.groupBy("label").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)).alias("i"))
    return total.select("label", F.bround(F.col("i") / F.col("t"), 3).alias("cohesion"))


def outline(functions: DataFrame, most: int = OUTLINE_PARTS, part: str = "type_id") -> DataFrame:
    """(module_id, part, members): the largest parts of each module, the rest as one."""
    size = functions.groupBy("module_id", F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("members"))
    rank = F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("members"), "part"))
    named = size.withColumn("k", rank).withColumn("part", F.when(F.col("k") <= most - 1, F.col("part")).otherwise(F.lit("(rest)")))
    return named.groupBy("module_id", "part").agg(F.sum("members").cast("long").alias("members"))
