"""Measured coverage: lines to functions, summaries, and the tests a change needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, point: str, key: list[str], on: list[str] | None = None) -> DataFrame:
    """points with the span (first, last, owner) of greatest first that holds them; of
    several the shortest, then the greatest owner.

    With ``on`` the range join runs within equal keys (a file), as it should on large
    tables."""
    inside = F.col(point).between(F.col("first"), F.col("last"))
    hit = points.join(spans, on).filter(inside) if on else points.join(spans, inside)
    return hit.groupBy(*key).agg(F.max_by("owner", F.struct(F.col("first"), -F.col("last"), F.col("owner"))).alias("owner"))


def bucketed_innermost(points: DataFrame, spans: DataFrame, point: str, key: list[str], width: float) -> DataFrame:
    """As ``innermost`` where no key bounds the range join: spans are dealt to the buckets of
    ``width`` that they meet, points to their own, and the join is on the bucket."""
    dealt = spans.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    )
    own = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return (
        own.join(dealt, "_bucket")
        .filter(F.col(point).between(F.col("first"), F.col("last")))
        .groupBy(*key)
        .agg(F.max_by("owner", F.struct(F.col("first"), -F.col("last"), F.col("owner"))).alias("owner"))
    )


def on_test_paths(steps: DataFrame, flows: DataFrame) -> DataFrame:
    """(fn) on the flow of some test."""
    tests = flows.filter("kind = 'test'").select(F.col("id").alias("flow_id"))
    return steps.join(tests, "flow_id", "left_semi").select("fn").distinct()


def summary(functions: DataFrame, covered: DataFrame, steps: DataFrame, flows: DataFrame) -> DataFrame:
    """Per module: functions, those that ran, those on a test path, and where the two differ."""
    ran = covered.select(F.col("fn").alias("id"), F.lit(True).alias("r")).distinct()
    path = on_test_paths(steps, flows).select(F.col("fn").alias("id"), F.lit(True).alias("p"))
    r, p = F.col("r").isNotNull(), F.col("p").isNotNull()
    return (
        functions.join(ran, "id", "left")
        .join(path, "id", "left")
        .groupBy("module_id")
        .agg(
            F.count(F.lit(1)).alias("functions"),
            F.count_if(r).alias("ran"),
            F.count_if(p).alias("on_a_test_path"),
            F.count_if(p & ~r).alias("path_but_never_ran"),
            F.count_if(~p & r).alias("ran_off_every_path"),
        )
    )


def compare_flow(steps: DataFrame, covered: DataFrame, flow, test) -> DataFrame:
    """(fn, state): what a test's flow predicts against what the test ran."""
    a = steps.filter(F.col("flow_id") == flow).select("fn").distinct().withColumn("a", F.lit(1))
    b = covered.filter(F.col("test") == test).select("fn").distinct().withColumn("b", F.lit(1))
    return a.join(b, "fn", "full").select(
        "fn",
        F.when(F.col("b").isNull(), "predicted").when(F.col("a").isNull(), "ran").otherwise("both").alias("state"),
    )


def tests_for(covered: DataFrame, most: int = 50, functions: DataFrame | None = None) -> DataFrame:
    """(test, lines, functions): tests by the lines they ran, of some functions or of all."""
    own = covered if functions is None else covered.join(functions.select(F.col("id").alias("fn")), "fn", "left_semi")
    return (
        own.groupBy("test")
        .agg(F.sum("lines").cast("long").alias("lines"), F.countDistinct("fn").alias("functions"))
        .orderBy(F.desc("lines"), "test")
        .limit(most)
    )


def affected_tests(changed: DataFrame, covered: DataFrame, steps: DataFrame, flows: DataFrame) -> DataFrame:
    """(test, reason): tests that ran changed code, then tests whose flow passes changed
    code that no test ran. Rank 1 is measured, 2 from the map."""
    own = changed.select(F.col("id").alias("fn"))
    measured = covered.join(own, "fn", "left_semi").select("test", F.lit(1).cast("long").alias("rank"))
    blind = own.join(covered.select("fn"), "fn", "left_anti")
    tests = flows.filter("kind = 'test'").select(F.col("id").alias("flow_id"))
    mapped = (
        steps.join(blind, "fn", "left_semi")
        .join(tests, "flow_id", "left_semi")
        .select(F.col("flow_id").cast(covered.schema["test"].dataType).alias("test"), F.lit(2).cast("long").alias("rank"))
    )
    return measured.unionByName(mapped).groupBy("test").agg(F.min("rank").alias("rank"))


def mark_scenarios(scenarios: DataFrame, covered: DataFrame, changed: DataFrame, same_run: bool) -> DataFrame:
    """(scenario, ran): whether a passing scenario (scenario, test, passes) ran changed code.

    Null where it does not pass, or where its test left no record and the coverage may be
    of another run; false if it left none in the very run that passed it."""
    hit = covered.join(changed.select(F.col("id").alias("fn"), F.lit(True).alias("_hit")).distinct(), "fn", "left")
    by_test = hit.groupBy("test").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("hit"))
    none = F.lit(False) if same_run else F.lit(None).cast("boolean")
    return scenarios.join(by_test, "test", "left").select(
        "scenario", F.when(F.col("passes"), F.coalesce("hit", none)).alias("ran")
    )
