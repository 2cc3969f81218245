"""Links that a compiler names, as JSON lines: caller, line, name, target, kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "caller string, line int, name string, target string, kind string"


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The usable rows; lines that do not parse or name no caller or target are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("caller is not null and target is not null")


def apply_links(calls: DataFrame, compiler: DataFrame) -> DataFrame:
    """(src, line, name, dst, precision, state) of resolved calls beside a compiler's: what
    it confirms or adds is exact, what it contradicts goes."""
    from weftgraph.operators.review import confirmed_links

    named = compiler.select(F.col("caller").alias("src"), "line", "name", F.col("target").alias("dst"))
    key = ["src", "line", "name"]
    states = confirmed_links(calls.filter("dst is not null"), named, key).filter("state <> 'removed'")
    old = calls.select(*key, "dst", F.col("precision").alias("_p"))
    return states.join(old, [*key, "dst"], "left").select(
        *key, "dst", F.when(F.col("state") == "kept", F.col("_p")).otherwise("exact").alias("precision"), "state"
    )
