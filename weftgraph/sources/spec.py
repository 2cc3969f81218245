"""Change folders in Markdown: tasks, requirements and scenarios as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spec_items(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, name, within, done) of Markdown lines (path, line_no, text).

    Lines in fenced blocks do not count; a scenario belongs to the requirement above it."""
    order = Window.partitionBy("path").orderBy("line_no")
    fence = F.sum(F.col("text").rlike(r"^\s*(```|~~~)").cast("int")).over(order)
    own = lines.withColumn("open", fence % 2).filter("open = 0")
    requirement = F.regexp_extract("text", r"^#{2,4} Requirement: *(.*?)\s*$", 1)
    scenario = F.regexp_extract("text", r"^#{2,5} Scenario: *(.*?)\s*$", 1)
    task = F.regexp_extract("text", r"^\s*[-*] \[[ xX]\] *(.*?)\s*$", 1)
    kind = F.when(requirement != "", "requirement").when(scenario != "", "scenario").when(task != "", "task")
    above = F.last(F.when(requirement != "", requirement), ignorenulls=True).over(order)
    return (
        own.withColumn("kind", kind)
        .withColumn("within", F.when(F.col("kind") == "scenario", above))
        .filter("kind is not null")
        .select(
            "path",
            "line_no",
            "kind",
            F.when(requirement != "", requirement).when(scenario != "", scenario).otherwise(task).alias("name"),
            "within",
            F.when(F.col("kind") == "task", F.col("text").rlike(r"^\s*[-*] \[[xX]\]")).alias("done"),
        )
    )


def code_names(lines: DataFrame) -> DataFrame:
    """(path, line_no, name): names in backticks outside fenced blocks."""
    order = Window.partitionBy("path").orderBy("line_no")
    fence = F.sum(F.col("text").rlike(r"^\s*(```|~~~)").cast("int")).over(order)
    names = F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]*(?:\(\))?)`"), F.lit(1))
    return (
        lines.withColumn("open", fence % 2)
        .filter("open = 0")
        .select("path", "line_no", F.explode(names).alias("name"))
        .withColumn("name", F.regexp_replace("name", r"\(\)$", ""))
    )


_INVARIANT = re.compile(r"\b(always|never|every|any|all|no matter|for each|idempotent|round.?trip|invariant)\b", re.I)


def states_invariant(name: str, body: str = "") -> bool:
    """Does a scenario state something about every input?"""
    return bool(_INVARIANT.search(name) or _INVARIANT.search(body))
