"""Results from the output of test runners: one pass of line patterns per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (pattern, group of the name, group of the status), first that fits counts.
PATTERNS = (
    (r"^(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS) (\S+::\S.*?)(?: - .*)?$", 2, 1),
    (r"^(\S+::\S.*?) (PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b.*$", 1, 2),
    (r"^\s*--- (PASS|FAIL|SKIP): (\S+).*$", 2, 1),
    (r"^\s*(not ok|ok) \d+ (?:- )?([^#]*?)\s*(?:#.*)?$", 2, 1),
    (r"^\s*(✓|✕|○) (.*?)(?: \(\d+(?:\.\d+)? m?s\))?$", 2, 1),
    (r"^\s*(Passed|Failed|Skipped) (\S.*?)(?: \[.*\])?$", 2, 1),
    (r"^(PASS|FAIL|SKIP):? (\S.*)$", 2, 1),
)
_STATUS = {
    "pass": ("PASSED", "PASS", "ok", "✓", "Passed", "XPASS"),
    "fail": ("FAILED", "ERROR", "FAIL", "not ok", "✕", "Failed"),
    "skip": ("SKIPPED", "SKIP", "XFAIL", "○", "Skipped"),
}


def _status(word: Column, text: Column) -> Column:
    out = F.lit(None).cast("string")
    for status, words in _STATUS.items():
        out = F.when(word.isin(*words), status).otherwise(out)
    return F.when(text.rlike(r"(?i)# *(skip|todo)\b") & word.isin("ok", "not ok"), "skip").otherwise(out)


def parse_output(lines: DataFrame) -> DataFrame:
    """(run, name, status) of (run, line_no, text); the last mention of a name counts."""
    text = F.rtrim("text")
    name, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, n, s in reversed(PATTERNS):
        fits = text.rlike(pattern)
        name = F.when(fits, F.regexp_extract(text, pattern, n)).otherwise(name)
        status = F.when(fits, _status(F.regexp_extract(text, pattern, s), text)).otherwise(status)
    rows = lines.select("run", "line_no", name.alias("name"), status.alias("status")).filter("name is not null and status is not null")
    k = F.row_number().over(Window.partitionBy("run", "name").orderBy(F.desc("line_no")))
    return rows.withColumn("k", k).filter("k = 1").select("run", "name", "status")


def bound_to_tests(results: DataFrame, tests: DataFrame) -> DataFrame:
    """Results with test_id where exactly one test (id, name) has the result's last name
    part, parameters in brackets left out."""
    plain = lambda c: F.regexp_replace(c, r"\[.*\]$", "")
    short = F.element_at(F.split(plain(F.col("name")), r"::|\.|/|\s>\s"), -1)
    one = tests.groupBy(F.col("name").alias("_short")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("test_id")).filter("_n = 1")
    return results.withColumn("_short", short).join(one, "_short", "left").drop("_short", "_n")


def counterexamples(lines: DataFrame) -> DataFrame:
    """(run, line_no, example): failing examples that property testers print."""
    example = F.regexp_extract("text", r"^\s*(?:Falsifying example: |Counterexample: |Falsifiable, after \d+ tests?[^:]*: ?)(.*)$", 1)
    return lines.select("run", "line_no", example.alias("example")).filter("example <> ''")
