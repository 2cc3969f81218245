"""History from ``git log --name-status -M --no-merges --format=commit %H %ct``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_log(lines: DataFrame) -> DataFrame:
    """(commit_seq, sha, ts, status, old_path, path) of (log, line_no, text), newest first.

    A running window carries each commit line down to its files; logs are dealt by name."""
    order = Window.partitionBy("log").orderBy("line_no")
    head = F.regexp_extract("text", r"^commit ([0-9a-f]{7,40}) (\d+)$", 1)
    sha = F.last(F.when(head != "", head), ignorenulls=True).over(order)
    at = F.last(F.when(head != "", F.regexp_extract("text", r"^commit ([0-9a-f]{7,40}) (\d+)$", 2).try_cast("long")), ignorenulls=True).over(order)
    seq = F.sum((head != "").cast("long")).over(order)
    columns = F.split("text", "\t")
    rows = lines.select(
        "log", "line_no", seq.alias("commit_seq"), sha.alias("sha"), F.timestamp_seconds(at).alias("ts"), columns.alias("c")
    ).filter((F.size("c") >= 2) & F.col("c")[0].rlike("^[ACDMRTU][0-9]*$"))
    renamed = F.size("c") >= 3
    return rows.select(
        "commit_seq",
        "sha",
        "ts",
        F.substring(F.col("c")[0], 1, 1).alias("status"),
        F.when(renamed, F.get("c", F.lit(1))).alias("old_path"),
        F.when(renamed, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("path"),
    )


def recent(changes: DataFrame, most: int = 1000, years: float = 2.0, now=None) -> DataFrame:
    """The changes of the newest commits within so many years."""
    end = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    cut = F.timestamp_seconds(F.unix_timestamp(end) - F.lit(int(years * 365.25 * 86400)))
    return changes.filter((F.col("commit_seq") <= most) & (F.col("ts") >= cut))
