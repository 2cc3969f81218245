"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Of S shards over n rows, shard s gets n // S rows, and the first n % S shards one
more (law ``rows``).  Each source partition first permutes its rows.  How many of
them go to each shard is drawn from the multivariate hypergeometric distribution,
with row sums the partition sizes and column sums the shard sizes: exactly the
counts that a uniform permutation of all rows would give.  The first so many rows
go to shard 0, the next to shard 1 and so on, and each shard permutes what it got.

Random order comes from hashes of the seed and the row, so a task that runs again
gives the same rows.  The driver sees one count per partition and draws one number
per partition and shard; the matrix goes to the shared folder as a table.  Rows are
handled by DataFrame functions alone.

Null texts have no bytes.  Repeated rows are placed one by one.  An empty table
gives no rows.  ``sharded`` keeps extra columns whatever their names (its own are ``shard``
and ``slot``), and ``write_shards`` writes whole rows.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import shared_text, staged, table

#: The matrix is broadcast up to so many entries (8 bytes each), else joined by a shuffle.
BROADCAST_ENTRIES = 4_000_000


def log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log probability of x of n by saddle-point terms, without differences of large logarithms."""

    def rest(k: int) -> float:
        """log k! less Stirling's first terms."""
        if k < 16:
            return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
        k2 = float(k) * k
        return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * k2)) / k2) / k2) / k2) / k

    def deviance(k: float, mean: float) -> float:
        """k log(k / mean) + mean - k"""
        if abs(k - mean) >= 0.1 * (k + mean):
            return k * math.log(k / mean) + mean - k
        v = (k - mean) / (k + mean)
        total, term, j = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1

    if x == 0:
        return n * math.log1p(-p) if p < q else n * math.log(q)
    if x == n:
        return n * math.log1p(-q) if q < p else n * math.log(p)
    return (
        rest(n) - rest(x) - rest(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
        + 0.5 * (math.log(n / (2 * math.pi * x)) - math.log(n - x))
    )


def log_hypergeometric(k: int, good: int, bad: int, draws: int) -> float:
    n = good + bad
    p, q = draws / n, (n - draws) / n
    return log_binomial(k, good, p, q) + log_binomial(draws - k, bad, p, q) - log_binomial(draws, n, p, q)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good, for any size: rejection from a
    flat top with exponential tails around the mode, which bounds every log-concave law,
    so some five tries on average whatever the spread."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = log_hypergeometric(mode, good, bad, draws)
    p = math.exp(at_mode)
    w = 1 + p / 2
    while True:
        flat = rng.random() <= w / (1 + w)
        y = (rng.random() * w if flat else w + rng.expovariate(1)) / p
        k = mode + (1 if rng.random() < 0.5 else -1) * math.floor(y + 0.5)
        under = math.log(1 - rng.random()) + min(0.0, w - p * y)
        if low <= k <= high and under <= log_hypergeometric(k, good, bad, draws) - at_mode:
            return k


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each source partition the number of its rows for each shard."""
    rng = random.Random(seed)
    room = shard_sizes(sum(sizes), shards)
    matrix = []
    for size in sizes:
        rest, row = sum(room), []
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, size)
            row.append(k)
            size -= k
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def sharded(df: DataFrame, identity: list[str], shards: int = 16, seed: int = 42) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard); columns of df with
    these names are replaced, all others are kept.

    ``identity`` names columns that tell rows apart; rows equal in all of them are
    interchangeable.  A shard of n rows is permuted in sqrt(n) buckets of its second key,
    so that neither a bucket nor the list of buckets is large.
    """
    spark = df.sparkSession
    # The caller's columns travel in one struct, so no name of theirs meets one of ours.
    mine = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")))
    named = [F.col(f"`{c}`") for c in identity]
    local = staged(
        df.select(mine.alias("row"), F.xxhash64(F.lit(seed), *named).alias("key"), F.struct(*named).alias("id"))
        .sortWithinPartitions("key", "id")
        .withColumn("at", F.monotonically_increasing_id())
        .select(
            "row",
            "at",
            F.xxhash64(F.lit(seed + 1), F.col("at"), "id").bitwiseAND(2**63 - 1).alias("second"),
            F.shiftright("at", 33).alias("part"),
            F.col("at").bitwiseAND((1 << 33) - 1).alias("rank"),
        ),
        "sharding",
    )
    counts = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    lines = []
    for p, drawn in zip(parts, communication_matrix([counts[p] for p in parts], shards, seed), strict=True):
        lines.append(json.dumps({"part": p, "cut": list(itertools.accumulate(drawn[:-1]))}))
    plan = spark.read.schema("part bigint, cut array<bigint>").json(shared_text(spark, "matrix", lines))
    if len(parts) * shards <= BROADCAST_ENTRIES:
        plan = F.broadcast(plan)
    n_buckets = 1 + math.isqrt(sum(counts.values()) // shards)
    dealt = local.join(plan, "part").select(
        "row",
        "at",
        "second",
        F.expr("size(filter(cut, c -> c <= rank))").alias("shard"),
        F.least(F.floor(F.col("second") / 2.0**63 * n_buckets), F.lit(n_buckets - 1)).alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("second", "at")
    return (
        dealt.withColumn("in", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("in") - 1).cast("long").alias("slot"))
    )


def write_shards(df: DataFrame, identity: list[str], path: str, shards: int = 16, seed: int = 42) -> None:
    """Write all of df, texts and all, as Parquet: a folder per shard, whose files hold runs
    of slots in order, so that a large shard is no task's alone."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sharded(df, identity, shards, seed)
    dealt.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharded(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
