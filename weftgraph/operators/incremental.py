"""Keeping results up to date: what changed, what must be made anew, and merging it in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of manifests (path, hash): added, removed, edited."""
    from weftgraph.operators.change import diff

    return diff(manifest, now, ["path"], ["hash"])


def mentions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, token): crc32 of every identifier that a file mentions, each once."""
    names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return files.select(path, F.explode(names).alias("w")).select(path, F.crc32(F.col("w").cast("binary")).alias("token"))


def to_resolve(changed: DataFrame, names: DataFrame, mentioned: DataFrame, imports: DataFrame) -> DataFrame:
    """(path) of files to resolve anew: changed, mentioning a changed name (token), or
    importing a changed file (path, target), directly or over others."""
    from weftgraph.operators.traverse import bfs

    by_name = mentioned.join(names.select("token").distinct(), "token", "left_semi").select("path")
    back = imports.select(F.col("target").alias("at"), F.col("path").alias("to")).distinct()
    by_import = bfs(changed.select(F.col("path").alias("id")), back, None).select(F.col("id").alias("path"))
    return changed.select("path").unionByName(by_name).unionByName(by_import).distinct()


def flows_to_walk(steps: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(flow_id) of flows that visit a node whose outgoing links (src, hash) changed."""
    from weftgraph.operators.change import diff

    changed = diff(before, after, ["src"], ["hash"]).select(F.col("src").alias("fn"))
    return steps.join(changed, "fn", "left_semi").select("flow_id").distinct()


def outgoing_hash(links: DataFrame) -> DataFrame:
    """(src, hash) over a node's distinct outgoing links, in whatever order they come."""
    return links.select("src", "dst").distinct().groupBy("src").agg(F.sum(F.xxhash64("dst").cast("decimal(38,0)")).cast("string").alias("hash"))


def merged_counts(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, n) with those of further rows added."""
    new = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return old.select(*keys, "n").unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def replaced(old: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """old with the partitions that new has in place of its own."""
    return old.join(new.select(partition).distinct(), partition, "left_anti").unionByName(new)
