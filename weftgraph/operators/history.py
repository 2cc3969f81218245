"""Change coupling from commit history: files, folders and functions that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import small, staged
from weftgraph.schema import BULK_FILES, FOLDER_SHARE, MIN_CONFIDENCE, MIN_TOGETHER


def bulk_commits(changes: DataFrame, bulk: int = BULK_FILES) -> DataFrame:
    """(commit_id, files): commits of more than ``bulk`` files, left out of coupling."""
    return changes.groupBy("commit_id").agg(F.countDistinct("path").alias("files")).filter(F.col("files") > bulk)


def usable(changes: DataFrame, bulk: int = BULK_FILES) -> DataFrame:
    """The changes of commits that are not bulk."""
    few = changes.groupBy("commit_id").agg(F.count(F.lit(1)).alias("_files")).filter(F.col("_files") <= bulk)
    return changes.join(few.select("commit_id"), "commit_id", "left_semi")


def renamed(changes: DataFrame) -> DataFrame:
    """Changes (commit_seq, status, old_path, path) with each path as it is called today.

    Renames are followed from old to new over any number of steps."""
    moves = changes.filter("status = 'R'").groupBy(F.col("old_path").alias("was")).agg(F.max_by("path", "commit_seq").alias("now"))
    moves = staged(moves.filter("was <> now"), "renames")
    while True:
        further = moves.alias("m").join(moves.alias("n"), F.col("m.now") == F.col("n.was"), "left")
        new = staged(
            further.select(F.col("m.was").alias("was"), F.coalesce("n.now", "m.now").alias("now")).filter("was <> now"), "renames"
        )
        # What moved in a circle drops out, so each round follows twice as many steps of the rest.
        same = new.exceptAll(moves).isEmpty()
        moves = new
        if same:
            break
    return changes.join(moves, F.col("path") == F.col("was"), "left").withColumn("path", F.coalesce("now", "path")).drop("was", "now")


def pair_counts(changes: DataFrame, bulk: int = BULK_FILES, at_least: int = 2) -> DataFrame:
    """(a, b, together), a < b. A commit has at most ``bulk`` files here, so its pairs are
    bounded; they are made from one array a commit, without a self-join."""
    sets = usable(changes, bulk).groupBy("commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return (
        sets.select(F.posexplode("paths").alias("i", "a"), "paths")
        .select("a", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("together"))
        .filter(F.col("together") >= at_least)
    )


def file_changes(changes: DataFrame, bulk: int = BULK_FILES) -> DataFrame:
    return usable(changes, bulk).groupBy("path").agg(F.count(F.lit(1)).alias("changes"))


def _with_changes(changes: DataFrame, bulk: int, at_least: int) -> DataFrame:
    each = file_changes(changes, bulk)
    return (
        pair_counts(changes, bulk, at_least)
        .join(each.select(F.col("path").alias("a"), F.col("changes").alias("ca")), "a")
        .join(each.select(F.col("path").alias("b"), F.col("changes").alias("cb")), "b")
    )


def strongest(changes: DataFrame, bulk: int = BULK_FILES, min_together: int = MIN_TOGETHER) -> DataFrame:
    """(file_, partner, together, changes) in the direction of the file that changes less."""
    first = F.col("ca") <= F.col("cb")
    return _with_changes(changes, bulk, min_together).select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("file_"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("partner"),
        "together",
        F.least("ca", "cb").alias("changes"),
    )


def partners(
    changes: DataFrame, path, bulk: int = BULK_FILES, min_together: int = MIN_TOGETHER, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(partner, together, changes): what changes along with one file often enough. The
    threshold is on the exact ratio."""
    both = _with_changes(changes, bulk, min_together).filter((F.col("a") == path) | (F.col("b") == path))
    own = F.when(F.col("a") == path, F.col("ca")).otherwise(F.col("cb"))
    return both.select(
        F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")).alias("partner"), "together", own.alias("changes")
    ).filter(F.col("together").cast("double") / F.col("changes") >= min_confidence)


def folder_counts(changes: DataFrame, at_least: int = 2) -> DataFrame:
    """(path, dir, together): commits that touch a file and a folder that does not hold it."""
    dirs = changes.select("commit_id", F.col("dir").alias("other")).distinct()
    return (
        changes.join(dirs, "commit_id")
        .filter("dir <> other")
        .groupBy("path", F.col("other").alias("dir"))
        .agg(F.countDistinct("commit_id").alias("together"))
        .filter(F.col("together") >= at_least)
    )


def telling_folders(folders: DataFrame, files: DataFrame, share: float = FOLDER_SHARE) -> DataFrame:
    """Folder rows that no single file in the folder explains: files has path, dir, other, together."""
    top = files.groupBy("path", "dir").agg(F.max("together").alias("best"))
    return folders.join(top, ["path", "dir"], "left").filter(F.coalesce("best", F.lit(0)) < share * F.col("together")).drop("best")


def missed(changes: DataFrame, touched: DataFrame, bulk: int = BULK_FILES, min_together: int = MIN_TOGETHER, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(partner, file_, together): partners of the touched files (path) that are not
    touched themselves, each with the file that says so most."""
    pairs = _with_changes(changes, bulk, min_together)
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "together", F.col("ca").alias("n")).unionByName(
        pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "together", F.col("cb").alias("n"))
    )
    own = touched.select("path").distinct()
    return (
        both.filter(F.col("together").cast("double") / F.col("n") >= min_confidence)
        .join(own, "path", "left_semi")
        .join(own.select(F.col("path").alias("partner")), "partner", "left_anti")
        .withColumn("k", F.row_number().over(Window.partitionBy("partner").orderBy(F.desc("together"), "path")))
        .filter("k = 1")
        .select("partner", F.col("path").alias("file_"), "together")
    )


def changed_functions(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(commit_id, fn): innermost functions (path, first, last, fn) of changed lines
    (commit_id, path, line)."""
    hit = hunks.join(spans, "path").filter(F.col("line").between(F.col("first"), F.col("last")))
    return hit.groupBy("commit_id", "path", "line").agg(F.max_by("fn", "first").alias("fn")).select("commit_id", "fn").distinct()


def related_changes(changes: DataFrame, commit, most: int = 5) -> DataFrame:
    """(commit_id, shared): earlier commits that touch most of the same files, newest first."""
    own = changes.filter(F.col("commit_id") == commit).select("path").distinct()
    return (
        changes.filter(F.col("commit_id") < commit)
        .join(small(own), "path", "left_semi")
        .groupBy("commit_id")
        .agg(F.countDistinct("path").alias("shared"))
        .orderBy(F.desc("shared"), F.desc("commit_id"))
        .limit(most)
    )
