"""Keep link counts current from a stream of changed files.

Each micro-batch names files with their new links; the rows of those files are replaced,
as a full rebuild would make them. A batch that runs again gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.incremental import replaced
from weftgraph.store import GraphStore

LINKS = "path string, src string, dst string, version long"


def read_changes(spark: SparkSession, folder: str, schema: str = LINKS) -> DataFrame:
    """A stream of link rows from JSON files as they arrive; a row without src says that the
    file has no links."""
    return spark.readStream.schema(schema).json(folder)


def apply_batch(store: GraphStore, batch: DataFrame) -> None:
    """Replace the links of the files in a batch; of several versions the latest counts."""
    latest = batch.groupBy("path").agg(F.max("version").alias("version"))
    new = batch.join(latest, ["path", "version"]).select("path", "src", "dst")
    old = store.read("file_links") if "file_links" in store.versions()["tables"] else None
    if old is not None:
        new = replaced(old, new, "path")
    store.write("file_links", new.distinct())


def follow(changes: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    return (
        changes.writeStream.foreachBatch(lambda df, _: apply_batch(store, df) if not df.isEmpty() else None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def link_counts(store: GraphStore) -> DataFrame:
    return store.read("file_links").filter("src is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def late_counts(events: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events of a stream (ts, kind) counted by window, late ones up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))
