"""Measured lines from coverage files: lcov, Cobertura, Istanbul, and coverage databases."""

from __future__ import annotations

import json
import sqlite3
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = "run string, test string, path string, line int, hits long"


def read_lcov(lines: DataFrame) -> DataFrame:
    """(run, test, path, line, hits) of lcov text lines (run, line_no, text)."""
    order = Window.partitionBy("run").orderBy("line_no")
    carried = lambda p: F.last(F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)), ignorenulls=True).over(order)
    hit = F.regexp_extract("text", r"^DA:(\d+),(\d+)", 1)
    return (
        lines.select(
            "run",
            carried(r"^TN:(.*)$").alias("test"),
            carried(r"^SF:(.*)$").alias("path"),
            hit.try_cast("int").alias("line"),
            F.regexp_extract("text", r"^DA:(\d+),(\d+)", 2).try_cast("long").alias("hits"),
        )
        .filter("line is not null and path is not null")
    )


def numbits(data: bytes) -> list[int]:
    """Line numbers of a bitmap, least bit first."""
    return [8 * i + b for i, byte in enumerate(data) for b in range(8) if byte >> b & 1]


def _rows(name: str, content: bytes) -> Iterator[tuple[str | None, str, int, int]]:
    if content[:16] == b"SQLite format 3\x00":
        with tempfile.NamedTemporaryFile(suffix=".db") as f:  # read within this task alone
            f.write(content)
            f.flush()
            con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
            try:
                query = "SELECT c.context, p.path, b.numbits FROM line_bits b JOIN file p ON p.id = b.file_id LEFT JOIN context c ON c.id = b.context_id"
                for test, path, bits in con.execute(query):
                    for line in numbits(bits):
                        yield (test or "").split("|")[0] or None, path, line, 1
            finally:
                con.close()
    elif content.lstrip()[:1] == b"<":
        for c in ET.fromstring(content).iter("class"):
            for x in c.iter("line"):
                yield None, c.get("filename", ""), int(x.get("number", 0)), int(x.get("hits", 0))
    elif content.lstrip()[:1] == b"{":
        for path, data in json.loads(content).items():
            best: dict[int, int] = {}
            for k, span in data.get("statementMap", {}).items():
                line = span["start"]["line"]
                best[line] = max(best.get(line, 0), int(data.get("s", {}).get(k, 0)))
            for line, hits in sorted(best.items()):
                yield None, data.get("path", path), line, hits


def read_files(files: DataFrame, run: str = "default") -> DataFrame:
    """(run, test, path, line, hits) of coverage files (path, content), by what they hold.

    Each file is read whole in one task, as its formats ask for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(_rows(name, content))
                if rows:
                    test, path, line, hits = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([run] * len(rows)), pa.array(test, pa.string()), pa.array(path), pa.array(line, pa.int32()), pa.array(hits, pa.int64())],
                        ["run", "test", "path", "line", "hits"],
                    )

    return files.select("path", "content").mapInArrow(parse, LINES)


def covered_functions(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, test, node_id, lines): measured lines that ran, counted for the innermost
    function (path, id, first, last, body_line) whose body holds them; test names without
    parameters."""
    ran = lines.filter("hits > 0").withColumn("test", F.regexp_replace("test", r"\[.*\]$", ""))
    start = F.coalesce("body_line", F.when(F.col("last") > F.col("first"), F.col("first") + 1).otherwise(F.col("first")))
    spans = nodes.select("path", F.col("id").alias("node_id"), start.alias("body"), "last", F.col("first").alias("outer"))
    hit = ran.join(spans, "path").filter(F.col("line").between(F.col("body"), F.col("last")))
    own = hit.groupBy("run", "test", "path", "line").agg(F.max_by("node_id", "outer").alias("node_id"))
    return own.groupBy("run", "test", "node_id").agg(F.count(F.lit(1)).alias("lines"))
