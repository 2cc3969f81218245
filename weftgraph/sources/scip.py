"""Index files of language servers (SCIP): occurrences of symbols, and the links they make.

The format is protocol buffers; only the few fields that matter are read, by their wire
form, so nothing beyond Python is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = "path string, line int, col int, symbol string, name string, defines boolean"
#: Field numbers of the format, and the role bit of a definition.
DOCUMENTS, RELATIVE_PATH, OCCURRENCES, RANGE, SYMBOL, ROLES = 2, 1, 2, 1, 2, 3
DEFINITION = 1


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers as int, everything with a length as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield number, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def last_name(symbol: str) -> str:
    """The name in a symbol's last descriptor: ``pkg/Engine#start().`` names start."""
    tail = re.sub(r"\([^()]*\)$", "", symbol.rstrip(".#/:!"))
    return re.split(r"[#/.\s:\]]", tail)[-1].strip("`")


def occurrences(index: bytes) -> Iterator[dict]:
    """The records of one index; local symbols, which no other file can name, are left out."""
    for number, document in fields(index):
        if number != DOCUMENTS:
            continue
        parts = list(fields(document))
        path = next((v.decode() for n, v in parts if n == RELATIVE_PATH), "")
        for n, occurrence in parts:
            if n != OCCURRENCES:
                continue
            place: list[int] = []
            symbol, roles = "", 0
            for k, v in fields(occurrence):
                if k == RANGE:
                    place += packed(v) if isinstance(v, bytes) else [v]
                elif k == SYMBOL:
                    symbol = v.decode()
                elif k == ROLES:
                    roles = v
            if place and symbol and not symbol.startswith("local "):
                yield {
                    "path": path, "line": place[0] + 1, "col": place[1] if len(place) > 1 else 0, "symbol": symbol,
                    "name": last_name(symbol), "defines": bool(roles & DEFINITION),
                }


def read_index(files: DataFrame) -> DataFrame:
    """``RECORDS`` of index files (content), one a task; a file that does not parse gives none."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("symbol", pa.string()), ("name", pa.string()), ("defines", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                try:
                    rows = list(occurrences(content or b""))
                except (ValueError, IndexError, UnicodeDecodeError):
                    continue
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 50_000], schema)

    return files.select("content").mapInArrow(run, RECORDS)


def links(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, line, name, target, kind) as a compiler's links: each use of a symbol in a
    callable (id, name, kind, path, first, last) to the node that the symbol's definition
    lies in; of nested spans the innermost."""
    span = nodes.filter("first is not null and last is not null")
    inside = lambda df: df.join(span.select("path", "first", "last", "kind", F.col("id").alias("node"), F.col("name").alias("own")), "path").filter(
        F.col("line").between(F.col("first"), F.col("last"))
    )
    inner = F.max_by("node", F.struct(F.col("first"), -F.col("last"), F.col("node")))
    defined = inside(records.filter("defines")).filter("own = name").groupBy("symbol").agg(inner.alias("target"))
    used = (
        inside(records.filter("not defines"))
        .filter("kind in ('callable', 'test')")
        .groupBy("path", "line", "col", "symbol", "name")
        .agg(inner.alias("caller"))
    )
    return used.join(defined, "symbol").select("caller", "line", "name", "target", F.lit("use").alias("kind")).distinct()
