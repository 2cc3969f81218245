"""Front ends by file ending: where a language of one's own is plugged in.

A front end is a function of (repo, path, text) that gives records as dictionaries, with
the columns of the Python front end; it runs on executors and is pickled by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources import python_ast

Parse = Callable[[str, str, str], list[dict]]
_FRONT_ENDS: dict[str, Parse] = {".py": python_ast.parse}


def register(ending: str, parse: Parse) -> None:
    """Use ``parse`` for files with this ending, in place of what was there."""
    if not ending.startswith("."):
        raise ValueError(f"an ending starts with a dot: {ending}")
    _FRONT_ENDS[ending] = parse


def endings() -> list[str]:
    return sorted(_FRONT_ENDS)


def parse_files(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Records of all files (path, text) that have a front end; a front end that fails gives
    one error record for the file."""
    parsers = dict(_FRONT_ENDS)
    columns = [c.split()[0] for c in python_ast.RECORDS.split(", ")]
    schema = pa.schema([(c, pa.int32() if t == "int" else pa.string()) for c, t in (x.split() for x in python_ast.RECORDS.split(", "))])

    def records(path: str, text: str) -> list[dict]:
        longest = max((e for e in parsers if path.endswith(e)), key=len)
        try:
            return parsers[longest](repo, path, text)
        except Exception as e:  # a front end of someone else's must not end the job
            return [{"record": "error", "path": path, "name": type(e).__name__, "attrs": str(e)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{c: r.get(c) for c in columns} for r in records(path, text)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    known = F.lit(False)
    for ending in parsers:
        known = known | F.endswith("path", F.lit(ending))
    return files.filter(known & F.col("text").isNotNull()).select("path", "text").mapInArrow(run, python_ast.RECORDS)
