"""Shared parts of the training-data operators: scratch tables, tokenizers, hashing."""

from __future__ import annotations

import base64
import json
import os
import pickle
import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import new_folder, staged  # noqa: F401  for the operators

BYTE_BPE_JSON = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE_JSON = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that never take part in learning labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions pickled by value get fresh globals for each task; this keeps loaded
    tokenizers and dictionaries across tasks.
    """
    return sys.modules.setdefault("_weftgraph_worker_cache", types.ModuleType("cache")).__dict__


def by_value(spark: SparkSession, value) -> Callable:
    """A function that gives value on executors.  A broadcast alone would pickle the value's
    class by reference, and executors need not have the package."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two more columns, and their names, that together tell its rows apart.

    Of files these are the path and the row's index in the file, which every scan gives
    alike however the files are split; of anything else, of a stored copy.
    """
    names = ["_file", "_at"]
    while set(names) & set(df.columns):
        names = [n + "_" for n in names]

    def marked(of: DataFrame) -> DataFrame:
        meta = of.metadataColumn("_metadata")
        return of.select("*", meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1]))

    try:
        out = marked(df)
        out.schema  # noqa: B018  resolves the columns
        return out, names
    except AnalysisException:
        return marked(staged(df, "identified")), names


def shared_text(spark: SparkSession, name: str, lines: list[str]) -> str:
    """Lines that the driver made, as a file in the shared folder."""
    path = f"{new_folder(spark, name)}/lines"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()
    return path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lean(f):
    """f over batches, returning freed memory to the system when the task ends: idle
    Python workers are kept beside the executor's own memory."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def slices(batch, column: int, rows: int = 500, size: int = 4_000_000):
    """A batch in parts of so many rows and bytes of a text column; a longer text is alone."""
    import pyarrow.compute as pc

    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > at and (i - at == rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(batch) > at:
        yield batch.slice(at)


class ByteBpe:
    """Ids of the byte-level BPE file, as the tokenizers library gives them with
    ``add_special_tokens=False``.

    The same vocabulary as merge ranks is run by tiktoken, which takes a fifth of
    the CPU time; tests hold the ids of both libraries equal over every code point
    and over generated texts.  A text that tiktoken refuses goes to the tokenizers
    library.  Strings of special tokens in a text become their ids, as there.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        self.json_path = json_path
        self._library = None
        self._fast = None
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
        if ranks_path and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            self._fast = tiktoken.Encoding(
                "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
            )

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.json_path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def ids(self, text: str):
        """The ids as a numpy array of unsigned 32-bit integers."""
        import numpy as np

        if self._fast is not None:
            try:
                return np.asarray(self._fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
            except BaseException as e:  # the native code reports stack limits as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def byte_bpe(paths: tuple[str, str | None]) -> ByteBpe:
    """The tokenizer of this worker process, loaded once."""
    cache = worker_cache()
    if ("byte_bpe", paths) not in cache.setdefault("loaded", {}):
        cache["loaded"]["byte_bpe", paths] = ByteBpe(*paths)
    return cache["loaded"]["byte_bpe", paths]


def byte_bpe_paths() -> tuple[str, str | None]:
    return tokenizer_path(BYTE_BPE_JSON), tokenizer_path(BYTE_BPE_RANKS)


def prefix_offsets(df: DataFrame, order: str, counts: dict[str, str], width: int = 4096) -> DataFrame:
    """Add to each row of df the sums of columns over all rows of smaller ``order``.

    ``order`` is a non-negative long, unique in df.  Two levels (inside a bucket of
    ``width`` consecutive values, then over the buckets) keep any one task to
    ``width`` rows or to one row per bucket.
    """
    from pyspark.sql import Window

    bucketed = df.withColumn("_bucket", F.expr(f"`{order}` div {width}"))
    totals = bucketed.groupBy("_bucket").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in counts.items()))
    over_buckets = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_bucket", *(F.coalesce(F.sum(f"_sum_{n}").over(over_buckets), F.lit(0)).alias(f"_start_{n}") for n in counts)
    )
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in counts.items()))
        .join(starts, "_bucket")
        .withColumns({n: (F.col(f"_start_{n}") + F.col(f"_in_{n}")).cast("long") for n in counts})
        .drop("_bucket", *(f"_start_{n}" for n in counts), *(f"_in_{n}" for n in counts))
    )


def labelled_sample(
    labels: DataFrame, label: str, per_class: dict[int, int], doc_id: str = "doc_id", seed: int = 42, first: int | None = None
) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of the labelled rows that may be learned from, and the number
    of all of them by class.

    ``per_class`` bounds the rows of each class, so the sample can be broadcast.  Rows
    are taken by a hash of the id, which does not depend on order or partitions.
    (doc_id, label, part): part is 0 for the even ranks of a class, at most ``first`` of
    them, and 1 for the others.
    """
    spark = labels.sparkSession
    usable = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(*per_class) & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for value, most in per_class.items():
        taken = usable.filter(F.col("label") == value).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
        most_first = most if first is None else first
        rows += [(r["doc_id"], value, int(i % 2 == 1 or i // 2 >= most_first)) for i, r in enumerate(taken.collect())]
    id_type = labels.schema[doc_id].dataType.simpleString()
    return spark.createDataFrame(rows, f"doc_id {id_type}, label int, part int"), counts


def logistic_fit(x, y, weights, ridge: float = 1e-3, rounds: int = 60):
    """Weighted logistic regression by Newton steps: coefficients, intercept last.
    y may be soft."""
    import numpy as np

    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge * weights.sum() / max(1, len(weights)))
    penalty[-1] = 1e-6

    def loss(v):
        z = a @ v
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2)

    last = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        slope = a.T @ (weights * (y - p)) - penalty * w
        curve = (a * (weights * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(w + size * step) > last:
            size /= 2
        w = w + size * step
        now = loss(w)
        if last - now < 1e-9 * max(1.0, abs(now)):
            break
        last = now
    return w
