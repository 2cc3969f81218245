"""Quality by compression: zstandard dictionaries of good and bad text.

Two dictionaries hold whole labelled texts, one of good and one of bad documents.
Every document is compressed with each, in blocks of ``BLOCK_BYTES`` that all start
from the dictionary, so that a long text does not outgrow what it gives.  What tells the classes apart is the
difference of the two sizes, over the larger one; with the sizes over the length and
the length itself it enters a logistic calibration on labelled rows that are in
neither dictionary, weighted to the class shares of all labelled rows.  Lengths beyond
those of the calibration count as its longest or shortest.

Bounds, all parameters: ``DICTIONARY_ROWS`` of each class, and at most half of it, are
looked at for the dictionaries of ``DICTIONARY_BYTES`` each (texts over a sixteenth of
that are left out there), and the rest of ``DICTIONARY_ROWS`` + ``CALIBRATION_ROWS`` for
the calibration.  Scoring
reads every whole text.  The score depends on the text alone.

Null and empty texts get the score of an empty text.  With no usable labels of one
class every score is the share of good labels (0.5 without labels).  Repeated rows get
one row each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_value, held_out, labelled_sample, lean, logistic_fit, table

DICTIONARY_BYTES = 1_000_000
DICTIONARY_ROWS = 1_000
CALIBRATION_ROWS = 6_000
LEVEL = 6
#: zstandard uses a dictionary in place for inputs up to this size.
BLOCK_BYTES = 32_768


@dataclass
class QualityModel:
    """The dictionaries, and the coefficients over ``expanded`` features."""

    good: bytes
    bad: bytes
    level: int = LEVEL
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    prior: float = 0.5
    #: Least and greatest log length of the calibration.
    lengths: tuple[float, float] = (0.0, float("inf"))

    def compressors(self):
        import zstandard as zs

        out = []
        for content in (self.good, self.bad):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zs.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False))
        return out

    def features(self, texts: Iterable[str | None]):
        """Per text: normalised size difference, both sizes per byte, log length."""
        import numpy as np

        good, bad = self.compressors()
        rows = []
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [data]
            g, b, n = sum(len(good.compress(c)) for c in blocks), sum(len(bad.compress(c)) for c in blocks), len(data) + 1
            rows.append(((b - g) / max(g, b), g / n, b / n, np.log(n)))
        return np.array(rows, dtype=float).reshape(-1, 4)

    @staticmethod
    def expanded(x):
        import numpy as np

        return np.c_[x, x**2, x[:, 0] * x[:, 1], x[:, 0] * x[:, 3]]

    def scores(self, x):
        import numpy as np

        if not self.weights:
            return np.full(len(x), self.prior)
        x = np.c_[x[:, :3], np.clip(x[:, 3], *self.lengths)]
        a = np.c_[(self.expanded(x) - np.array(self.mean)) / np.array(self.scale), np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(a @ np.array(self.weights), -40, 40)))


def _features_frame(docs: DataFrame, model: QualityModel, keep: str) -> DataFrame:
    """Of docs (text, <keep>) the features and the kept column."""
    shared = by_value(docs.sparkSession, model)  # two dictionaries of a fixed size
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            x = own.features(v.as_py() for v in batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(x[:, i], pa.float64()) for i in range(4))], [keep, "f0", "f1", "f2", "f3"]
            )

    return docs.mapInArrow(lean(run), f"{keep} {kind}, f0 double, f1 double, f2 double, f3 double")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    dictionary_bytes: int = DICTIONARY_BYTES,
    dictionary_rows: int = DICTIONARY_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
    level: int = LEVEL,
) -> QualityModel:
    import numpy as np

    most = dictionary_rows + calibration_rows
    sample, counts = labelled_sample(labels, label, {1: most, 0: most}, doc_id, first=dictionary_rows)
    known = sum(counts.values())
    model = QualityModel(b"", b"", level, prior=counts.get(1, 0) / known if known else 0.5)
    if len(counts) < 2:
        return model
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drawn = own.join(F.broadcast(sample), "doc_id")  # at most 2 * most ids
    contents = []
    for value in (1, 0):
        rows = (
            drawn.filter((F.col("part") == 0) & (F.col("label") == value))
            .filter(F.octet_length("text").between(1, dictionary_bytes // 16))
            .select("text", F.xxhash64("doc_id", "text").alias("k"))
            .orderBy("k")
            .limit(dictionary_rows)
        )
        held, size = [], 0
        for r in rows.collect():
            data = r["text"].encode()
            if size + len(data) <= dictionary_bytes:
                held.append(data)
                size += len(data)
        contents.append(b"\n".join(held))
    model.good, model.bad = contents
    rows = (
        _features_frame(drawn.filter("part = 1").select("text", "label"), model, "label")
        .toPandas()
        .sort_values(["label", "f0", "f1", "f2", "f3"])
    )
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    model.lengths = float(rows["f3"].min()), float(rows["f3"].max())
    x = model.expanded(rows[["f0", "f1", "f2", "f3"]].to_numpy(float))
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    weights = np.where(y == 1, counts[1] / known / (y == 1).mean(), counts[0] / known / (y == 0).mean())
    model.weights = logistic_fit((x - x.mean(0)) / (x.std(0) + 1e-9), y, weights).tolist()
    return model


def scored(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = by_value(docs.sparkSession, model)  # two dictionaries of a fixed size
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            s = own.scores(own.features(v.as_py() for v in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lean(run), f"doc_id {id_type}, score double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; texts are not moved."""
    shared = by_value(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            s = own.scores(own.features(v.as_py() for v in batch.column(at)))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
