"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.

Null texts: the classifiers score them as empty ones, the dedup stages take them as empty
(equal to other empty texts; without words, so no near copy), packing gives them a piece
with the end id.  Empty texts likewise.  Very long texts are read whole in every stage.
Rows with a null doc_id are judged like any other; exact dedup prefers other rows, near
dedup keeps them.  Of ties (equal texts, rows repeated with their doc_id) each dedup stage
keeps one row.  An empty table, or a stage that rejects every document, gives no rows and
the same columns.  Extra columns go through to the last stage, whatever their names, which
returns places only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, minmax_dedup, packing, quality, toxicity
from weftgraph.llm.common import identified, staged, table

#: Words of a shingle in the near-dedup stage.
SHINGLE_WORDS = 5


def _kept(docs: DataFrame, judged: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """The rows of docs that judged(docs, names) marks as kept.  Rows are named by their file
    and place in it, so that the two readings of docs agree however its files are split."""
    named, names = identified(docs)
    kept = judged(named, tuple(names)).filter("kept").select(*names)
    return named.join(kept, names, "left_semi").drop(*names)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier finds toxic go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return _kept(docs, lambda named, names: exact_dedup.exact_duplicates(named, carry=names))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays."""
    return _kept(docs, lambda named, names: minmax_dedup.near_duplicates(named, words=SHINGLE_WORDS, carry=names))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed(staged(packing.pieces(docs), "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("best-fit packing", packed_sequences),
]

#: Trained classifiers, hashing and tokenizers have no SQL form; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
