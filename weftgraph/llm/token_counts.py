"""Token counts: an exact histogram of encoded lengths.

One pass encodes every whole document and counts documents by length; the
histogram has one row per distinct length, however many documents there are.
Suffix sums over it answer totals, quantiles and truncated totals for every
context limit without touching the texts again.

Null and empty texts have length 0.  An empty table gives an empty histogram.
Repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import byte_bpe, byte_bpe_paths, lean, prefix_offsets, staged, table


def length_histogram(
    docs: DataFrame, text: str = "text", paths: tuple[str, str | None] | None = None, extra: int = 0
) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, ``extra`` ids added to each."""
    paths = paths or byte_bpe_paths()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(paths)
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                found[(len(encoder.ids(t)) if t else 0) + extra] += 1
        if found:
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["n_tokens", "n"]
            )

    return (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(lean(count), "n_tokens long, n long")
        .groupBy("n_tokens")
        .agg(F.sum("n").alias("n_docs"))
    )


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per distinct length n with what a context limit of n needs.

    docs_longer and tokens_longer sum over lengths above n, docs_within and
    tokens_within over lengths up to n; truncated_total is the number of tokens left
    if every document is cut at n, and share_within the quantile rank of n.
    """
    own = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    total = own.agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("n_tokens").alias("longest")).first()
    all_docs, all_tokens = F.lit(total["docs"] or 0), F.lit(total["tokens"] or 0)
    # About as many buckets of lengths as lengths in a bucket.
    width = 1 + math.isqrt(total["longest"] or 0)
    before = prefix_offsets(own, "n_tokens", {"docs_shorter": "n_docs", "tokens_shorter": "tokens"}, width)
    within, tokens = F.col("docs_shorter") + F.col("n_docs"), F.col("tokens_shorter") + F.col("tokens")
    return before.select(
        "n_tokens",
        "n_docs",
        within.alias("docs_within"),
        tokens.alias("tokens_within"),
        (all_docs - within).alias("docs_longer"),
        (all_tokens - tokens).alias("tokens_longer"),
        (tokens + F.col("n_tokens") * (all_docs - within)).alias("truncated_total"),
        (within.cast("double") / all_docs).alias("share_within"),
    )


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_within, tokens_within, docs_longer, truncated_total) of
    any limits, also between two lengths, in one pass over the histogram."""
    limits = sorted({int(x) for x in limits})
    n, docs = F.col("n_tokens"), F.col("n_docs")
    one = hist.agg(
        F.coalesce(F.sum(docs), F.lit(0)).alias("all_docs"),
        *(F.coalesce(F.sum(F.when(n <= c, docs)), F.lit(0)).alias(f"d{i}") for i, c in enumerate(limits)),
        *(F.coalesce(F.sum(F.when(n <= c, docs * n)), F.lit(0)).alias(f"t{i}") for i, c in enumerate(limits)),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(c).cast("long").alias("context_limit"),
                F.col(f"d{i}").alias("docs_within"),
                F.col(f"t{i}").alias("tokens_within"),
                (F.col("all_docs") - F.col(f"d{i}")).alias("docs_longer"),
                (F.col(f"t{i}") + F.lit(c) * (F.col("all_docs") - F.col(f"d{i}"))).alias("truncated_total"),
            )
            for i, c in enumerate(limits)
        )
    )
    return one.select(F.inline(rows))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that at least the share q of documents keep to."""
    return sums.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix sums of all documents."""
    return suffix_sums(staged(length_histogram(table(spark, sf_dir, "documents")), "lengths"))
