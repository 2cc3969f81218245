"""Best-fit packing by large-item matching.

Every whole document is encoded and gets an end id; longer ones are cut into full
pieces, the first piece taking the remainder.  Pieces above a third of the capacity
are matched greedily: the longest with the longest that fits beside it, so at most
two to a sequence.  Smaller pieces, longest first, go where the least room remains
that holds them.

Lengths are at most the capacity, so the plan is made on their histogram: pieces of
one length are alike, and the driver sees one count per length.  It yields runs of
equal sequences; each piece finds its place by its length and its rank among pieces
of that length.  The ranks are counted in buckets, so a common length is no task's
alone.

Null texts are empty: one piece with the end id.  An empty table gives no rows.
Repeated rows and equal ids are packed one by one; extra columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import byte_bpe, byte_bpe_paths, lean, staged, table

CAPACITY, END_ID = 1024, 2


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Whole if it fits, else full pieces with the remainder first."""
    return ([total % capacity] if total % capacity else []) + [capacity] * (total // capacity)


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    paths: tuple[str, str | None] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    paths = paths or byte_bpe_paths()
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = byte_bpe(paths)
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [], [])
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                ids = np.append(encoder.ids(t) if t else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
                at = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    own = ids[at : at + n]
                    row = (i, k, at, n, zlib.crc32(own.tobytes()), own if with_ids else None)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    at += n
            columns = [keys.take(pa.array(out[0], pa.int32()))] + [
                pa.array(x, t) for x, t in zip(out[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            ]
            if with_ids:
                columns.append(pa.array(out[5], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lean(cut), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    )


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for a histogram of piece lengths."""
    left = {n: c for n, c in histogram.items() if c > 0}
    by_gap: list[list[list]] = [[] for _ in range(capacity + 1)]

    def put(count: int, items: tuple[int, ...]) -> None:
        if count:
            by_gap[capacity - sum(items)].append([count, items])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if mate is None:
                count = left[n]
                put(count, (n,))
                left[n] = 0
            elif mate == n:
                count = left[n] // 2
                put(count, (n, n))
                left[n] -= 2 * count
            else:
                count = min(left[n], left[mate])
                put(count, (n, mate))
                left[n] -= count
                left[mate] -= count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            gap = next((g for g in range(n, capacity) if by_gap[g]), None)
            if gap is None:  # new sequences, each filled before the next is begun
                each = capacity // n
                put(count // each, (n,) * each)
                put(int(count % each > 0), (n,) * (count % each))
                break
            each, group = gap // n, by_gap[gap][-1]
            many = min(group[0], count // each) or 1
            each = min(each, count)
            group[0] -= many
            if not group[0]:
                by_gap[gap].pop()
            put(many, group[1] + (n,) * each)
            count -= many * each
    return [(count, items) for groups in by_gap for count, items in groups]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> list[dict]:
    """For each length and range of ranks the sequences and the offset in them."""
    out, next_rank, first = [], {}, 0
    for count, items in runs:
        at = 0
        for n in items:
            r = next_rank.get(n, 0)
            out.append({"length": n, "first_rank": r, "last_rank": r + count - 1, "sequence": first, "offset": at})
            next_rank[n] = r + count
            at += n
        first += count
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset.  ``cut`` has doc_id, piece and length and is
    read twice: give a stored table.

    The commonest length, of n pieces, is ranked in sqrt(n) buckets of about sqrt(n), so
    that neither a bucket nor the list of buckets is large."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = 1 + math.isqrt(max(histogram.values(), default=0))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = (
        dealt.withColumn("_in", F.row_number().over(inside))
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_start") + F.col("_in") - 1)
    )
    schema = "array<struct<length: bigint, first_rank: bigint, last_rank: bigint, sequence: bigint, offset: bigint>>"
    table_ = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(places(plan(histogram, capacity)))), schema)))
    return (
        ranked.join(F.broadcast(table_), "length")  # a few rows per length, of which there are at most `capacity`
        .filter(F.col("_rank").between(F.col("first_rank"), F.col("last_rank")))
        .withColumn("sequence_id", F.col("sequence") + F.col("_rank") - F.col("first_rank"))
        .drop("_bucket", "_in", "_start", "_rank", "first_rank", "last_rank", "sequence")
    )


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, of pieces cut ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(staged(pieces(table(spark, sf_dir, "documents")), "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
