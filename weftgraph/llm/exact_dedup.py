"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so (between words, by the letters around the
gap, at least ``LEAST`` and at most ``MOST`` characters on), so equal passages give
equal chunks wherever they stand.  Each distinct chunk text is moved once, to the group
of its hash: a hash with one text behind it is a verified identifier, and where two
texts share a hash each gets its rank in the group as well.  Texts are equal when
their ordered lists of identifiers are; only those lists, of 8 bytes a chunk, are
grouped and joined, never the texts.

Null texts count as empty; all empty texts are equal.  Of a group the row with the
largest doc_id stays (null ids count as the smallest); of repeated rows with that
doc_id one stays.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import staged, table

LEAST, MOST = 256, 8192
#: A word ends and one begins; which letters stand around the gap decides, about one
#: gap in a hundred of prose, so boundaries do not depend on where the text began.
BOUNDARY = r"(?=[a-hA-H])(?<=[a-mA-M]{2}[n-zN-Z][a-mA-M]\W?\s)"
#: Lazily up to the first boundary after LEAST characters, else MOST characters.
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?{BOUNDARY}|.{{1,{MOST}}}"


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The ordered chunks of a text; together they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_table(docs: DataFrame, text: str = "text", hashed=chunk_hash) -> DataFrame:
    """(hash, chunk, n): every distinct chunk of the table once."""
    return (
        docs.select(F.explode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("chunk"))
        .select(hashed(F.col("chunk")).alias("hash"), "chunk")
        .groupBy("hash", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed=chunk_hash, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, text_sha256, ids, *carry), stored: the ordered verified identifiers of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), *carry).withColumn("row", F.monotonically_increasing_id())

    def listed(of: DataFrame) -> DataFrame:
        return of.select(
            "doc_id",
            "row",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("text")), hashed).alias("ids"),
            *carry,
        )

    lists = staged(listed(base), "recipes")
    store = chunk_table(docs, text, hashed)
    shared = staged(store.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "shared-hashes")
    if shared.isEmpty():
        return lists
    # Colliding hashes: the rows are stored with their numbers, so that both readings name them alike.
    base = staged(base, "numbered-texts")
    ranks = store.join(shared, "hash", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
    )
    at = (
        base.select("row", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
        .withColumn("hash", hashed(F.col("chunk")))
        .join(ranks.select("hash", "chunk", "rank"), ["hash", "chunk"])
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    )
    return staged(
        listed(base)
        .join(at, "row", "left")
        .select(
            "doc_id",
            "row",
            "text_sha256",
            F.transform(
                "ids", lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.col("ranks")[i], F.lit(0)).alias("rank"))
            ).alias("ids"),
            *carry,
        ),
        "ranked-recipes",
    )


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed=chunk_hash, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, and
    the columns of docs that ``carry`` names."""
    lists = recipes(docs, doc_id, text, hashed, carry)
    # Stored, so that the join deals both sides out afresh and adaptive execution can
    # split a group that holds much of the table.
    groups = staged(
        lists.groupBy("ids").agg(
            F.max("doc_id").alias("keep_id"),
            F.max_by("row", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).alias("keep_row"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "copies",
    )
    return lists.join(groups, "ids").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        F.size("ids").cast("long").alias("n_chunks"),
        *carry,
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


#: As the operator has it, of rows repeated with the largest doc_id of a group one stays, and
#: of groups without any doc_id as well; the given ids are unique.
ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
