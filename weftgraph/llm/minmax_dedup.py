"""Near-dedup by min-max hashing, links confirmed on full shingle sets.

Words are runs of other bytes than ASCII white space, A-Z lower-cased; a document's
set holds the distinct runs of ``WORDS`` words.  Each of ``PERMUTATIONS`` hash
functions keeps its least and its greatest value over the set: two unbiased samples
of the resemblance for one evaluation.  Bands of ``ROWS`` values bring candidates
together; a pair at resemblance 0.8 shares none of the 32 bands with probability
(1 - 0.8 ** 4) ** 32, below 1e-7.

Documents with equal sets are one class.  A shingle that no other candidate has can be
in no intersection, so a class with fewer than 0.8 n shared shingles of n has no
link and leaves.  Of the others, in each bucket of a band every class is first checked
against one class of the bucket, over and over while that closes buckets, which joins up
most groups with a pair per class.  What then still lies in different groups of a bucket
is compared with each other where the bucket lies, in blocks of bounded size that emit a
spanning forest of their links and never pairs; so no candidate is left out, however
large its bucket.  Blocks hold classes of like set sizes, and those of the bucket's main
group apart: blocks whose sizes differ too much for a link, and blocks of that group among
themselves, do not meet.  Every check intersects two full sets.

Null, empty and blank texts have no set, link with nothing and stay, and so do rows
with a null id.  Repeated rows are copies: one stays.  Extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import lean, slices, staged, table
from weftgraph.llm.components import connected_components

WORDS = 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
PERMUTATIONS, ROWS = 64, 4
#: Least rounds of one class against its bucket; they go on while a round leaves at most this
#: share of the memberships in buckets with several groups.
STAR_ROUNDS, PROGRESS = 2, 0.6
#: Classes of a bucket that one block holds, of some thousand shingles each at most on
#: average; blocks meet in pairs.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000


class WordHashes(dict):
    """64-bit hashes of words, kept for those met before."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def finalized(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS):
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np

    own = text.encode("utf-8", "replace").lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter([hashes[w] for w in own], np.uint64, len(own))
    n = min(words, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(own) - n + 1 + k]
    return np.unique(finalized(out))


def seeds(n: int):
    """Odd multipliers and masks of the hash functions."""
    import numpy as np

    x = finalized(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return x[:n] | np.uint64(1), x[n:]


def band_keys(sets: list, permutations: int = PERMUTATIONS, rows: int = ROWS):
    """A row of band hashes for each non-empty set."""
    import numpy as np

    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    factor, mask = seeds(permutations)
    values = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        x = (flat ^ mask[k]) * factor[k]
        values[:, 2 * k] = np.minimum.reduceat(x, starts)
        values[:, 2 * k + 1] = np.maximum.reduceat(x, starts)
    bands = 2 * permutations // rows
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
    for r in range(rows):
        keys = finalized(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows])
    return keys.astype(np.int64)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of docs (doc_id, text, more): doc_id, n_shingles, s1, s2 (a 128-bit hash of the set), bands, more."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    carried = docs.columns[2:]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [shingle_set(v.as_py(), hashes, words) for v in batch.column(1)]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if some:
                    for i, k in zip(some, band_keys([sets[i] for i in some]), strict=True):
                        bands[i] = k
                both = np.array([[x >> 64, x & (2**64 - 1)] for x in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(both[:, k].astype(np.int64)) for k in (0, 1)),
                        pa.array(bands, pa.list_(pa.int64())),
                        *batch.columns[2:],
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", *carried],
                )

    return docs.mapInArrow(lean(sign), f"doc_id {id_type}, n_shingles long, s1 long, s2 long, bands array<long>{more}")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, n, shingles): the sets of the wanted (cls, doc_id, s1, s2), from their texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [shingle_set(v.as_py(), hashes, words) for v in batch.column(1)]
                both = np.array([[x >> 64, x & (2**64 - 1)] for x in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array(both[:, k].astype(np.int64)) for k in (0, 1)),
                        pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "s1", "s2", "shingles"],
                )

    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(lean(hashed), f"doc_id {id_type}, s1 long, s2 long, shingles array<long>")
    # Rows repeated with their id and text give the same set: one of them is enough.
    return (
        sets.join(wanted, ["doc_id", "s1", "s2"])
        .dropDuplicates(["cls"])
        .select("cls", F.size("shingles").cast("long").alias("n"), "shingles")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets resemble each other enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", shared)
        .filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
        .select("a", "b")
    )


def block_links(open_: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes of different components in one bucket, of
    (key, cls, n, component, group, members, shingles): each pair that can link is compared, a spanning forest returned."""
    import numpy as np

    # A cell of a bucket holds sets of like sizes, of the bucket's main group or not.  Sets
    # that link differ in size by 100 / percent at most, so by one cell's width.  A bucket
    # that fits one block is one cell.
    width = math.log(100 / percent * 1.01)
    own_cell = 2 * F.floor(F.log("n") / width) + (F.col("component") == F.col("group")).cast("int")
    fits = (F.col("members") <= block) & (F.col("shingles") <= BLOCK_SHINGLES)
    celled = open_.select("key", "cls", "component", "n", F.when(fits, 0).otherwise(own_cell).cast("long").alias("cell"))
    cells = staged(
        celled.groupBy("key", "cell").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        ),
        "bucket-cells",
    )
    near, main = F.abs(F.expr("a.cell div 2 - b.cell div 2")) <= 1, (F.col("a.cell") % 2 == 1) & (F.col("b.cell") % 2 == 1)
    partners = (
        cells.alias("a")
        .join(cells.alias("b"), F.col("a.key") == F.col("b.key"))
        .filter(near & ~main)
        .groupBy(F.col("a.key").alias("key"), F.col("a.cell").alias("cell"), F.col("a.blocks").alias("blocks"))
        .agg(F.collect_list(F.struct(F.col("b.cell").alias("cell"), F.col("b.blocks").alias("blocks"))).alias("partners"))  # at most six
    )
    # Each pair of blocks meets on its own, so that no task gets a whole large bucket.
    block_id = lambda cell, at: F.shiftleft(cell, 24) + at
    own = block_id(F.col("cell"), F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = (
        celled.join(partners, ["key", "cell"])
        .select("key", "cls", "component", own.alias("own"), F.explode("partners").alias("p"))
        .select("key", "cls", "component", "own", "p.cell", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("at"))
        .withColumn("other", block_id(F.col("cell"), F.col("at")))
        .select(
            "key",
            F.least("own", "other").alias("part"),
            F.greatest("own", "other").alias("with"),
            (F.col("own") <= F.col("other")).cast("int").alias("core"),
            "cls",
            "component",
        )
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, core rows first."""
        key, core, index, parent, found = None, [], None, {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def indexed():
            flat = np.concatenate([c[2] for c in core])
            at = np.repeat(np.arange(len(core)), [len(c[2]) for c in core])
            order = np.argsort(flat, kind="stable")
            words, starts = np.unique(flat[order], return_index=True)
            return words, np.append(starts, len(flat)), at[order], np.array([len(c[2]) for c in core])

        def check(cls, component, shingles, below):
            """Against the core classes before ``below``."""
            words, starts, at, sizes = index
            pos = np.searchsorted(words, shingles)
            pos = pos[pos < len(words)] if len(pos) and pos[-1] >= len(words) else pos
            pos = pos[words[pos] == shingles[: len(pos)]]
            if not len(pos):
                return
            n = starts[pos + 1] - starts[pos]
            both = np.zeros(len(core), np.int64)
            ends = np.cumsum(n)
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends // 1_000_000)) + 1):
                m = n[part]
                picks = np.repeat(starts[pos[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                both += np.bincount(at[picks], minlength=len(core))
            for k in np.flatnonzero(100 * both >= percent * (sizes + len(shingles) - both)):
                if k < below:
                    x, y = root(cls), root(core[k][0])
                    if x != y and core[k][1] != component:
                        parent[max(x, y)] = min(x, y)
                        found.append((cls, core[k][0]))

        def close():
            """Index the core; within one block its classes meet each other."""
            nonlocal index
            if core and index is None:
                index = indexed()
                if key[1] == key[2]:
                    for k, c in enumerate(core):
                        check(*c, k)

        def rows():
            a, b = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys, parts, others, cores, ids, components = (batch.column(i).to_pylist() for i in range(6))
            flat = batch.column(6)
            for i, name in enumerate(zip(keys, parts, others, strict=True)):
                if name != key:
                    close()
                    key, core, index, parent = name, [], None, {}
                shingles = flat[i].values.to_numpy()
                if cores[i]:
                    core.append((ids[i], components[i], shingles))
                elif core:
                    close()
                    check(ids[i], components[i], shingles, len(core))
            if found:
                yield rows()
        close()
        if found:
            yield rows()

    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.join(sets.select("cls", F.array_sort("shingles").alias("shingles")), "cls")
        .select("key", "part", "with", "core", "cls", "component", "shingles")
        .repartition(n, "key", "part", "with")
        .sortWithinPartitions("key", "part", "with", F.desc("core"))
        .mapInArrow(lean(compare), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, and the columns of docs
    that ``carry`` names.  Of a group one row of the least doc_id is kept."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with_more = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *carry)
    rows = staged(signed(with_more, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    linkable = rows.filter("n_shingles > 0 and doc_id is not null")
    kinds = staged(
        linkable.groupBy("n_shingles", "s1", "s2")
        .agg(F.min("doc_id").alias("first_id"), F.min_by("row", "doc_id").alias("first_row"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "set-classes",
    )
    banded = linkable.join(kinds.select("cls", F.col("first_row").alias("row")), "row").select(
        "cls", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")
    )
    shared = staged(
        banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key"), "shared-bands"
    )
    members = staged(banded.join(shared, "key").select("key", "cls", "n"), "band-members")
    wanted = kinds.join(members.select("cls").distinct(), "cls", "left_semi")
    sets = staged(full_sets(own, wanted.select("cls", F.col("first_id").alias("doc_id"), "s1", "s2"), words), "shingle-sets")

    # The shingles of each class that another candidate has as well.
    lone = (
        sets.select("cls", F.explode("shingles").alias("h"))
        .groupBy("h")
        .agg(F.min("cls").alias("cls"), F.count(F.lit(1)).alias("k"))
        .filter("k = 1")
        .groupBy("cls")
        .agg(F.count(F.lit(1)).alias("lone"))
    )
    members = staged(
        members.join(staged(lone, "lone-shingles"), "cls", "left")
        .select("key", "cls", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("c"))
        .filter(100 * F.col("c") >= percent * F.col("n")),
        "members",
    )
    links, labels = None, None
    star, before, done = 0, None, False
    while not done:
        if labels is None:
            open_ = members.withColumn("component", F.col("cls"))
        else:
            open_ = members.join(labels, F.col("cls") == F.col("node"), "left").select(
                "key", "cls", "n", "c", F.coalesce("component", "cls").alias("component")
            )
        drawn = F.xxhash64(F.lit(star), "cls")
        spread = staged(
            open_.groupBy("key")
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.count(F.lit(1)).alias("members"),
                F.sum("n").alias("shingles"),
                F.min_by("cls", drawn).alias("centre"),
                F.min_by("component", drawn).alias("group"),
            )
            .filter("low < high")
            .drop("low", "high"),
            f"open-bands-{star}",
        )
        left = spread.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]
        if not left:
            break
        open_ = open_.join(spread, "key")
        if star < STAR_ROUNDS or (before is not None and left <= PROGRESS * before):
            nearest = open_.filter("component <> group").groupBy("cls").agg(F.min("centre").alias("centre"))
            pairs = nearest.select(F.greatest("cls", "centre").alias("a"), F.least("cls", "centre").alias("b")).distinct()
            found = staged(confirmed(staged(pairs, "pairs"), sets, percent), "links")
        else:
            found = staged(block_links(open_, sets, percent), "links")
            done = True
        links = found if links is None else links.unionByName(found)
        labels = staged(connected_components(links), "labels")
        star, before = star + 1, left
    if labels is None:
        grouped = kinds.withColumn("component", F.col("cls"))
    else:
        grouped = kinds.join(labels, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    firsts = staged(
        grouped.groupBy("component").agg(
            F.min("first_id").alias("component_id"), F.min_by("first_row", "first_id").alias("kept_row")
        ),
        "first-ids",
    )
    by_set = staged(
        grouped.join(firsts, "component").select("n_shingles", "s1", "s2", "component_id", "kept_row"), "set-components"
    )
    c = by_set.select(F.col("n_shingles").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component_id", "kept_row")
    alone = F.col("component_id").isNull() | F.col("doc_id").isNull()
    return (
        rows.drop("bands")
        .join(c, (F.col("n_shingles") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("kept_row")).alias("kept"),
            *carry,
        )
    )


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
         ) AS w
  FROM documents
), sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), shingle AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)
), reach(a, b) AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least_of AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON a = doc_id
"""
