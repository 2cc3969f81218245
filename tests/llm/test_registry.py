"""The queries themselves: those with SQL against DuckDB, the others against plain Python."""

import zlib
from collections import Counter

import duckdb
import pytest

from weftgraph.llm import embedding_dedup, packing, registry
from weftgraph.llm.common import byte_bpe, byte_bpe_paths

SF = "/root/testdata/sf0.01"


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())


@pytest.fixture(scope="module")
def encoded(spark):
    bpe = byte_bpe(byte_bpe_paths())
    return {r.doc_id: bpe.ids(r.text or "").tolist() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts(spark, encoded):
    rows = {r.n_tokens: r for r in registry.QUERIES["op1_token_counts"](spark, SF).collect()}
    lengths = [len(x) for x in encoded.values()]
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        within = [x for x in lengths if x <= n]
        longer = [x for x in lengths if x > n]
        assert (r.n_docs, r.docs_within, r.tokens_within) == (lengths.count(n), len(within), sum(within))
        assert (r.docs_longer, r.tokens_longer) == (len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.share_within == pytest.approx(len(within) / len(lengths))


def test_token_files(spark, encoded):
    rows = {r.doc_id: r for r in registry.QUERIES["op6_token_files"](spark, SF).collect()}
    at = 0
    for i in sorted(encoded):
        ids = [*encoded[i], 0]
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(data))
        at += len(ids)
    assert len(rows) == len(encoded)


def test_packing(spark, encoded):
    rows = registry.QUERIES["op10_packing"](spark, SF).collect()
    places: dict = {}
    pieces: dict = {}
    for r in rows:
        ids = [*encoded[r.doc_id], packing.END_ID][r.start : r.start + r.length]
        assert len(ids) == r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for i, own in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024)
            at += length
        assert at == len(encoded[i]) + 1
    assert len(pieces) == len(encoded)


def test_bpe_words(spark):
    import hashlib

    from tokenizers import Tokenizer

    from weftgraph.llm.common import WORD_BPE_JSON, tokenizer_path

    library = Tokenizer.from_file(tokenizer_path(WORD_BPE_JSON))
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op8_bpe_words"](spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_sharding(spark):
    rows = registry.QUERIES["op9_sharding"](spark, SF).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    shards: dict = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_embedding_join_deals_in_proportion(spark):
    """Five times the vectors make less than seven times the rows, all found through pivots."""
    import numpy as np

    def dealt(n):
        x = np.random.default_rng(n).normal(size=(n, 24))
        x[n // 2 : n // 2 + n // 8] = x[0] + 0.05 * x[n // 2 : n // 2 + n // 8]  # a hot group of near copies
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        _, kinds = embedding_dedup.classes(df, "vec_id", "embedding")
        pairs, balls, spaces = embedding_dedup.dealt(kinds)
        assert len(spaces[24].pivots) >= embedding_dedup.LEAST_PIVOTS
        counted = balls.collect()
        assert len(counted) >= 0.9 * (n // 8)  # counted by the triangle inequality, not compared
        return pairs.count()

    assert dealt(6000) < 7 * dealt(1200)
