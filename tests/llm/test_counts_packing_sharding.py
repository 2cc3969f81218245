import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import packing, sharding, token_counts
from weftgraph.llm.common import BYTE_BPE_JSON, ByteBpe, byte_bpe_paths, staged, tokenizer_path
from tests.llm.conftest import awkward_rows

library = Tokenizer.from_file(tokenizer_path(BYTE_BPE_JSON))


def ids(text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_engine_equals_library_over_code_points():
    bpe = ByteBpe(*byte_bpe_paths())
    points = [chr(i) for i in range(1, 0x3000)] + [chr(i) for i in range(0x3000, 0x110000, 97) if not 0xD800 <= i < 0xE000]
    for c in points:
        text = f"a{c}1 {c} {c}{c}-{c}\nB"
        assert bpe.ids(text).tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_engine_equals_library(text):
    assert ByteBpe_shared.ids(text).tolist() == ids(text)


ByteBpe_shared = ByteBpe(*byte_bpe_paths())


def test_histogram_and_sums(awkward):
    lengths = sorted(len(ids(t)) for _, t in awkward_rows())
    hist = staged(token_counts.length_histogram(awkward), "h")
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    sums = token_counts.suffix_sums(hist)
    for r in sums.collect():
        n = r.n_tokens
        assert r.docs_within == sum(x <= n for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= n)
        assert r.docs_longer == sum(x > n for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.share_within == pytest.approx(r.docs_within / len(lengths))
    for r in token_counts.at_limits(hist, [0, 5, 77, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
        assert r.docs_longer == sum(x > r.context_limit for x in lengths)
    assert token_counts.quantile(sums, 0.5).first().n_tokens == lengths[-(-len(lengths) // 2) - 1]


def test_counts_of_nothing(empty):
    hist = staged(token_counts.length_histogram(empty), "h")
    assert token_counts.suffix_sums(hist).collect() == []
    assert token_counts.at_limits(hist, [10]).first().truncated_total == 0


def check_packing(rows, texts, capacity=1024):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    total = 0
    for doc_id, texts_of in texts.items():
        want = Counter()
        for t in texts_of:
            own = np.array([*ids(t), 2], "<u4")
            total += len(own)
            at = 0
            for k, n in enumerate(packing.piece_lengths(len(own), capacity)):
                want[k, at, n, zlib.crc32(own[at : at + n].tobytes())] += 1
                at += n
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == want
    assert len(by_doc) == len(texts)
    return len(by_sequence), -(-total // capacity)


def test_packing(awkward):
    texts = defaultdict(list)
    for i, t in awkward_rows():
        texts[i].append(t)
    cut = staged(packing.pieces(awkward, with_ids=True), "pieces")
    found = packing.packed(cut)
    used, least = check_packing(found.collect(), texts)
    assert used <= least + 2
    whole = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
    assert sum(map(len, whole.values())) == sum(len(ids(t)) + 1 for _, t in awkward_rows())


def test_packing_of_nothing(empty):
    assert packing.packed(staged(packing.pieces(empty), "pieces")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1))
def test_plan_places_every_piece(histogram):
    runs = packing.plan(histogram, 40)
    seen = Counter()
    for count, items in runs:
        assert sum(items) <= 40 and sum(3 * n > 40 for n in items) <= 2
        for n in items:
            seen[n] += count
    assert seen == Counter(histogram)
    ranks = defaultdict(list)
    for p in packing.places(runs):
        ranks[p["length"]] += range(p["first_rank"], p["last_rank"] + 1)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    histogram = Counter(min(1024, int(rng.lognormvariate(5.3, 1))+1) for _ in range(20_000))
    runs = packing.plan(histogram)
    bound = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert sum(c for c, _ in runs) <= 1.02 * bound


def test_sharding(awkward, spark):
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = awkward.select("doc_id", (F.octet_length(text) + 1).alias("bytes_"), F.crc32(text).alias("crc"), F.col("shard").alias("was"))
    found = sharding.sharded(rows.drop("was"), ["doc_id", "bytes_", "crc"]).collect()
    n = len(awkward_rows())
    assert len(found) == n
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert {s: sorted(x) for s, x in slots.items()} == {s: list(range(k)) for s, k in enumerate(sharding.shard_sizes(n, 16))}
    assert Counter((r.doc_id, r.crc) for r in found) == Counter((i, zlib.crc32((t or "").encode())) for i, t in awkward_rows())


def test_sharding_of_nothing(empty):
    assert sharding.sharded(empty.select("doc_id"), ["doc_id"]).collect() == []


def test_sharding_keeps_columns_of_any_name(awkward, spark, tmp_path):
    """Columns under the names that the operator uses inside, and its own."""
    names = ["key", "id", "at", "part", "rank", "second", "bucket", "in", "start", "cut", "row", "_key", "n"]
    df = awkward.select("doc_id", "text", *(F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))).alias(c) for c in names), F.lit(99).alias("shard"))
    found = sharding.sharded(df, ["doc_id", "text"], 5)
    assert found.columns == [*df.columns[:-1], "shard", "slot"]
    key = lambda r: tuple(str(r[c]) for c in df.columns[:-1])
    assert sorted(map(key, found.collect())) == sorted(map(key, df.collect()))
    path = tmp_path.as_uri() + "/shards"
    sharding.write_shards(df, ["doc_id", "text"], path, 5)
    back = spark.read.parquet(path)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    sizes = Counter(r.shard for r in back.collect())
    assert [sizes[k] for k in range(5)] == sharding.shard_sizes(df.count(), 5)


@pytest.mark.parametrize("n", [10**3, 10**6, 10**9, 10**12])
def test_probabilities_sum_to_one(n):
    """Over all that is not below 1e-30, in the sizes of a cluster's partitions and shards."""
    good, draws = n // 16, n // 1000
    mean = draws * good / n
    wide = int(12 * math.sqrt(mean) + 40)
    ks = range(max(0, int(mean) - wide), min(good, draws, int(mean) + wide) + 1)
    step = max(1, len(ks) // 40_000)  # an equidistant sum of a smooth peak is as exact
    total = step * sum(math.exp(sharding.log_hypergeometric(k, good, n - good, draws)) for k in ks[::step])
    assert total == pytest.approx(1, abs=1e-9)


def test_draws_follow_the_law():
    rng = random.Random(8)
    for good, bad, draws in ((3, 4, 5), (30, 70, 20), (1000, 15_000, 400), (1, 10**6, 10**5)):
        found = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if bad < 10**5 else (
                draws / (good + bad) if k else 1 - draws / (good + bad)
            )
            assert abs(found[k] - 20_000 * p) < 5 * math.sqrt(20_000 * p * (1 - p)) + 5
            assert math.exp(sharding.log_hypergeometric(k, good, bad, draws)) == pytest.approx(p, rel=1e-9, abs=1e-300)


def test_matrix_sums_and_distribution():
    sizes = [7, 0, 30, 13]
    matrix = sharding.communication_matrix(sizes, 4, 1)
    assert [sum(r) for r in matrix] == sizes
    assert [sum(c) for c in zip(*matrix, strict=True)] == sharding.shard_sizes(50, 4)
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.05)
    assert np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.05)
    big = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(300)]
    assert np.mean(big) == pytest.approx(250_000, rel=0.001)
    assert np.std(big) == pytest.approx((10**6 * 0.25 * 0.75) ** 0.5, rel=0.2)
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
