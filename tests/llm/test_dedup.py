import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows
from weftgraph.llm import embedding_dedup, exact_dedup, minmax_dedup
from weftgraph.llm.components import connected_components, least_labels


def components(n, pairs):
    labels = least_labels([a for a, _ in pairs], [b for _, b in pairs])
    return [labels.get(i, i) for i in range(n)]


def check_exact(rows):
    groups = defaultdict(list)
    for i, t in awkward_rows():
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    assert len(rows) == len(awkward_rows())
    kept = defaultdict(int)
    for r in rows:
        g = by_sha[r.text_sha256]
        best = max((i for i in g if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(g))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == best
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact(awkward):
    check_exact(exact_dedup.exact_duplicates(awkward).collect())


def test_exact_with_colliding_hashes(awkward):
    """A hash of seven values: identifiers are told apart by the chunks themselves."""
    check_exact(exact_dedup.exact_duplicates(awkward, hashed=lambda c: F.crc32(c.cast("binary")) % 7).collect())


def test_chunks_make_the_text(awkward):
    rows = awkward.select("text", exact_dedup.chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == (r.text or "")
        assert all(len(x) <= exact_dedup.MOST for x in r.c)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubdlmrnst") for _ in range(rng.randrange(2, 8)))
    shared = " ".join(word() for _ in range(6000))
    spark = awkward.sparkSession
    df = spark.createDataFrame([(1, "A" * 1500 + ". " + shared), (2, "Other start. " * 90 + shared)], "doc_id long, text string")
    assert exact_dedup.chunk_table(df).filter("n > 1").count() >= 3


def test_exact_of_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []


def brute_sets(words):
    sets = []
    for i, t in awkward_rows():
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        own = [w for w in own.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        n = min(words, len(own))
        sets.append((i, {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()))
    return sets


@pytest.mark.parametrize("words", [4, 5])
def test_near(awkward, words):
    sets = brute_sets(words)
    usable = [(i, s) for i, s in sets if s and i is not None]
    pairs = [
        (a, b)
        for b in range(len(usable))
        for a in range(b)
        if 100 * len(usable[a][1] & usable[b][1]) >= 80 * len(usable[a][1] | usable[b][1])
    ]
    component = components(len(usable), pairs)
    low = defaultdict(list)
    for k, c in enumerate(component):
        low[c].append(usable[k][0])
    want = sorted((usable[k][0], len(usable[k][1]), min(low[c])) for k, c in enumerate(component))
    rows = minmax_dedup.near_duplicates(awkward, words=words).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.n_shingles and r.doc_id is not None) == want
    for r in rows:
        if not r.n_shingles or r.doc_id is None:
            assert r.component_id == r.doc_id and r.kept
    kept = [r.component_id for r in rows if r.kept and r.n_shingles and r.doc_id is not None]
    assert sorted(kept) == sorted(min(g) for g in low.values())


def test_near_in_blocks(awkward):
    """Without star rounds and with tiny blocks the same groups come out."""
    usual = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(awkward).collect())
    was = minmax_dedup.STAR_ROUNDS, minmax_dedup.block_links.__defaults__
    minmax_dedup.STAR_ROUNDS, minmax_dedup.block_links.__defaults__ = 0, (80, 4)
    try:
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(awkward).collect()) == usual
    finally:
        minmax_dedup.STAR_ROUNDS, minmax_dedup.block_links.__defaults__ = was


def test_one_large_bucket(spark):
    """Thousands of unlike classes in one bucket, most of them in one group already: all links
    between groups are found, and the group's own blocks do not meet."""
    rng = random.Random(6)
    sets = []
    for i in range(1500):
        if i % 3 and i > 2:  # links at 0.8 exactly and just below, down and up in size
            base = rng.choice(sets)
            k = len(base) // 4
            extra = [rng.getrandbits(62) for _ in range(k + (i % 2))]
            sets.append(sorted(set(base) | set(extra)) if i % 5 else sorted(rng.sample(base, max(1, len(base) - len(base) // 5))))
        else:
            sets.append(sorted(rng.getrandbits(62) for _ in range(rng.choice([3, 5, 20, 50, 100]))))
    sets = [s[:400] for s in sets]
    group = [0 if i % 4 else i for i in range(len(sets))]
    rows = [(7, i, len(s), group[i], 0, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, cls long, n long, component long, group long, shingles array<long>").repartition(3)
    open_ = df.drop("shingles").withColumns({"members": F.lit(len(sets)), "shingles": F.lit(sum(map(len, sets)))})
    found = minmax_dedup.block_links(open_, df.select("cls", "n", "shingles"), 80, 64).collect()
    have = [set(s) for s in sets]
    want = [
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if group[a] != group[b] and 100 * len(have[a] & have[b]) >= 80 * len(have[a] | have[b])
    ]
    assert len(want) > 100 and {tuple(sorted((r.a, r.b))) for r in found} <= set(want)
    joined = lambda pairs: least_labels([a for a, _ in pairs], [b for _, b in pairs])
    same = [(i, 0) for i in range(len(sets)) if group[i] == 0 and i]
    assert joined([*((r.a, r.b) for r in found), *same]) == joined([*want, *same])


def test_near_of_nothing(empty):
    assert minmax_dedup.near_duplicates(empty).collect() == []


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    factor, mask = minmax_dedup.seeds(2000)
    same = np.mean([((a ^ m) * f).min() == ((b ^ m) * f).min() for f, m in zip(factor, mask)])
    same_max = np.mean([((a ^ m) * f).max() == ((b ^ m) * f).max() for f, m in zip(factor, mask)])
    assert same == pytest.approx(0.8, abs=0.04) and same_max == pytest.approx(0.8, abs=0.04)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2200, 2))] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000, 9001 + i) for i in range(500)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    want = least_labels([a for a, _ in pairs], [b for _, b in pairs])
    assert found == {n: c for n, c in want.items() if any(a != b for a, b in pairs if n in (a, b))}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        rows.append((i, rng.normal(size=8).tolist()))
    for i in range(300):
        base = np.array(rows[i % 40][1])
        rows.append((1000 + i, (base + rng.normal(size=8) * 0.15).tolist()))
    rows += [(2000 + i, rows[3][1]) for i in range(150)] + [(3000, rows[3][1]), (3000, rows[3][1])]
    rows += [(4000, [3 * x for x in rows[5][1]]), (4001, [1e-300 * x for x in rows[5][1]]), (4002, [1e300 * x for x in rows[5][1]])]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 5]
    rows += [(5000 + i, v) for i, v in enumerate(odd)] + [(None, rows[3][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit(1)).withColumn("n", F.lit(2))


def test_embeddings(spark, monkeypatch):
    rows, df = vectors(spark)
    monkeypatch.setattr(embedding_dedup.links, "__defaults__", (0.95, 60, 32))  # many cells, many blocks
    found = embedding_dedup.near_duplicates(df.repartition(5)).collect()
    good = {}
    for i, v in rows:
        if i is not None and i < 5000:
            x = np.array(v)
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    match = x @ x.T >= 0.95
    np.fill_diagonal(match, False)
    component = components(len(ids), [(int(a), int(b)) for a, b in np.argwhere(match)])
    want = {i: (int(match[k].sum()), ids[component[k]]) for k, i in enumerate(ids)}
    assert len(found) == len(rows)
    for r in found:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id) == (n, c), r
        assert r.kept == (r.vec_id == c)


def test_embedding_chains_in_one_block(spark):
    """Groups of vectors that each link with their neighbours only, in any order."""
    rng, groups, size = np.random.default_rng(5), 30, 20
    angle = np.arange(size) * 0.3  # neighbours at cosine 0.955, the next at 0.825
    rows = []
    for g in range(groups):
        v = np.zeros((size, 2 * groups))
        v[:, 2 * g], v[:, 2 * g + 1] = np.cos(angle), np.sin(angle)
        rows += [(g * size + k, x.tolist()) for k, x in enumerate(v)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df).collect()
    assert {r.vec_id: r.component_id for r in found} == {i: i // size * size for i, _ in rows}
    assert sum(r.kept for r in found) == groups
    assert all(r.n_links == (1 if r.vec_id % size in (0, size - 1) else 2) for r in found)


def test_embeddings_of_several_lengths(spark, monkeypatch):
    """Each length is compared in itself, whether it has pivots or not."""
    monkeypatch.setattr(embedding_dedup.links, "__defaults__", (0.95, 60, 32))
    rng = np.random.default_rng(9)
    good = {}
    for length, count in ((3, 200), (8, 300), (5, 40), (1, 3), (12, 1)):
        base = rng.normal(size=(max(1, count // 4), length))
        for k in range(count):
            good[len(good)] = base[k % len(base)] + rng.normal(size=length) * (0.15 if k % 3 else 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in good.items()], "vec_id long, embedding array<double>")
    ids = list(good)
    unit = [v / np.linalg.norm(v) for v in good.values()]
    match = np.array([[a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 for b in ids] for a in ids])
    component = components(len(ids), [(int(a), int(b)) for a, b in np.argwhere(match)])
    found = embedding_dedup.near_duplicates(df.repartition(5)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (int(match[i].sum()), component[i]) for i in ids}


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
