import hashlib

import pytest

import corpus_pipeline
from tests.llm.test_counts_packing_sharding import check_packing
from weftgraph.llm import quality, toxicity
from weftgraph.llm.components import least_labels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the driver does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = tmp_path_factory.mktemp("stage").as_uri() + f"/{k}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_classifiers_drop_what_they_reject(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module, before, after, keep in ((quality, 0, 1, 1), (toxicity, 1, 2, 0)):
        model = module.fit(stages[before], labels)
        want = {r.doc_id for r in module.scored(stages[before], model).collect() if r.predicted == keep}
        assert set(texts(stages[after])) == want


def test_exact_stage(stages):
    best = {}
    for i, t in texts(stages[2]).items():
        h = hashlib.sha256((t or "").encode()).digest()
        best[h] = max(best.get(h, i), i)
    assert set(texts(stages[3])) == set(best.values())


def test_near_stage(stages):
    sets = []
    for i, t in sorted(texts(stages[3]).items()):
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    pairs = [
        (a, b)
        for x, (b, sb) in enumerate(sets)
        for a, sa in sets[:x]
        if sa and sb and 100 * len(sa & sb) >= 80 * len(sa | sb)
    ]
    low = least_labels([a for a, _ in pairs], [b for _, b in pairs])
    assert set(texts(stages[4])) == {low.get(i, i) for i, _ in sets}


def test_packing_stage_and_run(spark, stages):
    rows = stages[5].collect()
    used, least = check_packing(rows, {i: [t] for i, t in texts(stages[4]).items()})
    assert used <= least + 3
    again = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def brute_kept(rows, stage):
    """The positions of the rows that a dedup stage keeps at least and at most: of equal
    groups one, of the id that the stage prefers."""
    if stage == "exact dedup":
        groups = {}
        for i, (doc_id, text, *_) in enumerate(rows):
            groups.setdefault(text or "", []).append((doc_id is not None, doc_id or 0, i))
        return sorted(max(g)[:2] for g in groups.values())
    sets = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode("utf-8", "replace").lower().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w and doc_id is not None else None)
    own = [i for i, s in enumerate(sets) if s]
    pairs = [(a, b) for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = least_labels([a for a, _ in pairs], [b for _, b in pairs])
    groups = {}
    for i, (doc_id, *_) in enumerate(rows):
        groups.setdefault(low.get(i, i), []).append((doc_id is None, doc_id or 0))
    return sorted((not n, i) for n, i in (min(g) for g in groups.values()))


@pytest.mark.parametrize("name", ["exact dedup", "near dedup"])
def test_dedup_stages_on_awkward_rows(spark, awkward, name):
    """Null and empty texts, null and repeated ids, long texts, clashing columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == brute_kept(rows, name)


@pytest.mark.parametrize("name", ["quality classifier", "toxicity", "best-fit packing"])
def test_other_stages_on_awkward_rows(spark, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, SF)
    if name == "best-fit packing":
        rows = out.collect()
        assert sum(r.piece == 0 for r in rows) == awkward.count()
    else:
        module = quality if name.startswith("quality") else toxicity
        label, keep = ("quality", 1) if module is quality else ("toxic", 0)
        model = module.fit(awkward, spark.read.parquet(f"{SF}/labels.parquet"), label)
        want = [r.doc_id for r in module.scored(awkward, model).collect() if r.predicted == keep]
        assert out.columns == awkward.columns
        assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, empty, name):
    """Also what a stage gets whose predecessor rejected everything."""
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, SF)
    assert out.collect() == []
    if name != "best-fit packing":
        assert out.columns == empty.columns


@pytest.mark.parametrize("name", ["exact dedup", "near dedup"])
def test_rows_keep_their_identity_when_files_are_split_otherwise(spark, stages, name):
    """The judgement is made under one split size, the rows are taken under another."""
    docs = stages[2].select("*")
    stage = dict(corpus_pipeline.STAGES)[name]
    usual = {r.doc_id for r in stage(spark, docs, SF).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = stage(spark, docs, SF)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert {r.doc_id for r in kept.collect()} == usual
        assert {r.doc_id for r in stage(spark, docs.filter("doc_id >= 0"), SF).collect()} == usual
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    made = spark.createDataFrame(docs.collect(), docs.schema).repartition(5)  # rows of no file
    assert {r.doc_id for r in stage(spark, made, SF).collect()} == usual
