import math
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import quality, registry, toxicity
from weftgraph.llm.common import held_out, labelled_sample, logistic_fit

RUDE = ["nastyword", "foulterm", "vileslur"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose, shouting junk, and prose with rude words or words on a rude stem."""
    rng = random.Random(11)
    syllables = ["ba", "den", "ri", "tor", "mel", "si", "gan", "lo", "pu", "fen"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(1500):
        n = rng.randrange(5, 120)
        text = [word() for _ in range(n)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice([*RUDE, "grubl" + word(), "grubl" + word()]))
        text = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "x" * 200_000), (2003, docs[5][1]), (2003, docs[5][1]), (None, "a b c")]
    labels += [(None, 1, 0), (3000, 1, 1), (5, None, None), (2000, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d = d.selectExpr("*", "1 as label", "2 as part", "3.0 as score", "'k' as key")
    return docs, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def truth(docs, rows, value):
    own = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 1500 and r.held_out}
    assert len(own) > 300
    return np.mean([own[i].predicted == value(i) for i in own])


def check_rows(docs, rows):
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    same = [r.score for r in rows if r.doc_id in (5, 2003)]
    assert len(same) == 3 and len(set(same)) == 1


def test_quality(labelled):
    docs, d, labels = labelled
    model = quality.fit(d, labels)
    rows = quality.scored(d, model).collect()
    check_rows(docs, rows)
    assert truth(docs, rows, lambda i: int(i % 4 != 0)) > 0.97
    kept = quality.accepted(d, model)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_quality_of_very_long_texts(spark):
    """Texts far longer than any learned from get the verdict of their parts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(8000)]
    text = lambda good, n: " ".join(rng.choices(words[:4000] if good else words[4000:], k=n))
    docs = [(i, text(i % 2, rng.randrange(20, 200))) for i in range(1200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(d, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int"))
    for good in (0, 1):
        for n in (2_000, 100_000, 350_000):  # from ten times the longest to 3 MB
            long = text(good, n)
            x, start = model.features([long]), model.features([long[:18_000]])
            assert (model.scores(x)[0] >= 0.5) == bool(good)
            # The whole tells the classes apart as well as its start does.
            assert x[0, 0] * start[0, 0] > 0 and abs(x[0, 0]) > 0.5 * abs(start[0, 0]), (n, x, start)
    # Length alone does not carry the score beyond what was learned from.
    assert model.scores(x) == pytest.approx(model.scores(np.c_[x[:, :3], [[model.lengths[1]]]]))


def test_toxicity(labelled):
    docs, d, labels = labelled
    model = toxicity.fit(d, labels)
    assert {"=" + w for w in RUDE} <= set(model.entries) and any("grubl".startswith(e[1:]) for e in model.entries)
    rows = toxicity.scored(d, model).collect()
    check_rows(docs, rows)
    assert truth(docs, rows, lambda i: int(i % 5 == 0)) > 0.97
    kept = toxicity.accepted(d, model)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_fit_is_the_same_in_any_partitions(labelled):
    _, d, labels = labelled
    a, b = toxicity.fit(d, labels), toxicity.fit(d.repartition(7, "text"), labels.repartition(5))
    assert a.entries == b.entries and a.weights == pytest.approx(b.weights)
    a, b = quality.fit(d, labels), quality.fit(d.repartition(7, "text"), labels.repartition(5))
    assert a.good == b.good and a.weights == pytest.approx(b.weights)


@pytest.mark.parametrize("module, value", [(quality, 0.5), (toxicity, 0.0)])
def test_without_labels(labelled, spark, module, value):
    docs, d, labels = labelled
    rows = module.scored(d, module.fit(d, labels.limit(0))).collect()
    assert len(rows) == len(docs) and all(r.score == pytest.approx(value) for r in rows)
    assert module.scored(d.limit(0), module.fit(d, labels.limit(0))).collect() == []
    one = labels.filter("quality = 1 and toxic = 0")
    assert len({round(r.score, 12) for r in module.scored(d, module.fit(d, one)).collect()}) == 1


def test_sample_leaves_held_out_rows(labelled):
    _, _, labels = labelled
    sample, counts = labelled_sample(labels, "quality", {1: 50, 0: 50})
    assert sample.count() == 100 and sample.filter(held_out(F.col("doc_id"))).count() == 0
    assert sum(counts.values()) > 900


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    accurate = [0.95, 0.9, 0.8, 0.7, 0.85]
    m = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accurate], axis=1).astype(float)
    m = np.c_[m, m[:, 3]]  # a voter that copies another
    post, found, correlation, parents = toxicity.label_model(m, 0.3)
    assert found[:3] == pytest.approx(accurate[:3], abs=0.05)
    assert correlation[3, 5] > 0.9 and ((post > 0.5) == y).mean() > 0.95
    # The copy hangs on its original, so what both say counts once.
    assert (parents[3], parents[5]) in ((-1, 3), (5, -1)) and (parents[[0, 1, 2, 4]] == -1).all()
    alone = toxicity.label_model(m[:, :5], 0.3)[0]
    assert np.abs(post - alone).max() < 0.02


def test_useful_voters():
    y = np.array([1, 1, 0, 0, 0, 0, 0, 0], float)
    m = np.array([[1, 0, 1, 0], [1, 0, 0, 0], [0, -1, 0, 0], [0, -1, 1, 0], [0, 0, 1, 0], [0, -1, 1, 0], [0, 0, 1, 0], [0, -1, 1, 0]], float)
    assert toxicity.useful(m, y, np.ones(8)).tolist() == [0, 1]


def brute_toxicity(model, text):
    """The score of one text, from the model's entries and weights alone."""
    own = re.findall(r"\w+", text.lower()) if text else []

    def has(entry):
        kind, rest = entry[0], entry[1:]
        if kind == "=":
            return rest in own
        on = [w for w in own if w.startswith(rest)]
        if kind == "~":
            return len(set(on)) > 1 and len(on) / len(own) >= toxicity.FAMILY_SHARE
        assert len(rest) == int(kind)
        return bool(on)

    hits = [w for e, w in zip(model.entries, model.weights, strict=True) if has(e)]
    return 1 / (1 + math.exp(-(model.intercept + sum(hits) + (model.any_weight if hits else 0.0))))


def brute_quality(model, text):
    import zstandard as zs

    data = (text or "").encode()
    blocks = [data[i : i + quality.BLOCK_BYTES] for i in range(0, max(len(data), 1), quality.BLOCK_BYTES)]

    def size(content):
        dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        return sum(len(zs.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False).compress(b)) for b in blocks)

    g, b, n = size(model.good), size(model.bad), len(data) + 1
    x = [(b - g) / max(g, b), g / n, b / n, min(max(math.log(n), model.lengths[0]), model.lengths[1])]
    x += [v * v for v in x] + [x[0] * x[1], x[0] * x[3]]
    z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("name, module, brute", [("op3_quality", quality, brute_quality), ("op7_toxicity", toxicity, brute_toxicity)])
def test_queries_against_brute_force(spark, name, module, brute):
    """Every row of the query, over a whole table, against a plain scorer of one text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = {r.doc_id: r for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    texts = docs.collect()
    assert len(rows) == len(texts)
    for d in texts:
        r = rows[d.doc_id]
        assert r.score == pytest.approx(brute(model, d.text), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= (0.5 if module is quality else 0.7))


def test_held_out_toxic_texts_are_found(spark):
    """On the larger given table; one toxic text in twenty shows no sign of it there."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = registry.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == v] for v in (1, 0))
    assert len(toxic) > 100 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01
    assert docs.count() > 0


HIDDEN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())

def seen(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("weftgraph") is not None])], ["seen"])

assert not any(r.seen for r in spark.range(4).mapInArrow(seen, "seen boolean").collect())
import corpus_pipeline
from weftgraph.llm import registry
for name in ("op2_embedding_dedup", "op3_quality", "op7_toxicity"):
    assert registry.QUERIES[name](spark, {sf!r}).count() > 0
assert corpus_pipeline.run(spark, {sf!r}).count() > 0
print("ALL WELL")
"""


def test_workers_need_not_have_the_package(tmp_path):
    """The package is on the driver's path only; executors get functions and models by value."""
    root = str(Path(registry.__file__).resolve().parents[2])
    script = tmp_path / "hidden.py"
    script.write_text(HIDDEN.format(root=root, sf="/root/testdata/sf0.001"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL WELL" in done.stdout, done.stderr[-3000:]


def test_logistic_fit():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert logistic_fit(x, y, np.ones(3000)) == pytest.approx([2, -1, 0.5], abs=0.2)
