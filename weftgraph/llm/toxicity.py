"""Toxicity by weak supervision.

Lexicons are mined from labelled rows: words, word beginnings, and families (several
words on one beginning that make up a share of the text) that occur in toxic documents
far more often than chance allows among as many entries.  They are dealt out over many
voters; pattern voters look at the text itself (shouting, one word over and over,
stretched letters, signs inside words, any dense family, few words), others at how many
different entries a text has and at what it lacks.  A voter that is right no more often
than its class is common is left out.  A generative label model with a hidden class
estimates each voter's vote probabilities by expectation maximisation; voters that say
the same thing within a class are tied in a forest, where a voter's probabilities depend
on the class and on its parent's vote.  The posterior labels train a linear classifier
over the lexicon entries of a text, and that classifier scores every document.

Bounds, all parameters: ``SAMPLE_ROWS`` toxic and twice as many other labelled rows are
drawn, ``ENTRIES`` lexicon entries are kept.  All distinct texts drawn are learned from;
those of one label that share their least word hash (copies, loose copies, now and then
unrelated texts) weigh as much as one text.  Scoring reads every whole text, and the
score depends on the text alone.

Null and empty texts have no entries and get the intercept's score.  With no usable
labels of one class every score is 0.  Repeated rows get one row each; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_value, held_out, labelled_sample, lean, logistic_fit, staged, table

SAMPLE_ROWS = 5_000
ENTRIES = 600
#: Chance finds that are put up with among all entries of a kind that are looked at.
CHANCE = 2.0
#: Least odds of an entry in toxic texts against others.
ODDS = 20.0
BEGINNINGS = range(3, 8)
#: A family is a beginning with two words or more that make up this share of a text.
FAMILY_SHARE = 0.01
VOTERS_PER_KIND = 4
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def entries_of(own: list[str]) -> set[str]:
    """The entries of a text's words: each word, marked by '='; the beginnings of words,
    by their length; and the beginnings of families, marked by '~'."""
    count = Counter(own)
    forms: Counter = Counter()
    share: Counter = Counter()
    for w, n in count.items():
        for k in BEGINNINGS:
            if len(w) < k:
                break
            forms[w[:k]] += 1
            share[w[:k]] += n
    out = {"=" + w for w in count}
    for s, n in forms.items():
        out.add(f"{len(s)}{s}")
        if n > 1 and share[s] >= FAMILY_SHARE * len(own):
            out.add("~" + s)
    return out


def sketch(own: list[str]) -> int:
    """The least hash over a text's longer words: copies and loose copies mostly share it."""
    return min((zlib.crc32(w.encode("utf-8", "replace")) for w in set(own) if len(w) > 4), default=-1)


def grouped_texts(sample: DataFrame) -> DataFrame:
    """(text, label, key) of the sample: each distinct text of a label once, with its sketch.
    All are learned from; texts of one label and sketch count as one together, so that a
    passage that goes round in many copies does not count as many witnesses."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch(tokens(v.as_py())) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["text", "label", "key"])

    return sample.dropDuplicates(["text", "label"]).mapInArrow(lean(keyed), "text string, label int, key long")


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): groups of sample (text, label, key) with the entry, by label."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        at, own = None, set()
        for batch in batches:
            for text, label, key in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                if (label, key) != at or key < 0:  # texts without longer words are no group
                    if at:
                        found[at[0]].update(own)
                    at, own = (label, key), set()
                own |= entries_of(tokens(text.as_py()))
        if at:
            found[at[0]].update(own)
        keys = list(found[0].keys() | found[1].keys())
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([found[k][e] for e in part], pa.int64()) for k in (1, 0))],
                ["entry", "toxic", "clean"],
            )

    return (
        sample.repartition("label", "key")
        .sortWithinPartitions("label", "key")
        .mapInArrow(lean(count), "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def surplus(toxic: Column, clean: Column, share: float) -> Column:
    """Log likelihood ratio of the entry's own toxic share against the sample's share:
    how surely the entry is no chance find among the many that are looked at."""
    n = toxic + clean
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def mined(counted: DataFrame, n_toxic: int, n_clean: int, most: int, chance: float = CHANCE) -> list[str]:
    """The entries that tell most, best first.

    An entry without bearing on the label reaches a log likelihood ratio of x with
    probability exp(-x) or so; of N entries of its kind that occur more than once, one is
    kept if its ratio is at least log(N / chance), whatever the sample's size.
    Of a beginning and a longer beginning or word that covers nearly all its documents,
    the longer is kept; what a kept beginning covers otherwise is left out."""
    share = n_toxic / (n_toxic + n_clean)
    kind = F.substring("entry", 1, 1).alias("kind")
    seen = {r["kind"]: r["n"] for r in counted.filter("toxic + clean > 1").groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = F.lit(float("inf"))
    for k, n in seen.items():
        least = F.when(F.substring("entry", 1, 1) == k, math.log(max(n / chance, 1))).otherwise(least)
    rows = (
        counted.filter("toxic > 1")
        .withColumn("odds", odds)
        .withColumn("worth", surplus(F.col("toxic"), F.col("clean"), share))
        .filter((F.col("odds") >= math.log(ODDS)) & (F.col("worth") >= least))
        .orderBy(F.desc("worth"), "entry")
        .limit(most * 16)
        .collect()
    )
    return pruned([(r["entry"], r["toxic"]) for r in rows])[:most]


def pruned(rows: list[tuple[str, int]]) -> list[str]:
    """Of entries with their numbers of documents, best first, those that say something new."""

    def shorter(name: str) -> set[str]:
        longest = len(name) - 1 if name[0] == "=" else len(name) - 2
        return {f"{'~' if name[0] == '~' else k}{name[1 : k + 1]}" for k in BEGINNINGS if k <= longest}

    inside: dict[str, int] = {}  # by beginning: most documents of a longer entry
    for name, n in rows:
        for at in shorter(name):
            inside[at] = max(inside.get(at, 0), n)
    out: dict[str, None] = {}
    for name, n in rows:
        if name[0] != "=" and inside.get(name, 0) >= 0.85 * n:
            continue
        # A family that tells more than the words and beginnings in it stands for them.
        families = {f"~{name[1 : k + 1]}" for k in BEGINNINGS if k < len(name)}
        if not (shorter(name) | families) & out.keys():
            out[name] = None
    return list(out)


@dataclass
class ToxicityModel:
    entries: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    any_weight: float = 0.0
    intercept: float = -40.0
    voters: list[str] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)
    #: The voter that each voter's table is conditioned on beside the class, or -1.
    parents: list[int] = field(default_factory=list)

    def finder(self):
        """A function from a text's words to the set of indexes of the entries they have."""
        index = {e: i for i, e in enumerate(self.entries)}
        whole = {e[1:]: i for e, i in index.items() if e[0] == "="}
        starts = {n: {e[1:]: i for e, i in index.items() if e[0] == str(n)} for n in BEGINNINGS}
        starts = {n: d for n, d in starts.items() if d}
        families = {n: {e[1:]: i for e, i in index.items() if e[0] == "~" and len(e) == n + 1} for n in BEGINNINGS}
        families = {n: d for n, d in families.items() if d}

        def find(own: list[str]) -> set[int]:
            distinct = set(own)
            found = {whole[w] for w in distinct & whole.keys()}
            for n, d in starts.items():
                found.update([d[s] for s in {w[:n] for w in distinct} & d.keys() if len(s) == n])
            for n, d in families.items():
                forms: dict[str, set[str]] = {}
                for w in distinct:
                    if w[:n] in d:
                        forms.setdefault(w[:n], set()).add(w)
                for s, f in forms.items():
                    if len(f) > 1 and sum([w in f for w in own]) >= FAMILY_SHARE * len(own):
                        found.add(d[s])
            return found

        return find

    def score(self, found: set[int]) -> float:
        z = self.intercept + sum(self.weights[i] for i in found) + (self.any_weight if found else 0.0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


#: Voters on the text itself.
PATTERNS = ["shouting", "one word over and over", "stretched letters", "signs inside words", "a family of any beginning", "few words"]
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SIGNS = re.compile(r"[^\W\d_][@$*!0-9]+[^\W\d_]")


def patterns(text: str | None, own: list[str]) -> list[int]:
    """Whether the text has each of ``PATTERNS``."""
    if not own:
        return [0] * len(PATTERNS)
    letters = [c for c in text if c.isalpha()]
    count = Counter(own)
    share = Counter()
    for w, n in count.items():
        if len(w) > 5:
            share[w[:5]] += n
    return [
        int(len(letters) > 20 and 2 * sum(c.isupper() for c in letters) > len(letters)),
        int(len(own) >= 20 and 5 * count.most_common(1)[0][1] >= len(own)),
        int(bool(STRETCHED.search(text))),
        int(bool(SIGNS.search(text))),
        int(len(own) >= 20 and 50 * max(share.values(), default=0) >= len(own)),
        int(len(own) < 20),
    ]


def votes(found: list[set[int]], sizes: list[int], looks: list[list[int]], entries: list[str]):
    """(names, matrix of -1, 0, 1): lexicon voters say toxic or abstain, and so do voters on
    the text; voters on the number and kinds of entries also say clean."""
    import numpy as np

    kinds = list(dict.fromkeys(e[0] for e in entries))
    rank: Counter = Counter()
    voter_of, names = {}, []
    for i, e in enumerate(entries):
        name = f"lexicon {e[0]}{rank[e[0]] % VOTERS_PER_KIND}"
        rank[e[0]] += 1
        if name not in names:
            names.append(name)
        voter_of[i] = names.index(name)
    n = len(names)
    names += ["several entries", "entries per word", "no entry", *(f"no entry of kind {k}" for k in kinds), *PATTERNS]
    m = np.zeros((len(found), len(names)), dtype=float)
    for row, (own, size, look) in enumerate(zip(found, sizes, looks, strict=True)):
        for i in own:
            m[row, voter_of[i]] = 1
        m[row, n] = 1 if len(own) >= 3 else 0 if own else -1
        m[row, n + 1] = 1 if own and len(own) * 40 >= size else 0
        m[row, n + 2] = -1 if not own else 0
        have = {entries[i][0] for i in own}
        for j, k in enumerate(kinds):
            m[row, n + 3 + j] = 0 if k in have else -1
        m[row, n + 3 + len(kinds) :] = look
    return names, m


def useful(m, y, weights):
    """The voters whose votes are right more often than the class they vote for is common."""
    import numpy as np

    share = float(weights @ y / weights.sum())
    keep = []
    for j in range(m.shape[1]):
        says, contradicts = weights * (m[:, j] == 1), weights * (m[:, j] == -1)
        right = (says @ y + 1.5 * share) / (says.sum() + 1.5)
        clean = (contradicts @ (1 - y) + 1.5 * (1 - share)) / (contradicts.sum() + 1.5)
        if (says.sum() and right >= 2 * share) or (contradicts.sum() and clean > 1 - share):
            keep.append(j)
    return np.array(keep, dtype=int)


def label_model(m, prior: float, weights=None, rounds: int = 30):
    """Posterior of the hidden class for each row of votes, the voters' accuracies, their
    correlations given the class, and each voter's parent.

    First the voters are independent given the class; then a maximum spanning forest of
    their mutual information given the class is laid through those that say the same
    thing, and a voter's table is conditioned on its parent's vote as well, so that what
    two of them say together counts once.  Both are fitted by expectation maximisation.
    """
    import numpy as np

    rows, n = m.shape
    weights = np.ones(rows) if weights is None else weights
    flat = np.zeros((rows, 3 * n))  # a column for each voter and vote
    flat[np.arange(rows)[:, None], 3 * np.arange(n)[None, :] + (m + 1).astype(int)] = 1
    post = np.where((m == 1).any(axis=1), 0.9, 0.02)
    parent = np.full(n, -1)

    def joint(post):
        """Weighted counts of votes of two voters by class: [class][voter, vote, voter, vote]."""
        return [((flat * (weights * w)[:, None]).T @ flat).reshape(n, 3, n, 3) for w in (1 - post, post)]

    def single(counts):
        own = np.arange(n)
        alone = counts[own, :, own, :].diagonal(axis1=1, axis2=2)
        return (alone + 0.1) / (alone.sum(axis=1, keepdims=True) + 0.3)

    def posterior(counts):
        z = np.full(rows, math.log(prior / (1 - prior)))
        codes = (m + 1).astype(int)
        alone = [single(c) for c in counts]
        for j in range(n):
            p = parent[j]
            if p < 0:
                z += (np.log(alone[1][j]) - np.log(alone[0][j]))[codes[:, j]]
            else:
                given = []
                for c, a in zip(counts, alone, strict=True):  # what is rare leans on the voter's own table
                    both = c[p, :, j, :] + a[j][None, :]
                    given.append(np.log(both / both.sum(axis=1, keepdims=True)))
                z += (given[1] - given[0])[codes[:, p], codes[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def forest(counts):
        total = sum(c[0, :, 0, :].sum() for c in counts)
        shared = np.zeros((n, n))
        for c in counts:
            of_class = max(c[0, :, 0, :].sum(), 1e-9)
            a = single(c)
            p = (c + 0.01) / (of_class + 0.09)
            ratio = np.log(p) - np.log(a[:, :, None, None]) - np.log(a[None, None, :, :])
            shared += of_class / total * (p * ratio).sum(axis=(1, 3))
        out, group = np.full(n, -1), list(range(n))
        links: dict[int, list[int]] = {j: [] for j in range(n)}
        pairs = [(shared[i, j], i, j) for i in range(n) for j in range(i + 1, n) if shared[i, j] > 0.01 and 2 * total * shared[i, j] > 20]
        for _, i, j in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            if group[i] != group[j]:
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
                links[i].append(j)
                links[j].append(i)
        seen: set[int] = set()
        for root in range(n):
            todo = [root] if root not in seen else []
            seen.add(root)
            while todo:
                i = todo.pop()
                for j in links[i]:
                    if j not in seen:
                        seen.add(j)
                        out[j] = i
                        todo.append(j)
        return out

    for turn in range(rounds):
        counts = joint(post)
        if turn == rounds // 2:
            parent = forest(counts)
        post = posterior(counts)
    # What is left of each vote beside its expectation given the class.
    expected = [single(c) @ np.array((-1, 0, 1)) for c in joint(post)]
    rest = m - np.outer(1 - post, expected[0]) - np.outer(post, expected[1])
    spread = rest.std(axis=0)
    scaled = np.where(spread > 1e-6, (rest - rest.mean(axis=0)) / np.maximum(spread, 1e-6), 0.0)
    correlation = scaled.T @ scaled / max(1, rows)
    np.fill_diagonal(correlation, 1.0)
    accuracy = [
        float((post @ (m[:, j] == 1) + (1 - post) @ (m[:, j] == -1)) / max(1.0, (m[:, j] != 0).sum())) for j in range(n)
    ]
    return post, accuracy, correlation, parent


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    most: int = ENTRIES,
    chance: float = CHANCE,
) -> ToxicityModel:
    sample, counts = labelled_sample(labels, label, {1: sample_rows, 0: 2 * sample_rows}, doc_id)
    model = ToxicityModel()
    if len(counts) < 2:
        return model
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    drawn = own.join(F.broadcast(sample), "doc_id").select("text", "label")  # at most 3 * sample_rows ids
    drawn = staged(grouped_texts(drawn), "toxicity-sample")
    group = F.when(F.col("key") >= 0, F.col("key"))
    seen = {
        r["label"]: r["n"]
        for r in drawn.groupBy("label")
        .agg((F.count_distinct(group) + F.sum((F.col("key") < 0).cast("int"))).alias("n"))
        .collect()
    }
    if len(seen) < 2:
        return model
    model.entries = mined(entry_counts(drawn), seen[1], seen[0], most, chance)
    find_in = model

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = find_in.finder()
        for batch in batches:
            texts = [v.as_py() for v in batch.column(0)]
            words = [tokens(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sorted(finder(w)) for w in words], pa.list_(pa.int32())),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([patterns(t, w) for t, w in zip(texts, words, strict=True)], pa.list_(pa.int32())),
                    *batch.columns[1:],
                ],
                ["found", "size", "looks", "label", "key"],
            )

    rows = drawn.mapInArrow(lean(find), "found array<int>, size long, looks array<int>, label int, key long").collect()
    learn(model, [(set(r["found"]), r["size"], list(r["looks"]), r["label"], r["key"]) for r in rows], counts[1] / sum(counts.values()))
    return model


def learn(model: ToxicityModel, rows: list[tuple[set[int], int, list[int], int, int]], prior: float) -> None:
    """The label model and the linear classifier of the sample's (entries, words, patterns, label, key)."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (r[3], r[4], r[1], sorted(r[0]), r[2]))
    found, sizes, looks, y, keys = (list(c) for c in zip(*rows, strict=True))
    y = np.array(y, dtype=float)
    in_group = Counter(zip(y.tolist(), keys, strict=True))
    weights = np.array([1.0 if k < 0 else 1 / in_group[v, k] for v, k in zip(y.tolist(), keys, strict=True)])
    names, m = votes(found, sizes, looks, model.entries)
    kept = useful(m, y, weights)
    model.voters, m = [names[j] for j in kept], m[:, kept]
    if not len(kept):
        return
    share = float(weights @ y / weights.sum())
    post, model.accuracies, correlation, parents = label_model(m, share, weights)
    model.correlations, model.parents = correlation.tolist(), parents.tolist()
    x = np.zeros((len(rows), len(model.entries) + 1))
    for i, f in enumerate(found):
        x[i, sorted(f)] = 1
        x[i, -1] = bool(f)
    # The sample holds more toxic rows than the table: weighted back to its shares.
    w = logistic_fit(x, post, weights * np.where(post >= 0.5, prior / share, (1 - prior) / (1 - share)), ridge=0.02)
    model.weights, model.any_weight, model.intercept = w[:-2].tolist(), float(w[-2]), float(w[-1])


def scored(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = by_value(docs.sparkSession, model)  # at most ENTRIES entries
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        finder = own.finder()
        for batch in batches:
            s = [own.score(finder(tokens(v.as_py()))) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lean(run), f"doc_id {id_type}, score double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; texts are not moved."""
    shared = by_value(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        finder = own.finder()
        for batch in batches:
            yield batch.filter(pa.array([own.score(finder(tokens(v.as_py()))) < threshold for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
