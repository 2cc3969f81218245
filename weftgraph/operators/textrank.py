"""Text relevance: words and their weights, similar claims, described flows, budgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import keyword_words, split_words
from weftgraph.runtime import staged


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, distinct_n): words of letters and digits in each text."""
    w = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return texts.select(key, F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct_n"))


def document_frequency(texts: DataFrame, text: str, at_least: int = 1) -> DataFrame:
    """(w, df). Words are made distinct within each text first, so that the exchange
    carries partial counts only and no second distinct is needed."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return (
        texts.select(F.explode(w).alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") >= at_least)
    )


def rarest_words(texts: DataFrame, key: str, text: str, most: int = 3, at_least: int = 2) -> DataFrame:
    """(key, w, df): for each text its rarest words that at least so many texts have."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    own = texts.select(key, F.explode(w).alias("w"))
    df = own.groupBy("w").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= at_least)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("df", "w"))
    return own.join(df, "w").withColumn("k", rank).filter(F.col("k") <= most).select(key, "w", "df")


def shared_words(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """(i, j, inter, uni) of texts (i, text) and (j, text) that share at least ``least``
    distinct words: an inverted-index join on words, no cross join."""
    words = lambda df, key, n: df.select(key, keyword_words(F.col("text")).alias("w")).select(key, F.size("w").alias(n), F.explode("w").alias("w"))
    return (
        words(a, "i", "na")
        .join(words(b, "j", "nb"), "w")
        .groupBy("i", "j", "na", "nb")
        .agg(F.count(F.lit(1)).alias("inter"))
        .filter(F.col("inter") >= least)
        .select("i", "j", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))
    )


def weighted_jaccard(a, b, light: list[str], weight: float = 0.5):
    """Similarity of two word arrays as a column; words in ``light`` count less."""
    common = F.array(*(F.lit(w) for w in light)) if light else F.array().cast("array<string>")
    size = lambda x: F.aggregate(x, F.lit(0.0), lambda s, w: s + F.when(F.array_contains(common, w), weight).otherwise(1.0))
    both, either = size(F.array_intersect(a, b)), size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


#: Endings that are cut, longest first, and what takes their place.
ENDINGS = {
    "ations": "", "ions": "", "ion": "", "ings": "", "ing": "", "ers": "", "er": "", "ors": "", "or": "",
    "ies": "y", "ied": "y", "sses": "ss", "es": "", "ed": "", "s": "",
}
#: Endings that double a last letter (stepping), and letters that stay double.
DOUBLING, STAY_DOUBLE = ("ing", "ed", "er", "ers"), "ls"


def stem(word: str) -> str:
    """A light English stem: saves, saved and saving meet, and so do validate and validator."""
    w = word.lower()
    end = "" if w.endswith("ss") else next((e for e in ENDINGS if w.endswith(e) and len(w) - len(e) >= 3), "")
    if end:
        w = w[: -len(end)] + ENDINGS[end]
    if end in DOUBLING and len(w) > 3 and w[-1] == w[-2] and w[-1] not in STAY_DOUBLE:
        w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def stemmed(x):
    """``stem`` of a column."""
    w = F.lower(x)
    longest = "|".join(f"(?<=^.{{3,99}}){e}" for e in ENDINGS)
    end = F.when(w.endswith("ss"), F.lit("")).otherwise(F.regexp_extract(w, f"({longest})$", 1))
    cut = F.left(w, F.length(w) - F.length(end))
    for e, put in ENDINGS.items():
        if put:
            cut = F.when(end == e, F.concat(cut, F.lit(put))).otherwise(cut)
    double = end.isin(*DOUBLING) & (F.length(cut) > 3) & cut.rlike(rf"([^{STAY_DOUBLE}])\1$")
    once = F.when(double, F.left(cut, F.length(cut) - 1)).otherwise(cut)
    return F.when(once.endswith("e") & (F.length(once) > 3), F.left(once, F.length(once) - 1)).otherwise(once)


def _answers(t: str, synonyms: list[str]):
    """How well a word of a name answers a query word."""

    def value(w):
        same = (w == t) | (stemmed(w) == t)
        also = stemmed(w).isin(*synonyms) if synonyms else F.lit(False)
        return (
            F.when(same, 1.0)
            .when(F.startswith(w, F.lit(t)) & (F.length(w) <= len(t) + 4), 0.8)
            .when(also, 0.6)
            .otherwise(0.0)
        )

    return value


def find_flows(nodes: DataFrame, description: str, most: int = 10, per_group: int = 3, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, score, covered): nodes (id, name, group) for a described behaviour.

    Each query word finds name words exactly (1), as a beginning with at most four more
    letters (0.8) or by a synonym (0.6), weighted by its rarity; covering more of the query
    counts more. At most ``per_group`` results share a group."""
    asked = sorted({stem(w) for w in re.findall(r"[a-z0-9]+", description.lower()) if len(w) > 1})
    own = nodes.select("id", "group", split_words(F.col("name")).alias("w"))
    best = [F.coalesce(F.array_max(F.transform("w", _answers(t, [stem(x) for x in (synonyms or {}).get(t, [])]))), F.lit(0.0)) for t in asked]
    scored = staged(own.select("id", "group", *(b.alias(f"t{i}") for i, b in enumerate(best))), "terms")
    stats = scored.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(asked)))).first()
    raw, covered = F.lit(0.0), F.lit(0)
    for i in range(len(asked)):
        raw = raw + F.col(f"t{i}") * F.log(F.lit(1 + stats["n"] / (1 + stats[f"df{i}"])))
        covered = covered + (F.col(f"t{i}") > 0).cast("int")
    score = raw * (0.4 + covered / F.lit(max(1, len(asked))))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "id"))
    return (
        scored.select("id", "group", score.alias("score"), covered.cast("long").alias("covered"))
        .filter("score > 0")
        .withColumn("k", rank)
        .filter(F.col("k") <= per_group)
        .orderBy(F.desc("score"), "id")
        .limit(most)
        .select("id", "score", "covered")
    )


def budget_pack(items: DataFrame, group: str, order: list, size, budget: int) -> DataFrame:
    """Items of each group in order while their running size keeps to the budget."""
    run = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("run", run.cast("long")).filter(F.col("run") <= budget)


def written_paths(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, path): known paths that a text (key, text) names in full or by an end of whole
    parts that only one known path has."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w.-]+(?:/[\w.-]+)*)"), F.lit(1)))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    asked = texts.select("key", F.explode(words).alias("word")).withColumn("word", F.regexp_replace("word", r"\.+$", ""))
    found = known.select("path", F.explode(ends).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return asked.join(found.filter("n = 1"), "word").select("key", "path").distinct()
