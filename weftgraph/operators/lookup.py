"""Finding nodes: by name, by owner, by words; neighbours; flows; selectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import search_words
from weftgraph.runtime import first_per


def resolve_names(asked: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """For each asked name: how many nodes have it, and the node if it is the only one."""
    found = nodes.groupBy(name).agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("_one"))
    return (
        asked.join(found, name, "left")
        .select(
            name,
            F.coalesce("candidates", F.lit(0)).alias("candidates"),
            F.when(F.col("candidates") == 1, F.col("_one")).alias("node"),
        )
    )


def owner_members(nodes: DataFrame, owner: str = "type_id", name: str = "name") -> DataFrame:
    """(owner, name, node): members that their owner's name and their own tell apart."""
    return (
        nodes.groupBy(owner, name)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("node"))
        .filter("_n = 1")
        .select(owner, name, "node")
    )


def like_pattern(text: str) -> str:
    """A pattern that holds the text anywhere, its wildcards escaped."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", text) + "%"


def substring_hits(nodes: DataFrame, text: str, most: int = 20, name: str = "name") -> DataFrame:
    """Nodes whose name holds the text in any case: shorter names first."""
    return nodes.filter(F.col(name).ilike(like_pattern(text))).orderBy(F.length(name), "id").limit(most)


def _begins(t: str):
    return lambda w: F.startswith(w, F.lit(t))


def _equals(t: str):
    return lambda w: w == F.lit(t)


def prefix_and(texts: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """Keys of the texts where every query word begins some word."""
    terms = re.findall(r"[a-z0-9_]+", query.lower())
    own = search_words(F.col(text))
    hit = F.lit(bool(terms))
    for t in terms:
        hit = hit & F.exists(own, _begins(t))
    return texts.filter(hit).select(key)


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf)."""
    return (
        texts.select(key, F.explode(search_words(F.col(text))).alias("token"))
        .groupBy("token", key)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25(texts: DataFrame, query: str, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the texts with any query word.

    Length and term counts come from one pass over the texts; no postings are built."""
    terms = sorted(set(re.findall(r"[a-z0-9_]+", query.lower())))
    own = texts.select(key, search_words(F.col(text)).alias("w")).select(
        key,
        F.size("w").alias("len"),
        *(F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)),
    )
    stats = own.agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    ).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(stats["mean"] or 1.0))))
    return own.withColumn("score", score).filter("score > 0").select(key, "score")


def exact_first(nodes: DataFrame, text: str, most: int, name: str = "name") -> DataFrame:
    """Exact hits in front of substring hits, cut to ``most``."""
    rank = F.when(F.lower(name) == text.lower(), 0).otherwise(1)
    return (
        nodes.filter(F.col(name).ilike(like_pattern(text)))
        .withColumn("rank_", rank.cast("long"))
        .orderBy("rank_", F.length(name), "id")
        .limit(most)
    )


def neighbors_first_n(pairs: DataFrame, n: int) -> DataFrame:
    """(src, dst, sites, total): the first n neighbours of each node, and how many there are."""
    total = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    return first_per(pairs, ["src"], [F.desc("sites"), "dst"], n).drop("_rank").join(total, "src").select("src", "dst", "sites", "total")


def edge_rows(access: DataFrame) -> DataFrame:
    """(src, kind, total, first): per node and edge kind how many, and the first target."""
    return access.groupBy("src", "kind").agg(F.count(F.lit(1)).alias("total"), F.min("field").alias("first"))


def flows_through(steps: DataFrame, flows: DataFrame, node: int | str, kind: str | None = None) -> DataFrame:
    """Flows that run through a node."""
    own = steps.filter(F.col("fn") == node).select(F.col("flow_id").alias("id")).distinct()
    found = flows.join(own, "id", "left_semi")
    return found.filter(F.col("kind") == kind) if kind else found


def flow_detail(steps: DataFrame, functions: DataFrame, flow: int | str, most: int = 400) -> DataFrame:
    """The ordered steps of one flow with their nodes."""
    own = steps.filter(F.col("flow_id") == flow)
    return (
        own.join(functions.select(F.col("id").alias("fn"), "name", "module_id"), "fn")
        .orderBy("seq")
        .limit(most)
    )


def flow_list(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows with their number of steps and distinct callables."""
    size = steps.groupBy(F.col("flow_id").alias("id")).agg(
        F.count(F.lit(1)).alias("steps"), F.countDistinct("fn").alias("callables")
    )
    return flows.join(size, "id", "left").na.fill(0, ["steps", "callables"])


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes by selector: ``module:x``, ``type:x``, ``id:x``, ``path:x`` (equal or below),
    ``*``; comparisons mind case."""
    form, _, value = selector.partition(":")
    if selector == "*":
        return nodes
    by: dict[str, Column] = {
        "module": F.col("module_id") == value if "module_id" in nodes.columns else F.lit(False),
        "type": F.col("type_id") == value if "type_id" in nodes.columns else F.lit(False),
        "id": F.col("id").cast("string") == value,
        "path": (F.col("path") == value) | F.startswith("path", F.lit(value.rstrip("/") + "/")) if "path" in nodes.columns else F.lit(False),
    }
    if form not in by:
        raise ValueError(f"unknown selector: {selector}")
    return nodes.filter(by[form])


def modules_of_tests(files: DataFrame, share: float = 0.8) -> DataFrame:
    """(module_id, tests, files): modules of which at least a share of the files (module_id,
    is_test) are tests, or that are named so."""
    named = F.lower(F.col("module_id").cast("string")).rlike("(^|[./_-])(tests?|specs?)([./_-]|$)")
    by = files.groupBy("module_id").agg(F.count_if("is_test").alias("tests"), F.count(F.lit(1)).alias("files"))
    return by.filter((F.col("tests") >= share * F.col("files")) | named)


def product_code(ids: DataFrame, ancestors: DataFrame, callables: DataFrame, tests: DataFrame) -> DataFrame:
    """(id): callables in or under the given nodes, tests left out; ancestors is (id, ancestor)."""
    inside = ancestors.join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return inside.join(callables.select("id"), "id", "left_semi").join(tests.select("id"), "id", "left_anti")


def purposes(nodes: DataFrame, notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, purpose): a note of a person, else a fresh inferred one, else the declared text
    (id, doc), cut to its first sentence."""
    from weftgraph.functions import first_sentence

    said = notes.filter("layer = 'intent' or not stale").groupBy("id").agg(
        F.max_by("value", F.struct((F.col("layer") == "intent").alias("i"), F.col("value"))).alias("note")
    )
    return (
        nodes.select("id")
        .join(said, "id", "left")
        .join(docs.groupBy("id").agg(F.min("doc").alias("doc")), "id", "left")
        .select("id", first_sentence(F.coalesce("note", "doc")).alias("purpose"))
    )


def source_lines(files: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """(id, first, text, cut): the source of each node (id, path, first, last), at most so
    many lines of it; files has path and text."""
    lines = F.slice(F.split("text", "\n"), F.col("first"), F.least(F.col("last") - F.col("first") + 1, F.lit(most)))
    return nodes.join(files, "path").select(
        "id", "first", F.array_join(lines, "\n").alias("text"), (F.col("last") - F.col("first") + 1 > most).alias("cut")
    )


#: How much a hit counts in a node's name, qualified name and path.
SEARCH_WEIGHTS = {"name": 10.0, "qualified": 3.0, "path": 1.0}


def weighted_hits(nodes: DataFrame, query: str, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): nodes where every query word begins some word of the weighted columns, by
    BM25 over the weighted number of hits.  One pass counts, no postings are built."""
    terms = re.findall(r"[a-z0-9_]+", query.lower())
    words = {c: search_words(F.coalesce(F.col(c), F.lit(""))) for c in weights}
    hits = [sum((F.lit(w) * F.size(F.filter(words[c], _begins(t))) for c, w in weights.items()), F.lit(0.0)) for t in terms]
    length = sum((F.size(x) for x in words.values()), F.lit(0)).cast("double")
    own = nodes.select("id", length.alias("len"), *(h.alias(f"f{i}") for i, h in enumerate(hits)))
    if not terms:
        return own.select("id", F.lit(0.0).alias("score")).limit(0)
    stats = own.agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms)))
    ).first()
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        f, n = F.col(f"f{i}"), stats[f"n{i}"]
        rarity = F.greatest(F.log(F.lit((stats["n"] - n + 0.5) / (n + 0.5))), F.lit(1e-6))
        score = score + rarity * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(float(stats["mean"] or 1.0))))
        every = every & (f > 0)
    return own.filter(every).select("id", score.alias("score"))


def search(nodes: DataFrame, text: str, most: int = 20) -> DataFrame:
    """(id, name, kind, path, score): what the text names exactly (an id, a name, a path or
    the end of one, Owner.name) first, then weighted word hits, or, where there are none,
    names and ids that hold the text."""
    q = text.strip()
    qualified = F.regexp_replace("id", r"^[^:]*:[^:]*:", "")
    own = nodes.select("id", "name", "kind", "path").withColumn("qualified", qualified)
    ends = F.endswith("path", F.lit("/" + q)) & F.col("kind").isin("file", "module")
    owned = F.endswith("qualified", F.lit("." + q)) if "." in q else F.lit(False)
    grade = (
        F.when(F.col("id") == q, 5).when(F.col("path").eqNullSafe(q) & F.col("kind").isin("file", "module"), 4)
        .when(F.col("name") == q, 3).when(ends, 2).when(owned | (F.col("qualified") == q), 1).otherwise(0)
    )
    found = weighted_hits(own, q, SEARCH_WEIGHTS)
    if found.isEmpty():
        held = F.col("name").ilike(like_pattern(q)) | F.col("id").ilike(like_pattern(q))
        found = own.filter(held).select("id", F.lit(0.0).alias("score"))
    rows = own.withColumn("grade", grade if q else F.lit(0)).join(found, "id", "left").filter("score is not null or grade > 0")
    return rows.orderBy(F.desc("grade"), F.desc_nulls_last("score"), F.length("id"), "id").limit(most).select("id", "name", "kind", "path", "score")


def find(nodes: DataFrame, text: str, most: int = 5) -> DataFrame:
    """(id, name, kind, path, outcome): the one node that a text means (``found``), the
    several that it could mean (``candidate``), or what it may have meant (``did you mean``)."""
    q = text.strip()
    qualified = F.regexp_replace("id", r"^[^:]*:[^:]*:", "")
    own = nodes.select("id", "name", "kind", "path", qualified.alias("qualified"))
    named = own.filter((F.col("id") == q) | (F.col("name") == q) | (F.col("path") == q) | (F.col("qualified") == q) | F.endswith("qualified", F.lit("." + q)))
    # An id beats a path, a path a name: only the best kind of match counts.
    grade = F.when(F.col("id") == q, 3).when((F.col("path") == q) & (F.col("kind") == "file"), 2).when(F.col("path") == q, 0).otherwise(1)
    graded = named.withColumn("grade", grade)
    top = graded.agg(F.max("grade").alias("g")).first()["g"]
    if top is not None:
        best = graded.filter(F.col("grade") == top).orderBy(F.length("id"), "id").limit(most + 1)
        n = best.count()
        return best.limit(most).select("id", "name", "kind", "path", F.lit("found" if n == 1 else "candidate").alias("outcome"))
    last = re.split(r"[:.]", q)[-1]
    return search(nodes, last, most).drop("score").withColumn("outcome", F.lit("did you mean"))


def expanded(node, tree: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(section, kind, total, first): one node in detail: what it contains by kind, its edges
    out and in by kind, whom it calls and who calls it; tree has id, parent_id, kind."""
    pairs = calls.select("src", "dst").distinct()
    some = lambda df, section, kind, end: df.groupBy(F.lit(section).alias("section"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("total"), F.min(end).alias("first")
    )
    return (
        some(tree.filter(F.col("parent_id") == node), "contains", F.col("kind"), "id")
        .unionByName(some(edges.filter(F.col("src") == node), "out", F.col("kind"), "dst"))
        .unionByName(some(edges.filter(F.col("dst") == node), "in", F.col("kind"), "src"))
        .unionByName(some(pairs.filter(F.col("src") == node), "calls", F.lit("calls"), "dst"))
        .unionByName(some(pairs.filter(F.col("dst") == node), "called_by", F.lit("calls"), "src"))
    )
