"""Findings and learned decisions, mutation sites, tours, and what compilers confirm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import SIMILAR


def confirmed_links(found: DataFrame, compiler: DataFrame, key: list[str], target: str = "dst") -> DataFrame:
    """(key, target, state): links of the front end (key, target) beside a compiler's:
    confirmed, added by it, or removed where the compiler knows the site and names another."""
    known = compiler.select(*key).distinct().withColumn("_known", F.lit(True))
    a = found.select(*key, target).distinct().withColumn("_f", F.lit(True))
    b = compiler.select(*key, target).distinct().withColumn("_c", F.lit(True))
    both = a.join(b, [*key, target], "full").join(known, key, "left")
    state = (
        F.when(F.col("_f") & F.col("_c"), "confirmed")
        .when(F.col("_c"), "added")
        .when(F.col("_known"), "removed")
        .otherwise("kept")
    )
    return both.select(*key, target, state.alias("state"))


def chosen_sites(sites: DataFrame, most: int = 30, per_line: int = 3) -> DataFrame:
    """Mutation sites (path, line, col, ...): at most ``per_line`` of a line, the first ``most``."""
    k = F.row_number().over(Window.partitionBy("path", "line").orderBy("col"))
    return sites.withColumn("k", k).filter(F.col("k") <= per_line).orderBy("k", "path", "line", "col").limit(most).drop("k")


def mutant_marks(results: DataFrame) -> DataFrame:
    """(scenario, killed, survived, mark) of results (scenario, mutant, status): a mutant is
    killed by a scenario if any of its tests failed on it."""
    one = results.groupBy("scenario", "mutant").agg(F.bool_or(F.col("status") == "fail").alias("dead"))
    return one.groupBy("scenario").agg(
        F.count_if("dead").alias("killed"), F.count_if(~F.col("dead")).alias("survived")
    ).withColumn("mark", F.when(F.col("survived") == 0, "kills all").when(F.col("killed") == 0, "kills none").otherwise("kills some"))


def best_decisions(findings: DataFrame, decisions: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(finding, decision, level, similarity): of the decisions whose scope holds a
    finding's evidence, the closest by level (node, type, file, module), then the most
    similar claim of at least ``least``.

    findings: finding, words, and one column per level; decisions: decision, words, scope,
    level. The join is on (level, scope), so only overlapping pairs are compared."""
    levels = ["node", "type", "file", "module"]
    scopes = findings.select("finding", "words", F.posexplode(F.array(*(F.col(x).cast("string") for x in levels))).alias("rank", "scope"))
    names = F.array(*(F.lit(x) for x in levels))
    own = scopes.withColumn("level", F.element_at(names, F.col("rank") + 1))
    d = decisions.select("decision", F.col("words").alias("w2"), F.col("scope").cast("string").alias("scope"), "level")
    union = F.size(F.array_union("words", "w2"))
    similar = F.when(union > 0, F.size(F.array_intersect("words", "w2")) / union).otherwise(0.0)
    hit = own.join(d, ["level", "scope"]).withColumn("similarity", similar).filter(F.col("similarity") >= least)
    k = F.row_number().over(Window.partitionBy("finding").orderBy("rank", F.desc("similarity"), "decision"))
    return hit.withColumn("k", k).filter("k = 1").select("finding", "decision", "level", "similarity")


def decision_status(hits: DataFrame, least: int = 2) -> DataFrame:
    """(decision, hits, accepted, dismissed, status) of hits (decision, resolution): retired
    after ``least`` accepted findings if they outnumber the dismissed ones."""
    return hits.groupBy("decision").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("resolution") == "accepted").alias("accepted"),
        F.count_if(F.col("resolution") == "dismissed").alias("dismissed"),
    ).withColumn("status", F.when((F.col("accepted") >= least) & (F.col("accepted") > F.col("dismissed")), "retired").otherwise("active"))


def stale_parts(named: DataFrame, members: DataFrame, share: float = 0.5) -> DataFrame:
    """(part, kept, total, stale) of named parts (part, member): stale if less than a share
    of the members is still in the part (members: part, member)."""
    now = members.select("part", "member").distinct().withColumn("_in", F.lit(True))
    return (
        named.select("part", "member").distinct()
        .join(now, ["part", "member"], "left")
        .groupBy("part")
        .agg(F.count_if(F.col("_in").isNotNull()).alias("kept"), F.count(F.lit(1)).alias("total"))
        .withColumn("stale", F.col("kept") < share * F.col("total"))
    )


def task_verdicts(tasks: DataFrame) -> DataFrame:
    """(task, verdict): tasks (task, named, touched, contradicted, proven) by what was
    touched of what they name and their scenarios' verdicts; a tick never counts."""
    c = F.col
    return tasks.select(
        "task",
        F.when(c("contradicted") > 0, "contradicted")
        .when(c("named") == 0, "needs a person")
        .when(c("touched") == 0, "contradicted")
        .when(c("touched") < c("named"), "partial")
        .when(c("proven") > 0, "proven")
        .otherwise("inconclusive")
        .alias("verdict"),
    )


def tour(modules: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(stop, module_id, used_by): a reading list, the modules that most others use first;
    edges are (from_module, to_module)."""
    used = edges.filter("from_module <> to_module").groupBy(F.col("to_module").alias("module_id")).agg(F.countDistinct("from_module").alias("used_by"))
    own = modules.select("module_id").distinct().join(used, "module_id", "left").na.fill(0, ["used_by"])
    top = own.orderBy(F.desc("used_by"), "module_id").limit(most)
    k = F.row_number().over(Window.orderBy(F.desc("used_by"), "module_id"))  # over at most ``most`` rows
    return top.withColumn("stop", k.cast("long"))


def hot_functions(functions: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, flows, callers): how many flows run through each function and who calls it."""
    flows = steps.groupBy(F.col("fn").alias("id")).agg(F.countDistinct("flow_id").alias("flows"))
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return functions.select("id").join(flows, "id", "left").join(callers, "id", "left").na.fill(0, ["flows", "callers"])


def edge_changes(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(src, dst, state) of links gained or lost at changed nodes (id)."""
    from weftgraph.operators.change import diff

    at = changed.select(F.col("id").alias("src"))
    return diff(before.join(at, "src", "left_semi"), after.join(at, "src", "left_semi"), ["src", "dst"])


def unbacked(arrows: DataFrame, links: DataFrame) -> DataFrame:
    """Drawn arrows (src, dst) without a link behind them."""
    return arrows.select("src", "dst").distinct().join(links.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def code_unchanged(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision, state): is the code behind a decision (decision, id, hash) as it was?"""
    now = nodes.select("id", F.col("hash").alias("_now")).distinct()
    own = decisions.join(now, "id", "left")
    state = F.when(F.count_if(F.col("_now").isNull()) > 0, "gone").when(
        F.count_if(F.col("_now") != F.col("hash")) > 0, "changed"
    ).otherwise("unchanged")
    return own.groupBy("decision").agg(state.alias("state"))
