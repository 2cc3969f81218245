"""Comparing graphs, assessing planned changes, and judging what was done."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import base_id
from weftgraph.operators.links import reverse_adjacency
from weftgraph.operators.traverse import bfs
from weftgraph.runtime import staged
from weftgraph.schema import ASSESS_DEPTH, BREAKING, ROLES


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """(keys, state): added, removed, or edited where a value differs; unchanged rows are
    left out. Keys compare null-safely, values too."""
    values = values or []
    b = before.select(*keys, *(F.col(v).alias(f"_b_{v}") for v in values)).distinct().withColumn("_b", F.lit(True))
    a = after.select(*keys, *(F.col(v).alias(f"_a_{v}") for v in values)).distinct().withColumn("_a", F.lit(True))
    edited: Column = F.lit(False)
    for v in values:
        edited = edited | ~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(edited, "edited")
    return b.join(a, keys, "full").withColumn("state", state).filter(F.col("state").isNotNull()).select(*keys, "state")


def resigned(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(before, after): a removed and an added callable of one base id, where each is the
    only one of it."""
    ids_b, ids_a = before.select(key).distinct(), after.select(key).distinct()
    gone = ids_b.join(ids_a, key, "left_anti").select(F.col(key).alias("before"), base_id(F.col(key)).alias("base"))
    new = ids_a.join(ids_b, key, "left_anti").select(F.col(key).alias("after"), base_id(F.col(key)).alias("base"))
    only_gone = gone.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("before")).filter("n = 1")
    only_new = new.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("after")).filter("n = 1")
    return only_gone.drop("n").join(only_new.drop("n"), "base").select("before", "after")


def dependency_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_module, to_module, before_n, after_n) where the counts of links differ."""
    b = before.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("before_n"))
    a = after.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("after_n"))
    return (
        b.join(a, ["from_module", "to_module"], "full")
        .na.fill(0, ["before_n", "after_n"])
        .filter("before_n <> after_n")
    )


def flow_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(flow_id, added, removed): steps (flow_id, fn) that a flow gained and lost."""
    both = diff(before, after, ["flow_id", "fn"])
    return both.groupBy("flow_id").agg(
        F.count_if(F.col("state") == "added").alias("added"), F.count_if(F.col("state") == "removed").alias("removed")
    )


def own_changes(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, lines): changed lines (path, line) of each span that lie in no nested span."""
    hit = lines.join(spans, "path").filter(F.col("line").between(F.col("first"), F.col("last")))
    inner = hit.groupBy("path", "line").agg(F.max_by("id", "first").alias("id"))
    return inner.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))


def assess(targets: DataFrame, calls: DataFrame, access: DataFrame | None = None, edges: DataFrame | None = None, depth: int = ASSESS_DEPTH) -> DataFrame:
    """(id, role, dist) of everything that planned changes (id, action) touch.

    Callers one hop off must be edited where the contract breaks, else are direct; those
    further off indirect. Readers and writers of a changed field likewise. Of several
    roles the first in order counts."""
    broken = F.col("action").isin(*BREAKING)
    near = F.when(broken, "must_edit").otherwise("direct")
    changed = targets.select("id", F.lit("changed").alias("role"), F.lit(0).cast("long").alias("dist"))
    back = staged(reverse_adjacency(calls, edges), "adjacency")
    first = (
        targets.join(back, F.col("id") == F.col("at"))
        .select(F.col("to").alias("id"), near.alias("role"), F.lit(1).cast("long").alias("dist"))
    )
    rows = changed.unionByName(first)
    if access is not None:
        users = targets.join(access, F.col("id") == F.col("field")).select(
            F.col("src").alias("id"), near.alias("role"), F.lit(1).cast("long").alias("dist")
        )
        rows = rows.unionByName(users)
    far = bfs(targets.select("id").distinct(), back, depth).filter("dist > 1")
    rows = rows.unionByName(far.select("id", F.lit("indirect").alias("role"), "dist"))
    order = F.lit(0)
    for i, r in enumerate(ROLES):
        order = F.when(F.col("role") == r, i).otherwise(order)
    rank = rows.withColumn("_order", order.cast("long")).groupBy("id").agg(
        F.min("_order").alias("_order"), F.min("dist").alias("dist")
    )
    names = F.array(*(F.lit(r) for r in ROLES))
    return rank.select("id", F.element_at(names, (F.col("_order") + 1).cast("int")).alias("role"), "dist")


def risks(assessed: DataFrame, functions: DataFrame, tested: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, level, n) of an assessment: reaching outside the modules of the change, code
    without tests, and links that are guesses only."""
    own = assessed.join(functions.select("id", "module_id"), "id")
    home = own.filter("role = 'changed'").select("module_id").distinct()
    outside = own.filter("role in ('must_edit', 'direct')").join(home, "module_id", "left_anti")
    untested = assessed.filter("role = 'changed'").select("id").join(tested.select("id"), "id", "left_anti")
    guesses = pairs.filter("guess").join(assessed.select(F.col("id").alias("src")), "src", "left_semi")
    level = F.when(F.count_if(F.col("role") == "must_edit") > 0, "high").otherwise("medium")
    n = F.count(F.lit(1))
    return (
        outside.agg(F.lit("outside_module").alias("kind"), level.alias("level"), n.alias("n"))
        .unionByName(untested.agg(F.lit("untested").alias("kind"), F.lit("high").alias("level"), n.alias("n")))
        .unionByName(guesses.agg(F.lit("guesses").alias("kind"), F.lit("low").alias("level"), n.alias("n")))
        .filter("n > 0")
    )


def review(predicted: DataFrame, touched: DataFrame, key: str = "id") -> DataFrame:
    """(key, state): as_predicted, not_predicted, untouched."""
    return (
        predicted.select(key).distinct().withColumn("p", F.lit(1))
        .join(touched.select(key).distinct().withColumn("t", F.lit(1)), key, "full")
        .select(
            key,
            F.when(F.col("p").isNull(), "not_predicted").when(F.col("t").isNull(), "untouched").otherwise("as_predicted").alias("state"),
        )
    )


def test_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, delta) of two runs (name, status)."""
    b, a = before.select("name", F.col("status").alias("b")), after.select("name", F.col("status").alias("a"))
    was, now = F.col("b"), F.col("a")
    return b.join(a, "name", "full").select(
        "name",
        F.when(was.isNull() & (now == "fail"), "new_failing")
        .when(was.isNull(), "added")
        .when(now.isNull(), "removed")
        .when((was == "pass") & (now == "fail"), "newly_failing")
        .when((was == "fail") & (now == "pass"), "newly_passing")
        .otherwise("same")
        .alias("delta"),
    )


def scenario_verdicts(scenarios: DataFrame) -> DataFrame:
    """(scenario, verdict) by the decision table, first rule that holds.

    Columns: passed, failed, inconclusive (counts after), measured, ran, reached, asserted,
    failed_before, is_new (booleans)."""
    c = F.col
    return scenarios.select(
        "scenario",
        F.when((c("passed") > 0) & (c("failed") > 0), "partial")
        .when(c("failed") > 0, "contradicted")
        .when(c("passed") == 0, "inconclusive")
        .when(c("measured") & ~c("ran"), "needs a person")
        .when(~c("asserted"), "unasserted")
        .when(c("failed_before") | c("is_new"), "proven")
        .when(c("ran") | c("reached"), "proven")
        .otherwise("needs a person")
        .alias("verdict"),
    )


def removal_verdicts(tasks: DataFrame, nodes_after: DataFrame, calls_after: DataFrame) -> DataFrame:
    """(id, verdict) of removed or renamed (id, renamed_to): still there contradicts, a
    missing new name contradicts, callers left over make it partial, else proven."""
    now = nodes_after.select(F.col("id").alias("n")).distinct()
    callers = calls_after.groupBy(F.col("dst").alias("d")).agg(F.countDistinct("src").alias("callers"))
    return (
        tasks.join(now, F.col("id") == F.col("n"), "left")
        .withColumnRenamed("n", "still")
        .join(now.withColumnRenamed("n", "m"), F.col("renamed_to") == F.col("m"), "left")
        .join(callers, F.col("id") == F.col("d"), "left")
        .select(
            "id",
            F.when(F.col("still").isNotNull(), "contradicted")
            .when(F.col("renamed_to").isNotNull() & F.col("m").isNull(), "contradicted")
            .when(F.coalesce("callers", F.lit(0)) > 0, "partial")
            .otherwise("proven")
            .alias("verdict"),
        )
    )


def gate(facts: DataFrame, blocking: list[str]) -> DataFrame:
    """(kind, n) of the facts that block."""
    return facts.filter(F.col("kind").isin(*blocking)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def renames(before: DataFrame, after: DataFrame, key: str = "id", body: str = "hash") -> DataFrame:
    """(before, after): one gone and one new node of the same body, each alone in it."""
    gone = before.join(after.select(key).distinct(), key, "left_anti").groupBy(body).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("before")
    )
    new = after.join(before.select(key).distinct(), key, "left_anti").groupBy(body).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("after")
    )
    return gone.filter("n = 1").drop("n").join(new.filter("n = 1").drop("n"), body).select("before", "after")


def drift(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, state) of written names against the graph: gone, moved, signature, body, ok.

    Both have id, path, declaration and body hashes; the first difference counts."""
    n = nodes.select("id", *(F.col(c).alias(f"n_{c}") for c in ("path", "declaration", "body")))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    return anchors.join(n.withColumn("there", F.lit(True)), "id", "left").select(
        "id",
        F.when(F.col("there").isNull(), "gone")
        .when(differs("declaration"), "signature")
        .when(differs("path"), "moved")
        .when(differs("body"), "body")
        .otherwise("ok")
        .alias("state"),
    )


def grade(links: DataFrame) -> DataFrame:
    """(tp, fp, fn) of rows (found, true)."""
    p, t = F.col("found"), F.col("true")
    return links.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, with their side; empty if equal as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


#: Lines that are no code of their own, and lines that bring names in.
COMMENT = r"^\s*($|#|//|/\*|\*|--|<!--|[\x22\x27]{3})"
IMPORT = r"^\s*(import\s|from\s+\S+\s+import\s|using\s|#include\s|use\s|require\(|const\s.*=\s*require\(|export\s.*\sfrom\s)"
#: Lines beside task code that belong to it, and the longest run that may name it.
BESIDE, LONGEST_RUN = 2, 15


def explained(nodes: DataFrame, leftover: DataFrame, spans: DataFrame, names: list[str]) -> DataFrame:
    """(id, explained): whether the changed lines of a node that no task covers go with those
    that one does.

    nodes has id, top (a file's top level), first, last; leftover id, line, text; spans id,
    a, b of task code.  Each line must be blank, a comment, an import beside task code, near
    task code, or in a short run of changed lines that names it; and a node that is no top
    level must hold task code."""
    word = "|".join(re.escape(n) for n in names if n)
    says = F.col("text").rlike(rf"(^|[^A-Za-z0-9_$])({word})($|[^A-Za-z0-9_$])") if word else F.lit(False)
    in_order = Window.partitionBy("id").orderBy("line")
    run = Window.partitionBy("id", "run")
    lines = leftover.withColumn("run", F.col("line") - F.row_number().over(in_order))
    lines = lines.withColumn("named", (F.count(F.lit(1)).over(run) <= LONGEST_RUN) & F.max(says).over(run))
    own = nodes.select("id", "top", "first", "last").join(spans, "id")
    held = own.groupBy("id").agg(F.bool_or((F.col("first") <= F.col("a")) & (F.col("b") <= F.col("last"))).alias("holds"))
    # The lines beside each span, so that nearness is an equi-join.
    beside = spans.select("id", F.explode(F.sequence(F.col("a") - BESIDE, F.col("b") + BESIDE)).alias("line")).distinct().withColumn("near", F.lit(True))
    fine = (
        F.col("named")
        | F.col("near").isNotNull()
        | F.col("text").rlike(COMMENT)
        | (F.col("holds").isNotNull() & F.col("text").rlike(IMPORT))
    )
    return (
        lines.join(beside, ["id", "line"], "left")
        .join(held, "id", "left")
        .groupBy("id")
        .agg(F.bool_and(fine).alias("fine"), F.bool_or(F.coalesce("holds", F.lit(False))).alias("holds"))
        .join(nodes.select("id", "top"), "id")
        .select("id", (F.col("fine") & (F.col("top") | F.col("holds"))).alias("explained"))
    )
