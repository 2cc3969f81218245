"""One object with a method per question, over a store."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import annotations, change, communities, coverage, history, incremental, links, lookup, patterns, rollup, rules, textrank, traverse
from weftgraph.schema import HISTORY_COMMITS, HISTORY_DAYS, IMPACT_DEPTH, TRACE_DEPTH
from weftgraph.store import GraphStore


class GraphEngine:
    def __init__(self, spark: SparkSession, store: GraphStore, snapshot: str | None = None):
        self.spark, self.store, self._snapshot = spark, store, snapshot

    def _read(self, relation: str) -> DataFrame:
        return self.store.read(relation, self._snapshot)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @cached_property
    def calls(self) -> DataFrame:
        return self._read("calls").select(
            F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "site_start", "dispatch", F.col("precision").alias("precision_")
        )

    @cached_property
    def edges(self) -> DataFrame:
        return self._read("edges").select(
            "kind", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.get_json_object("attrs", "$.channel").alias("channel")
        )

    @cached_property
    def functions(self) -> DataFrame:
        """Callables with their nearest type and module."""
        tree = self.nodes.select("id", "parent_id", "kind")
        own = self.nodes.filter("kind in ('callable', 'test')")
        return (
            own.join(traverse.nearest_of_kind(tree, "type").withColumnRenamed("found", "type_id"), "id", "left")
            .join(traverse.nearest_of_kind(tree, "module").withColumnRenamed("found", "module_id"), "id", "left")
            .select("id", "name", "type_id", "module_id", "path")
        )

    @cached_property
    def flows_(self) -> DataFrame:
        return self._read("flows")

    @cached_property
    def steps(self) -> DataFrame:
        return self._read("flow_steps").select("flow_id", "seq", F.col("callable_id").alias("fn"), "parent_seq")

    @cached_property
    def covered(self) -> DataFrame:
        return self._read("covered").select("test", F.col("node_id").alias("fn"), "lines")

    @cached_property
    def access(self) -> DataFrame:
        return self.edges.filter("kind in ('reads', 'writes')").select("kind", "src", F.col("dst").alias("field"))

    def module_edges(self) -> DataFrame:
        return rollup.module_edges(self.calls, self.functions)

    def overview(self) -> DataFrame:
        return rollup.overview(self.functions, self.calls, self.access)

    def search(self, text: str, most: int = 20) -> DataFrame:
        return lookup.search(self.nodes, text, most)

    def find(self, text: str) -> DataFrame:
        return lookup.find(self.nodes, text)

    def expand(self, text: str) -> DataFrame:
        """One node in detail, by id or by a name that only one node has; else nothing."""
        found = self.find(text).filter("outcome = 'found'").first()
        tree = self.nodes.select("id", "parent_id", "kind")
        return lookup.expanded(found["id"] if found else None, tree, self.edges, self.calls)

    def chain(self, node: str) -> DataFrame:
        return traverse.flow_chain(node, self.steps, self.flows_)

    def process_boundaries(self) -> DataFrame:
        return patterns.process_boundary(self.edges.filter("kind = 'communicates'").withColumn("pipes", F.lit(False)))

    def add_rule(self, kind: str, selector_from: str, selector_to: str | None = None, severity: str = "error", status: str = "proposed") -> int:
        """Record a rule, or give the id of the same one."""
        if kind not in ("forbid", "no_cycle", "must_be_tested"):
            raise ValueError(f"unknown kind of rule: {kind}")
        known = self.store.read("rules")
        same = known.filter((F.col("kind") == kind) & (F.col("selector_from") == selector_from) & F.col("selector_to").eqNullSafe(selector_to)).first()
        if same:
            return same["id"]
        new = (known.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
        self.store.append("rules", self.spark.createDataFrame([(new, kind, selector_from, selector_to, None, severity, status)], known.schema))
        return new

    def add_finding(self, change_id: str, reviewer: str, severity: str, claim: str, evidence: list[str]) -> str:
        """Record a reviewer's claim about known nodes; the same claim has the same id."""
        there = {r["id"] for r in self.nodes.filter(F.col("id").isin(*evidence)).select("id").collect()} if evidence else set()
        if not claim.strip() or set(evidence) - there:
            raise ValueError("a finding needs a claim and evidence that is on the map")
        new = hashlib.sha1(f"{change_id}|{reviewer}|{claim}|{sorted(evidence)}".encode()).hexdigest()[:12]
        known = self.store.read("findings")
        if known.filter(F.col("id") == new).isEmpty():
            row = (new, change_id, reviewer, severity, claim, evidence, "open", None)
            self.store.append("findings", self.spark.createDataFrame([row], known.schema))
        return new

    def write_coverage(self, covered: DataFrame) -> None:
        """Measured lines (run, test, test_id, node_id, lines), in place of those of the same runs."""
        known = self.store.read("covered")
        self.store.write("covered", incremental.replaced(known, covered.select(*known.columns), "run"))

    def neighbors(self, n: int = 100) -> DataFrame:
        return lookup.neighbors_first_n(links.call_pairs(self.calls).select("src", "dst", "sites"), n)

    def impact(self, node: str, depth: int = IMPACT_DEPTH) -> DataFrame:
        outer = self.nodes.filter("kind = 'callable'").select("id", "parent_id").join(
            self.nodes.filter("kind = 'callable'").select(F.col("id").alias("parent_id")), "parent_id"
        )
        return traverse.impact(node, self.calls, depth, self.edges, outer.select("id", F.col("parent_id").alias("outer")))

    def trace(self, start: str, goal: str, depth: int = TRACE_DEPTH) -> DataFrame:
        return traverse.shortest_path(start, goal, self.calls, depth)

    def flows(self, through: str | None = None, kind: str | None = None) -> DataFrame:
        if through is not None:
            return lookup.flows_through(self.steps, self.flows_, through, kind)
        return self.flows_.filter(F.col("kind") == kind) if kind else self.flows_

    def flow(self, flow_id: str) -> DataFrame:
        return lookup.flow_detail(self.steps, self.functions, flow_id)

    def find_flows(self, description: str, most: int = 10) -> DataFrame:
        return textrank.find_flows(self.functions.select("id", "name", F.col("path").alias("group")), description, most)

    def shared_state(self) -> DataFrame:
        return rollup.shared_state(self.access, self.functions)

    def _changes(self, days: int = HISTORY_DAYS, commits: int = HISTORY_COMMITS) -> DataFrame:
        """The recent changes, each path as it is called today."""
        now = history.renamed(self._read("changes"))
        newest = now.agg(F.max("ts").alias("t")).first()["t"]
        last = now.select("commit_seq").distinct().orderBy(F.desc("commit_seq")).limit(commits)
        recent = now if newest is None else now.filter(F.col("ts") >= F.lit(newest) - F.expr(f"interval {days} days"))
        return recent.join(F.broadcast(last), "commit_seq", "left_semi").select(F.col("commit_seq").alias("commit_id"), "path").distinct()

    def coupling(self, **thresholds) -> DataFrame:
        return history.strongest(self._changes(), **thresholds)

    def coverage(self) -> DataFrame:
        return coverage.summary(self.functions, self.covered, self.steps, self.flows_)

    def affected_tests(self, changed: list[str]) -> DataFrame:
        """(test, rank): tests that ran the changed code (1), then those whose flow passes
        changed code that no test ran (2)."""
        own = self.spark.createDataFrame([(c,) for c in changed], "id string")
        return coverage.affected_tests(own, self.covered, self.steps, self.flows_)

    def assess(self, targets: list[tuple[str, str]], depth: int = 4) -> DataFrame:
        return change.assess(self.spark.createDataFrame(targets, "id string, action string"), self.calls, self.access, self.edges, depth)

    def compare(self, snapshot: str) -> DataFrame:
        """Nodes added, removed or edited since a snapshot."""
        keep = F.col("kind").isin("type", "callable", "field", "test")
        before = self.store.read("nodes", snapshot).filter(keep)
        return change.diff(before, self.nodes.filter(keep), ["id"], ["content_hash"])

    def check_rules(self) -> dict[int, DataFrame]:
        """Violations by confirmed rule."""
        out = {}
        for r in self._read("rules").filter("status = 'confirmed'").collect():  # rules are written by people
            if r["kind"] == "forbid":
                out[r["id"]] = rules.forbidden(self.calls, self.functions, r["selector_from"], r["selector_to"])
            elif r["kind"] == "no_cycle":
                out[r["id"]] = rules.cycles(self.calls, self.functions)
            elif r["kind"] == "must_be_tested":
                scope = lookup.select_nodes(self.functions, r["selector_from"])
                out[r["id"]] = rules.must_be_tested(scope, self.steps, self.flows_, self.covered)
        return out

    def test_delta(self, before: str, after: str) -> DataFrame:
        runs = self._read("test_results")
        return change.test_delta(runs.filter(F.col("run") == before), runs.filter(F.col("run") == after))

    def outline(self) -> DataFrame:
        return communities.outline(self.functions)

    def notes(self) -> DataFrame:
        return annotations.notes(self._read("annotations"))

    def context(self, focus: list[str], budget_tokens: int = 2000, rounds: int = 20) -> DataFrame:
        """Nodes around a focus by personalised rank, as many as a token budget holds."""
        w = self.calls.groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.least(F.lit(1.5), F.count(F.lit(1)) * 0.5).alias("weight"))
        both = w.unionByName(w.select(F.col("to").alias("at"), F.col("at").alias("to"), "weight")).groupBy("at", "to").agg(F.max("weight").alias("weight"))
        seeds = self.spark.createDataFrame([(f, 1.0 / len(focus)) for f in focus], "id string, weight double")
        rank = traverse.pagerank(both, seeds, rounds).join(self.nodes.select("id", "name", "path"), "id")
        tokens = (F.length("id") + F.length("name") + F.length(F.coalesce("path", F.lit("")))) / 4
        # No more nodes fit than those of the least size, so only so many of the highest rank are packed.
        least = rank.agg(F.min(tokens).alias("t")).first()["t"] or 1.0
        top = rank.orderBy(F.desc("rank"), "id").limit(int(budget_tokens / max(least, 0.25)) + 1)
        return textrank.budget_pack(top.withColumn("_all", F.lit(1)), "_all", [F.desc("rank"), "id"], tokens, budget_tokens).drop("_all")
