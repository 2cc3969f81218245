"""Command line over a store: ``python -m weftgraph STORE COMMAND ...``, JSON lines out."""

from __future__ import annotations

import argparse
import os
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from weftgraph.engine import GraphEngine
from weftgraph.export import graph_json, sequence_diagram
from weftgraph.indexing import index_tree
from weftgraph.store import GraphStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("store", help="folder of the store")
    p.add_argument("--most", type=int, default=100, help="rows to print")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a, **({"nargs": "+"} if a.endswith("s") else {}))
        for o, default in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", type=type(default) if default is not None else str, default=default)

    add("index", "root", "repo")
    add("snapshot", "name")
    add("forget", "repos")
    for name in ("overview", "module-edges", "shared-state", "coverage", "outline", "notes", "rules", "neighbors", "export"):
        add(name)
    add("search", "text")
    add("find-flows", "text")
    add("impact", "node", depth=6)
    add("trace", "start", "goal", depth=12)
    add("flows", through=None, kind=None)
    add("flow", "flow_id")
    add("diagram", "flow_id")
    add("context", "nodes", budget=2000)
    add("assess", "action", "nodes", depth=4)
    add("affected-tests", "nodes")
    add("compare", "snapshot")
    add("test-delta", "before", "after")
    add("coupling")
    return p


def answer(e: GraphEngine, a: argparse.Namespace) -> DataFrame | str | None:
    """The rows or text of one command."""
    plain = {
        "overview": e.overview,
        "module-edges": e.module_edges,
        "shared-state": e.shared_state,
        "coverage": e.coverage,
        "outline": e.outline,
        "notes": e.notes,
        "neighbors": e.neighbors,
        "coupling": e.coupling,
    }
    if a.command in plain:
        return plain[a.command]()
    if a.command == "index":
        return index_tree(e.spark, e.store, a.root, a.repo)
    if a.command == "snapshot":
        return e.store.snapshot(a.name)
    if a.command == "forget":
        return e.store.forget(a.repos)
    if a.command == "rules":
        found = e.check_rules()
        return "\n".join(f'{{"rule": {k}, "violations": {df.count()}}}' for k, df in sorted(found.items()))
    if a.command == "search":
        return e.search(a.text, a.most)
    if a.command == "find-flows":
        return e.find_flows(a.text, a.most)
    if a.command == "impact":
        return e.impact(a.node, a.depth).orderBy("dist", "id")
    if a.command == "trace":
        return e.trace(a.start, a.goal, a.depth)
    if a.command == "flows":
        return e.flows(a.through, a.kind)
    if a.command == "flow":
        return e.flow(a.flow_id)
    if a.command == "diagram":
        return sequence_diagram(e.flow(a.flow_id).withColumnRenamed("module_id", "owner"))
    if a.command == "context":
        return e.context(a.nodes, a.budget).orderBy("run")
    if a.command == "assess":
        return e.assess([(n, a.action) for n in a.nodes], a.depth)
    if a.command == "affected-tests":
        return e.affected_tests(a.nodes)
    if a.command == "compare":
        return e.compare(a.snapshot)
    if a.command == "test-delta":
        return e.test_delta(a.before, a.after)
    return graph_json(e.nodes.select("id", "kind", "name"), e.edges.select("kind", "src", "dst"))


def main(argv: list[str], spark: SparkSession | None = None, out: TextIO = sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    path = a.store if "://" in a.store else f"file://{os.path.abspath(a.store)}"
    found = answer(GraphEngine(spark, GraphStore(spark, path)), a)
    if isinstance(found, str):
        print(found, file=out)
    elif found is not None:
        for line in found.limit(a.most).toJSON().collect():
            print(line, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
