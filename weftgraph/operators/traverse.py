"""Traversal: level by level over edge tables, each level a semi-naive join.

A frontier meets the edges, what was seen before is taken away by an anti-join, and
the new level is written to the shared folder, so lineages stay short and each level
costs its own frontier.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import BROADCAST_ROWS, first_per, staged
from weftgraph.schema import FLOW_DEPTH, FLOW_STEPS_MOST, IMPACT_DEPTH, RESTART, TRACE_DEPTH


def bfs(start: DataFrame, edges: DataFrame, depth: int | None, lift: DataFrame | None = None, until=None) -> DataFrame:
    """(id, dist, prev): nodes reached from start (id) over edges (at, to) within depth.

    ``prev`` is the least node of the level before. ``lift`` (id, outer) lets an enclosing
    node join at the distance of the one inside it. Without depth: until nothing is new;
    with ``until``: at most to the level of that node."""
    kind = start.schema["id"].dataType.simpleString()
    seen = _lifted(
        start.select("id").distinct().select("id", F.lit(0).cast("long").alias("dist"), F.lit(None).cast(kind).alias("prev")), lift
    )
    seen = front = staged(seen, "reached")
    dist = 0
    while depth is None or dist < depth:
        dist += 1
        step = (
            front.select(F.col("id").alias("at"))
            .join(edges.select("at", "to"), "at")
            .groupBy(F.col("to").alias("id"))
            .agg(F.min("at").alias("prev"))
            .select("id", F.lit(dist).cast("long").alias("dist"), "prev")
        )
        front = staged(_lifted(step.join(seen, "id", "left_anti"), lift, seen), "reached")
        size = front.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id") == F.lit(until)).alias("found")).first()
        if not size["n"]:
            break
        seen = seen.unionByName(front)
        if size["found"]:
            break
    return seen


def _lifted(level: DataFrame, lift: DataFrame | None, seen: DataFrame | None = None) -> DataFrame:
    if lift is None:
        return level
    outer = level.join(lift, "id").select(F.col("outer").alias("id"), "dist", F.col("id").alias("prev"))
    outer = outer.groupBy("id").agg(F.min("dist").alias("dist"), F.min("prev").alias("prev")).join(level, "id", "left_anti")
    return level.unionByName(outer if seen is None else outer.join(seen, "id", "left_anti"))


def impact(node, calls: DataFrame, depth: int = IMPACT_DEPTH, edges: DataFrame | None = None, lift: DataFrame | None = None) -> DataFrame:
    """(id, dist) of what a change of node reaches: its callers, theirs and so on."""
    from weftgraph.operators.links import reverse_adjacency

    spark = calls.sparkSession
    kind = calls.schema["src"].dataType.simpleString()
    start = spark.range(1).select(F.lit(node).cast(kind).alias("id"))
    return bfs(start, staged(reverse_adjacency(calls, edges), "adjacency"), depth, lift).select("id", "dist")


def impact_by_module(reached: DataFrame, functions: DataFrame) -> DataFrame:
    return (
        reached.filter("dist > 0")
        .join(functions.select("id", "module_id"), "id")
        .groupBy("module_id")
        .agg(F.count(F.lit(1)).alias("reached"), F.min("dist").alias("nearest"))
    )


def flows_touched(reached: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows with a step in what was reached, with the steps that are."""
    return (
        steps.join(reached.select(F.col("id").alias("fn")), "fn", "left_semi")
        .groupBy("flow_id")
        .agg(F.count(F.lit(1)).alias("steps"))
    )


def reaching(nodes: DataFrame, calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (id) that reach any of the nodes, by distance; no depth limit."""
    back = staged(calls.select(F.col("dst").alias("at"), F.col("src").alias("to")).filter("at <> to").distinct(), "adjacency")
    return bfs(nodes, back, None).select("id", "dist").join(entries.select("id").distinct(), "id", "left_semi")


def shortest_path(start, goal, calls: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """(pos, id) of a shortest path; of several the one over the least nodes, backwards."""
    spark = calls.sparkSession
    kind = calls.schema["src"].dataType.simpleString()
    edges = staged(calls.select(F.col("src").alias("at"), F.col("dst").alias("to")).filter("at <> to").distinct(), "adjacency")
    reached = bfs(spark.range(1).select(F.lit(start).cast(kind).alias("id")), edges, depth, until=goal)
    last = reached.filter(F.col("id") == goal).select("id", "dist").first()
    path = []
    if last:
        # Backwards in one plan: each level, filtered by its distance, meets a single row.
        hops = last["dist"]
        back = spark.range(1).select(F.lit(last["id"]).cast(kind).alias(f"p{hops}"))
        for d in range(hops, 0, -1):
            level = reached.filter(F.col("dist") == d).select(F.col("id").alias(f"p{d}"), F.col("prev").alias(f"p{d - 1}"))
            back = level.join(F.broadcast(back), f"p{d}")
        row = back.first()
        path = [(d, row[f"p{d}"]) for d in range(hops + 1)]
    return spark.createDataFrame(path, f"pos long, id {kind}").orderBy("pos")


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor, dist) for every node of a tree (id, parent_id), itself at 0.

    Distances double each round, so a tree of depth d takes log d rounds; parents that form
    a circle are refused."""
    up = staged(tree.filter("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("dist")), "ancestors")
    reach = 1
    while True:
        if reach > 1 << 16:
            raise ValueError("the parents of some nodes form a circle")
        more = (
            up.filter(F.col("dist") == reach)
            .select("id", F.col("ancestor").alias("mid"))
            .join(up.select(F.col("id").alias("mid"), "ancestor", "dist"), "mid")
            .select("id", "ancestor", (F.col("dist") + reach).alias("dist"))
        )
        more = staged(more, "ancestors")
        if more.isEmpty():
            break
        up, reach = up.unionByName(more), 2 * reach
    return up.unionByName(tree.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("dist")))


def nearest_of_kind(tree: DataFrame, kind: str) -> DataFrame:
    """(id, found): the nearest ancestor of a kind, itself included; tree has id, parent_id, kind."""
    up = ancestors(tree).join(tree.filter(F.col("kind") == kind).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return up.groupBy("id").agg(F.min_by("ancestor", "dist").alias("found"))


def two_cycles(pairs: DataFrame) -> DataFrame:
    """(from_m, to_m), from_m < to_m: units that depend on each other directly.

    One aggregation over unordered pairs instead of a self-join."""
    both = pairs.filter("from_m <> to_m").select(
        F.least("from_m", "to_m").alias("a"), F.greatest("from_m", "to_m").alias("b"), (F.col("from_m") < F.col("to_m")).alias("up")
    )
    return (
        both.groupBy("a", "b")
        .agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d"))
        .filter("u and d")
        .select(F.col("a").alias("from_m"), F.col("b").alias("to_m"))
    )


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on cycles of (at, to): the largest node of each strongly
    connected component names it.

    Nodes without an edge in or out are trimmed; then each node takes the largest label
    that reaches it, and the nodes that reach back to the owner of their label are its
    component. What remains goes round again."""
    left, out = edges.filter("at <> to").select("at", "to").distinct(), None
    while True:
        left = staged(left, "cyclic")
        while True:
            n = left.count()
            trimmed = left.join(left.select(F.col("to").alias("at")), "at", "left_semi").join(
                left.select(F.col("at").alias("to")), "to", "left_semi"
            )
            trimmed = staged(trimmed.select("at", "to"), "cyclic")
            if trimmed.count() == n:
                break
            left = trimmed
        if left.isEmpty():
            break
        label = staged(left.select(F.col("at").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
        while True:
            best = left.join(label, F.col("at") == F.col("id")).groupBy("to").agg(F.max("label").alias("best"))
            new = label.join(best, F.col("id") == F.col("to"), "left").select("id", F.greatest("label", "best").alias("label"))
            new = staged(new, "labels")
            changed = not new.exceptAll(label).isEmpty()
            label = new
            if not changed:
                break
        inside = (
            left.join(label.select(F.col("id").alias("at"), F.col("label").alias("la")), "at")
            .join(label.select(F.col("id").alias("to"), F.col("label").alias("lt")), "to")
            .filter("la = lt")
        )
        inside = staged(inside.select("at", "to", F.col("la").alias("label")), "inside")
        found = staged(label.filter("id = label").select("id", "label"), "component")
        while True:
            more = inside.join(found.select(F.col("id").alias("to"), F.col("label").alias("l")), "to").filter("label = l")
            more = more.select(F.col("at").alias("id"), "label").distinct().join(found, ["id", "label"], "left_anti")
            more = staged(more, "component")
            if more.isEmpty():
                break
            found = found.unionByName(more)
        found = staged(found.select(F.col("id").alias("node"), F.col("label").alias("component")), "component")
        out = found if out is None else out.unionByName(found)
        done = found.select("node")
        left = left.join(done.withColumnRenamed("node", "at"), "at", "left_anti").join(
            done.withColumnRenamed("node", "to"), "to", "left_anti"
        )
    spark = edges.sparkSession
    kind = edges.schema["at"].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    size = out.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return out.join(size.filter("size > 1"), "component").select("node", "component")


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, restart: float = RESTART) -> DataFrame:
    """(id, rank): personalised rank by power iteration over weighted edges (at, to, weight).

    seeds (id, weight) sum to 1. Rank at a node without an edge out goes back to the seeds."""
    total = edges.groupBy("at").agg(F.sum("weight").alias("_total"))
    share = staged(edges.join(total, "at").select("at", "to", (F.col("weight") / F.col("_total")).alias("p")), "transitions")
    seeds = staged(seeds.select("id", F.col("weight").cast("double").alias("s")), "seeds")
    rank = seeds.select("id", F.col("s").alias("rank"))
    for _ in range(rounds):
        moved = rank.join(share, F.col("id") == F.col("at")).groupBy("to").agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        out = rank.join(total.select(F.col("at").alias("id")), "id", "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        rank = staged(
            moved.select(F.col("to").alias("id"), "m")
            .join(seeds, "id", "full")
            .select(
                "id",
                (
                    (1 - restart) * F.coalesce("m", F.lit(0.0)) + (restart + (1 - restart) * out) * F.coalesce("s", F.lit(0.0))
                ).alias("rank"),
            ),
            "rank",
        )
    return rank


def walks(starts: DataFrame, calls: DataFrame, depth: int = FLOW_DEPTH, most: int = FLOW_STEPS_MOST) -> DataFrame:
    """(flow_id, seq, depth, fn, parent_seq, truncated): depth-first walks in call order,
    each callable once a walk, at most ``depth`` deep and ``most`` steps.

    The order of visiting decides what a walk holds, so each is made in one task; but a
    walk of ``most`` steps looks at few of the callables within ``depth``. In rounds, it
    goes as far as the successors it was given allow, then asks for those of the callable
    where it stopped and of others that likely follow; joins bring them. The callable where
    it stopped is always among them, so every round takes it on, and the last one has gone
    the whole way. From round ``depth`` on twice as many are asked for each time, which keeps
    rounds few where the guess is wrong."""
    first = calls.filter("src <> dst").groupBy("src", "dst").agg(F.min("site_start").cast("long").alias("line"))
    # A walk has seen ``most`` callables at most, so one of the first most + 1 ends it.
    ordered = F.sort_array(F.collect_list(F.struct("line", "dst")))
    lists = staged(
        first_per(first, ["src"], ["line", "dst"], most + 1)
        .groupBy(F.col("src").alias("node"))
        .agg(F.transform(ordered, lambda x: x["dst"]).alias("after")),
        "successors",
    )
    mean = lists.agg(F.avg(F.size("after"))).first()[0] or 0.0
    sizes, size = [], 0.0
    for _ in range(depth + 1):
        size = min(1 + mean * size, most)
        sizes.insert(0, size)
    kind, node_type = starts.schema["id"].dataType.simpleString(), calls.schema["src"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = (arrow[kind], pa.int64(), pa.int64(), arrow[node_type], pa.int64(), pa.bool_())
    names = ["flow_id", "seq", "depth", "fn", "parent_seq", "truncated"]

    def walker(least: int):
        def one(flow, entry, following) -> pa.RecordBatch:
            """The steps of a walk; before it is whole, rows without seq: the callables it asks for."""
            out, seen, wanted, ahead, truncated = [], set(), [], 0.0, False
            stack = [(entry, 0, None)]
            while stack:
                node, d, parent = stack.pop()
                if node in seen:
                    continue
                if len(out) == most:
                    truncated = True
                    break
                if len(wanted) >= least and len(out) + ahead >= most:
                    break
                seen.add(node)
                seq = len(out)
                out.append((flow, seq, d, node, parent))
                if d == depth:
                    continue
                if node not in following:
                    wanted.append(node)
                    ahead += sizes[d] - 1
                    continue
                stack += [(n, d + 1, seq) for n in reversed(following[node]) if n not in seen]
            if wanted:
                out = [(flow, None, None, n, None) for n in wanted]
            columns = [*zip(*out, strict=True), [truncated] * len(out)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flow, entry, following = None, None, {}
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for f, node, after, is_entry in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        if f != flow:
                            if flow is not None:
                                yield one(flow, entry, following)
                            flow, entry, following = f, None, {}
                        if is_entry:
                            entry = node
                        elif after is None:
                            following.setdefault(node, ())
                        else:
                            following[node] = after
            if flow is not None:
                yield one(flow, entry, following)

        return walk

    none = F.lit(None).cast(f"array<{node_type}>")
    known = starts.filter("id is not null and entry is not null").select(
        F.col("id").alias("flow_id"), F.col("entry").cast(node_type).alias("node"), none.alias("after"), F.lit(True).alias("is_entry")
    )
    asked, steps, done = known.select("flow_id", "node"), None, 0
    while True:
        # Those asked for without a list have no successors.
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        given = asked.select("flow_id", "node", none.alias("after"), F.lit(False).alias("is_entry")).unionByName(
            lists.join(asked, "node").select("flow_id", "node", "after", F.lit(False).alias("is_entry"))
        )
        known = staged(known.join(asked.select("flow_id"), "flow_id", "left_semi").unionByName(given), "known")
        made = staged(
            known.repartition("flow_id")
            .sortWithinPartitions("flow_id")
            .mapInArrow(
                walker(min(1 << max(0, done - depth), most)),
                f"flow_id {kind}, seq long, depth long, fn {node_type}, parent_seq long, truncated boolean",
            ),
            "walked",
        )
        whole = made.filter("seq is not null")
        steps = whole if steps is None else steps.unionByName(whole)
        asked = made.filter("seq is null").select("flow_id", F.col("fn").alias("node"))
        if asked.isEmpty():
            break
        done += 1
    # What lies at full depth and would have gone on makes its walk a cut one.
    steps = staged(steps, "walks")
    cut = steps.filter(F.col("depth") == depth).join(lists.select(F.col("node").alias("fn")), "fn", "left_semi")
    cut = cut.select("flow_id", F.lit(True).alias("_cut")).distinct()
    return steps.join(cut, "flow_id", "left").select(*names[:-1], F.coalesce("_cut", "truncated").alias("truncated"))


def subtree(tree: DataFrame, root) -> DataFrame:
    """(id, dist) of a node and all below it in a tree (id, parent_id)."""
    kind = tree.schema["id"].dataType.simpleString()
    down = tree.filter("parent_id is not null").select(F.col("parent_id").alias("at"), F.col("id").alias("to"))
    return bfs(tree.sparkSession.range(1).select(F.lit(root).cast(kind).alias("id")), down, None).select("id", "dist")


def label_rounds(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): label propagation over undirected weighted edges (a, b, w): each node
    takes the label of most weight around it, its own counting half a link, the least of
    equals."""
    both = staged(
        edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "undirected"
    )
    label = staged(both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label", "w")
        mine = label.select("id", "label", F.lit(0.5).alias("w"))
        weight = near.unionByName(mine).groupBy("id", "label").agg(F.sum("w").alias("w"))
        pick = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "label"))
        label = staged(weight.withColumn("k", pick).filter("k = 1").select("id", "label"), "labels")
    return label


def explained_path(steps: DataFrame, calls: DataFrame, flow, helpers: int = 8, most: int = 40) -> DataFrame:
    """(seq, fn, callers) of one flow in order, without helpers that many call."""
    callers = calls.groupBy(F.col("dst").alias("fn")).agg(F.countDistinct("src").alias("callers"))
    own = steps.filter(F.col("flow_id") == flow).join(callers, "fn", "left").na.fill(0, ["callers"])
    return own.filter((F.col("callers") < helpers) | (F.col("seq") == 0)).select("seq", "fn", "callers").orderBy("seq").limit(most)


def path_without_data_first(start, goal, calls: DataFrame, channels: DataFrame, depth: int = 16) -> DataFrame:
    """A shortest path over calls alone; only if there is none, over data channels as well."""
    found = shortest_path(start, goal, calls, depth)
    return shortest_path(start, goal, calls.select("src", "dst").unionByName(channels.select("src", "dst")), depth) if found.isEmpty() else found


def only_called_from(calls: DataFrame, named: DataFrame) -> DataFrame:
    """(id): nodes that something else calls, and only nodes of ``named`` (id) do."""
    pairs = calls.filter("src <> dst").select("src", "dst").distinct()
    own = named.select(F.col("id").alias("src"), F.lit(True).alias("_in")).distinct()
    by = pairs.join(own, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all"))
    return by.filter("all").select("id")


def flow_chain(node, steps: DataFrame, flows: DataFrame) -> DataFrame:
    """(pos, src, dst): the calls by which a stored flow comes from its start to a node; of
    several flows an entry's before a test's, then the one that comes there first."""
    spark = steps.sparkSession
    kind = steps.schema["fn"].dataType.simpleString()
    at = steps.filter(F.col("fn") == node).join(flows.select(F.col("id").alias("flow_id"), "kind"), "flow_id")
    best = at.orderBy(F.col("kind") != "entry", "seq", "flow_id").select("flow_id", "seq").first()
    links = []
    if best:
        # One flow has at most FLOW_STEPS_MOST steps.
        own = {r["seq"]: r for r in steps.filter((F.col("flow_id") == best["flow_id"]) & (F.col("seq") <= best["seq"])).collect()}
        seq = best["seq"]
        while own[seq]["parent_seq"] is not None and own[seq]["parent_seq"] in own:
            parent = own[seq]["parent_seq"]
            links.append((own[parent]["fn"], own[seq]["fn"]))
            seq = parent
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(reversed(links))]
    return spark.createDataFrame(rows, f"pos long, src {kind}, dst {kind}")
