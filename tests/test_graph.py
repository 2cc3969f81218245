"""Order-dependent and iterative operators on tiny graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph import export, runtime
from weftgraph.operators import change, channels, communities, coverage, history, links, patterns, resolution, rules, textrank, traverse


def calls(spark, pairs, precision="heuristic"):
    rows = [(a, b, i + 1, "static", precision) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, site_start int, dispatch string, precision_ string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_lift_reaches_callers_of_the_enclosing_function(spark):
    c = calls(spark, [("main", "outer")])
    lift = spark.createDataFrame([("inner", "outer")], "id string, outer string")
    assert rows(traverse.impact("inner", c, 6, lift=lift)) == [("inner", 0), ("main", 1), ("outer", 0)]


def test_diamond_with_a_back_edge(spark):
    c = calls(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")])
    assert rows(traverse.shortest_path("A", "D", c)) == [(0, "A"), (1, "B"), (2, "D")]
    assert rows(traverse.shortest_path("A", "Z", c)) == []
    e = c.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    assert rows(traverse.strong_components(e)) == [(x, "D") for x in "ABCD"]
    f = spark.createDataFrame([(1, 1), (2, 2)], "id long, entry long")
    n = calls(spark, [(1, 2)]).select(*(F.col(x).cast("long") if x in ("src", "dst") else F.col(x) for x in ("src", "dst", "site_start", "dispatch", "precision_")))
    assert rows(traverse.walks(f, n), "flow_id", "seq", "fn", "depth", "parent_seq") == [(1, 0, 1, 0, None), (1, 1, 2, 1, 0), (2, 0, 2, 0, None)]


def test_components_of_two_cycles_and_a_tail(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (7, 7)], "at long, to long")
    assert rows(traverse.strong_components(e)) == [(1, 2), (2, 2), (3, 5), (4, 5), (5, 5)]
    assert rows(traverse.strong_components(e.limit(0))) == []


def test_walk_order_depth_and_truncation(spark):
    chain = spark.createDataFrame([(i, i + 1, 1, "static", "exact") for i in range(12)], "src long, dst long, site_start int, dispatch string, precision_ string")
    f = spark.createDataFrame([(0, 0), (9, 9)], "id long, entry long")
    found = traverse.walks(f, chain)
    assert [r[1] for r in rows(found.filter("flow_id = 0").select("seq", "fn"))][:9] == list(range(9))
    assert rows(found.groupBy("flow_id").agg(F.max("depth").alias("d"), F.bool_or("truncated").alias("t"))) == [(0, 8, True), (9, 3, False)]
    two = spark.createDataFrame([(1, 2, 5, "s", "e"), (1, 3, 2, "s", "e"), (3, 2, 1, "s", "e")], "src long, dst long, site_start int, dispatch string, precision_ string")
    order = traverse.walks(spark.createDataFrame([(1, 1)], "id long, entry long"), two).orderBy("seq").collect()
    assert [(r.fn, r.depth, r.parent_seq) for r in order] == [(1, 0, None), (3, 1, 0), (2, 2, 1)]


def walked(entry, after, depth=8, most=300):
    """A walk by plain recursion: its steps, and whether it was cut."""
    steps, seen, cut = [(0, 0, entry, None)], {entry}, False

    def go(node, d, parent):
        nonlocal cut
        if d == depth:
            cut |= bool(after.get(node))
            return
        for n in after.get(node, ()):
            if n not in seen:
                if len(steps) == most:
                    cut = True
                    return
                seen.add(n)
                steps.append((len(steps), d + 1, n, parent))
                go(n, d + 1, len(steps) - 1)

    go(entry, 0, 0)
    return [(*s, cut) for s in steps]


def sites(spark, after):
    found = [(a, b, i) for a, bs in after.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(found, "src long, dst long, site_start int")


@pytest.mark.parametrize("depth, most", [(8, 300), (3, 7), (0, 5), (8, 1)])
def test_walks_equal_plain_recursion(spark, depth, most):
    draw = random.Random(depth)
    # Sparse with circles, dense, a hub with more successors than a walk has steps, a lone chain.
    after = {i: draw.sample([x for x in range(400) if x != i], draw.choice([0, 1, 1, 2, 3])) for i in range(400)}
    after |= {i: draw.sample([x for x in range(1000, 1200) if x != i], 25) for i in range(1000, 1200)}
    after |= {2000: list(range(2001, 2500)), 2001: [2002, 2400, 5], 2002: [2000]}
    after |= {i: [i + 1] for i in range(3000, 3008)}
    after = {a: bs for a, bs in after.items() if bs}
    entries = [*range(0, 40), *range(1000, 1010), 2000, 2001, 2002, 3000, 3001, 9999]
    starts = spark.createDataFrame([(-e, e) for e in entries], "id long, entry long")
    found = traverse.walks(starts, sites(spark, after), depth, most)
    expected = sorted((-e, *s) for e in entries for s in walked(e, after, depth, most))
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_walks_are_given_what_they_look_at_not_all_within_their_depth(spark, monkeypatch):
    draw = random.Random(1)
    after = {i: draw.sample([x for x in range(2000) if x != i], 20) for i in range(2000)}
    written = []

    def staged(df, name):
        out = runtime.staged(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(traverse, "staged", staged)
    starts = spark.createDataFrame([(e, e) for e in range(10)], "id long, entry long")
    assert traverse.walks(starts, sites(spark, after)).count() == 10 * 300
    assert max(n for name, n in written if name != "successors") <= 10 * 300
    assert len(written) < 30


def test_overrides_and_data_channels_in_reverse(spark):
    c = calls(spark, [("caller", "Base.m")])
    e = spark.createDataFrame(
        [("overrides", "Impl.m", "Base.m", None), ("communicates", "writer", "reader", "db"), ("communicates", "sender", "handler", "queue")],
        "kind string, src string, dst string, channel string",
    )
    # A change of the implementation reaches the base, and so its callers.
    assert ("caller", 2) in rows(traverse.impact("Impl.m", c, 6, e))
    assert rows(traverse.impact("writer", c, 6, e)) == [("reader", 1), ("writer", 0)]
    assert rows(traverse.impact("handler", c, 6, e)) == [("handler", 0), ("sender", 1)]


def test_a_pair_is_a_guess_only_if_every_site_is(spark):
    c = calls(spark, [("a", "b")], "guess").unionByName(calls(spark, [("a", "b")])).unionByName(calls(spark, [("a", "c")], "guess"))
    assert rows(links.call_pairs(c), "src", "dst", "sites", "guess") == [("a", "b", 2, False), ("a", "c", 1, True)]


def test_fan_out_guard(spark):
    pairs = spark.createDataFrame([("x", i) for i in range(9)] + [("y", i) for i in range(8)], "address string, n int")
    assert rows(links.fan_out_guard(pairs, "address", 8).select("address").distinct()) == [("y",)]


def test_ancestors_and_subtree(spark):
    t = spark.createDataFrame([(str(i), str(i - 1) if i else None, "module" if i == 2 else "callable") for i in range(20)], "id string, parent_id string, kind string")
    assert traverse.ancestors(t).count() == 20 * 21 // 2
    assert dict(rows(traverse.nearest_of_kind(t, "module")))["19"] == "2"
    assert traverse.subtree(t, "15").count() == 5


def test_two_cliques_are_two_communities(spark):
    clique = lambda xs: [(a, b, 1.0) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    left, right = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    e = spark.createDataFrame([*clique(left), *clique(right), ("a0", "b0", 1.0)], "a string, b string, w double")
    units = spark.createDataFrame([(x, "m") for x in left + right], "id string, module_id string")
    found = communities.communities(e, units)
    labels = dict(rows(found.select("id", "label")))
    assert len(set(labels.values())) == 2 and len({labels[x] for x in left}) == 1
    q = communities.modularity(e, found.select("id", "label")).first()[0]
    assert q > 0.3
    assert all(0.9 < c < 1 for _, c in rows(communities.cohesion(e, found.select("id", "label"))))
    one = spark.createDataFrame([(x, "m") for x in left], "id string, module_id string")
    assert communities.communities(e.filter("a like 'a%' and b like 'a%'"), one, least=2).count() == 0


def test_pagerank_sums_to_one_and_prefers_near_nodes(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0), ("b", "x", 1.0)], "at string, to string, weight double")
    r = dict(rows(traverse.pagerank(e, spark.createDataFrame([("a", 1.0)], "id string, weight double"), 30)))
    assert sum(r.values()) == pytest.approx(1) and r["a"] > r["b"] > r["c"] > r["d"]


def test_coupling_history(spark):
    schema = "commit_seq long, status string, old_path string, path string"
    c = spark.createDataFrame([(1, "M", None, "new.py"), (2, "R", "mid.py", "new.py"), (3, "R", "old.py", "mid.py"), (4, "M", None, "old.py"), (4, "M", None, "x.py")], schema)
    assert {r.path for r in history.renamed(c).collect()} == {"new.py", "x.py"}
    log = spark.createDataFrame([(i, p) for i in range(6) for p in ("rules.py", "docs.md")] + [(9, f"f{k}") for k in range(60)] + [(7, "rules.py")], "commit_id long, path string")
    assert rows(history.bulk_commits(log)) == [(9, 60)]
    assert rows(history.strongest(log)) == [("docs.md", "rules.py", 6, 6)]
    assert rows(history.partners(log, "rules.py")) == [("docs.md", 6, 7)]
    touched = spark.createDataFrame([("rules.py",)], "path string")
    assert rows(history.missed(log, touched)) == [("docs.md", "rules.py", 6)]
    folders = spark.createDataFrame([("a.py", "tests/cases", 4), ("b.py", "tests/cases", 4)], "path string, dir string, together long")
    files = spark.createDataFrame([("a.py", "tests/cases", "one.json", 4)], "path string, dir string, other string, together long")
    assert rows(history.telling_folders(folders, files)) == [("b.py", "tests/cases", 4)]


def test_innermost_span(spark):
    points = spark.createDataFrame([("f", 5), ("f", 12), ("g", 5)], "path string, line int")
    spans = spark.createDataFrame([("f", 1, 20, "outer"), ("f", 4, 6, "inner")], "path string, first int, last int, owner string")
    assert rows(coverage.innermost(points, spans, "line", ["path", "line"], ["path"])) == [("f", 12, "outer"), ("f", 5, "inner")]


def test_change_operators(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(change.resigned(ids("m.f(a)", "m.g(a)", "m.h"), ids("m.f(a,b)", "m.g(x)", "m.g(y)", "m.h"))) == [("m.f(a)", "m.f(a,b)")]
    tasks = spark.createDataFrame([("a", None), ("b", "c"), ("d", None), ("e", "f")], "id string, renamed_to string")
    after = ids("a", "f")
    assert rows(change.removal_verdicts(tasks, after, calls(spark, [("z", "d")]))) == [("a", "contradicted"), ("b", "contradicted"), ("d", "partial"), ("e", "proven")]
    flags = "scenario int, passed int, failed int, measured boolean, ran boolean, reached boolean, asserted boolean, failed_before boolean, is_new boolean"
    table = [
        (1, 1, 1, True, True, True, True, True, False, "partial"),
        (2, 0, 1, True, True, True, True, True, False, "contradicted"),
        (3, 0, 0, True, True, True, True, True, False, "inconclusive"),
        (4, 1, 0, True, False, True, True, True, False, "needs a person"),
        (5, 1, 0, True, True, True, False, True, False, "unasserted"),
        (6, 1, 0, False, False, False, True, True, False, "proven"),
        (7, 1, 0, False, False, True, True, False, False, "proven"),
        (8, 1, 0, False, False, False, True, False, False, "needs a person"),
    ]
    found = change.scenario_verdicts(spark.createDataFrame([t[:-1] for t in table], flags))
    assert rows(found) == [(t[0], t[-1]) for t in table]
    before = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "id string, h string")
    now = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", None)], "id string, h string")
    assert rows(change.diff(before, now, ["id"], ["h"])) == [("w", "added"), ("y", "edited"), ("z", "removed")]
    assert rows(change.differences(before, before)) == []
    targets = spark.createDataFrame([("f", "signature")], "id string, action string")
    roles = {r.id: r.role for r in change.assess(targets, calls(spark, [("a", "f"), ("b", "a"), ("f", "f")])).collect()}
    assert roles == {"f": "changed", "a": "must_edit", "b": "indirect"}


def test_routes(spark):
    routes = spark.createDataFrame([(1, "/items/{id}"), (2, "/items/special"), (3, "/users/<a>"), (4, "/users/:b")], "route int, template string")
    asked = spark.createDataFrame([(1, "http://h/items/special?x"), (2, "/items/3"), (3, "/users/1"), (4, "/none")], "request int, url string")
    assert rows(channels.match_routes(asked, routes)) == [(1, 2), (2, 1)]


def test_topics_tables_files_and_stubs(spark):
    sent = spark.createDataFrame([("p", "a.b.c"), ("q", "a/x/c")], "src string, topic string")
    listen = spark.createDataFrame([("1", "a.b.c"), ("2", "a.*.c"), ("3", "a.#"), ("4", "a/+/c"), ("5", "a.*")], "dst string, pattern string")
    assert rows(channels.match_topics(sent, listen).select("src", "dst")) == [("p", "1"), ("p", "2"), ("p", "3"), ("q", "4")]
    w = spark.createDataFrame([("w", "Users"), ("v", "orders")], "src string, table string")
    r = spark.createDataFrame([("r", "users"), ("s", "user"), ("t", "Orders")], "dst string, table string")
    assert rows(channels.match_tables(w, r)) == [("v", "t", "orders", "heuristic"), ("w", "r", "users", "heuristic"), ("w", "s", "users ~ user", "guess")]
    f = lambda *x: spark.createDataFrame(x, "node string, path string")
    assert rows(channels.match_files(f(("a", "out/x.csv")), f(("b", "in/x.csv"), ("c", "y.csv")))) == [("a", "b", "x.csv")]
    stub = spark.createDataFrame([("c", "S", "m", "app/web/client.py")], "src string, service string, method string, path string")
    servers = spark.createDataFrame([("far", "S", "m", "lib/server.py"), ("near", "S", "m", "app/api/server.py")], "dst string, service string, method string, path string")
    assert rows(channels.match_stubs(stub, servers)) == [("c", "near")]
    di = channels.match_registrations(
        spark.createDataFrame([("c", "IX", "m")], "src string, interface string, name string"),
        spark.createDataFrame([("IX", "X")], "interface string, type_id string"),
        spark.createDataFrame([("X", "m", "X.m"), ("X", "n", "X.n")], "owner string, name string, id string"),
    )
    assert rows(di) == [("c", "X.m")]
    ev = channels.match_events(spark.createDataFrame([("a", "e"), ("a", "e")], "src string, event string"), spark.createDataFrame([("h", "e")], "handler string, event string"))
    assert rows(ev, "src", "dst", "event") == [("a", "h", "e")]


def test_rules(spark):
    n = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m3")], "id string, module_id string")
    c = calls(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert rows(rules.forbidden(c, n, "module:m1", "module:m2")) == [("a", "b")]
    assert rows(rules.cyclic_pairs(c, n)) == []
    assert rows(rules.cycles(c, n)) == [(x, "m3") for x in ("m1", "m2", "m3")]
    with pytest.raises(ValueError):
        rules.forbidden(c, n, "nonsense:x", "*")


def test_text(spark):
    nodes = spark.createDataFrame([(1, "saveUserOrder", "f"), (2, "order_saver", "f"), (3, "deleteUser", "g"), (4, "paint", "h")], "id int, name string, group string")
    found = textrank.find_flows(nodes, "save the order", 10, synonyms={"save": ["store"]}).collect()
    assert [r.id for r in found][:2] == [1, 2] and 4 not in [r.id for r in found]
    df = spark.createDataFrame([(["a", "b", "the"], ["b", "c", "the"])], "a array<string>, b array<string>")
    assert df.select(textrank.weighted_jaccard(F.col("a"), F.col("b"), ["the"])).first()[0] == pytest.approx(1.5 / 3.5)


def test_patterns(spark):
    sub = spark.createDataFrame([("A", "I"), ("B", "I"), ("C", "J")], "sub string, super string")
    fields = spark.createDataFrame([("A", "I", True), ("B", "I", False), ("C", "I", True)], "owner string, type_id string, many boolean")
    assert rows(patterns.composite(sub, fields)) == [("A", "I")]
    assert rows(patterns.decorator(sub, fields)) == [("B", "I")]
    uses = spark.createDataFrame([("X", "I"), ("A", "I"), ("X", "J")], "owner string, type_id string")
    assert rows(patterns.strategy(sub, uses)) == [("I", 2, 1)]


def test_resolution_prefers_the_nearest(spark):
    bases = spark.createDataFrame([("C", "B"), ("B", "A")], "sub string, super string")
    closure = resolution.base_closure(bases)
    assert rows(closure) == [("B", "A", 1), ("C", "A", 2), ("C", "B", 1)]
    methods = spark.createDataFrame([("A.m", "A", "m"), ("B.m", "B", "m"), ("C.m", "C", "m"), ("C.x", "C", "x")], "id string, owner string, name string")
    assert rows(resolution.overrides(methods, closure)) == [("B.m", "A.m"), ("C.m", "B.m")]


def test_export(spark):
    assert export.layers([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]) == {"a": 0, "b": 1, "c": 2}
    steps = spark.createDataFrame([(0, None, "f", "A"), (1, 0, "g", "B"), (2, 1, "h", "C")], "seq int, parent_seq int, fn string, owner string")
    text = export.sequence_diagram(steps)
    assert "participant p1 as B" in text and "p1->>p2: h" in text
    value, cut = export.fit({"x": list(range(200)), "y": "z" * 30}, 120)
    assert len(str(value)) < 200 and cut["x"].endswith("of 200")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    assert export.graph_json(n, e) == '{"edges": [{"dst": "b", "src": "a"}], "nodes": [{"id": "a"}, {"id": "b"}]}'


def test_more_resolution(spark):
    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    files = df([("a.py", True), ("b.py", True), ("c.py", False)], "path string, has_body boolean")
    assert rows(resolution.script_entries(files, df([("a.py", "b.py")], "path string, dst string"))) == [("a.py",)]
    methods = df([("m1", "d", "T"), ("m2", "d", "U")], "id string, folder string, receiver string")
    types = df([("T1", "d", "T"), ("U1", "d", "U"), ("U2", "d", "U"), ("T2", "e", "T")], "id string, folder string, name string")
    assert rows(resolution.attached_methods(methods, types)) == [("m1", "T1")]
    imports = df([("x", "@app/core/a"), ("x", "@app/b"), ("x", "other")], "path string, target string")
    aliases = df([("@app", "src"), ("@app/core", "src/kernel")], "prefix string, put string")
    assert rows(resolution.aliased(imports, aliases)) == [("x", "@app/b", "src/b"), ("x", "@app/core/a", "src/kernel/a")]
    tree = df([("src/lib/a.go",), ("src/util/b.go",), ("test/util/b.go",)], "path string")
    asked = df([("m.go", "lib/a"), ("m.go", "util/b"), ("m.go", "src/util/b")], "path string, target string")
    assert rows(resolution.by_path_suffix(asked, tree)) == [("m.go", "lib/a", "src/lib/a.go"), ("m.go", "src/util/b", "src/util/b.go")]
    passed = df([("f", "x", "T")], "fn string, param string, type_id string")
    handed = df([("f", "x", "g", "y"), ("g", "y", "h", "z"), ("h", "z", "f", "x")], "fn string, param string, to_fn string, to_param string")
    assert rows(resolution.argument_types(passed, handed)) == [("f", "x", "T"), ("g", "y", "T"), ("h", "z", "T")]
    calls_ = df([(1, "f", 2), (2, "g", 1)], "call int, name string, argc int")
    cands = df([("f", "f2", 2, 2), ("f", "f9", 0, 99), ("g", "g1", 1, 1), ("g", "g2", 1, 1)], "name string, dst string, argc_min int, argc_max int")
    assert rows(resolution.overload(calls_, cands)) == [(1, "f2")]
    before = df([("r", "/old", "c1", "o")], "repo string, root string, first_commit string, origin string")
    now = df([("/new", "c1", "o"), ("/x", "c2", "o")], "root string, first_commit string, origin string")
    assert rows(resolution.moved_members(before, now)) == [("r", "/old", "/new")]
    spawns = df([("s", "python tools/run.py --x"), ("t", "run.py")], "src string, command string")
    programs = df([("p", "tools/run.py"), ("q", "other/run.py")], "dst string, path string")
    assert rows(channels.match_spawns(spawns, programs)) == [("s", "p")]


def test_more_text_and_reviews(spark):
    from weftgraph.operators import lookup, review

    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    known = df([("src/a.py",), ("src/util/b.py",), ("test/util/b.py",)], "path string")
    texts = df([("k", "See a.py, src/util/b.py and util/b.py."), ("l", "nothing")], "key string, text string")
    assert rows(textrank.written_paths(texts, known)) == [("k", "src/a.py"), ("k", "src/util/b.py")]
    decisions = df([("d", "a", "1"), ("e", "b", "1"), ("f", "z", "1")], "decision string, id string, hash string")
    assert rows(review.code_unchanged(decisions, df([("a", "1"), ("b", "2")], "id string, hash string"))) == [("d", "unchanged"), ("e", "changed"), ("f", "gone")]
    files = df([("a.py", "1\n2\n3\n4\n5")], "path string, text string")
    nodes = df([("n", "a.py", 2, 4)], "id string, path string, first int, last int")
    assert rows(lookup.source_lines(files, nodes, 2)) == [("n", 2, "2\n3", True)]


def test_compiler_links(spark, tmp_path):
    from weftgraph.sources import compiler

    (tmp_path / "l.json").write_text('{"caller": "a", "line": 1, "name": "f", "target": "x"}\n{"caller": "a", "line": 2, "name": "g", "target": "z"}\nnot json\n{"line": 3}\n')
    found = compiler.read_links(spark, tmp_path.as_uri())
    assert found.count() == 2
    own = spark.createDataFrame([("a", 1, "f", "x", "heuristic"), ("a", 2, "g", "y", "guess"), ("a", 9, "h", "w", "guess")], "src string, line int, name string, dst string, precision string")
    assert rows(compiler.apply_links(own, found), "line", "dst", "precision", "state") == [(1, "x", "exact", "confirmed"), (2, "z", "exact", "added"), (9, "w", "guess", "kept")]
