"""Sources, the Python front end, the store and the stream."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import GraphEngine
from weftgraph.functions import first_sentence, plural_stem, slug, split_words, test_path
from weftgraph.indexing import python_graph
from weftgraph.operators import incremental
from weftgraph.sources import assets, coverage_files, files, gitlog, keyshape, python_ast, spec, sql_strings, test_output
from weftgraph.store import GraphStore
from weftgraph.streaming import refresh

test_path.__test__ = False


def lines(spark, text, **key):
    name, value = next(iter(key.items()))
    rows = [(value, i + 1, t) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, f"{name} string, line_no int, text string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "rule, path, out",
    [
        ("*.log", "a/b.log", True),
        ("/x", "a/x", False),
        ("build/", "a/build/c.txt", True),
        ("a/**/z", "a/b/c/z", True),
        ("**/tmp", "q/tmp/f", True),
        ("doc/*.txt", "doc/a/b.txt", False),
        ("f[0-9]", "f7", True),
        ("# c", "# c", False),
    ],
)
def test_ignore_rules(rule, path, out):
    compiled = [p for p in [files.ignore_pattern(rule)] if p]
    assert files.ignored(path, compiled) == out
    again = [p for p in map(files.ignore_pattern, [rule, "!" + rule]) if p]
    assert not files.ignored(path, again)


def test_read_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/pyproject.toml").write_text("")
    (tmp_path / "pkg/a.py").write_text("x = 1\n")
    (tmp_path / "pkg/b.bin").write_bytes(b"\x00\x01" * 50)
    (tmp_path / "pkg/u.py").write_bytes("y = 'é'\n".encode("utf-16"))
    (tmp_path / "pkg/min.js").write_text("a" * 30_000)
    (tmp_path / "skip.log").write_text("no")
    found = files.read_tree(spark, str(tmp_path), ["*.log"])
    by = {r.path: r for r in found.collect()}
    assert set(by) == {"pkg/pyproject.toml", "pkg/a.py", "pkg/b.bin", "pkg/u.py", "pkg/min.js"}
    assert by["pkg/b.bin"].reason == "binary" and by["pkg/min.js"].reason == "minified" and "é" in by["pkg/u.py"].text
    assert rows(files.skipped_summary(found), "reason", "n") == [("binary", 1), ("minified", 1)]
    assert dict(rows(files.modules(found)))["pkg/a.py"] == "pkg"


SOURCES = {
    "pkg/base.py": '''
import os

class Base:
    limit = 1

    def run(self, a, b=2):
        return self.helper()

    def helper(self):
        self.limit += 1
        return os.getcwd()


class Child(Base):
    def helper(self):
        super().helper()
        return 2
''',
    "pkg/main.py": '''
from pkg.base import Child, Base
from pkg import util
import requests


@app.get("/items/{id}")
def show(id):
    c = Child()
    c.run(1)
    util.tool(3)
    util.rare_method()
    requests.get("http://x/items/3")
    db.execute("SELECT a FROM items JOIN users ON 1")
    with open("out/x.csv", "w") as f:
        f.write("")


if __name__ == "__main__":
    show(1)
''',
    "pkg/util.py": "def tool(x):\n    def inner():\n        return x\n    return inner()\n",
    "pkg/bad.py": "def broken(:\n",
    "tests/test_main.py": "from pkg.main import show\n\ndef test_show(client):\n    assert show(1)\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    return python_graph(df, "r")


def short(x):
    return x and x.replace("r:python:", "")


def test_python_nodes(graph):
    kinds = {short(r.id): r.kind for r in graph["nodes"].collect()}
    assert kinds["pkg.base.Child"] == "type" and kinds["pkg.base.Base.limit"] == "field" and kinds["pkg.util.tool.inner"] == "callable"
    assert kinds["tests.test_main.test_show"] == "test" and kinds["pkg.main.<main>"] == "entry_point"
    assert rows(graph["errors"], "path", "name") == [("pkg/bad.py", "SyntaxError")]


def test_python_calls(graph):
    found = {(short(r.src), r.name): (short(r.dst), r.outcome) for r in graph["calls"].collect()}
    assert found["pkg.base.Base.run", "helper"] == ("pkg.base.Base.helper", "resolved")
    assert found["pkg.base.Child.helper", "helper"] == ("pkg.base.Base.helper", "resolved")
    assert found["pkg.main.show", "Child"] == ("pkg.base.Child", "resolved")
    assert found["pkg.main.show", "run"] == ("pkg.base.Base.run", "resolved")
    assert found["pkg.main.show", "tool"] == ("pkg.util.tool", "resolved")
    assert found["pkg.main.show", "rare_method"] == (None, "unresolved")
    assert found["pkg.base.Base.helper", "getcwd"] == (None, "external")
    assert found["tests.test_main.test_show", "show"] == ("pkg.main.show", "resolved")


def test_python_edges(graph):
    e = {(r.kind, short(r.src), short(r.dst)) for r in graph["edges"].collect()}
    assert ("extends", "pkg.base.Child", "pkg.base.Base") in e
    assert ("overrides", "pkg.base.Child.helper", "pkg.base.Base.helper") in e
    assert {("reads", "pkg.base.Base.helper", "pkg.base.Base.limit"), ("writes", "pkg.base.Base.helper", "pkg.base.Base.limit")} <= e
    assert ("imports", "r:file:pkg/main.py", "r:file:pkg/base.py") in e
    assert ("contains", "pkg.base.Base", "pkg.base.Base.run") in e


def test_python_endpoints(graph):
    e = {(r.channel, r.role, r.address) for r in graph["endpoints"].collect()}
    assert {("http", "serve", "/items/{id}"), ("http", "call", "http://x/items/3"), ("db", "read", "items"), ("db", "read", "users"), ("file", "write", "out/x.csv")} <= e


def test_parser_survives_anything():
    for text in ("", "﻿x=1", "def f(", "\x00", "class A(B()): pass", "a.b[c].d += 1", "async def f(): await g()"):
        assert isinstance(python_ast.parse("r", "x.py", text), list)


def test_sql_tables():
    f = sql_strings.sql_tables
    assert f("INSERT INTO a SELECT * FROM b JOIN c.d ON x") == [("write", "a"), ("read", "b"), ("read", "d")]
    assert f("WITH t AS (SELECT 1 FROM u) SELECT * FROM t") == [("read", "u")]
    # The clause that writes does not read, another one of the same table does.
    assert f("update x set y = 1 where z in (select q from x)") == [("write", "x"), ("read", "x")]
    assert f("insert into t select a from t") == [("write", "t"), ("read", "t")]
    assert f("delete from t where 1 = 1") == [("write", "t")]
    assert f("select extract(year from ts), trim(both ' ' from name) from orders") == [("read", "orders")]
    assert f("SELECT a FROM t join u on x") == [("read", "t")]
    assert f("Select from the menu") == [] and f("drop by from here maybe") == [("read", "here")] and f("hello from x") == []


def test_git_log(spark):
    text = "commit " + "a" * 40 + " 1700000000\n\nM\tsrc/x.py\nR090\told.py\tnew.py\n\ncommit " + "b" * 40 + " 1600000000\n\nA\tz.py"
    found = gitlog.parse_log(lines(spark, text, log="l"))
    assert rows(found, "commit_seq", "status", "old_path", "path") == [(1, "M", None, "src/x.py"), (1, "R", "old.py", "new.py"), (2, "A", None, "z.py")]
    assert gitlog.recent(found, now="2023-11-20 00:00:00").count() == 2


def test_runner_output(spark):
    text = "\n".join(
        ["PASSED tests/a.py::test_x", "FAILED tests/a.py::test_y[1] - boom", "tests/a.py::test_z SKIPPED (why)", "--- FAIL: TestGo (0.0s)", "ok 1 - adds", "not ok 2 - subtracts # TODO later", "  ✓ works (3 ms)", "noise", "Passed Shop.Cart [2 ms]", "FAILED tests/a.py::test_x"]
    )
    found = dict(rows(test_output.parse_output(lines(spark, text, run="r")), "name", "status"))
    assert found == {"tests/a.py::test_x": "fail", "tests/a.py::test_y[1]": "fail", "tests/a.py::test_z": "skip", "TestGo": "fail", "adds": "pass", "subtracts": "skip", "works": "pass", "Shop.Cart": "pass"}
    tests = spark.createDataFrame([("t1", "test_y"), ("t2", "test_z"), ("t3", "test_z")], "id string, name string")
    bound = test_output.bound_to_tests(test_output.parse_output(lines(spark, text, run="r")), tests)
    assert dict(rows(bound, "name", "test_id"))["tests/a.py::test_y[1]"] == "t1"
    assert dict(rows(bound, "name", "test_id"))["tests/a.py::test_z"] is None
    assert rows(test_output.counterexamples(lines(spark, "Falsifying example: f(x=0)\nfine", run="r")), "example") == [("f(x=0)",)]


def test_coverage_readers(spark, tmp_path):
    lcov = lines(spark, "TN:t[1]\nSF:a.py\nDA:3,2\nDA:4,0\nend_of_record", run="r")
    assert rows(coverage_files.read_lcov(lcov)) == [("r", "t[1]", "a.py", 3, 2), ("r", "t[1]", "a.py", 4, 0)]
    db = tmp_path / "c.db"
    con = sqlite3.connect(db)
    con.executescript("create table file(id integer, path text); create table context(id integer, context text); create table line_bits(file_id integer, context_id integer, numbits blob)")
    con.execute("insert into file values (1, 'a.py')")
    con.execute("insert into context values (1, 't::x|run')")
    con.execute("insert into line_bits values (1, 1, ?)", (bytes([0b1000, 1]),))
    con.commit()
    con.close()
    xml = b'<coverage><class filename="b.py"><lines><line number="7" hits="1"/></lines></class></coverage>'
    istanbul = json.dumps({"c.js": {"path": "c.js", "statementMap": {"0": {"start": {"line": 2}}}, "s": {"0": 5}}}).encode()
    df = spark.createDataFrame([("c.db", db.read_bytes()), ("x.xml", xml), ("i.json", istanbul), ("other", b"zz")], "path string, content binary")
    found = coverage_files.read_files(df, "r")
    assert rows(found) == sorted([("r", None, "b.py", 7, 1), ("r", None, "c.js", 2, 5), ("r", "t::x", "a.py", 3, 1), ("r", "t::x", "a.py", 8, 1)], key=str)
    nodes = spark.createDataFrame([("a.py", "outer", 1, 20, 2), ("a.py", "inner", 7, 9, 8)], "path string, id string, first int, last int, body_line int")
    assert rows(coverage_files.covered_functions(found, nodes)) == [("r", "t::x", "inner", 1), ("r", "t::x", "outer", 1)]


def test_key_shapes():
    assert keyshape.shape_of(["user:", None, ":profile"]) == (":", ("user", "", "profile"))
    assert keyshape.template_shape("a/{x}/b/%s") == ("/", ("a", "", "b", ""))
    assert keyshape.literal_shape("plain") is None
    for text in ("user:1", "http://x/{a}/b", "/a/{x}/b", "some prose: and more: of it", "a::b:c", "a/b\n/c", "x:" * 200):
        assert keyshape.template_shape(text) is None, text
    assert keyshape.template_shape("user:{id}:") == (":", ("user", ""))
    assert keyshape.alignment(("user", "", "profile"), ("user", "7", "profile")) == (0, 2)
    assert keyshape.alignment(("user", "", "x"), ("user", "", "y")) is None
    assert keyshape.fit_precision(3) == "heuristic" and keyshape.fit_precision(2) == "guess"


def test_spec_and_assets(spark):
    text = "### Requirement: Save\n#### Scenario: Twice\n- [x] do `save_all()`\n```\n- [ ] not this\n```\n- [ ] later"
    found = spec.spec_items(lines(spark, text, path="p"))
    assert rows(found, "kind", "name", "within", "done") == [("requirement", "Save", None, None), ("scenario", "Twice", "Save", None), ("task", "do `save_all()`", None, True), ("task", "later", None, False)]
    assert rows(spec.code_names(lines(spark, text, path="p")), "name") == [("save_all",)]
    assert spec.states_invariant("always sorted") and not spec.states_invariant("adds one")
    scene = '[ext_resource type="Script" path="res://a.gd" id=1]\n[node name="Root"]\n[connection signal="s" from="X" to="Root" method="on_s"]'
    assert rows(assets.godot_scenes(lines(spark, scene, path="m.tscn")), "what", "target", "owner") == [("script", "a.gd", None), ("signal", "on_s", "Root")]
    g = "0" * 31 + "a"
    meta = lines(spark, f"guid: {g}", path="A.cs.meta").unionByName(lines(spark, f"x: {{guid: {g}}}\ny: {{guid: {'b' * 32}}}", path="B.prefab"))
    links, missing = assets.asset_links(assets.unity_uses(meta), assets.unity_guids(meta))
    assert rows(links) == [("B.prefab", "A.cs")] and rows(missing) == [("b" * 32, 1)]


def test_scalar_functions(spark):
    value = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert value(split_words, "saveHTTPOrder_2x") == ["save", "http", "order", "2", "x"]
    assert [value(plural_stem, x) for x in ("cities", "boxes", "users", "class", "bus")] == ["city", "box", "user", "class", "bus"]
    assert value(slug, "Fix: a Bug!") == "fix-a-bug"
    assert value(first_sentence, "One. Two.") == "One." and value(first_sentence, "w " * 300).endswith("…")
    assert [value(test_path, x) for x in ("tests/a.py", "src/a.spec.ts", "src/latest.py")] == [True, True, False]
    yes = ("e2e/login.ts", "a/testing/b.py", "Basket.UnitTests/X.cs", "src/FooTests.cs", "a\\\\test\\\\b.cs", "x/test_a.py", "conftest.py", "a/b_test.py")
    no = ("test_data.json", "src/contest.py", "latests/a.py", "a/attest/b.py", "src/Test.py")
    assert all(value(test_path, x) for x in yes) and not any(value(test_path, x) for x in no)


def test_store(spark, tmp_path):
    store = GraphStore(spark, tmp_path.as_uri())
    node = lambda i, h="1", layer="fact": (i, "callable", i, None, i.split(":")[0], None, None, None, None, h, layer, None, None, None)
    schema = store.read("nodes").schema
    store.insert_nodes(spark.createDataFrame([node("r:a"), node("r:b"), node("q:c"), node("r:i", layer="intent")], schema))
    store.insert_nodes(spark.createDataFrame([node("r:a", "2"), node("r:d")], schema))
    assert rows(store.read("nodes"), "id", "content_hash") == [("q:c", "1"), ("r:a", "1"), ("r:b", "1"), ("r:d", "1"), ("r:i", "1")]
    store.snapshot("before")
    store.clear_facts("r")
    assert rows(store.read("nodes"), "id") == [("q:c",), ("r:i",)]
    engine = GraphEngine(spark, store)
    assert rows(engine.compare("before")) == [("r:a", "removed"), ("r:b", "removed"), ("r:d", "removed")]
    store.upsert("nodes", spark.createDataFrame([node("q:c", "9")], schema), ["id"])
    assert dict(rows(store.read("nodes"), "id", "content_hash"))["q:c"] == "9"
    generation = store.generation
    store.drop_snapshot("before")
    assert store.generation == generation
    with pytest.raises(KeyError):
        store.read("nodes", "before")
    with pytest.raises(ValueError):
        store.snapshot("../x")


def test_stream_equals_rebuild(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = GraphStore(spark, (tmp_path / "store").as_uri())
    batches = [
        [{"path": "a", "src": "f", "dst": "g", "version": 1}, {"path": "b", "src": "f", "dst": "g", "version": 1}],
        [{"path": "a", "src": "f", "dst": "h", "version": 2}, {"path": "b", "src": None, "dst": None, "version": 2}, {"path": "a", "src": "x", "dst": "y", "version": 1}],
    ]
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        query = refresh.follow(refresh.read_changes(spark, source.as_uri()), store, (tmp_path / "check").as_uri())
        query.awaitTermination(120)
    assert rows(refresh.link_counts(store)) == [("f", "h", 1)]


def test_incremental(spark):
    f = spark.createDataFrame([("a", "foo bar"), ("b", "foo"), ("c", "baz")], "path string, text string")
    m = incremental.mentions(f)
    changed = spark.createDataFrame([("c", "edited")], "path string, state string")
    names = m.filter("path = 'a'").select("token")
    imports = spark.createDataFrame([("d", "c"), ("e", "d"), ("d", "e"), ("x", "y")], "path string, target string")
    assert rows(incremental.to_resolve(changed, names, m, imports)) == [("a",), ("b",), ("c",), ("d",), ("e",)]
    old = spark.createDataFrame([("p", 1), ("q", 2)], "k string, v int")
    assert rows(incremental.replaced(old, spark.createDataFrame([("q", 3)], "k string, v int"), "k")) == [("p", 1), ("q", 3)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    from weftgraph.indexing import index_tree

    root = tmp_path_factory.mktemp("tree")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "pkg/pyproject.toml").write_text("")
    (root / "tests/setup.cfg").write_text("")
    store = GraphStore(spark, tmp_path_factory.mktemp("store").as_uri())
    index_tree(spark, store, str(root), "r")
    return root, store


def test_index_tree_answers_questions(spark, indexed):
    _, store = indexed
    e = GraphEngine(spark, store)
    reached = dict(rows(e.impact("r:python:pkg.base.Base.helper"), "id", "dist"))
    assert reached["r:python:pkg.main.show"] == 2 and reached["r:python:tests.test_main.test_show"] == 3
    assert [short(x) for _, x in rows(e.trace("r:python:tests.test_main.test_show", "r:python:pkg.base.Base.run"))] == ["tests.test_main.test_show", "pkg.main.show", "pkg.base.Base.run"]
    assert ("r:module:tests", "r:module:pkg", 1) in rows(e.module_edges(), "from_module", "to_module", "n")
    flow = e.flow("flow:r:python:tests.test_main.test_show").collect()
    assert [short(r.fn) for r in flow][:2] == ["tests.test_main.test_show", "pkg.main.show"]
    assert {r.id for r in e.search("helper").collect()} == {"r:python:pkg.base.Base.helper", "r:python:pkg.base.Child.helper"}
    assert {short(r.id) for r in e.context(["r:python:pkg.main.show"], 60).collect()} >= {"pkg.main.show"}
    assert {r.kind for r in e.flows().collect()} == {"test", "entry"}
    assert e.coverage().count() == 2 and e.overview().count() == 2 and e.outline().count() > 0
    assert rows(e.shared_state(), "field") == [("r:python:pkg.base.Base.limit",)]
    assert e.neighbors(1).count() > 0 and e.notes().count() == 0 and e.check_rules() == {}
    assert {short(r.id): r.role for r in e.assess([("r:python:pkg.util.tool", "remove")]).collect()}["pkg.main.show"] == "must_edit"
    assert e.find_flows("show items").first().id == "r:python:pkg.main.show"


def test_index_again_equals_once(spark, indexed):
    from weftgraph.indexing import index_tree
    from weftgraph.operators.change import differences

    root, store = indexed
    store.snapshot("first")
    index_tree(spark, store, str(root), "r")
    for relation in ("nodes", "edges", "calls", "flows", "flow_steps"):
        assert differences(store.read(relation), store.read(relation, "first")).count() == 0, relation
    (root / "pkg/util.py").write_text("def tool(x):\n    return x\n\ndef extra():\n    return tool(1)\n")
    index_tree(spark, store, str(root), "r")
    changed = {short(i): s for i, s in rows(GraphEngine(spark, store).compare("first"))}
    assert changed == {"pkg.util.tool": "edited", "pkg.util.tool.inner": "removed", "pkg.util.extra": "added"}
    store.forget(["r"])
    assert store.read("nodes").count() == 0


def test_command_line(spark, tmp_path):
    import io

    from weftgraph.__main__ import main

    for path, text in SOURCES.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(text)
    store = str(tmp_path / "s")

    def run(*argv):
        out = io.StringIO()
        assert main([store, *argv], spark, out) == 0
        return out.getvalue().splitlines()

    assert run("index", str(tmp_path / "t"), "r") == [] and run("snapshot", "one") == []
    assert [json.loads(x)["dist"] for x in run("impact", "r:python:pkg.util.tool")][:2] == [0, 1]
    assert len(run("trace", "r:python:pkg.main.show", "r:python:pkg.util.tool")) == 2
    assert "sequenceDiagram" in run("diagram", "flow:r:python:tests.test_main.test_show")[0]
    assert run("compare", "one") == [] and run("rules") == [""]
    assert json.loads(run("export")[0])["nodes"]


def test_routes(spark):
    from weftgraph.operators.channels import match_routes

    routes = spark.createDataFrame(
        [(t, t) for t in ("/items/{id}", "/items/special", "/Files/{*path}", "/files/<path:p>/raw", "/a/{x}", "/a/:y", "/{any}/end", "/")], "route string, template string"
    )
    urls = {
        "/items/3": "/items/{id}", "/ITEMS/Special?q=1": "/items/special", "https://h/files/x/y/z": "/Files/{*path}", "/files": None,
        "/a/1": None, "/b/end": "/{any}/end", "/nothing/here/at/all": None, "/": "/",
    }
    asked = spark.createDataFrame([(u, u) for u in urls], "request string, url string")
    assert {r.request: r.route for r in match_routes(asked, routes).collect()} == {u: r for u, r in urls.items() if r}


def test_tables_and_topics(spark):
    from weftgraph.operators.channels import match_tables, match_topics

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    w = df([("a", "Users"), ("b", "orders"), ("self", "log")], "src string, table string")
    r = df([("c", "users"), ("c", "user"), ("d", "order"), ("self", "log")], "dst string, table string")
    assert rows(match_tables(w, r), "src", "dst", "address", "precision") == [("a", "c", "users", "heuristic"), ("b", "d", "orders ~ order", "guess")]
    many = df([(f"w{i}", "item" + "s" * (i % 2)) for i in range(6)], "src string, table string")
    assert match_tables(many, df([("x", "item"), ("y", "items")], "dst string, table string"), most=11).count() == 0
    assert match_tables(many, df([("x", "item"), ("y", "items")], "dst string, table string"), most=12).count() == 12
    sent = df([("p", "shop.cart.add"), ("q", "other")], "src string, topic string")
    heard = df([("one", "shop.*.add"), ("rest", "shop.#"), ("all", "#"), ("no", "shop.*"), ("lead", "*.cart.add")], "dst string, pattern string")
    found = rows(match_topics(sent, heard), "src", "dst")
    assert found == [("p", "all"), ("p", "lead"), ("p", "one"), ("p", "rest"), ("q", "all")]


def test_stems(spark):
    from weftgraph.operators.textrank import stem, stemmed

    together = [("saves", "saved", "saving", "save"), ("validate", "validation", "validator"), ("step", "stepping", "stepped", "stepper"), ("query", "queries", "queried"), ("class", "classes")]
    for group in together:
        assert len({stem(w) for w in group}) == 1, group
    words = [w for g in together for w in g] + ["pass", "press", "falling", "miss", "is", "ed", "ions", "stations", "going", "ties", "bees", "grasses", "user", "err", "adder"]
    found = spark.createDataFrame([(w,) for w in words], "w string")
    assert all(r.s == stem(r.w) for r in found.select("w", stemmed(F.col("w")).alias("s")).collect())


CHANNELS = {
    "web/app.py": "@app.get('/items/{item_id}')\ndef item(item_id):\n    return load()\n\ndef load():\n    db.execute('select name from items')\n",
    "web/client.py": "def fetch():\n    return http.get('/items/3')\n\ndef lost():\n    http.get('/nowhere/1')\n",
    "jobs/work.py": "def sell():\n    bus.publish('shop.sold', 1)\n    db.execute('insert into item values (1)')\n\ndef listen():\n    bus.subscribe('shop.*', on_sold)\n\ndef on_sold():\n    open('out/report.csv', 'w')\n",
    "jobs/report.py": "import subprocess\ndef read():\n    open('report.csv')\n\ndef start():\n    subprocess.run(['python', 'jobs/tool.py'])\n",
    "jobs/tool.py": "print(1)\n",
    "tests/conftest.py": "import pytest\n@pytest.fixture\ndef shop():\n    from jobs.work import sell\n    sell()\n",
    "tests/test_shop.py": "def test_it(shop):\n    assert shop\n",
}


def test_index_links_channels(spark, tmp_path):
    """Impact, traces and flows cross routes, queues, tables, files, programs and fixtures."""
    from weftgraph.indexing import index_tree

    for path, text in CHANNELS.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    store = GraphStore(spark, (tmp_path / "store").as_uri())
    generation = store.generation
    index_tree(spark, store, str(tmp_path / "tree"), "r")
    assert store.generation == generation + 1  # one move
    e = GraphEngine(spark, store)
    at = lambda i: i.removeprefix("r:python:")
    sent = {(r.channel, at(r.src), at(r.dst)) for r in e.edges.filter("kind = 'communicates'").collect()}
    assert sent == {
        ("http", "web.client.fetch", "web.app.item"),
        ("queue", "jobs.work.sell", "jobs.work.on_sold"),
        ("db", "jobs.work.sell", "web.app.load"),
        ("file", "jobs.work.on_sold", "jobs.report.read"),
        ("process", "jobs.report.start", "jobs.tool.<module>"),
    }
    assert ("tests.test_shop.test_it", "tests.conftest.shop") in {(at(r.src), at(r.dst)) for r in e.calls.collect()}
    assert {at(i) for i, _ in rows(e.impact("r:python:web.app.load"), "id", "dist")} >= {"web.app.item", "web.client.fetch"}
    assert "web.app.load" in {at(i) for i, _ in rows(e.impact("r:python:jobs.work.sell"), "id", "dist")}  # written, so its readers
    flow = [at(r.fn) for r in e.flow("flow:r:python:tests.test_shop.test_it").collect()]
    assert flow[:2] == ["tests.test_shop.test_it", "tests.conftest.shop"] and "jobs.work.on_sold" in flow
    assert "flow:r:python:jobs.tool.<module>" in {r.id for r in e.flows().collect()}
    assert store.unreferenced() == [] and store.clean() == 0


def test_store_moves_at_once(spark, tmp_path, monkeypatch):
    """Whatever step a write dies at, readers find the old version or the new one."""
    store = GraphStore(spark, tmp_path.as_uri())
    row = lambda *ids: spark.createDataFrame([(i, "p", 1) for i in ids], "run string, test string, lines int").selectExpr("run", "test", "cast(null as string) test_id", "cast(null as string) node_id", "lines")
    store.write("covered", row("a"))
    for name in ("_written", "_move", "_point"):
        with monkeypatch.context() as m:
            m.setattr(GraphStore, name, lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                store.write_all({"covered": row("b"), "test_results": store.read("test_results")})
        assert rows(GraphStore(spark, tmp_path.as_uri()).read("covered"), "run") == [("a",)]
    assert store.clean() > 0 and rows(store.read("covered"), "run") == [("a",)]
    before = store.versions()["tables"]["covered"]
    store.append("covered", row("b", "c"))
    assert rows(store.read("covered"), "run") == [("a",), ("b",), ("c",)]
    assert before in store.versions()["tables"]["covered"]  # what was there lies where it lay
    other = store.versions()
    store.append("covered", row("d"))
    with pytest.raises(RuntimeError):
        store._move(other, {})


def test_search_find_expand(spark, indexed, tmp_path):
    from weftgraph.indexing import index_tree

    store = GraphStore(spark, tmp_path.as_uri())
    index_tree(spark, store, str(indexed[0]), "r")
    e = GraphEngine(spark, store)
    run = "r:python:pkg.base.Base.run"
    assert e.search("Base.run").first().id == run and e.search(run).first().id == run
    assert e.search("pkg/base.py").first().path == "pkg/base.py" and e.search("base.py").first().path == "pkg/base.py"
    assert {r.id for r in e.search("elpe").collect()} == {r.id for r in e.search("helper").collect()}  # no word begins so
    assert e.search("").count() >= 0 and e.search("%").count() == 0
    assert [(r.id, r.outcome) for r in e.find("Base.run").collect()] == [(run, "found")]
    assert {r.outcome for r in e.find("helper").collect()} == {"candidate"} and e.find("helper").count() == 2
    guess = e.find("pkg.base.Base.helpr").collect()
    assert all(r.outcome == "did you mean" for r in guess)
    assert {r.outcome for r in e.find("Nowhere.helpe").collect()} == {"did you mean"}
    found = {(r.section, r.kind): r.total for r in e.expand("Base.run").collect()}
    assert found[("called_by", "calls")] >= 1 and e.expand("helper").count() == 0
    assert {(r.section, r.kind) for r in e.expand("r:python:pkg.base.Base").collect()} >= {("contains", "callable"), ("contains", "field")}
    chain = e.chain(run).collect()
    assert chain and chain[-1].dst == run
    rule = e.add_rule("forbid", "module:a", "module:b")
    assert e.add_rule("forbid", "module:a", "module:b") == rule and e.add_rule("no_cycle", "*") == rule + 1
    with pytest.raises(ValueError):
        e.add_rule("wish", "*")
    claim = e.add_finding("c1", "me", "minor", "does too much", [run])
    assert e.add_finding("c1", "me", "minor", "does too much", [run]) == claim and store.read("findings").count() == 1
    with pytest.raises(ValueError):
        e.add_finding("c1", "me", "minor", "x", ["r:python:no.such"])
    lines_ = spark.createDataFrame([("one", "t", "t", run, 3), ("two", "t", "t", run, 4)], store.read("covered").schema)
    e.write_coverage(lines_)
    e.write_coverage(lines_.filter("run = 'two'").withColumn("lines", F.lit(9)))
    assert rows(store.read("covered"), "run", "lines") == [("one", 3), ("two", 9)]


def test_leftover_edits(spark):
    from weftgraph.operators.change import explained

    nodes = spark.createDataFrame([("top", True, 1, 99), ("cls", False, 1, 99), ("fn", False, 200, 220), ("far", True, 1, 99)], "id string, top boolean, first int, last int")
    spans = spark.createDataFrame([("top", 10, 12), ("cls", 20, 30), ("fn", 1, 5), ("far", 10, 12)], "id string, a int, b int")
    edits = [
        ("top", 1, "import os"), ("top", 9, "x = 1"), ("top", 14, ""), ("top", 40, "# note"), ("top", 50, "register(made)"), ("top", 51, "other()"),
        ("cls", 31, "y = 2"), ("fn", 201, "# note"), ("far", 60, "z = 3"),
    ]
    found = explained(nodes, spark.createDataFrame(edits, "id string, line int, text string"), spans, ["made"])
    assert dict(rows(found, "id", "explained")) == {"top": True, "cls": True, "fn": False, "far": False}


def test_relabelled(spark):
    from weftgraph.operators.patterns import relabelled

    schema = "id string, pattern string, matcher string, evidence_hash string, stale boolean"
    labels = spark.createDataFrame([("a", "p", "structural", "1", False), ("b", "p", "person", "1", False), ("c", "q", "person", "2", True)], schema)
    found = spark.createDataFrame([("d", "p", "7")], "id string, pattern string, evidence_hash string")
    now = spark.createDataFrame([("b", "9"), ("c", "2")], "id string, evidence_hash string")
    assert rows(relabelled(labels, found, now), "id", "matcher", "stale") == [("b", "person", True), ("c", "person", False), ("d", "structural", False)]


def message(*parts):
    """A protocol-buffer message of (number, int | bytes | str)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in parts:
        v = v.encode() if isinstance(v, str) else v
        out += number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v
    return out


def test_scip_index(spark):
    from weftgraph.sources import scip

    at = lambda line, symbol, roles=0: (2, message((1, bytes([line - 1, 4, 9])), (2, symbol), (3, roles)))
    start = "scip-x npm pkg 1.0 `src/e.ts`/Engine#start()."
    index = message(
        (1, message((3, "file:///root"))),
        (2, message((1, "e.ts"), at(3, start, 1), at(300 % 128, "local 4"), (4, "ts"))),
        (2, message((1, "m.ts"), at(12, start), at(13, "scip-x npm pkg 1.0 `src/o.ts`/other()."))),
    )
    files = spark.createDataFrame([(index,), (b"\xff\xff",), (b"",), (None,)], "content binary")
    found = scip.read_index(files)
    assert rows(found, "path", "line", "name", "defines") == [("e.ts", 3, "start", True), ("m.ts", 12, "start", False), ("m.ts", 13, "other", False)]
    nodes = spark.createDataFrame(
        [("E", "Engine", "type", "e.ts", 1, 9), ("E.start", "start", "callable", "e.ts", 3, 5), ("main", "main", "callable", "m.ts", 10, 20), ("main.in", "in", "callable", "m.ts", 11, 14)],
        "id string, name string, kind string, path string, first int, last int",
    )
    assert rows(scip.links(found, nodes)) == [("main.in", 12, "start", "E.start", "use")]
    assert [scip.last_name(s) for s in ("a b c d pkg/Engine#", "x y z 1 m/f(+1).", "x y z 1 m/`odd name`#")][:2] == ["Engine", "f"]


def test_front_end_of_ones_own(spark, monkeypatch):
    from weftgraph.sources import adapters

    monkeypatch.setattr(adapters, "_FRONT_ENDS", dict(adapters._FRONT_ENDS))

    def toy(repo, path, text):
        if "!" in text:
            raise ValueError("no such thing")
        return [{"record": "node", "path": path, "id": f"{repo}:toy:{w}", "kind": "callable", "name": w} for w in text.split()]

    adapters.register(".toy", toy)
    with pytest.raises(ValueError):
        adapters.register("toy", toy)
    files = spark.createDataFrame([("a.toy", "f g"), ("b.toy", "!"), ("c.py", "def h(): pass"), ("d.other", "x"), ("e.toy", None)], "path string, text string")
    found = adapters.parse_files(files, "r")
    assert adapters.endings() == [".py", ".toy"]
    assert rows(found.filter("kind = 'callable'"), "path", "name") == [("a.toy", "f"), ("a.toy", "g"), ("c.py", "h")]
    assert rows(found.filter("record = 'error'"), "path", "name") == [("b.toy", "ValueError")]
