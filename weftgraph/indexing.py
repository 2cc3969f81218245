"""From Python sources to graph relations: parse, resolve, link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import route_segments
from weftgraph.operators import channels, resolution, traverse
from weftgraph.runtime import staged
from weftgraph.sources import files as trees
from weftgraph.sources import adapters
from weftgraph.schema import DATA_CHANNELS
from weftgraph.store import GraphStore


def python_graph(files: DataFrame, repo: str = "repo") -> dict[str, DataFrame]:
    """nodes, edges, calls, imports, endpoints, channels and errors of Python files (path, text)."""
    records = staged(adapters.parse_files(files, repo), "records")
    part = lambda r: records.filter(F.col("record") == r)
    raw = part("node").select("id", "kind", "name", "parent_id", "path", "first", "last", "body_line", "attrs")
    types = raw.filter("kind = 'type'").select("id", "name", "path")
    owner = types.select(F.col("id").alias("parent_id"), F.col("id").alias("owner"))
    attr = lambda k: F.get_json_object("attrs", f"$.{k}").cast("int")
    nodes = staged(
        raw.join(owner, "parent_id", "left").withColumns({"argc_min": attr("argc_min"), "argc_max": attr("argc_max")}), "nodes"
    )
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^src/", ""), r"\.py$", ""), "/", ".")
    sources = files.select("path", F.regexp_replace(module, r"\.__init__$", "").alias("module"))
    imported = staged(
        resolution.imports_to_files(part("import").select("path", "name", "target", F.col("receiver").alias("member")), sources), "imports"
    )
    refs = part("type_ref").select(F.col("id").alias("src"), "path", F.col("target").alias("name"), "role")
    typed = staged(resolution.types_by_name(refs, types, imported), "types")
    closure = resolution.base_closure(typed.filter("role = 'base'").select(F.col("src").alias("sub"), F.col("dst").alias("super")))
    named = types.select(F.col("id").alias("_t"), F.col("name").alias("_n"))
    only = named.groupBy("_n").agg(F.min("_t").alias("_t"), F.count(F.lit(1)).alias("_k")).filter("_k = 1")
    known = lambda df: df.join(only, F.element_at(F.split("target", r"\."), -1) == F.col("_n"), "left").withColumn(
        "owner", F.when(F.contains("target", F.lit(":python:")), F.col("target")).otherwise(F.col("_t"))
    )
    sites = known(part("call")).select(F.col("id").alias("src"), "path", "name", "receiver", F.when(F.col("receiver").isNotNull(), F.col("owner")).alias("owner"), "argc", "line")
    calls = staged(resolution.calls_to_nodes(sites, nodes, imported, closure), "calls")
    uses = known(part("field_use")).select(F.col("id").alias("src"), "name", "owner", F.col("role").alias("access"), "line")
    fields = nodes.filter("kind = 'field'").select("id", "name", "owner")
    touched = resolution.fields_to_nodes(uses.filter("owner is not null"), fields, closure)
    methods = nodes.filter("kind = 'callable' and owner is not null").select("id", "owner", "name")
    edges = (
        typed.select(F.when(F.col("role") == "base", "extends").otherwise("uses_type").alias("kind"), "src", "dst")
        .unionByName(resolution.overrides(methods, closure).select(F.lit("overrides").alias("kind"), "src", "dst"))
        .unionByName(touched.select("kind", "src", "dst"))
        .unionByName(
            imported.filter("dst is not null").select(
                F.lit("imports").alias("kind"), F.concat(F.lit(f"{repo}:file:"), "path").alias("src"), F.concat(F.lit(f"{repo}:file:"), "dst").alias("dst")
            )
        )
    )
    endpoints = staged(
        part("endpoint").select(F.col("kind").alias("channel"), "role", F.col("id").alias("src"), F.col("target").alias("address"), F.col("name").alias("method"), "line"),
        "endpoints",
    )
    asked = fixture_calls(nodes).select("src", "dst", *(F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns if c not in ("src", "dst", "precision")), F.lit("heuristic").alias("precision"))
    return {
        "imports": imported,
        "channels": staged(channel_links(endpoints, nodes), "channels"),
        "nodes": nodes,
        "edges": staged(resolution.finished(nodes, edges), "edges"),
        "calls": calls.unionByName(asked.select(*calls.columns)),
        "endpoints": endpoints,
        "errors": part("error").select("path", "name", "attrs"),
    }


def channel_links(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(channel, src, dst, address, precision): requests to route handlers, publishers to
    subscribers, writers of a table or file to its readers, launchers to programs."""
    own = lambda channel, role: endpoints.filter((F.col("channel") == channel) & (F.col("role") == role))
    link = lambda df, channel, address, precision: df.select(
        F.lit(channel).alias("channel"), "src", "dst", address.alias("address"), precision.alias("precision")
    )
    sure, guess = F.lit("heuristic"), F.lit("guess")

    # The verb goes in front as a segment of its own; a route without one serves any that is asked.
    path = F.array_join(route_segments(F.col("address")), "/")
    spelled = lambda verb: F.concat(F.lit("/"), verb, F.lit("/"), path)
    asked = own("http", "call").select("src", "address", spelled(F.col("method")).alias("request"), F.col("method").alias("verb")).distinct()
    served = own("http", "serve").withColumn("verb", F.nullif("method", F.lit("")))
    any_verb = served.filter("verb is null").drop("verb").crossJoin(F.broadcast(asked.select("verb").distinct()))  # a few verbs
    routes = served.filter("verb is not null").unionByName(any_verb).select(F.col("src").alias("dst"), spelled(F.col("verb")).alias("template")).distinct()
    met = channels.match_routes(asked.select("request", F.col("request").alias("url")).distinct(), routes.select(F.struct("dst", "template").alias("route"), "template"))
    http = asked.join(met, "request").select("src", F.col("route.dst").alias("dst"), "address").distinct()

    names = nodes.filter("kind in ('callable', 'test')").groupBy("name").agg(F.min("id").alias("named"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    heard = own("queue", "subscribe").join(names, F.element_at(F.split("method", r"\."), -1) == F.col("name"), "left")
    subscribed = heard.select(F.coalesce("named", "src").alias("dst"), F.col("address").alias("pattern")).distinct()
    queue = channels.match_topics(own("queue", "publish").select("src", F.col("address").alias("topic")), subscribed)

    ends = lambda channel, role, node, name: own(channel, role).select(F.col("src").alias(node), F.col("address").alias(name)).distinct()
    db = channels.match_tables(ends("db", "write", "src", "table"), ends("db", "read", "dst", "table"))
    file = channels.match_files(ends("file", "write", "node", "path"), ends("file", "read", "node", "path"))
    programs = nodes.filter("kind = 'callable' and name = '<module>'").select(F.col("id").alias("dst"), "path")
    process = channels.match_spawns(own("process", "spawn").select("src", F.col("address").alias("command")), programs)
    return (
        link(http, "http", F.col("address"), sure)
        .unionByName(link(queue, "queue", F.col("address"), sure))
        .unionByName(link(db, "db", F.col("address"), F.col("precision")))
        .unionByName(link(file, "file", F.col("address"), guess))
        .unionByName(link(process.withColumn("address", F.lit(None).cast("string")), "process", F.col("address"), sure))
        .filter("src <> dst")
        .distinct()
    )


def fixture_calls(nodes: DataFrame) -> DataFrame:
    """(src, dst): tests and fixtures to the fixtures that their parameters name."""
    params = F.from_json(F.get_json_object("attrs", "$.params"), "array<string>")
    is_fixture = F.coalesce(F.get_json_object("attrs", "$.fixture") == "true", F.lit(False))
    asking = nodes.filter((F.col("kind") == "test") | is_fixture).select("id", "path", F.explode(params).alias("param"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    given = nodes.filter(is_fixture).select("id", "name", folder.alias("folder"), "path")
    return resolution.fixtures(asking, given).filter("src <> dst")


def flow_tables(graph: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """flows and flow_steps: walks from each test, from each file's entry point and from each
    script, over calls, fixtures and channels that carry no data at rest."""
    nodes = graph["nodes"]
    tests = nodes.filter("kind = 'test'").select("id", "name", F.col("id").alias("entry_id"), F.lit("test").alias("kind"))
    module = F.regexp_replace("id", r"<main>$", "<module>")
    mains = nodes.filter("kind = 'entry_point'").select("id", "name", module.alias("entry_id"), F.lit("entry").alias("kind"))
    bodies = nodes.filter("kind = 'callable' and name = '<module>'")
    scripts = resolution.script_entries(bodies.select("path", F.lit(True).alias("has_body")), graph["imports"])
    has_main = nodes.filter("kind = 'entry_point'").select("path")
    alone = bodies.join(scripts.join(has_main, "path", "left_anti"), "path", "left_semi").join(nodes.filter("kind = 'test'").select("path"), "path", "left_anti")
    loose = alone.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("id").alias("entry_id"), F.lit("entry").alias("kind"))
    entries = tests.unionByName(mains).unionByName(loose).withColumn("id", F.concat(F.lit("flow:"), "id"))
    sent = graph["channels"].filter(~F.col("channel").isin(*DATA_CHANNELS)).select("src", "dst", F.lit(None).cast("int").alias("site_start"))
    calls = graph["calls"].filter("dst is not null").select("src", "dst", F.col("line").alias("site_start")).unionByName(sent)
    steps = staged(traverse.walks(entries.select("id", F.col("entry_id").alias("entry")), calls), "steps")
    size = steps.groupBy(F.col("flow_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("steps"), F.max("truncated").alias("truncated"))
    flows = entries.join(size, "id").select("id", "name", "entry_id", "kind", "steps", "truncated")
    rows = steps.select(
        "flow_id",
        F.col("seq").cast("int").alias("seq"),
        F.col("depth").cast("int").alias("depth"),
        F.col("fn").alias("callable_id"),
        F.lit("call").alias("via"),
        F.lit(None).cast("int").alias("site_line"),
        F.col("parent_seq").cast("int").alias("parent_seq"),
    )
    return flows, rows


def index_tree(spark: SparkSession, store: GraphStore, root: str, repo: str, rules: list[str] | None = None) -> None:
    """Index a source tree: the facts of one repository are made anew, those of others, and
    what people and reviewers said, stay."""
    tree = staged(trees.read_tree(spark, root, rules), "tree")
    texts = tree.filter("text is not null")
    graph = python_graph(texts.select("path", "text"), repo)
    flows, steps = flow_tables(graph)
    hashes = texts.select("path", F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    none = lambda t: F.lit(None).cast(t)
    module = trees.modules(tree.select("path"))
    module_id = lambda m: F.concat(F.lit(f"{repo}:module:"), F.when(m == "", ".").otherwise(m))
    raw = graph["nodes"].join(module, "path", "left")
    parent = F.when((F.col("kind") == "file") & F.col("module").isNotNull(), module_id(F.col("module"))).otherwise(F.col("parent_id"))
    nodes = (
        raw.withColumn("parent", parent)
        .join(hashes, "path", "left")
        .select(
            "id", "kind", "name", F.col("parent").alias("parent_id"), F.lit(repo).alias("repo_id"), F.lit("python").alias("language"), "path",
            F.col("first").alias("span_start"), F.col("last").alias("span_end"), "content_hash", F.lit("fact").alias("layer"),
            F.lit("ast").alias("source"), none("string").alias("commit_sha"), "attrs",
        )
    )
    own = module.select("module").distinct().filter("module is not null")
    modules = own.select(
        module_id(F.col("module")).alias("id"), F.lit("module").alias("kind"), F.col("module").alias("name"), none("string").alias("parent_id"),
        F.lit(repo).alias("repo_id"), none("string").alias("language"), F.col("module").alias("path"), none("int").alias("span_start"),
        none("int").alias("span_end"), none("string").alias("content_hash"), F.lit("fact").alias("layer"), F.lit("tree").alias("source"),
        none("string").alias("commit_sha"), none("string").alias("attrs"),
    )
    sent = graph["channels"].select(
        F.lit("communicates").alias("kind"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "precision", F.lit("fact").alias("layer"),
        F.to_json(F.struct("channel", "address")).alias("attrs"),
    )
    edges = graph["edges"].select(
        "kind", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("heuristic").alias("precision"), F.lit("fact").alias("layer"), none("string").alias("attrs")
    ).unionByName(sent)
    calls = graph["calls"].filter("dst is not null").select(
        F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("static").alias("dispatch"), "precision", F.col("line").alias("site_start"), F.col("line").alias("site_end")
    )
    # All relations move together, so that no reader sees half of the repository.
    kept = store.without_facts(repo)
    fresh = nodes.unionByName(modules).dropDuplicates(["id"]).join(kept["nodes"].select("id"), "id", "left_anti")
    mine = F.coalesce(F.col("entry_id").startswith(f"{repo}:"), F.lit(False))
    ours = F.coalesce(F.col("flow_id").startswith(f"flow:{repo}:"), F.lit(False))
    columns = lambda r: store.read(r).columns
    store.write_all(
        {
            "nodes": kept["nodes"].unionByName(fresh.select(*columns("nodes"))),
            "edges": kept["edges"].unionByName(edges.select(*columns("edges"))),
            "calls": kept["calls"].unionByName(calls.select(*columns("calls"))),
            "flows": store.read("flows").filter(~mine).unionByName(flows),
            "flow_steps": store.read("flow_steps").filter(~ours).unionByName(steps),
        }
    )
