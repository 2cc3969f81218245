"""Links over channels: routes, tables, topics, files, and registered implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import normalised, plural_stem, route_segments
from weftgraph.operators.links import guarded_join
from weftgraph.schema import DB_FAN_OUT, FILE_FAN_OUT, QUEUE_FAN_OUT


#: How a route segment that takes any rest of an address is written.
REST = r"^\*|^\{\*|^<path:|^\[\.\.\.|:path\}$|\*\}$"


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route): requests (request, url) to routes (route, template), without regard
    to case.  A segment that starts with <, { or : matches any one segment, a last one that
    is a wildcard one or more; the route with most literal segments wins, of equals the one
    without a wildcard, and a tie links nothing.

    Requests and routes meet on the first segment and, but for wildcards, their number."""
    req = requests.select("request", F.transform(route_segments(F.col("url")), F.lower).alias("s"))
    tpl = routes.select("route", F.transform(route_segments(F.col("template")), F.lower).alias("t"))
    param = lambda x: x.rlike(r"^[<{:*\[]")
    last = F.try_element_at("t", F.lit(-1))
    wild = F.coalesce(last.rlike(REST), F.lit(False))
    shaped = tpl.select("route", "t", wild.alias("wild"), F.when(wild, F.size("t") - 1).otherwise(F.size("t")).alias("m"))
    head = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    keyed = shaped.withColumns(
        {
            "key": F.when((F.size("t") > 0) & param(head("t")), F.lit(None).cast("string")).otherwise(head("t")),
            "n": F.when(F.col("wild"), -1).otherwise(F.size("t")),
        }
    )
    # A request asks under its own first segment and under none, with its number and with -1.
    asked = req.withColumn("n_s", F.size("s")).select(
        "request", "s", "n_s", F.explode(F.array(head("s"), F.lit(None).cast("string"))).alias("k")
    ).withColumn("at", F.explode(F.array("n_s", F.lit(-1))))
    fits = F.forall(F.zip_with(F.slice("s", F.lit(1), F.col("m")), F.slice("t", F.lit(1), F.col("m")), lambda a, b: param(b) | (a == b)), lambda x: x)
    literal = F.size(F.filter("t", lambda x: ~param(x)))
    hit = (
        asked.join(keyed, F.col("k").eqNullSafe(F.col("key")) & (F.col("at") == F.col("n")))
        .filter((~F.col("wild") | (F.col("n_s") > F.col("m"))) & fits)
        .select("request", "route", (2 * literal + (~F.col("wild")).cast("int")).alias("literal"))
    )
    best = Window.partitionBy("request")
    return (
        hit.withColumn("top", F.max("literal").over(best))
        .filter("literal = top")
        .withColumn("k", F.count(F.lit(1)).over(best))
        .filter("k = 1")
        .select("request", "route")
    )


def match_topics(published: DataFrame, subscribed: DataFrame, most: int = QUEUE_FAN_OUT) -> DataFrame:
    """(src, dst, address): publishers (src, topic) to subscribers (dst, pattern): equal, or
    by wildcard: * one dot segment, # the rest, + one slash segment. Addresses with more
    links than ``most`` are dropped.

    Plain names meet in an equi-join; only patterns with a wildcard are tried on topics,
    and they on distinct topics of the same beginning alone."""
    wild = F.col("pattern").rlike(r"[*#+]")
    escaped = F.regexp_replace("pattern", r"([.^$|()\[\]{}\\?])", r"\\$1")
    one = F.regexp_replace(escaped, r"\+", "[^/]+")  # first, as the others bring in signs of their own
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(one, r"\*", "[^.]+"), "#", ".*"), F.lit("$"))
    # A pattern's first segment is fixed or has a wildcard; topics ask under theirs and under none.
    first = lambda c: F.split(c, "[./]")[0]
    start = F.when(first(F.col("pattern")).rlike(r"[*#+]"), F.lit(None).cast("string")).otherwise(first(F.col("pattern")))
    patterns = subscribed.filter(wild).select("pattern", regex.alias("rx"), start.alias("start")).distinct()
    topics = published.select("topic").distinct()
    asked = topics.select("topic", F.explode(F.array(first(F.col("topic")), F.lit(None).cast("string"))).alias("at"))
    met = F.col("at").eqNullSafe(F.col("start")) & F.expr("topic rlike rx")
    pairs = asked.join(patterns, met).select("topic", "pattern")
    plain = topics.join(subscribed.filter(~wild), F.col("topic") == F.col("pattern")).select("topic", "dst")
    heard = plain.unionByName(pairs.join(subscribed, "pattern").select("topic", "dst")).distinct()
    links = guarded_join(published.select("src", "topic").distinct(), heard, "topic", most)
    return links.select("src", "dst", F.col("topic").alias("address"))


def match_tables(writers: DataFrame, readers: DataFrame, most: int = DB_FAN_OUT) -> DataFrame:
    """(src, dst, address, precision): writers (src, table) to readers (dst, table) of one
    table, each pair once a table and none with itself.  Equal normalised names are
    heuristic; names equal only after folding plurals are guesses.  Folded names of more
    than ``most`` pairs are too common to link."""
    folded = lambda df, end: df.select(end, normalised(F.col("table")).alias(end[0])).distinct().withColumn("stem", plural_stem(F.col(end[0])))
    w, r = folded(writers, "src"), folded(readers, "dst")
    # Names are matched with their counts first; only those within the bound are expanded.
    a = w.groupBy("stem").agg(F.count_distinct("src").alias("_a"))
    b = r.groupBy("stem").agg(F.count_distinct("dst").alias("_b"))
    few = a.join(b, "stem").filter(F.col("_a") * F.col("_b") <= most).select("stem")
    same = F.col("s") == F.col("d")
    return (
        w.join(few, "stem", "left_semi")
        .join(r, "stem")
        .filter(~F.col("src").eqNullSafe(F.col("dst")))
        .groupBy("src", "dst", "stem")
        .agg(F.min(F.when(same, F.col("s"))).alias("equal"), F.min(F.concat_ws(" ~ ", "s", "d")).alias("alike"))
        .select(
            "src",
            "dst",
            F.coalesce("equal", "alike").alias("address"),
            F.when(F.col("equal").isNotNull(), "heuristic").otherwise("guess").alias("precision"),
        )
    )


def match_files(writers: DataFrame, readers: DataFrame, most: int = FILE_FAN_OUT) -> DataFrame:
    """(src, dst, address): writers and readers (node, path) that name the same file, where
    at most ``most`` pairs do."""
    name = F.element_at(F.split("path", "/"), -1)
    w = writers.select(F.col("node").alias("src"), name.alias("address")).distinct()
    r = readers.select(F.col("node").alias("dst"), name.alias("address")).distinct()
    return guarded_join(w, r, "address", most).filter("src <> dst").select("src", "dst", "address")


def match_registrations(calls: DataFrame, registrations: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): calls (src, interface, name) to the method of that name of each type
    registered for the interface (interface, type_id); members has owner, name, id."""
    return (
        calls.join(registrations, "interface")
        .join(members.select(F.col("owner").alias("type_id"), "name", F.col("id").alias("dst")), ["type_id", "name"])
        .select("src", "dst")
        .distinct()
    )


def match_events(raised: DataFrame, handled: DataFrame) -> DataFrame:
    """(src, dst, event): raisers (src, event) to handlers (dst, event), each once."""
    handlers = handled.select(F.col("handler").alias("dst"), "event").distinct()
    return raised.select("src", "event").distinct().join(handlers, "event").select("src", "dst", "event")


def match_stubs(calls: DataFrame, servers: DataFrame) -> DataFrame:
    """(src, dst): remote calls (src, service, method, path) to servers (dst, service,
    method, path); of several the one that shares most leading folders, none on a tie."""
    p, q = F.split("path", "/"), F.split("server_path", "/")
    same = F.zip_with(p, q, lambda a, b: a.eqNullSafe(b))
    shared = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))
    hit = calls.join(servers.withColumnRenamed("path", "server_path"), ["service", "method"]).withColumn("shared", shared)
    best = Window.partitionBy("src", "service", "method")
    return (
        hit.withColumn("top", F.max("shared").over(best))
        .filter("shared = top")
        .withColumn("k", F.count(F.lit(1)).over(best))
        .filter("k = 1")
        .select("src", "dst")
    )


def match_keys(writers: DataFrame, readers: DataFrame) -> DataFrame:
    """(src, dst, hits, precision): writers (src, parts) to readers (dst, parts) of composed
    keys, a hole being an empty part, where at least two fixed parts agree at one alignment
    and none disagrees.

    Pairs that can fit share a fixed part, so they meet on parts, not all with all; only
    they are aligned."""
    from collections.abc import Iterator

    import pyarrow as pa

    w = writers.select("src", "parts").distinct()
    r = readers.select(F.col("dst"), F.col("parts").alias("read")).distinct()
    fixed = lambda df, c, out: df.select("*", F.explode(F.array_distinct(F.filter(c, lambda x: x != ""))).alias(out))
    pairs = (
        fixed(w, F.col("parts"), "p").join(fixed(r, F.col("read"), "p"), "p").groupBy("src", "dst", "parts", "read")
        .agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("src", "dst", "parts", "read")
    )
    kinds = {k: t for k, t in pairs.dtypes}

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.sources.keyshape import alignment, fit_precision

        for batch in batches:
            found = [alignment(tuple(a), tuple(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([f is not None for f in found], pa.bool_())
            hits = [f[1] for f in found if f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(hits, pa.int64()), pa.array([fit_precision(h) for h in hits], pa.string())],
                ["src", "dst", "hits", "precision"],
            )

    return pairs.mapInArrow(align, f"src {kinds['src']}, dst {kinds['dst']}, hits long, precision string")


def match_spawns(spawns: DataFrame, programs: DataFrame) -> DataFrame:
    """(src, dst): launched commands (src, command) to the program (dst, path) whose file a
    word of the command ends in; the longest path that fits, none where two fit alike."""
    words = F.filter(F.split("command", r"[\s\"']+"), lambda x: x != "")
    asked = spawns.select("src", F.explode(F.transform(words, lambda x: F.regexp_replace(x, r"^\.?/+", ""))).alias("word"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    hit = asked.join(programs.select("dst", F.explode(ends).alias("word")), "word")
    w = Window.partitionBy("src")
    best = hit.withColumn("most", F.max(F.length("word")).over(w)).filter(F.length("word") == F.col("most")).select("src", "dst").distinct()
    return best.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("src", "dst")
