"""Names to nodes: imports, types, overrides, calls and fields as ranked joins.

Every rule gives candidates with a priority; the best priority counts, and a call
links to all candidates of it only where the rule says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import staged


def imports_to_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target, member, dst): dst is the file that an import names, null if it is
    outside. A member may itself be a module. files has path and module (dotted name)."""
    f = files.select(F.col("module").alias("_m"), F.col("path").alias("_f"))
    sub = f.select(F.col("_m").alias("_m2"), F.col("_f").alias("_f2"))
    as_module = F.concat_ws(".", "target", "member")
    return (
        imports.join(f, F.col("target") == F.col("_m"), "left")
        .join(sub, as_module == F.col("_m2"), "left")
        .select("path", "name", "target", "member", F.coalesce("_f2", "_f").alias("dst"), F.col("_f2").isNotNull().alias("is_module"))
    )


def types_by_name(refs: DataFrame, types: DataFrame, imported: DataFrame) -> DataFrame:
    """(src, dst, role): type references (src, path, name, role) to declarations (id, name,
    path): the same file first, then a file that an import brings in."""
    own = refs.join(types.select(F.col("id").alias("dst"), "name", "path"), ["name", "path"]).withColumn("_rank", F.lit(0))
    via = (
        refs.join(imported.filter("dst is not null").select("path", "name", F.col("dst").alias("_file"), "member"), ["path", "name"])
        .join(types.select(F.col("id").alias("dst"), F.col("name").alias("member"), F.col("path").alias("_file")), ["member", "_file"])
        .withColumn("_rank", F.lit(1))
    )
    both = own.select("src", "path", "name", "role", "dst", "_rank").unionByName(via.select("src", "path", "name", "role", "dst", "_rank"))
    k = F.row_number().over(Window.partitionBy("src", "name", "role").orderBy("_rank", "dst"))
    return both.withColumn("_k", k).filter("_k = 1").select("src", "dst", "role")


def base_closure(bases: DataFrame) -> DataFrame:
    """(sub, super, dist): all bases of each type over (sub, super), nearest distance; until
    nothing is new."""
    out = front = staged(bases.select("sub", "super", F.lit(1).cast("long").alias("dist")).filter("sub <> super").distinct(), "bases")
    while True:
        nxt = (
            front.withColumnRenamed("super", "_mid")
            .join(bases.select(F.col("sub").alias("_mid"), "super"), "_mid")
            .select("sub", "super", (F.col("dist") + 1).alias("dist"))
            .filter("sub <> super")
            .distinct()
            .join(out, ["sub", "super"], "left_anti")
        )
        front = staged(nxt, "bases")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def overrides(methods: DataFrame, closure: DataFrame) -> DataFrame:
    """(src, dst): methods (id, owner, name) to the method of that name in the nearest base."""
    m = methods.select(F.col("id").alias("src"), F.col("owner").alias("sub"), "name")
    b = methods.select(F.col("id").alias("dst"), F.col("owner").alias("super"), "name")
    hit = m.join(closure, "sub").join(b, ["super", "name"]).filter(~F.col("name").rlike("^__.*__$"))
    return hit.groupBy("src").agg(F.min_by("dst", F.struct("dist", "dst")).alias("dst"))


def calls_to_nodes(calls: DataFrame, nodes: DataFrame, imported: DataFrame, closure: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """(src, line, name, dst, rank, precision, outcome): call records (src, path, name,
    receiver, owner, argc, line) to callables (id, name, owner, path, kind, argc_min, argc_max).

    By rank: 1 a bare name in scope of the own file, 2 a name that an import brings in, 3 a
    member of the receiver's own type (owner), 4 of its bases, nearest first, 5 a member of an
    imported module, 6 the only callable of that name anywhere, a guess, unless the name is
    known on an outside type. outcome is resolved, external or unresolved."""
    own = calls.withColumn("_c", F.xxhash64("src", "path", "name", "receiver", "line"))
    fn = nodes.filter("kind in ('callable', 'type', 'test')")
    fits = (F.col("argc_min").isNull() | (F.col("argc") >= F.col("argc_min"))) & (F.col("argc_max").isNull() | (F.col("argc") <= F.col("argc_max")))
    target = lambda *c: fn.select(F.col("id").alias("dst"), "argc_min", "argc_max", *c)
    bare = own.filter("receiver is null")
    brought = imported.select("path", F.col("name").alias("_as"), F.col("dst").alias("_file"), "member", "is_module")
    parts = [
        bare.join(target("name", "path", "owner").filter("owner is null").drop("owner"), ["name", "path"]).withColumn("rank", F.lit(1)),
        bare.join(brought.withColumnRenamed("_as", "name"), ["path", "name"])
        .join(target(F.col("name").alias("member"), F.col("path").alias("_file"), "owner").filter("owner is null").drop("owner"), ["member", "_file"])
        .withColumn("rank", F.lit(2)),
        own.filter("receiver is not null and receiver <> 'base'").join(target("name", "owner"), ["name", "owner"]).withColumn("rank", F.lit(3)),
        own.filter("receiver is not null")
        .join(closure.select(F.col("sub").alias("owner"), F.col("super").alias("_base"), "dist"), "owner")
        .join(target("name", F.col("owner").alias("_base")), ["name", "_base"])
        .withColumn("rank", F.lit(10) + F.col("dist")),
        own.filter("receiver is not null")
        .join(brought.filter("is_module").withColumnRenamed("_as", "receiver"), ["path", "receiver"])
        .join(target("name", F.col("path").alias("_file"), "owner").filter("owner is null").drop("owner"), ["name", "_file"])
        .withColumn("rank", F.lit(5)),
    ]
    columns = ["_c", "dst", "rank"]
    sure = None
    for p in parts:
        rows = p.filter(fits).select(*(F.col(c).cast("int").alias(c) if c == "rank" else F.col(c) for c in columns))
        sure = rows if sure is None else sure.unionByName(rows)
    only = fn.filter("owner is not null").groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("dst")).filter("_n = 1")
    guess = own.filter("receiver is not null and receiver not in ('this', 'base') and owner is null").join(only, "name")
    guess = guess.join(brought.select("path", F.col("_as").alias("receiver")), ["path", "receiver"], "left_anti")
    if outside is not None:
        guess = guess.join(outside.select("name"), "name", "left_anti")
    found = sure.unionByName(guess.select("_c", "dst", F.lit(100).alias("rank")))
    k = F.row_number().over(Window.partitionBy("_c").orderBy("rank", "dst"))
    best = found.withColumn("_k", k).filter("_k = 1").drop("_k")
    known_outside = imported.filter("dst is null").select("path", F.col("name").alias("_first")).distinct()
    first = F.substring_index(F.coalesce("receiver", "name"), ".", 1)
    return (
        own.join(best, "_c", "left")
        .join(known_outside.withColumnRenamed("path", "_p").withColumn("_ext", F.lit(True)), (F.col("path") == F.col("_p")) & (first == F.col("_first")), "left")
        .select(
            "src",
            "line",
            "name",
            "dst",
            "rank",
            F.when(F.col("rank") == 100, "guess").when(F.col("rank").isNotNull(), "heuristic").alias("precision"),
            F.when(F.col("dst").isNotNull(), "resolved").when(F.col("_ext"), "external").otherwise("unresolved").alias("outcome"),
        )
    )


def fields_to_nodes(uses: DataFrame, fields: DataFrame, closure: DataFrame) -> DataFrame:
    """(kind, src, dst, n, line): uses (src, name, owner, access, line) to fields (id, name,
    owner) of the type or its nearest base; reads and writes are counted apart."""
    direct = uses.join(fields.select(F.col("id").alias("dst"), "name", "owner"), ["name", "owner"]).withColumn("dist", F.lit(0).cast("long"))
    up = uses.join(closure.select(F.col("sub").alias("owner"), F.col("super").alias("_base"), "dist"), "owner").join(
        fields.select(F.col("id").alias("dst"), "name", F.col("owner").alias("_base")), ["name", "_base"]
    )
    both = direct.select("src", "name", "line", "access", "dst", "dist").unionByName(up.select("src", "name", "line", "access", "dst", "dist"))
    k = F.row_number().over(Window.partitionBy("src", "name", "line", "access").orderBy("dist", "dst"))
    one = both.withColumn("_k", k).filter("_k = 1")
    kinds = F.when(F.col("access") == "rw", F.array(F.lit("reads"), F.lit("writes"))).when(F.col("access") == "w", F.array(F.lit("writes"))).otherwise(F.array(F.lit("reads")))
    return (
        one.select("src", "dst", "line", F.explode(kinds).alias("kind"))
        .groupBy("kind", "src", "dst")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    )


def fixtures(tests: DataFrame, fixture_nodes: DataFrame) -> DataFrame:
    """(src, dst): parameters of tests (id, path, param) to the nearest fixture (id, name,
    folder, path): the same file, then the deepest folder above."""
    hit = tests.join(
        fixture_nodes.select(F.col("id").alias("dst"), F.col("name").alias("param"), F.col("folder").alias("_d"), F.col("path").alias("_p")), "param"
    ).filter((F.col("path") == F.col("_p")) | ((F.col("_d") == "") | F.startswith("path", F.concat("_d", F.lit("/")))) & F.endswith("_p", F.lit("conftest.py")))
    near = F.struct((F.col("path") == F.col("_p")).alias("same"), F.length("_d").alias("depth"), F.col("dst").alias("d"))
    return hit.groupBy(F.col("id").alias("src"), "param").agg(F.max_by("dst", near).alias("dst")).select("src", "dst").distinct()


def finished(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends known, each once, and containment from the nodes' parents."""
    ids = nodes.select("id")
    kept = (
        edges.select("kind", "src", "dst")
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .distinct()
    )
    inside = nodes.filter("parent_id is not null").select(F.lit("contains").alias("kind"), F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return kept.select("kind", "src", "dst").unionByName(inside)


def script_entries(files: DataFrame, imported: DataFrame) -> DataFrame:
    """(path): files with top-level code (has_body) that no import names: programs."""
    named = imported.filter("dst is not null").select(F.col("dst").alias("path")).distinct()
    return files.filter("has_body").select("path").join(named, "path", "left_anti")


def attached_methods(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(id, owner): methods written outside their type (id, folder, receiver) to the type of
    that name in the same folder (id, folder, name), where there is one."""
    one = types.groupBy("folder", F.col("name").alias("receiver")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("owner"))
    return methods.join(one.filter("_n = 1"), ["folder", "receiver"]).select("id", "owner")


def aliased(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, target, real): import targets under an alias prefix (prefix, put), the longest
    prefix first. Prefixes of a target are made from it, so the join is on equal keys."""
    parts = F.split("target", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = imports.select("path", "target", F.explode(prefixes).alias("prefix")).join(aliases, "prefix")
    best = hit.groupBy("path", "target").agg(F.max_by(F.struct("prefix", "put"), F.length("prefix")).alias("b"))
    return best.select("path", "target", F.concat(F.col("b.put"), F.expr("substring(target, length(b.prefix) + 1)")).alias("real"))


def by_path_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, dst): import targets that are the end of exactly one file's path without
    its ending; whole path parts only."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    wanted = imports.select("target").distinct()
    found = (
        files.select(F.col("path").alias("dst"), F.explode(ends).alias("target"))
        .join(wanted, "target", "left_semi")
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("dst"))
        .filter("_n = 1")
        .drop("_n")
    )
    return imports.select("path", "target").join(found, "target").filter("path <> dst").select("path", "target", "dst")


def argument_types(passed: DataFrame, forwarded: DataFrame) -> DataFrame:
    """(fn, param, type_id): the types that callers pass to a parameter. passed has those
    known at a call; forwarded (fn, param, to_fn, to_param) are parameters handed on, and
    types follow them until nothing is new."""
    out = front = staged(passed.select("fn", "param", "type_id").distinct(), "argument-types")
    while True:
        nxt = (
            front.join(forwarded, ["fn", "param"])
            .select(F.col("to_fn").alias("fn"), F.col("to_param").alias("param"), "type_id")
            .distinct()
            .join(out, ["fn", "param", "type_id"], "left_anti")
        )
        front = staged(nxt, "argument-types")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def overload(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """(call, dst): of several candidates (name, dst, argc_min, argc_max) the one whose
    argument count fits most narrowly; none where two fit alike."""
    hit = calls.join(candidates, "name").filter("argc between argc_min and argc_max").withColumn("room", F.col("argc_max") - F.col("argc_min"))
    w = Window.partitionBy("call")
    best = hit.withColumn("least", F.min("room").over(w)).filter("room = least")
    return best.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("call", "dst")


def moved_members(before: DataFrame, now: DataFrame) -> DataFrame:
    """(repo, was, now): repositories known by first commit and origin at another root."""
    return (
        before.select("repo", F.col("root").alias("was"), "first_commit", "origin")
        .join(now.select(F.col("root").alias("now"), "first_commit", "origin"), ["first_commit", "origin"])
        .filter("was <> now")
        .select("repo", "was", "now")
    )
