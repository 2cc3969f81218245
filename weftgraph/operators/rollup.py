"""Links and flows rolled up to modules, and state shared across types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ends(links: DataFrame, functions: DataFrame, *columns: str) -> DataFrame:
    """links with columns of both ends, prefixed from_ and to_."""
    f = functions.select("id", *columns)
    src = f.select(F.col("id").alias("src"), *(F.col(c).alias(f"from_{c}") for c in columns))
    dst = f.select(F.col("id").alias("dst"), *(F.col(c).alias(f"to_{c}") for c in columns))
    return links.join(src, "src").join(dst, "dst")


def module_edges(calls: DataFrame, functions: DataFrame, unit: str = "module_id") -> DataFrame:
    """(from_module, to_module, n): call sites between different modules.

    Sites are counted per pair before the joins, so that the joins carry one row per pair."""
    pairs = calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("sites"))
    return (
        _ends(pairs, functions, unit)
        .filter(F.col(f"from_{unit}") != F.col(f"to_{unit}"))
        .groupBy(F.col(f"from_{unit}").alias("from_module"), F.col(f"to_{unit}").alias("to_module"))
        .agg(F.sum("sites").cast("long").alias("n"))
    )


def most_called_across(calls: DataFrame, functions: DataFrame, most: int = 20, unit: str = "module_id") -> DataFrame:
    """The nodes with most distinct callers in other modules."""
    return (
        _ends(calls.select("src", "dst").distinct(), functions, unit)
        .filter(F.col(f"from_{unit}") != F.col(f"to_{unit}"))
        .groupBy("dst")
        .agg(F.count(F.lit(1)).alias("callers"))
        .orderBy(F.desc("callers"), "dst")
        .limit(most)
    )


def overview(functions: DataFrame, calls: DataFrame, access: DataFrame) -> DataFrame:
    """Per module: functions, types, call sites out, fields written and read."""
    by = functions.groupBy("module_id").agg(
        F.count(F.lit(1)).alias("functions"), F.countDistinct("type_id").alias("types"), F.countDistinct("name").alias("names")
    )
    module = functions.select(F.col("id").alias("src"), "module_id")
    sites = calls.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(module, "src")
    touched = (
        access.groupBy("src")
        .agg(F.count_if(F.col("kind") == "writes").alias("w"), F.count_if(F.col("kind") == "reads").alias("r"))
        .join(module, "src")
    )
    return (
        by.join(sites.groupBy("module_id").agg(F.sum("n").cast("long").alias("call_sites")), "module_id", "left")
        .join(
            touched.groupBy("module_id").agg(F.sum("w").cast("long").alias("writes"), F.sum("r").cast("long").alias("reads")),
            "module_id",
            "left",
        )
        .na.fill(0, ["call_sites", "writes", "reads"])
    )


def flows_crossing(steps: DataFrame, functions: DataFrame) -> DataFrame:
    """Flows that leave the module of their first step, and those that come back to it
    from a step elsewhere. One window per flow instead of joins of steps with steps."""
    from pyspark.sql import Window

    own = steps.join(functions.select(F.col("id").alias("fn"), "module_id"), "fn")
    flow = Window.partitionBy("flow_id")
    home = F.max(F.when(F.col("seq") == 0, F.col("module_id"))).over(flow)
    parent = F.max("module_id").over(flow.orderBy("seq").rangeBetween(-1, -1))
    away = F.col("module_id") != F.col("home")
    back = ~away & (F.col("parent") != F.col("home"))
    return (
        own.withColumn("home", home)
        .withColumn("parent", parent)
        .filter(F.col("home").isNotNull())
        .groupBy("flow_id")  # dealt by flow already
        .agg(F.bool_or(away).alias("away"), F.bool_or(back).alias("back"))
        .agg(F.count_if("away").alias("crossing"), F.count_if("back").alias("returning_"))
    )


def shared_state(access: DataFrame, functions: DataFrame, outside: Column | None = None) -> DataFrame:
    """Per field: writers, the types they belong to, and their modules. access has one row
    per kind, src and field."""
    own = access.filter("kind = 'writes'").join(functions.select(F.col("id").alias("src"), "type_id", "module_id"), "src")
    if outside is not None:
        own = own.filter(outside)
    # Writers are distinct per field already; what is counted distinct has one row per type.
    by_type = own.groupBy("field", "type_id", "module_id").agg(F.count(F.lit(1)).alias("n"))
    return by_type.groupBy("field").agg(
        F.sum("n").cast("long").alias("writers"),
        F.countDistinct("type_id").alias("written_from"),
        F.countDistinct("module_id").alias("writer_modules"),
    )


def field_access(access: DataFrame) -> DataFrame:
    """Per field: readers, writers, uses and the first line."""
    return access.groupBy("field").agg(
        F.count_if(F.col("kind") == "reads").alias("readers"),
        F.count_if(F.col("kind") == "writes").alias("writers"),
        F.sum("n").cast("long").alias("uses"),
        F.min("line").cast("long").alias("first_line"),
    )


def cross_repo(links: DataFrame, repos: DataFrame) -> DataFrame:
    """(from_repo, to_repo, kind, n): links (kind, src, dst) between repositories (id, repo)."""
    r = repos.select("id", "repo")
    return (
        links.filter("kind <> 'contains'")
        .join(r.select(F.col("id").alias("src"), F.col("repo").alias("from_repo")), "src")
        .join(r.select(F.col("id").alias("dst"), F.col("repo").alias("to_repo")), "dst")
        .filter("from_repo <> to_repo")
        .groupBy("from_repo", "to_repo", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def systems(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(system, members, name): groups (system, member) with their name (system, value,
    layer), a person's before an inferred one."""
    said = names.groupBy("system").agg(
        F.max_by("value", F.struct((F.col("layer") == "intent").alias("i"), F.col("value"))).alias("name")
    )
    return groups.groupBy("system").agg(F.countDistinct("member").alias("members")).join(said, "system", "left")


def part_links(calls: DataFrame, functions: DataFrame, part: str = "type_id") -> DataFrame:
    """(part, members, inside, out, into): call pairs of each part inside it, out of it and
    into it, and its size."""
    size = functions.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("members"))
    both = _ends(calls.select("src", "dst").distinct(), functions, part)
    a, b = F.col(f"from_{part}"), F.col(f"to_{part}")
    rows = both.select(a.alias("part"), (a == b).alias("inside"), F.lit(True).alias("out")).unionByName(
        both.filter(a != b).select(b.alias("part"), F.lit(False).alias("inside"), F.lit(False).alias("out"))
    )
    sums = rows.groupBy("part").agg(
        F.count_if("inside").alias("inside"),
        F.count_if(F.col("out") & ~F.col("inside")).alias("out"),
        F.count_if(~F.col("out")).alias("into"),
    )
    return size.join(sums, "part", "left").na.fill(0, ["inside", "out", "into"])
