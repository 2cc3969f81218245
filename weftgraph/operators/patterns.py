"""Structural patterns over types: each matcher is one aggregation or semi-join.

Relations: subtypes (sub, super), fields (owner, name, type_id, role, is_static, many),
methods (id, owner, returns, visibility, is_ctor), calls (src, dst), creates (src, type_id),
events (src, address).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def composite(subtypes: DataFrame, fields: DataFrame) -> DataFrame:
    """(type_id, super): a type that holds many of its own supertype."""
    many = fields.filter("many").select(F.col("owner").alias("sub"), F.col("type_id").alias("super")).distinct()
    return subtypes.join(many, ["sub", "super"], "left_semi").select(F.col("sub").alias("type_id"), "super").distinct()


def decorator(subtypes: DataFrame, fields: DataFrame) -> DataFrame:
    """(type_id, super): a type that holds one of its own supertype and is no composite."""
    one = fields.filter("not many").select(F.col("owner").alias("sub"), F.col("type_id").alias("super")).distinct()
    found = subtypes.join(one, ["sub", "super"], "left_semi").select(F.col("sub").alias("type_id"), "super").distinct()
    return found.join(composite(subtypes, fields), ["type_id", "super"], "left_anti")


def strategy(subtypes: DataFrame, uses: DataFrame, least: int = 2) -> DataFrame:
    """(super, implementations, contexts): supertypes with at least ``least`` subtypes that
    another type uses (owner, type_id)."""
    kinds = subtypes.groupBy("super").agg(F.countDistinct("sub").alias("implementations")).filter(F.col("implementations") >= least)
    own = uses.join(subtypes.select(F.col("sub").alias("owner"), F.col("super").alias("type_id")), ["owner", "type_id"], "left_anti")
    contexts = own.groupBy(F.col("type_id").alias("super")).agg(F.countDistinct("owner").alias("contexts"))
    return kinds.join(contexts, "super")


def template_method(calls: DataFrame, methods: DataFrame, overridden: DataFrame) -> DataFrame:
    """(id): methods that call an overridden method of their own type."""
    own = methods.select(F.col("id").alias("src"), F.col("owner").alias("o1"))
    hook = methods.join(overridden.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("dst"), F.col("owner").alias("o2"))
    return calls.join(own, "src").join(hook, "dst").filter("o1 = o2 and src <> dst").select(F.col("src").alias("id")).distinct()


def observer(events: DataFrame, handlers: DataFrame, least: int = 1) -> DataFrame:
    """(owner, address, handlers): events by the type that raises them and who listens."""
    return (
        events.select("owner", "address").distinct()
        .join(handlers.select("address", "handler").distinct(), "address")
        .groupBy("owner", "address")
        .agg(F.countDistinct("handler").alias("handlers"))
        .filter(F.col("handlers") >= least)
    )


def factory(creates: DataFrame, subtypes: DataFrame, least: int = 2) -> DataFrame:
    """(src, super, made): functions that make at least ``least`` types of one supertype;
    of several supertypes the one with most."""
    made = (
        creates.select("src", F.col("type_id").alias("sub")).distinct()
        .join(subtypes, "sub")
        .groupBy("src", "super")
        .agg(F.countDistinct("sub").alias("made"))
        .filter(F.col("made") >= least)
    )
    best = F.max(F.struct(F.col("made"), F.col("super"))).alias("b")
    return made.groupBy("src").agg(best).select("src", F.col("b.super").alias("super"), F.col("b.made").alias("made"))


def builder(methods: DataFrame) -> DataFrame:
    """(owner, steps): types with two or more methods that return their own type and one
    that builds another. methods has owner, name, returns."""
    own = F.col("returns") == F.col("owner")
    ends = F.lower("name").rlike("^(build|create)") & ~own
    return (
        methods.groupBy("owner")
        .agg(F.count_if(own).alias("steps"), F.count_if(ends).alias("ends"))
        .filter("steps >= 2 and ends >= 1")
        .select("owner", "steps")
    )


def singleton(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner): types with a static field of their own type and no public constructor."""
    held = fields.filter("is_static and owner = type_id").select("owner").distinct()
    hidden = methods.filter("is_ctor").groupBy("owner").agg(F.bool_and(F.col("visibility") != "public").alias("h")).filter("h")
    return held.join(hidden, "owner", "left_semi")


def process_boundary(links: DataFrame) -> DataFrame:
    """(launcher, program, pipes): a function that starts another program, and whether it
    talks to it over pipes; links has src, dst, channel, pipes."""
    return (
        links.filter("channel = 'process'")
        .groupBy(F.col("src").alias("launcher"), F.col("dst").alias("program"))
        .agg(F.bool_or(F.coalesce("pipes", F.lit(False))).alias("pipes"))
    )


def relabelled(labels: DataFrame, found: DataFrame, hashes: DataFrame, matcher: str = "structural") -> DataFrame:
    """Labels (id, pattern, matcher, evidence_hash, stale) after a fresh pass: the matcher's own
    are those found now; others stay, and are stale if the evidence hashes to something else
    now (hashes has id, evidence_hash)."""
    now = hashes.select("id", F.col("evidence_hash").alias("_now"))
    kept = labels.filter(F.col("matcher") != matcher).join(now, "id", "left")
    stale = ~F.col("evidence_hash").eqNullSafe(F.col("_now"))
    fresh = found.select("id", "pattern", F.lit(matcher).alias("matcher"), "evidence_hash", F.lit(False).alias("stale"))
    return fresh.unionByName(kept.select("id", "pattern", "matcher", "evidence_hash", stale.alias("stale")))
