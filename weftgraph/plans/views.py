"""Property-graph views over the order tables, for exercising every operator at scale.

A part is a callable, its type a module, its type and brand a type; one order's lines
in order are a chain of calls; suppliers are the fields that parts touch; an order is a
flow and a commit; events are test results and covered lines.

``CTES`` holds the same views as text for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT = "1998-01-01 00:00:00"
RUN_CUT = "2024-01-16 00:00:00"
_LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
    "l_returnflag",
    "l_linestatus",
)


class Views:
    """The views of one folder of tables; each is planned where it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """The lines of every order with their place in it."""
        place = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
        return self.table("lineitem").withColumn("rn", F.row_number().over(place))

    def functions(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.concat("p_type", F.lit("/"), "p_brand").alias("type_id"),
            F.col("p_type").alias("module_id"),
        )

    def calls(self) -> DataFrame:
        """Call sites: each line's part calls the next line's; one window, no self-join."""
        place = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
        return (
            self.table("lineitem")
            .select(
                F.col("l_partkey").alias("src"),
                F.lead("l_partkey").over(place).alias("dst"),
                F.row_number().over(place).alias("site_start"),
                F.when(F.col("l_returnflag") == "R", "virtual").otherwise("static").alias("dispatch"),
                F.when(F.col("l_discount") < 0.02, "guess").otherwise("heuristic").alias("precision_"),
            )
            .filter("src <> dst")
        )

    def access(self) -> DataFrame:
        return (
            self.lines()
            .groupBy(
                F.when(F.col("l_returnflag") == "R", "writes").otherwise("reads").alias("kind"),
                F.col("l_partkey").alias("src"),
                F.col("l_suppkey").alias("field"),
            )
            .agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("line"))
        )

    def flows(self) -> DataFrame:
        return (
            self.table("orders")
            .select(
                F.col("o_orderkey").alias("id"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("entry").alias("kind"),
                F.col("o_custkey").alias("entry_id"),
            )
        )

    def steps(self) -> DataFrame:
        return self.lines().select(
            F.col("l_orderkey").alias("flow_id"),
            (F.col("rn") - 1).alias("seq"),
            F.col("l_partkey").alias("fn"),
            F.when(F.col("rn") > 1, F.col("rn") - 2).alias("parent_seq"),
        )

    def changes(self) -> DataFrame:
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("dir"))
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("path"))
            .distinct()
            .join(supplier, "path")
            .select("commit_id", "path", "dir")
        )

    def tests(self) -> DataFrame:
        """Last event of each user before and after the cut; argmax, not a window."""
        last = F.max(F.struct("ts", "event_id", "event_type")).alias("e")
        status = F.when(F.col("e.event_type") == "error", "fail").when(F.col("e.event_type") == "signup", "skip").otherwise("pass")
        run = F.when(F.col("ts") < F.lit(RUN_CUT).cast("timestamp"), "before").otherwise("after")
        return (
            self.table("events")
            .groupBy(run.alias("run"), F.col("user_id").alias("name"))
            .agg(last)
            .select("run", "name", status.alias("status"))
        )

    def covered(self) -> DataFrame:
        return (
            self.table("events")
            .filter("event_type = 'purchase'")
            .groupBy(F.col("user_id").alias("test"), (F.col("event_id") % 2000).alias("fn"))
            .agg(F.count(F.lit(1)).alias("lines"))
        )


_CTE = {
    "g_li": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem",
    "g_fn": "SELECT p_partkey AS id, p_name AS name, concat(p_type, '/', p_brand) AS type_id, p_type AS module_id FROM part",
    "g_calls": "SELECT a.l_partkey AS src, b.l_partkey AS dst, a.rn AS site_start, CASE WHEN a.l_returnflag = 'R' THEN 'virtual' ELSE 'static' END AS dispatch, CASE WHEN a.l_discount < 0.02 THEN 'guess' ELSE 'heuristic' END AS precision_ FROM g_li a JOIN g_li b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1 WHERE a.l_partkey <> b.l_partkey",
    "g_access": "SELECT CASE WHEN l_returnflag = 'R' THEN 'writes' ELSE 'reads' END AS kind, l_partkey AS src, l_suppkey AS field, count(*) AS n, min(rn) AS line FROM g_li GROUP BY 1, 2, 3",
    "g_flows": "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE 'entry' END AS kind, o_custkey AS entry_id FROM orders",
    "g_steps": "SELECT l_orderkey AS flow_id, rn - 1 AS seq, l_partkey AS fn, nullif(rn - 2, -1) AS parent_seq FROM g_li",
    "g_changes": "SELECT DISTINCT l_orderkey AS commit_id, l_suppkey AS path, s_nationkey AS dir FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "g_tests": "SELECT run, name, status FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS run, user_id AS name, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'pass' END AS status, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-16 00:00:00' ORDER BY ts DESC, event_id DESC) AS k FROM events) t WHERE k = 1",
    "g_covered": "SELECT user_id AS test, event_id % 2000 AS fn, count(*) AS lines FROM events WHERE event_type = 'purchase' GROUP BY 1, 2",
}
_NEEDS = {"g_calls": ["g_li"], "g_access": ["g_li"], "g_steps": ["g_li"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """The body with the named views in front, as DuckDB reads it."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    head = ", ".join(f"{n} AS ({_CTE[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        body, recursive = body[15:], True
    elif body.upper().startswith("WITH "):
        body = body[5:]
    elif head:
        return f"WITH {head} {body}"
    else:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{body}"
