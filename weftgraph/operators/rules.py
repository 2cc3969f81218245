"""Architecture rules: forbidden links, cycles, and code that must be tested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lookup import select_nodes
from weftgraph.operators.traverse import strong_components, two_cycles


def forbidden(pairs: DataFrame, nodes: DataFrame, selector_from: str, selector_to: str) -> DataFrame:
    """Distinct links (src, dst) from one selection into another."""
    a = select_nodes(nodes, selector_from).select(F.col("id").alias("src"))
    b = select_nodes(nodes, selector_to).select(F.col("id").alias("dst"))
    return pairs.select("src", "dst").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def unit_pairs(pairs: DataFrame, nodes: DataFrame, unit: str) -> DataFrame:
    """(from_m, to_m): distinct links between units."""
    f = nodes.select("id", F.col(unit).alias("u"))
    return (
        pairs.select("src", "dst")
        .distinct()
        .join(f.select(F.col("id").alias("src"), F.col("u").alias("from_m")), "src")
        .join(f.select(F.col("id").alias("dst"), F.col("u").alias("to_m")), "dst")
        .select("from_m", "to_m")
        .distinct()
    )


def cyclic_pairs(pairs: DataFrame, nodes: DataFrame, unit: str = "module_id") -> DataFrame:
    return two_cycles(unit_pairs(pairs, nodes, unit))


def cycles(pairs: DataFrame, nodes: DataFrame, unit: str = "module_id") -> DataFrame:
    """(node, component): units on some cycle; each set of nodes is reported once."""
    return strong_components(unit_pairs(pairs, nodes, unit).select(F.col("from_m").alias("at"), F.col("to_m").alias("to")))


def must_be_tested(nodes: DataFrame, steps: DataFrame, flows: DataFrame, covered: DataFrame) -> DataFrame:
    """Nodes on no test flow and in no coverage row."""
    on_test = steps.join(flows.filter("kind = 'test'").select(F.col("id").alias("flow_id")), "flow_id", "left_semi")
    known = on_test.select(F.col("fn").alias("id")).unionByName(covered.select(F.col("fn").alias("id"))).distinct()
    return nodes.select("id").join(known, "id", "left_anti")
