"""Every catalogue query against its SQL, on the smallest tables."""

import duckdb
import pytest

from weftgraph.plans import catalog
from weftgraph.schema import FLOW_DEPTH

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(rows):
    value = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(tuple(str(value(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in found.description}
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert sorted(types) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert plain(rows) == plain([tuple(r[i] for i in order) for r in found.fetchall()])


def test_flows_are_walked_to_the_default_depth(spark):
    rows = QUERIES["dfs_flows"](spark, SF).select("depth").collect()
    assert max(r.depth for r in rows) == FLOW_DEPTH


@pytest.mark.parametrize("parts, hops", [((1, 3, 4, 5, 2), 4), ((1, 3, 4, 5, 6, 2), None), ((2, 1), None)])
def test_trace_asks_as_far_as_its_sql(spark, tmp_path, parts, hops):
    """One order whose lines lead from part 1 to part 2 in so many calls."""
    con = duckdb.connect()
    con.execute(
        f"copy (select * replace (1::BIGINT as l_orderkey, k::INTEGER as l_linenumber, ({list(parts)})[k]::BIGINT as l_partkey)"
        f" from (select *, row_number() over () as k from '{SF}/lineitem.parquet' limit {len(parts)}))"
        f" to '{tmp_path}/lineitem.parquet' (format parquet)"
    )
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert con.execute(SQL["trace_shortest"]).fetchall() == [(hops,)]
    assert [tuple(r) for r in QUERIES["trace_shortest"](spark, str(tmp_path)).collect()] == [(hops,)]
