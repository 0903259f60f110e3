"""Every registered query against its DuckDB oracle (sf0.001; the driver runs sf0.01)."""

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    from check_oracle import compare
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_every_query_has_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["l_linestatus", "mean_0", "lci_0", "uci_0"]


def test_oracle_types_match_spark_types(spark):
    import duckdb
    from check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    m = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    qs, sqls = E.queries(), E.oracle_sql()
    bad = {}
    for name in sorted(sqls):
        st = dict(qs[name](spark, SF_SMALL).dtypes)
        rel = con.sql(sqls[name])
        ot = dict(zip(rel.columns, [str(t) for t in rel.types]))
        diff = {c: (st[c], ot.get(c)) for c in st if m.get(st[c], st[c]) != ot.get(c)}
        if diff:
            bad[name] = diff
    assert not bad, bad
