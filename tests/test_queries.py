"""Queries against their SQL on the smallest tables, and that they stand without the rest."""

import glob
import os

import duckdb
import pytest

from lamina.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["overlay_all_layers", "members_resolved", "axis_fold_lww", "flags_layered", "read_with_pending", "ports_wide", "default_filled", "wide_to_long"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r.values()) for r in df.select(*cols).toArrow().to_pylist())))
    sql = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall()
    assert mine == sorted(map(repr, sql))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_imports_whatever_was_taken_out():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
