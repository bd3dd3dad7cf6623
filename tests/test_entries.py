"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from entries import AREAS
from scripts.check import TABLES, norm

SF = "/root/testdata/sf0.001"
QUICK = ["qry_classify", "lex_search", "vec_label_neighbours", "grf_two_hop", "chk_build_chunks", "gov_verify_index",
         "jon_use_signals", "win_next_story", "agg_audit_changes", "str_todo_state"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("ALL_ENTRIES") else QUICK


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_entry_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert norm(E.queries()[name](spark, SF).toPandas()) == norm(con.sql(E.oracle_sql()[name]).df())


def test_every_area_has_sql():
    assert all(set(area.ORACLES) == set(area.QUERIES) for area in AREAS)
