"""Registered queries against their SQL at the smallest scale.

A spread of queries runs by default; LEDGERLINE_ALL=1 runs them all.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
FEW = [
    "c01_parse_amounts", "c14_label_rules_coin_1", "d02_invoice_history", "d07_order_overrun", "d13_key_difference", "e10_net_by_side",
    "e17_top_and_other", "f07_interpolate_by_time", "f15_active_start", "g03_top_combinations", "i03_fill_common_span", "j11_non_negative_search",
    "j18_classical_decomposition", "j25_kruskal_wallis", "k07_training_table", "k18_residual_share_table", "l05_slice_metric_matrix",
    "m06_paid_by_order_age", "b09_template_status", "a16_target_lines",
]
NAMES = sorted(SQL) if os.environ.get("LEDGERLINE_ALL") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, cursor.fetchall())


def test_entry(spark):
    rows = entry(spark).collect()
    assert FLAGSHIP in SQL and len(rows) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
