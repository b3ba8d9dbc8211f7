"""A sample of the registered queries against their SQL; ROLLBOOK_ALL=1 runs all of them (or use tools/check.py)."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "a2_read_union a6_read_documents b7_norm_addr_strict b21_name_keys b24_mixed_name_keys c1_clean d3_flag_duplicates d4_dedup_priority_removed "
    "e1_crossref_matched e2_compare_possible e4_match_cascade e8_license_lookup e11_apply_corrections f1_consolidate f2_pivot_wide f5_overlap_matrix "
    "f9_majority_label f15_freq_all f18_county_table g1_address_status g2_address_status_round2 g6_assign_label h1_parse_courses h5_search_filtered "
    "h9_session_history s2_session_history_stream"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


def chosen():
    return sorted(contract.oracle_sql()) if os.environ.get("ROLLBOOK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", chosen())
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    expected = db.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "mailing_match" in df.columns


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
