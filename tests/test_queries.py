"""A sample of registered queries against their oracle on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from harness.check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ["a1_style_usage", "a4_property_consensus", "j2_style_cascade", "j24_edit_overlay", "v1_package_limits", "s5_content_extraction"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, text = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_packs_are_scanned_with_turns_that_lack_values(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "b"), (None, 0, "user", "c")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    ok, text = compare(spark, con, entry.queries()["s3_pack_scan"], entry.oracle_sql()["s3_pack_scan"], str(tmp_path))
    assert ok, text
