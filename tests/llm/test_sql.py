"""The SQL of queries over rows with every odd case, against the operators."""

import duckdb
import pytest

from pixelloom.llm import simhash
from pixelloom.llm.queries import queries
from pixelloom.llm.sql import ORACLE_SQL


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """Tables with nulls, ties, repeated rows and long texts, for Spark and DuckDB."""
    folder, db = tmp_path_factory.mktemp("odd"), duckdb.connect()
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(1, 60)] + [(10, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    shingles = [(300 + k, " ".join("abcdefghijkl"[:n] * (k + 1) for n in range(1, 6)), "en", "a", 1) for k in range(12)]  # of 4 to 200 bytes
    for name, table in (("documents", docs.unionByName(spark.createDataFrame(shingles, docs.schema))), ("labels", labels)):
        table.coalesce(1).write.parquet(f"file://{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return f"file://{folder}", db


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_line_dedup", "op7_simhash_near_dedup", "op11_secret_scan", "op12_merkle_manifest", "op13_filter_audit"])
def test_query_matches_sql(spark, odd, name):
    folder, db = odd
    want = db.sql(ORACLE_SQL[name])
    got = queries()[name](spark, folder)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_budget_of_the_sql():
    assert simhash.BITS == 4 and "<= 4" in ORACLE_SQL["op7_simhash_near_dedup"]
