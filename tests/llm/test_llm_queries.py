"""The registered queries: SQL where there is some, and every row of the table."""

import duckdb
import pytest

import __spark_entry__
from geoloom.llm import queries as op

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in op.queries()) == list(range(1, 11))
    assert set(op.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(op.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = op.queries()[name](spark, SF).toPandas(), con.execute(op.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))


@pytest.mark.parametrize("name, table", [("op2_simhash_golay", "documents"), ("op3_url_rules", "pages"), ("op6_weak_toxicity", "documents"), ("op7_token_frames", "documents"), ("op8_fst_bpe", "documents"), ("op9_mix_flow", "documents"), ("op10_cotrain_quality", "documents")])
def test_whole_tables(spark, name, table):
    key = {"pages": "page_id"}.get(table, "doc_id")
    got = op.queries()[name](spark, SF)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
