import hashlib

import pytest

from quern.llm import pii, queries

SF = "/root/testdata/sf0.001"


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_pii(spark, SF).collect()
    assert len(got) == len(texts) and sum(r["n_email"] for r in got) > 0
    for r in got:
        spans = [(k, a, b) for k, a, b, _ in pii.find_spans(texts[r["doc_id"]])]
        base = [s for s in spans if s[0] in pii.BASE]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == pii.digest(base) == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]


@pytest.mark.parametrize("name", ["op3_quality", "op10_langid"])
def test_held_out_accuracy(spark, name):
    """The learnt queries reach a high accuracy on documents they have not learnt from."""
    sf = "/root/testdata/sf0.01"
    if name == "op10_langid":
        truth = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lang AS truth")
        got = queries.QUERIES[name](spark, sf).join(truth, "doc_id").where("held_out AND truth IS NOT NULL").collect()
        assert sum(r["truth"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    else:
        truth = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS truth")
        got = queries.QUERIES[name](spark, sf).join(truth, "doc_id").where("held_out").collect()
        assert sum(r["truth"] == r["predicted"] for r in got) >= 0.9 * len(got)
    assert got


@pytest.mark.parametrize("name", ["op1_warc", "op4_exact_dedup"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    want = con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({queries.ORACLES[name]})").fetchall()
    assert rows == sorted(map(tuple, want), key=str)
