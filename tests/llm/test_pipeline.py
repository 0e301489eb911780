"""The stages, each on what its predecessor kept, and the registered queries with SQL."""

import os

import brute
import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from landlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if number < 4:
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            rows = before.select("doc_id", "text").orderBy("doc_id").collect()
            groups = brute.find(brute.near_texts([r.text for r in rows])[0], range(len(rows)))
            assert {r.doc_id for r in docs.collect()} == {rows[i].doc_id for i in groups.values()}
        if name == "pii":
            assert docs.count() == before.count()
            assert all(not brute.spans(r.text) or "[" in r.text for r in docs.collect())
    lengths = before.count()
    assert docs.select("sequence_id").distinct().count() <= lengths
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_oracles(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SF, name)}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
        assert rows == sorted(map(repr, want.project(", ".join(columns)).fetchall())), name


def test_every_query_covers_its_table(spark):
    sizes = {"documents": spark.read.parquet(f"{SF}/documents.parquet").count(), "pages": spark.read.parquet(f"{SF}/pages.parquet").count()}
    for name in ("op2_pii", "op3_quality_rules", "op7_mixing", "op9_simhash_dedup"):
        assert queries.QUERIES[name](spark, SF).agg(F.count(F.lit(1))).first()[0] == sizes["documents"]
    assert queries.QUERIES["op5_url_lists"](spark, SF).count() == sizes["pages"]
