"""The pipeline's stages one by one, and the SQL of the operators' queries."""

import duckdb
import pytest

import corpus_pipeline
from tesela.llm import queries
from tesela.llm.common import saved
from tesela.llm.exact_dedup import keep_first
from tesela.llm.mixing import Mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
        if name in ("quality classifier", "exact dedup", "near dedup"):
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert before is None or ids <= before
            before = ids
        if name == "exact dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert docs.filter("NOT round_trip").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= before


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted([str(r[names.index(c)]) for c in columns] for r in out.fetchall())
    assert sorted([str(r[c]) for c in columns] for r in df.collect()) == want


def test_each_stage_bounds_its_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(key), spark.read.parquet(f"{SF}/documents.parquet")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, SF)
            assert spark.conf.get(key) == "4m"
            spark.conf.set(key, "1m")
            stage(spark, docs, SF)
            assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_recipe_and_edges_are_parts_of_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (Mix(docs).docs, keep_first(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ExternalRDD" not in plan and "LogicalRDD" not in plan
