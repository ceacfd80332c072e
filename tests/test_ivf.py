"""Inverted lists: all sampled queries, lists that grow, and k rows whatever the lists hold."""

import numpy as np
from pyspark.sql import functions as F

from tesela import queries
from tesela.functions import vectors

SF = "/root/testdata/sf0.001"


def test_probes_widen_to_k_rows(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, v array<double>")
    centres = vectors.kmeans(df, "v", 12)
    indexed = vectors.ivf_assign(df, "v", centres)
    for part in (indexed, indexed.filter("id < 12")):
        got = [r.id for r in vectors.ivf_knn(part, "v", [1.0, 0, 0, 0], 12, "id", centres, 1).collect()]
        assert len(got) == 12
    assert got == [r.id for r in vectors.knn(df.filter("id < 12"), "v", [1.0, 0, 0, 0], 12, "id").collect()]


def test_ranks_are_of_exact_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", vectors.unit(F.col("embedding")).alias("v"))
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    centres = vectors.kmeans(df, "v", vectors.list_count(len(ids)))
    got = vectors.neighbour_ranks(df, "v", "vec_id", centres).collect()
    asked = [i for i in ids if i % 100 == 0]
    assert {r.query_id for r in got} == set(asked) and len(got) == 10 * len(asked)
    for i in asked:
        s = x @ x[ids == i][0]
        s[ids == i] = -9
        assert {r.vec_id for r in got if r.query_id == i} == set(ids[np.argsort(-s)[:10]])
    i, probes = asked[0], 3
    found = vectors.ivf_knn(vectors.ivf_assign(df.filter(f"vec_id <> {i}"), "v", centres), "v", x[ids == i][0].tolist(), 10, "vec_id", centres, probes)
    near = {r.vec_id for r in got if r.query_id == i}
    assert {r.vec_id for r in found.collect()} & near == {r.vec_id for r in got if r.query_id == i and r.list_rank < probes}


def test_query_measures_all_sampled_rows(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    rows = queries.ivf_recall(spark, SF).collect()
    assert {r.queries for r in rows} == {n} and rows[0].probes == vectors.probe_count(rows[0].lists) and rows[-1].recall >= 0.9
