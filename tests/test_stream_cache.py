"""The stream's cache against the batch rule over the same questions in the same order, however they come."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.plans import run_eval
from tessera.sources import keyed
from tessera.streaming import cache

T = 0.92
BEGAN = datetime.datetime(2024, 1, 1)


def questions():
    """Groups of questions close to each other (0.97 and more), some equal, some refused; groups are far apart."""
    rng = np.random.default_rng(11)
    out = []
    for k in range(48):
        g = rng.integers(9)
        v = np.eye(12)[g] + (0.03 * rng.normal(size=12) if rng.random() < 0.6 else 0)
        out.append((100 + k, k, bool(rng.random() < 0.3), "v1", [float(x) for x in v], BEGAN + datetime.timedelta(minutes=k)))
    return out


@pytest.fixture(scope="module")
def want(spark):
    d = spark.createDataFrame(questions(), cache.QUESTIONS)
    near = retrieval.vector_topk(d, d.select(F.col("query_id").alias("id"), "vector"), 60, "cosine", T)
    got = run_eval.served(d.select("query_id", "seq", "refused"), near.select("query_id", F.col("id").alias("other_id"), F.col("score").alias("similarity")), T)
    return sorted((r["query_id"], r["served_by"], None if r["cache_similarity"] is None else round(r["cache_similarity"], 9)) for r in got.collect())


@pytest.mark.parametrize("cuts", [(0, 48), (0, 17, 48), (0, 1, 9, 30, 48)])
def test_batches_do_not_matter(spark, tmp_path, want, cuts):
    path = str(tmp_path / "s")
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(questions()[a:b], cache.QUESTIONS).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cache.QUESTIONS).parquet(str(tmp_path / "in"))
        cache.served_stream(stream, path, str(tmp_path / "cp"), 12, T, tables=6, bits=4).awaitTermination(150)
    got = keyed.opened(spark, path).table("served").collect()
    assert sorted((r["query_id"], r["served_by"], None if r["cache_similarity"] is None else round(r["cache_similarity"], 9)) for r in got) == want
    assert {r["query_id"] for r in got if r["stored"]} == {q for (q, by, _), r in zip(want, questions(), strict=True) if by is None and not r[2]}


def test_versions_and_what_is_no_vector(spark, tmp_path):
    v = [1.0, 0.0, 0.0]
    late = lambda k: BEGAN + datetime.timedelta(hours=k)
    run = lambda: cache.served_stream(spark.readStream.schema(cache.QUESTIONS).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "cp"), 3, T, tables=2, bits=2, keep_ms=3_600_000).awaitTermination(100)
    rows = [(1, 1, False, "a", v), (2, 2, False, "b", v), (3, 3, False, "a", v), (4, 4, False, "a", None), (5, 5, False, "a", [1.0]), (6, 6, False, "a", [None, 1.0, 1.0])]
    spark.createDataFrame([(*r, late(0)) for r in rows], cache.QUESTIONS).write.parquet(str(tmp_path / "in"))
    run()
    got = {r["query_id"]: (r["served_by"], r["stored"]) for r in keyed.opened(spark, str(tmp_path / "s")).table("served").collect()}
    assert got == {1: (None, True), 2: (None, True), 3: (1, False)}
    # a day later the bucket's time is over: the same question finds nothing
    for k, (q, vector) in enumerate([(9, [-1.0, 0.0, 0.0]), (10, v)]):
        spark.createDataFrame([(q, q, False, "a", vector, late(24 + k))], cache.QUESTIONS).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {r["query_id"]: r["served_by"] for r in keyed.opened(spark, str(tmp_path / "s")).table("served").collect()}
    assert got[10] is None


def test_misses_of_the_tables():
    share = lambda t: (1 - (1 - np.arccos(t) / np.pi) ** cache.BITS) ** cache.TABLES
    assert share(0.92) < 0.002 and share(0.97) < 1e-5
