"""The inverted-list index against the search over all rows."""

import re

import numpy as np
import pytest

from tessera.operators import ann, retrieval


def table(spark, n, dim, seed=3, kind="float"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)  # scores of l2 are above 0 for near unit vectors
    rows = [(f"v{k:05d}", [float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, f"id string, vector array<{kind}>")


def hits(df):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize(("similarity", "kind"), [("l2", "float"), ("cosine", "double")])
def test_all_lists_give_the_exact_answer_and_few_give_most_of_it(spark, tmp_path, similarity, kind):
    rows = table(spark, 1500, 16, kind=kind).repartition(5)
    queries = rows.where("substr(id, 5) = '07'").selectExpr("id AS query_id", "vector")
    want = hits(retrieval.vector_topk(queries, rows, 10, similarity))
    ann.write(ann.build(rows, 30, similarity, block=64), str(tmp_path / "i"))
    index = ann.read(spark, str(tmp_path / "i"))
    assert len(index.centroids) == 30 and index.blocks.count() > 30
    assert hits(ann.search(index, queries, 10, probes=30, again=150)) == want
    got = ann.search(index, queries, 10, probes=6)
    found = {(r["query_id"], r["id"]) for r in got.collect()}
    recall = len(found & {(q, i) for (q, _), (i, _) in want.items()}) / len(want)
    assert recall >= 0.95
    plan = ann.search(index, queries.limit(1), 10, probes=2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan)  # folders of other lists stay closed


def test_recall_on_the_embeddings(spark, sf):
    from tessera.plans import registry

    want = {(r["query_id"], r["id"]) for r in registry.QUERIES["vector_topk"](spark, sf).collect()}
    got = {(r["query_id"], r["id"]) for r in registry.QUERIES["ann_topk"](spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.95


def test_equal_vectors_fill_many_blocks(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)] + [(k, [0.0, float(k)]) for k in range(500, 520)], "id long, vector array<double>")
    index = ann.build(rows, 4, block=50)
    assert index.blocks.groupBy("list").count().agg({"count": "max"}).first()[0] >= 10
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r["id"] for r in ann.search(index, queries, 3, probes=4, again=200).orderBy("rank").collect()] == [0, 1, 2]


def test_what_is_no_vector_takes_no_part(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.5]), (8, [1.0, 2.5])]
    rows = spark.createDataFrame(bad, "id long, vector array<double>")
    queries = spark.createDataFrame([(k, v) for k, v in bad if k in (1, 4, 6, 7)], "query_id long, vector array<double>")
    assert sorted((r["query_id"], r["id"]) for r in ann.search(ann.build(rows), queries, 5).collect()) == [(7, 7), (7, 8), (7, 8)]
    none = ann.build(rows.where("id < 3"))
    assert ann.search(none, queries, 5).count() == 0


def test_an_index_of_nothing_is_stored(spark, tmp_path):
    ann.write(ann.build(spark.createDataFrame([], "id long, vector array<double>")), str(tmp_path / "i"))
    assert ann.search(ann.read(spark, str(tmp_path / "i")), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).count() == 0


def test_candidates_of_a_task_are_a_querys_first():
    import pyarrow as pa

    part = lambda q, d: (pa.array(q), np.full(len(q), 1, np.int32), np.zeros(len(q), np.int32), np.arange(len(q), dtype=np.int32), np.array(d, float))
    kept, full = ann._first([part(["a", "b", "a"], [3, 5, 1]), part(["a", "b", "a"], [2, 5, 1])], 2)
    assert list(zip(kept[0].to_pylist(), kept[4].tolist(), kept[3].tolist(), strict=True)) == [("a", 1, 2), ("a", 1, 2), ("b", 5, 1), ("b", 5, 1)]
    assert full.tolist() == [False, True, False, True]
