"""Every registered query against its DuckDB text, at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v if isinstance(v, datetime.datetime) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["recurring_phrases", "keyword_bm25", "vector_topk", "eval_metrics", "verbatim_outcomes"])
def test_partitioning_does_not_matter(spark, sf, name, tmp_path):
    key = lambda df: sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    want = key(registry.QUERIES[name](spark, sf))
    for t in ("documents", "embeddings", "benchmark", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    assert key(registry.QUERIES[name](spark, str(tmp_path))) == want


def test_a_route_is_decided_once_for_all(spark, sf):
    plan = registry.QUERIES["route_union"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Union" not in plan
