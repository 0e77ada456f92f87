"""Stores of bucketed tables: what a change touches, what readers see, what expires."""

import os

import pytest

from tessera.operators import corpus
from tessera.sources import keyed

SCHEMA = "id string, v long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def parts(path):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture()
def store(spark, tmp_path):
    s = keyed.opened(spark, str(tmp_path / "s"))
    s.create("t", SCHEMA, "id", 16)
    s.upsert("t", spark.range(200).selectExpr("cast(id AS string) AS id", "id AS v"))
    s.commit()
    return s


def test_only_touched_buckets_are_written(spark, store):
    before = parts(store.path)
    reader = keyed.opened(spark, store.path).table("t")
    old, new = rows(reader), spark.createDataFrame([("7", -7), ("new", 1), (None, 3)], SCHEMA)
    written = store.upsert("t", new)
    assert written == store.touched("t", new) and 1 <= len(written) <= 3
    assert rows(keyed.opened(spark, store.path).table("t")) == old  # nothing shows before the commit
    store.commit()
    after = parts(store.path)
    assert {p: after[p] for p in before} == before and {int(p.split("_bucket=")[1].split("/")[0]) for p in set(after) - set(before)} == set(written)
    assert rows(reader) == old  # a reader stays with its version
    want = rows(corpus.upsert(reader.sparkSession.createDataFrame(old, SCHEMA), new, "id"))
    assert rows(keyed.opened(spark, store.path).table("t")) == want


def test_deleted_rows_emptied_buckets_and_nothing(spark, store):
    assert store.delete("t", spark.createDataFrame([("x-unknown",)], "id string")) and store.delete("t", spark.createDataFrame([], "id string")) == []
    store.delete("t", store.table("t").select("id"))
    store.commit()
    assert rows(keyed.opened(spark, store.path).table("t")) == [] and keyed.opened(spark, store.path).body["tables"]["t"]["folders"] == {}


def test_two_writers(spark, store):
    other = keyed.opened(spark, store.path)
    one = spark.createDataFrame([("a", 1)], SCHEMA)
    store.upsert("t", one)
    other.upsert("t", one)
    store.commit()
    with pytest.raises(keyed.Outdated):
        other.commit()
    assert keyed.opened(spark, store.path).version == 2


def test_signed_counts(spark, store):
    store.create("n", "k string, a long, b long", "k", 4)
    store.add("n", spark.createDataFrame([("x", 1, 2), ("x", 1, 0), ("y", 5, 5), (None, 1, 1)], "k string, a long, b long"))
    store.add("n", spark.createDataFrame([("x", -2, -1), ("y", -5, -5), ("z", 0, 0)], "k string, a long, b long"))
    store.commit()
    got = [tuple(r) for r in keyed.opened(spark, store.path).table("n").collect()]
    assert ("x", 0, 1) in got and not any(r[0] in ("y", "z") for r in got)


def test_old_folders_expire(spark, store):
    for k in range(4):
        store.upsert("t", spark.createDataFrame([(str(k), 1000 + k)], SCHEMA))
        store.commit()
    under_way = keyed.opened(spark, store.path)
    under_way.upsert("t", spark.createDataFrame([("9", 9)], SCHEMA))
    want, n = rows(store.table("t")), len(parts(store.path))
    assert store.expire(keep=1) > 0 and len(parts(store.path)) < n
    assert rows(keyed.opened(spark, store.path).table("t")) == want
    under_way.commit()
    assert (("9", 9)) in rows(keyed.opened(spark, store.path).table("t"))
    assert store.expire(keep=1) == 0  # this store is of an older version
