import zlib
from collections import defaultdict

from tessera.llm import sharding


def shards(docs, n, **how):
    return sharding.shard_by_bytes(sharding.measured(docs), n, **how).collect()


def check(got, given, n):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in given)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n))


def test_messy_rows_keep_their_place(messy):
    given = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for n in (1, 4, 40):
        check(shards(messy, n), given, n)


def test_sizes_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = shards(docs, 8)
    check(got, given, 8)
    size, total, most = defaultdict(int), sum(r["size"] for r in got), max(r["size"] for r in got)
    for r in got:
        size[r["shard"]] += r["size"]
    assert all(abs(s - total / 8) <= 2 * most for s in size.values())


def test_a_hot_group_is_cut(spark):
    docs = spark.createDataFrame([(k, "same text" if k % 3 else f"text {k}") for k in range(600)], "doc_id long, text string")
    size = defaultdict(int)
    for r in shards(docs, 10):
        size[r["shard"]] += r["size"]
    assert len(size) == 10 and max(size.values()) - min(size.values()) <= 0.1 * sum(size.values()) / 10 + 60


def test_against_a_plain_scan(spark, messy, sf):
    """Shards and slots of a driver-side prefix sum over the same order."""
    for docs, n in ((spark.read.parquet(f"{sf}/documents.parquet"), 40), (messy, 7)):
        rows = sharding.measured(docs)
        order = rows.orderBy("grp", "doc_id", "size", "text_crc32").collect()
        total, begin, want, slots = sum(r["size"] for r in order), 0, [], defaultdict(int)
        for r in order:
            shard = sum(total * k // n <= begin for k in range(1, n))
            want.append((str(r["doc_id"]), r["size"], r["text_crc32"], shard, slots[shard]))
            slots[shard] += 1
            begin += r["size"]
        got = sharding.shard_by_bytes(rows, n).collect()
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(want)


def test_empty_table(none):
    assert shards(none, 40) == []
