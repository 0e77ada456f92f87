import random

import numpy as np

from tessera.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil black tea"


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], x["item_id"]): x for r in decontam.scan(d, i, **how).collect() for x in r["leaks"]}


def test_passages_are_found_and_clean_texts_are_not(spark):
    pad = " ".join(f"filler{k}" for k in range(300))
    changed = ITEM.replace("seven", "eight")
    docs = [(1, f"{pad} {ITEM} {pad}"), (2, f"{pad} {ITEM.upper().replace(' ', '  ')}"), (3, pad), (4, ITEM[:40]), (5, changed), (6, None), (7, ""), (8, "hi")]
    got = found(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "hi"), (10, ITEM), (None, pad)])
    assert set(got) == {(1, 10), (2, 10), (8, 13)} and got[1, 10]["start_word"] == 300 and got[1, 10]["similarity"] == 1.0
    assert (5, 10) in found(spark, docs, [(10, ITEM)], similarity=0.4)


def test_windows_against_brute_force():
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(3, 25)))) for k in range(12)]
    held = decontam.Benchmark(items, similarity=0.5, radius=64)
    for _ in range(20):
        words = random.choices(vocabulary, k=80)
        i, t = random.choice(items)
        at = random.randint(0, 60)
        words[at:at] = t.split()
        if random.random() < 0.5:
            words[at + 1] = "changed"
        want = {}
        for i, t in items:
            own = t.split()
            n = min(5, len(own))
            bag = decontam.Counter(decontam.shingles(decontam.hashed(own), n).tolist())
            for k in range(len(words) - len(own) + 1):
                s = held.weighted(decontam.Counter(decontam.shingles(decontam.hashed(words[k : k + len(own)]), n).tolist()), bag)
                if s >= 0.5 and s > want.get(i, (0,))[0]:
                    want[i] = (s, k)
        assert {x[0]: (x[4], x[1]) for x in held.leaks(words)} == want
        assert held.suspects([words])[0] or not want


def test_the_multi_index_misses_nothing():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64)
    queries = np.concatenate([f ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for f in fps for _ in [0]] + [fps[:5]], axis=None).astype(np.uint64)
    q, i, d = decontam.MultiIndex(fps, 20).within(queries)
    want = {(a, b) for a in range(len(queries)) for b in range(60) if int(np.bitwise_count(queries[a] ^ fps[b])) <= 20}
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == want and (d <= 20).all()


def test_messy_and_empty(messy, none, spark):
    items = spark.createDataFrame([(1, "a a a a a a a a")], "item_id long, text string")
    out = decontam.scan(messy, items)
    assert out.count() == messy.count() and [r["doc_id"] for r in out.where("size(leaks) > 0").collect()] == [11]
    assert decontam.scan(none, items).count() == 0 and decontam.scan(messy, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(str, decontam.scan(docs, items).select("doc_id", "leaks").collect()))
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 15)
    rows = decontam.scan(docs, items).select("doc_id", "leaks").collect()
    assert sorted((r["doc_id"], len(r["leaks"])) for r in rows) == sorted((r["doc_id"], len(r["leaks"])) for r in decontam.scan(docs, items).collect())
    assert sum(len(r["leaks"]) for r in rows) == sum(s.count("item_id=") for s in whole) > 0


def test_a_text_shorter_than_the_item_is_held_whole(spark):
    words = [f"w{k}" for k in range(59)]
    docs = [(1, " ".join(words[:-1])), (2, " ".join(words[2:])), (3, " ".join(words[:30])), (4, "w2 w1")]
    got = found(spark, docs, [(10, " ".join(words)), (11, "w2 w1 w3")])
    assert set(got) == {(1, 10), (2, 10)} and (got[1, 10]["start_word"], got[1, 10]["end_word"]) == (0, 58) and abs(got[1, 10]["similarity"] - 54 / 55) < 1e-9


def test_leaks_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = random.Random(3)
    common = [" ".join(f"c{k}w{i}" for i in range(12)) for k in range(4)]
    items = [(k, " ".join([common[k % 4], *(f"own{k}w{i}" for i in range(20))])) for k in range(40)]
    docs = []
    for n, (_, text) in enumerate(items):
        words = text.split()
        for k in rng.sample(range(len(words)), n % 3):
            words[k] = "changed"
        docs.append((n, " ".join([common[(n + 1) % 4], *words, "and", "more"])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontam.scan(d, i, similarity=0.6).collect()))
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 7)
    assert sorted(map(str, decontam.scan(d, i, similarity=0.6).collect())) == whole and sum(s.count("item_id=") for s in whole) > 20


def test_recall_at_the_radius_that_is_shipped():
    """Windows edited down to the similarity: all that reach it must be found by the index of RADIUS bits."""
    rng, reached, found_ = random.Random(9), 0, 0
    items = [(k, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randint(12, 90)))) for k in range(200)]
    held = decontam.Benchmark(items)
    bags = dict(items)
    for k, text in items:
        for _ in range(6):
            words = text.split()
            for at in rng.sample(range(len(words)), max(1, len(words) // 45)):
                words[at] = "changed"
            n = min(5, len(words))
            a, b = (decontam.Counter(decontam.shingles(decontam.hashed(x.split()), n).tolist()) for x in (" ".join(words), bags[k]))
            if held.weighted(a, b) >= decontam.SIMILARITY:
                reached += 1
                found_ += k in {x[0] for x in held.leaks(["pad", *words, "pad"])}
    assert reached > 300 and found_ == reached
