import numpy as np
import pytest
import xxhash

from tessera.llm import graph, simhash


def slow(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(width, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(ids, fps, radius):
    par = list(range(len(fps)))

    def top(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                par[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_messy_documents_against_brute_force(messy):
    given = [(r["doc_id"], r["text"]) for r in messy.collect()]
    fps = [slow(t) for _, t in given]
    want = sorted(zip([str(d) for d, _ in given], fps, grouped([d for d, _ in given], fps, 4), strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(messy).collect())
    assert got == want


def test_small_tiles_find_the_same_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    a = simhash.near_duplicates(docs, radius=20, tile_rows=16).collect()
    fps = {r["doc_id"]: r["fp"] % 2**64 for r in a}
    ids = sorted(fps)
    want = dict(zip(ids, grouped(ids, [fps[i] for i in ids], 20), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in a} == want


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("local", [0, graph.LOCAL])
def test_a_long_chain_is_one_component(spark, local):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges, local=local).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[500] == got[501] == 500 and len(got) == 303


def test_a_dense_group_gives_a_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    x = np.unique(np.array([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 60, 400)], np.uint64))
    u, v = simhash.near(x, x, 4, True, block=16)
    assert len(u) == len(x) - 1
    at = {int(z): k for k, z in enumerate(x)}
    assert len(set(graph.roots(len(x), np.array([at[int(z)] for z in u]), np.array([at[int(z)] for z in v])))) == 1


def test_a_hub_and_no_edges(spark):
    hub = spark.range(1, 3000).selectExpr("id + 10 AS u", "5L AS v")
    assert {r["root"] for r in graph.components(hub, local=0).collect()} == {5}
    assert graph.components(hub.limit(0)).count() == 0
