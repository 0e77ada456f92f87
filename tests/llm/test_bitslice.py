import math

import numpy as np
import pytest

from tessera.llm import bitslice


def run(spark, rows, k=5, block=64, every=3, groups=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string")
    v = bitslice.quantised(df)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.search(v.where(f"vec_id % {every} = 0"), bitslice.index(v, block), k, groups).collect())


def slow(rows, k=5, every=3):
    v = [(i, [math.floor(float(np.float32(x)) * 256) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q in v:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in v if j != i)[:k]  # noqa: B905
            out += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -x))) for n, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01, 300.0])
def test_random_vectors(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in (rng.normal(size=7) * scale).astype(np.float32)], "q") for i in range(150)]
    assert run(spark, rows) == slow(rows)


def test_ties_nulls_and_short_vectors(spark):
    rows = [(i, [0.5, -0.25, 0.0], None) for i in range(90)]
    rows += [(200, None, ""), (201, [None, 1.0, 1.0], ""), (202, [float("nan"), 1.0, 1.0], ""), (203, [float("inf"), 0.0, 0.0], ""), (None, [1.0, 1.0, 1.0], ""), (300, [], ""), (303, [1.0], ""), (306, [1e30, 0.0], "")]
    rows += [(309, [70000.0, 1.0], ""), (310, [-1e38, 2.0], ""), (312, [-3e38, 0.0], ""), (313, [65535.99, 0.0], ""), (314, [1e30, 1.0], "")]
    assert run(spark, rows) == slow(rows)


def test_few_rows_and_none(spark):
    assert run(spark, [(3, [1.0, 2.0], ""), (4, [1.0, -1.0], "")]) == [(3, 1, 4, -65536)]
    assert run(spark, [(3, [1.0], "")]) == []
    v = bitslice.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert bitslice.search(v, bitslice.index(v), 5).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (130, 5))
    slices, _ = bitslice.sliced(rows)
    for q in (rng.integers(-300, 300, 5), np.zeros(5, int), np.array([1, 0, 0, 0, -1])):
        total, base = bitslice.scores(slices, q)
        got = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << p for p, s in enumerate(total)), np.zeros(130, np.int64)) + base
        assert (got == rows @ q).all()


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_components_of_any_size(spark, kind):
    """Scores beyond a long rank by their exact values."""
    values = [1.0, -1.0, 2.0**24, -(2.0**40), 1e18, -1e25, 3e38, -3e38, 0.00390625] + ([1.7e308, -1.7e308, 5e-324] if kind == "array<double>" else [])
    rows = [(i, [values[i % len(values)], values[i * 5 % 7], float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    v = bitslice.quantised(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.search(v.where("vec_id % 10 = 0"), bitslice.index(v, 64), 5, 4).collect())
    big = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in e]) for i, e in rows]
    want = []
    for i, q in big:
        if i % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in big if j != i)[:5]
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -x))) for n, (x, j) in enumerate(s)]
    assert got == sorted(want)
