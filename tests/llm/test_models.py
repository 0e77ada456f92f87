import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import learn, quality, toxicity


def auc(score, y):
    r = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize(("op", "column", "held"), [(toxicity.op5_toxicity, "toxic", lambda d: zlib.crc32(str(d).encode()) % 5 == 0), (quality.op9_quality, "quality", lambda d: zlib.crc32(str(d).encode()) % 3 == 1)])
def test_held_out_accuracy(spark, op, column, held):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == held(d) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    y = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(got[d]["score"], v, got[d]["predicted"]) for d, v in y.items() if d in got and held(d)]
    s, v, p = (np.array(x) for x in zip(*out, strict=True))
    assert (p == v).mean() >= (0.985 if column == "toxic" else 0.99) and auc(s, v) > (0.96 if column == "toxic" else 0.995)


def plain_lexicon(sets, y, sure):
    """The lexicon by plain counting: sets of terms a text."""
    toxic, clean = Counter(), Counter()
    for terms, label in zip(sets, y, strict=True):
        (toxic if label else clean).update(terms)
    prior, out = np.log((y.sum() + 1) / ((1 - y).sum() + 1)), {}
    for term, a in toxic.items():
        w = np.log((a + 0.5) / (clean[term] + 0.5)) - prior
        if a >= 3 and w >= 1.5 and w >= sure * np.sqrt(1 / (a + 0.5) + 1 / (clean[term] + 0.5)):
            out[term] = w
    return out


def training_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").where("toxic IS NOT NULL").orderBy("doc_id").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    sets = [{t for w in set(toxicity.WORD.findall((r["text"] or "").lower())) for t in toxicity.terms(w)} for r in rows]
    return rows, sets, np.array([r["toxic"] for r in rows])


def test_the_lexicon_by_plain_counting(spark, sf):
    rows, sets, y = training_rows(spark, sf)
    got = toxicity.lexicon(spark.createDataFrame([(r["text"] or "", r["toxic"]) for r in rows], "text string, y int"))
    want = plain_lexicon(sets, y, toxicity.SURE)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_the_lexicons_threshold_comes_from_training_rows(spark):
    """Three folds within the training rows; no row of the held-out fold is seen."""
    rows, sets, y = training_rows(spark, "/root/testdata/sf0.1")
    deal = lambda what, n: np.array([zlib.crc32(f"{what}{r['doc_id']}".encode()) % n for r in rows])
    fold, half, loss = deal("cv", 3), deal("half", 10), {}
    for sure in (1.64, 2.3, 3.3, 4.0, 5.0):
        for f in range(3):
            first, grow, rest = np.flatnonzero((fold != f) & (half < 6)), np.flatnonzero((fold != f) & (half >= 6)), np.flatnonzero(fold == f)
            features = toxicity.Features(plain_lexicon([sets[i] for i in first], y[first], sure))
            trees = learn.Trees().fit(features.matrix([rows[i]["text"] for i in grow]), y[grow].astype(float))
            p = 1 / (1 + np.exp(-trees.raw(features.matrix([rows[i]["text"] for i in rest]))))
            loss[sure] = loss.get(sure, 0) - np.log(np.clip(np.where(y[rest] == 1, p, 1 - p), 1e-6, 1)).mean()
    assert min(loss, key=loss.get) == toxicity.SURE


def test_a_label_that_vocabulary_alone_carries(spark):
    """Shapes are the same on both sides: only the words tell."""
    rng = np.random.default_rng(7)
    sides = (["careful", "sourced", "report", "well", "method"], ["wonder", "miracle", "shocking", "buy", "trick"])
    rows = [(k, " ".join(rng.choice([*sides[k % 2], "other", "words", "that", "both", "hold"], 30)), k % 2) for k in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    grams = quality.Grams()
    assert list(grams.of("careful")) != list(grams.of("miracle")) and quality.shape("careful") == quality.shape("miracle")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == k % 2 for k in held]) > 0.98


@pytest.mark.parametrize("module", [toxicity, quality])
def test_messy_empty_and_unlabelled(spark, messy, none, module):
    column = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (900, 1)], f"doc_id long, {column} int")
    for some in (labels, labels.limit(0)):
        model = module.train(messy, some)
        out = module.scored(messy, model)
        assert out.count() == messy.count() and out.where("score BETWEEN 0 AND 1").count() == messy.count() and set(messy.columns) == set(out.columns)
        assert module.scored(none, model).count() == 0
    assert module.train(none, labels).score([np.zeros(1, np.int32)] if module is quality else np.zeros((1, toxicity.FEATURES)))[0] == 0.5


def test_the_sample_is_bounded_and_leaves_the_fold_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = learn.labelled(docs, labels, "toxic", 5, 0, True, 10)
    assert got.count() <= 10
    whole = learn.labelled(docs, labels, "toxic", 5, 0, True).count()
    assert whole == sum(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in labels.collect())


def test_long_words_are_read_to_their_end():
    """What tells lies beyond any prefix of a word."""
    grams, stem = quality.Grams(), "a" * 5000
    assert list(grams.of(stem + "-B9")) != list(grams.of(stem)) and not any(len(w) > quality.LONG for w in grams.cache)
    end = "".join(f"{k}x" for k in range(500))
    lex = {toxicity.terms("w" + end)[0]: 5.0}
    features = toxicity.Features(lex)
    assert features.of("w" + end)[0] == 1.0 and features.of("w" + end + "y")[0] == 0.0 and not features.cache.keys() & {"w" + end}


def test_the_sample_ends_before_its_bytes_do(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    whole = learn.labelled(docs, labels, "toxic", 5, 0, True).count()
    assert 30 < whole < 50 and learn.labelled(docs, labels, "toxic", 5, 0, True, most=1000).count() == 10


def test_isotonic_and_platt():
    x = np.arange(200.0)
    y = (x + np.random.default_rng(1).normal(0, 20, 200) > 100).astype(float)
    f = learn.Isotonic().fit(x, y).at(np.linspace(-10, 300, 50))
    assert (np.diff(f) >= 0).all() and f[0] < 0.2 and f[-1] > 0.8
    a, b = learn.platt(x - 100, y)
    assert a > 0 and abs(b) < 2


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    rows = [np.array(sorted({int(k) for k in rng.integers(0, 20, 5)} | {20 if s > 0 else 21, 22}), np.int32) for s in y]
    w = learn.dual_descent(rows, np.ones(23), y, np.full(300, 1.0))
    assert all(np.sign(w[r].sum()) == s for r, s in zip(rows, y, strict=True))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = learn.Trees().fit(x[:1500], y[:1500])
    assert ((t.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95
