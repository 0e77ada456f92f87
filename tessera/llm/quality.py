"""Quality: a linear hinge-loss model over n-gram indicators scaled by their classes' log-count ratios.

The n-grams are runs of one or two words, in lower case, and of one to three word shapes: a word's letter case, digits, and
marks as they stand, with repeats of the word before it marked; they are hashed to a fixed number of features. The model is fitted by dual coordinate descent
on a labelled sample with a bound on its rows and on its bytes; a logistic curve, fitted on a fifth of that sample that the model has not seen, turns its
margin into a score. Only the text is an input of a score.
Defined cases: null and empty texts have the bias feature alone and get its score; rows with a null doc_id are scored and
not held out; repeated rows are scored each; without labels of both classes the score is the share of label 1 (0.5 with
no label at all); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, table, tidied, tune
from .learn import SAMPLE, dual_descent, labelled, platt

FOLDS, HELD = 3, 1
BITS = 20
BIAS = 1 << BITS
LONG = 64  # characters
PRIME = np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")


def _case(run: re.Match) -> str:
    word = run[0]
    if word.isupper():
        return "X" if len(word) > 1 else "I"
    if word.islower():
        return "a" if len(word) > 1 else "i"
    return "A" if word[1:].islower() else "m"


def shape(word: str) -> str:
    """Letter runs as their case, digit runs as 9, marks as they stand."""
    return DIGITS.sub("9", LETTERS.sub(_case, word))


class Grams:
    """Sorted feature numbers of texts; words that are not long are kept in a bounded cache, with their shapes."""

    def __init__(self, entries: int = 400_000):
        self.entries, self.cache = entries, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.array([BIAS], np.int32)
        cache = self.cache
        if len(cache) > self.entries:
            cache.clear()
        code = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass"))
        new = {w: code(shape(w)) << 32 | code(w.lower()) for w in set(words) if w not in cache}
        cache.update(new)
        both = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        own, s = (both & np.uint64(0xFFFFFFFF)) + np.uint64(1), both >> np.uint64(32)
        for w in new:
            if len(w) > LONG:
                del cache[w]
        s[1:] += np.fromiter(map(eq, words, words[1:]), np.uint64, len(words) - 1) << np.uint64(33)
        s = (s + np.uint64(1)) * PRIME
        two = (s[:-1] ^ (s[:-1] >> np.uint64(29))) * PRIME + s[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * PRIME + s[2:]
        own *= np.uint64(0xC2B2AE3D27D4EB4F)
        pair = (own[:-1] ^ (own[:-1] >> np.uint64(30))) * PRIME + own[1:]
        grams = np.unique(np.concatenate([s, two * np.uint64(3), three * np.uint64(5), own * np.uint64(7), pair * np.uint64(9)]))
        return np.append(np.unique((grams ^ (grams >> np.uint64(32))) * PRIME >> np.uint64(64 - BITS)), BIAS).astype(np.int32)


class Model:
    def __init__(self, weights: np.ndarray | None, a: float, b: float, prior: float):
        self.weights, self.a, self.b, self.prior = weights, a, b, prior

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        margin = np.array([self.weights[f].sum() for f in features])
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, penalty: float = 0.1) -> Model:
    """The model, from at most `limit` labelled rows outside the held-out fold."""
    tune(docs.sparkSession)
    rows = labelled(docs, labels, "quality", FOLDS, HELD, True, limit)

    @tidied
    def measure(batches):
        grams = Grams()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grams.of(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1), b.column(2)], ["x", "y", "part"])

    got = rows.mapInArrow(measure, "x array<int>, y int, part int").toArrow()
    if not got.num_rows:
        return Model(None, 0, 0, 0.5)
    x = [np.asarray(v.values) for v in got.column("x").combine_chunks()]
    y, part = got.column("y").to_numpy().astype(np.float64), got.column("part").to_numpy()
    order = sorted(range(len(x)), key=lambda i: (part[i], y[i], x[i].tobytes()))
    fit, rest = [i for i in order if part[i] < 80], [i for i in order if part[i] >= 80]
    if len(set(y[fit])) < 2 or len(set(y[rest])) < 2:
        return Model(None, 0, 0, float(y.mean()))
    p, q = np.ones(BIAS + 1), np.ones(BIAS + 1)
    for i in fit:
        (p if y[i] else q)[x[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[BIAS] = 1.0
    positive = y[fit].mean()
    cost = penalty * np.where(y[fit] > 0, 0.5 / positive, 0.5 / (1 - positive))
    w = dual_descent([x[i] for i in fit], ratio, np.where(y[fit] > 0, 1.0, -1.0), cost) * ratio
    a, b = platt(np.array([w[x[i]].sum() for i in rest]), y[rest])
    return Model(w, a, b, float(y.mean()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double, 0 to 1) as the last column; a column of that name is replaced."""
    names = [c for c in docs.columns if c != "score"]
    docs, at = docs.select(*names), names.index("text")
    given = docs.sparkSession.sparkContext.broadcast(model)
    tune(docs.sparkSession)

    @tidied
    def run(batches):
        grams = Grams()
        for b in batches:
            score = given.value.score([grams.of(t) for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, schema_with(docs, ("score", "double")))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
