"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The labelled sample is dealt by hash of doc_id: half of it finds the lexicon (words and word beginnings that toxic texts
hold far more often), three tenths grow the trees, one fifth calibrates. Only the text is an input of a score.
Defined cases: null and empty texts score like a text without words; rows with a null doc_id are scored and not held
out; repeated rows are scored each; without labels of both classes the score is the share of label 1 (0.5 with no label
at all); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, table, tidied, tune
from .learn import SAMPLE, Isotonic, Trees, labelled

FOLDS = 5
WORD = re.compile(r"\w+")
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer ti tú usted ustedes vosotros tuyo contigo".split())
HIDDEN = re.compile(r"[^\W\d_][*@$#!0-9|+]+[^\W\d_]")
NEAR = 8  # words
LONG = 64  # letters: a longer word is a term by its hash
SURE = 3.3  # standard deviations: the best of 0 to 5 by cross-validation within training rows, see tests/llm/test_models.py
FEATURES = 18


def terms(word: str) -> list[str]:
    """A word, whole, and its beginnings of four to six letters, which are marked."""
    whole = word if len(word) <= LONG else "#" + hashlib.sha1(word.encode("utf-8", "surrogatepass")).hexdigest()
    return [whole, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Weight of each term that toxic texts hold far more often, by log odds of documents.

    A term counts if three toxic texts hold it and its log odds lie SURE standard deviations over the classes' own.
    """

    @tidied
    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y] += 1
                (toxic if y else clean).update({t for w in set(WORD.findall(text.lower())) for t in terms(w)})
        for some in ([*toxic] + [t for t in clean if t not in toxic],):
            yield pa.RecordBatch.from_arrays([pa.array(["", *some], pa.string()), pa.array([n[1], *(toxic[t] for t in some)], pa.int64()), pa.array([n[0], *(clean[t] for t in some)], pa.int64())], ["term", "t", "c"])

    counts = rows.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = lambda a, b: F.log((F.col("t") + a) / (F.col("c") + b))
    total = counts.where("term = ''").first()
    if not total or not total["t"] or not total["c"]:
        return {}
    prior = float(np.log((total["t"] + 1) / (total["c"] + 1)))
    best = counts.where("term <> '' AND t >= 3").withColumn("w", odds(0.5, 0.5) - prior).where(f"w >= 1.5 AND w >= {SURE} * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))")
    return {r["term"]: r["w"] for r in best.collect()}


class Features:
    """Dense features of texts, given a lexicon; the weights of words that are not long are kept in a bounded cache."""

    def __init__(self, lex: dict[str, float], entries: int = 400_000):
        self.lex, self.entries, self.cache = lex, entries, {}

    def _weight(self, word: str) -> float:
        found = max((self.lex.get(t, 0.0) for t in terms(word)), default=0.0)
        return found + (100.0 if word in SECOND_PERSON else 0.0)

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        cache = self.cache
        if len(cache) > self.entries:
            cache.clear()
        new = {w: self._weight(w) for w in set(words) if w not in cache}
        long = [w for w in new if len(w) > LONG]
        cache.update(new)
        n = len(words)
        value = np.fromiter(map(cache.__getitem__, words), np.float64, n)
        for w in long:
            del cache[w]
        second = value >= 100
        value = np.where(second, value - 100, value)
        strong, medium = np.flatnonzero(value >= 3), int((value > 0).sum())
        near = 0
        at = np.flatnonzero(second)
        if len(strong) and len(at):
            k = np.searchsorted(at, strong)
            gap = np.minimum(np.abs(strong - at[np.minimum(k, len(at) - 1)]), np.abs(strong - at[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        seen = np.bincount(raw, minlength=256)
        size, letters = max(len(raw), 1), max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
        marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
        triple = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 64)).sum()) if len(raw) > 2 else 0
        each = max(n, 1)
        return [
            len(strong) / each, float(np.log1p(len(strong))), medium / each, float(np.log1p(medium)),
            float(value.sum()) / each, float(value.max(initial=0.0)), float(np.sort(value)[-3:].sum()) if n else 0.0,
            near / each, float(np.log1p(near)), len(at) / each,
            int(seen[65:91].sum()) / letters, marks / size, int(seen[33]) / size, int(seen[63]) / size,
            len(HIDDEN.findall(low)) / each, triple / size, int(seen[48:58].sum()) / size, float(np.log1p(n)),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t) for t in texts], np.float64).reshape(-1, FEATURES)


class Model:
    def __init__(self, lex: dict[str, float], trees: Trees | None, calibration: Isotonic | None, prior: float):
        self.lex, self.trees, self.calibration, self.prior = lex, trees, calibration, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        # the trees' own order breaks the calibration's ties, without moving a score by more than a thousandth
        fine = (1 / (1 + np.exp(-raw)) - 0.5) * 0.002
        return np.clip(self.calibration.at(raw) + fine, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model, from at most `limit` labelled rows outside the held-out fold."""
    tune(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", FOLDS, 0, True, limit).checkpoint()
    share = rows.agg(F.avg("y")).first()[0]
    lex = lexicon(rows.where("part < 50").select("text", "y"))

    @tidied
    def measure(batches):
        features = Features(lex)
        for b in batches:
            x = features.matrix(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "part"])

    got = rows.where("part >= 50").mapInArrow(measure, "x array<double>, y int, part int").toArrow()
    if not got.num_rows:
        return Model(lex, None, None, 0.5 if share is None else float(share))
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    y, part = got.column("y").to_numpy().astype(np.float64), got.column("part").to_numpy()
    order = np.lexsort((*x.T, y, part))
    x, y, part = x[order], y[order], part[order]
    grow = part < 80
    if len(set(y[grow])) < 2 or len(set(y[~grow])) < 2:
        return Model(lex, None, None, float(share))
    trees = Trees().fit(x[grow], y[grow])
    return Model(lex, trees, Isotonic().fit(trees.raw(x[~grow]), y[~grow]), float(share))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double, 0 to 1) as the last column; a column of that name is replaced."""
    names = [c for c in docs.columns if c != "score"]
    docs, at = docs.select(*names), names.index("text")
    given = docs.sparkSession.sparkContext.broadcast(model)
    tune(docs.sparkSession)

    @tidied
    def run(batches):
        features = Features(given.value.lex)
        for b in batches:
            x = features.matrix(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(given.value.score(x), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, schema_with(docs, ("score", "double")))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
