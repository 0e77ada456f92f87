"""Benchmark decontamination: item-sized windows, SimHash candidates and exact weighted-shingle similarity.

A window of a document has as many words as the benchmark item it is held against; a document of fewer words is one
window. Windows that share no shingle with any
item have similarity zero and are passed over. The others get a SimHash of their weighted shingles; a multi-index over
blocks of its bits finds every item fingerprint of that window size within the radius, by pigeonhole; candidates are
kept if their weighted Jaccard similarity, over shingles as a bag, reaches the threshold. Weights are 1 + ln(N / df)
over the N items of the whole benchmark, however many blocks it is read in; a shingle of no item weighs as one of a
single item.
Words are runs of word characters in lower case; an item of fewer words than a shingle is one shingle.
Defined cases: null, empty and wordless texts have no leaks, items without words or with a null text match nothing; an
item with a null id is left out; repeated items are held once an id, repeated documents each; ties between windows go to
the first; empty tables give no rows; extra columns are carried along, one named leaks is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, ranges, schema_with, table, tidied, tune, written

WORD = re.compile(r"\w+")
WIDTH, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCKS = 8  # of 8 bits each
ITEMS_AT_ONCE = 20_000
ROW = "__row_of_decontam"
STEP = np.uint64(0x9E3779B97F4A7C15)
LEAK = pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())])
LEAK_SQL = "array<struct<item_id:bigint,start_word:bigint,end_word:bigint,hamming:int,similarity:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashed(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes."""
    out = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * STEP + h[k : k + len(out)]
    out = (out ^ (out >> np.uint64(29))) * STEP
    return out ^ (out >> np.uint64(32))


def simhashes(codes: np.ndarray, weights: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the runs of n shingles that begin at `begins`: bits whose weighted votes are positive."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    total = np.vstack([np.zeros((1, 64)), np.cumsum((2 * bits - 1) * weights[:, None], axis=0)])
    votes = total[begins + n] - total[begins]
    return np.packbits(votes > 1e-9, axis=1, bitorder="little").view("<u8")[:, 0]


class MultiIndex:
    """All fingerprints within `radius` bits: some block of 8 bits then differs in at most radius // BLOCKS."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        flips = [x for x in range(256) if bin(x).count("1") <= radius // BLOCKS]
        self.start, self.items = [], []
        for b in range(BLOCKS):
            own = (fps >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
            value = (own[:, None] ^ np.array(flips)[None, :]).ravel()
            item = np.repeat(np.arange(len(fps)), len(flips))
            order = np.argsort(value, kind="stable")
            self.items.append(item[order])
            self.start.append(np.searchsorted(value[order], np.arange(257)))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, item number, distance) of every pair within the radius."""
        pairs = []
        for b in range(BLOCKS):
            value = (queries >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
            a, n = self.start[b][value], self.start[b][value + 1] - self.start[b][value]
            pairs.append(np.repeat(np.arange(len(queries)), n) * len(self.fps) + self.items[b][ranges(a, n)])
        q, i = np.divmod(np.unique(np.concatenate(pairs)), max(len(self.fps), 1))
        d = np.bitwise_count(queries[q] ^ self.fps[i]).astype(np.int32)
        near = d <= self.radius
        return q[near], i[near], d[near]


class Benchmark:
    """What documents are held against: (id, text) items."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, over: tuple[int, dict[int, int]] | None = None):
        """over: the number of items with words and the df of each shingle that several hold; by default of these items."""
        self.width, self.similarity = width, similarity
        listed = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
        codes = [shingles(hashed(w), min(width, len(w))) for _, w in listed]
        own = Counter(c for x in codes for c in set(x.tolist()))
        self.known = np.array(sorted(own), np.uint64)
        total, df = over or (len(listed), {c: n for c, n in own.items() if n > 1})
        self.shared = np.array(sorted(df), np.uint64)
        self.weight = np.array([1 + math.log(total / df[c]) for c in self.shared.tolist()])
        self.unknown = 1 + math.log(max(total, 1))
        by: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(listed):
            by[len(w)].append(k)
        self.groups = {}  # by number of words: ids, bags, index
        self.sizes = defaultdict(set)  # the window sizes of items that hold a shingle
        for m, members in by.items():
            fps = np.array([simhashes(codes[k], self.weights(codes[k]), np.zeros(1, np.int64), len(codes[k]))[0] for k in members], np.uint64)
            self.groups[m] = ([listed[k][0] for k in members], [Counter(codes[k].tolist()) for k in members], MultiIndex(fps, radius))
            for k in members:
                for c in set(codes[k].tolist()):
                    self.sizes[c].add(m)
        # the runs of vocabulary numbers that are items' shingles, by run length: what the first look at a text goes by
        self.runs = {}
        for _, w in listed:
            n = min(width, len(w))
            self.runs.setdefault(n, []).append(self._numbers(np.array([self.vocabulary[x] for x in w], np.uint64), n))
        self.runs = {n: np.unique(np.concatenate(x)) for n, x in self.runs.items()}

    @staticmethod
    def _numbers(ids: np.ndarray, n: int) -> np.ndarray:
        """A code of each run of n numbers; 0 if one of them is 0."""
        size = max(len(ids) - n + 1, 0)
        out, real = np.zeros(size, np.uint64), np.ones(size, bool)
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * STEP + ids[k : k + size]
            real &= ids[k : k + size] != 0
        return np.where(real, out | np.uint64(1), 0)

    def weights(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(codes), self.unknown)
        k = np.minimum(np.searchsorted(self.shared, codes), len(self.shared) - 1)
        return np.where(self.shared[k] == codes, self.weight[k], self.unknown)

    def weighted(self, a: Counter, b: Counter) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        names = list(a.keys() | b.keys())
        w = dict(zip(names, self.weights(np.array(names, np.uint64)).tolist(), strict=True))
        return sum(w[c] * min(a[c], b[c]) for c in names) / sum(w[c] * max(a[c], b[c]) for c in names)

    def leaks(self, words: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, end, Hamming distance, similarity) of each item found, by its most similar window."""
        h, found = hashed(words), {}
        for n in self.runs:
            codes = shingles(h, n)
            hit = np.flatnonzero(np.isin(codes, self.known))
            starts = defaultdict(list)
            for at in hit.tolist():
                for m in self.sizes[int(codes[at])]:
                    if min(self.width, m) == n:
                        starts[m].append(at)
            for m, places in starts.items():
                size = min(m, len(words))  # a shorter text is one window
                each, places = size - n + 1, np.array(places)  # shingles a window
                mark = np.zeros(len(words) - size + 2, np.int64)
                np.add.at(mark, np.maximum(places - each + 1, 0), 1)
                np.add.at(mark, np.minimum(places, len(words) - size) + 1, -1)
                windows = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                ids, bags, index = self.groups[m]
                cut = np.flatnonzero(np.diff(windows, prepend=-2) > 1)
                for some in np.split(windows, cut[1:]) if len(windows) else []:
                    for k in range(0, len(some), 4096):
                        part = some[k : k + 4096]
                        own = codes[part[0] : part[-1] + each]
                        q, i, d = index.within(simhashes(own, self.weights(own), part - part[0], each))
                        for at, item, distance in zip(part[q].tolist(), i.tolist(), d.tolist(), strict=True):
                            s = self.weighted(Counter(codes[at : at + each].tolist()), bags[item])
                            if s >= self.similarity:
                                best = found.get(ids[item])
                                if best is None or (s, -at) > (best[4], -best[1]):
                                    found[ids[item]] = (ids[item], at, at + size, distance, s)
        return [found[i] for i in sorted(found)]

    def suspects(self, texts: list[list[str]]) -> np.ndarray:
        """Which texts hold a shingle of some item, over all texts at once."""
        sizes = np.array([len(w) + 1 for w in texts], np.int64)  # a zero parts the texts
        get, ids, at = self.vocabulary.get, np.zeros(int(sizes.sum()), np.uint64), 0
        for w, n in zip(texts, sizes.tolist(), strict=True):
            ids[at : at + n - 1] = np.fromiter((get(x, 0) for x in w), np.uint64, n - 1)
            at += n
        ends, out = np.cumsum(sizes), np.zeros(len(texts), bool)
        for n, known in self.runs.items():
            place = np.flatnonzero(ids != 0)
            place = place[place <= len(ids) - n]
            codes = self._numbers(ids, n)[place]
            out[np.searchsorted(ends, place[(codes != 0) & np.isin(codes, known)], "right")] = True
        return out


def frequencies(items: DataFrame, width: int) -> tuple[int, dict[int, int]]:
    """How many of the items (item_id, text) have words, and the df of each shingle that several of them hold."""

    def run(batches):
        for b in batches:
            out = []
            for words in map(words_of, b.column(0).to_pylist()):
                if words:
                    out += [None, *np.unique(shingles(hashed(words), min(width, len(words)))).view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["code"])

    rows = items.select("text").mapInArrow(tidied(run), "code long").groupBy("code").agg(F.count("*").alias("n")).where("n > 1 OR code IS NULL").collect()
    df = {r["code"]: r["n"] for r in rows}
    total = df.pop(None, 0)
    return total, {c % 2**64: n for c, n in df.items()}


#: The benchmark a worker holds, for the next task of the same block: key and Benchmark.
HELD: dict[str, Benchmark] = {}
KEPT["decontam"] = HELD.clear


def _block(items: list[tuple[int, str | None]], spark, width: int, similarity: float, radius: int, over):
    """A function of (texts) that gives the leaks of each, as dictionaries; workers build the benchmark once."""
    key, given = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def leaks(texts: list[str | None]) -> list[list[dict]]:
        from tessera.llm import decontam

        held = decontam.HELD.get(key)
        if held is None:
            decontam.HELD.clear()
            held = decontam.HELD[key] = Benchmark(given.value, width, similarity, radius, over and over.value)
        words = [words_of(t) for t in texts]
        out = [[] for _ in words]
        for k in np.flatnonzero(held.suspects(words)).tolist():
            out[k] = [dict(zip(("item_id", "start_word", "end_word", "hamming", "similarity"), x, strict=True)) for x in held.leaks(words[k])]
        return out

    return leaks


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs with leaks: an array of (item_id, start_word, end_word, hamming, similarity).

    items (item_id, text) are read in blocks of ITEMS_AT_ONCE, a job each, so what is broadcast has a bound whatever their
    number, but for the df of the shingles that several items share. With one block no row moves; with more the documents
    are stored once with a number, and what the blocks find is joined to them.
    """
    spark = docs.sparkSession
    tune(spark, rows=2048)
    names = [c for c in docs.columns if c != "leaks"]
    out, at = docs.select(*names), names.index("text")
    listed = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    blocks = max(1, -(-listed.count() // ITEMS_AT_ONCE))
    over = spark.sparkContext.broadcast(frequencies(listed, width)) if blocks > 1 else None  # one block counts its own

    def items_of(block):
        some = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        return _block([(r["item_id"], r["text"]) for r in some], spark, width, similarity, radius, over)

    if blocks == 1:
        leaks = items_of(0)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaks(b.column(at).to_pylist()), pa.list_(LEAK))], [*names, "leaks"])

        return out.mapInArrow(tidied(run, "decontam"), schema_with(out, ("leaks", LEAK_SQL)))
    stored = written(out.withColumn(ROW, F.monotonically_increasing_id()), "decontam")
    found = None
    for block in range(blocks):
        leaks = items_of(block)

        def run(batches, leaks=leaks):
            for b in batches:
                numbers, got = b.column(0).to_pylist(), leaks(b.column(1).to_pylist())
                rows = [(n, leak) for n, some in zip(numbers, got, strict=True) for leak in some]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], LEAK)], [ROW, "leak"])

        some = written(stored.select(ROW, F.col("text").cast("string")).mapInArrow(tidied(run, "decontam"), f"{ROW} long, leak {LEAK_SQL[6:-1]}"), "decontam")
        found = some if found is None else found.unionByName(some)
    # a document's leaks are bounded by its own words
    found = found.groupBy(ROW).agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    none = F.array().cast(LEAK_SQL)
    return stored.join(found, ROW, "left").select(*[f"`{c}`" for c in names], F.coalesce("leaks", none).alias("leaks"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start_word", "x.end_word", "x.hamming", "x.similarity")
