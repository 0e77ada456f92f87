"""Best-fit packing of token sequences, planned on the histogram of lengths.

A document is its token ids and id 0; only documents longer than a sequence are cut. Pieces of over a third of the
capacity are large: greedy matching, longest first, pairs each with the longest large piece that fits beside it, so at
most two share a sequence. Smaller pieces, longest first, go to the fullest sequence that still takes them.
Only counts by length (at most `capacity` numbers) reach the driver; pieces get a rank within their length, and the
plan says which ranks go where.
Defined cases: a null or empty text is the single id 0; a null doc_id keeps its row; repeated rows are packed each; an
empty table gives no rows; extra columns of the pieces are carried along (sequence_id and offset are replaced).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, pieces, ranges, schema_with, table, tidied, tune, written

CAPACITY = 2048
CELL, RANK, BEFORE = "__cell", "__rank_in_length", "__before_cell"
END = np.zeros(1, "<u4").tobytes()
ODD = re.compile("[\x1c-\x1fΣ]")  # characters where str and the tokenizer's normaliser may disagree


MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which opens tokens of its own


#: Words that a worker's cache holds: some 300 bytes each. Fewer take more time.
CACHED = 800_000


class WordTokens:
    """Ids of whole texts by a tokenizers file, from a bounded cache of words.

    The file's pre-tokenizer never lets a token span white space, so a text's ids are its words' ids in order. Texts in
    which Python's lower-casing or white space could differ from the normaliser's are encoded whole, and so are those that
    hold one of the file's added tokens, which keep the file's own meaning.
    """

    def __init__(self, path: str, entries: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.entries, self.cache = Tokenizer.from_file(path), entries, {"": b""}
        added = [t.content for t in self.of.get_added_tokens_decoder().values()]
        self.named = list(added)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        vocab = self.of.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.stops: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Puts the words into the cache. A plain word's closing marks are a token run of their own; plain words are
        encoded many at a time and cut at their word ends."""
        cache, whole, stops = self.cache, self.whole, self.stops
        plain, marked = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        cores = [w.rstrip(MARKS) for w in marked]
        plain += {c for c in cores if c not in cache and c.isalpha()}.difference(plain)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.of.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (ends * 4).tolist()
                cache.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                cache.update((w, whole(w)) for w in some)
        if len(stops) > 50_000:
            stops.clear()
        for w, core in zip(marked, cores, strict=True):
            if core.isalpha():
                marks = w[len(core) :]
                if marks not in stops:
                    stops[marks] = whole(marks)
                cache[w] = cache[core] + stops[marks]
            else:
                cache[w] = whole(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        The words of all texts are numbered at once; each different word is looked up once, and the ids are gathered.
        """
        if len(self.cache) > self.entries:  # the first words in are the most frequent ones
            self.cache = dict(islice(self.cache.items(), self.entries // 4))
        lows, alone = [], {}
        for k, text in enumerate(texts):
            text = text or ""
            low = text.lower()
            if self.added.search(text):
                alone[k], low = self.whole(text), ""
            elif not text.isascii():
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                    low = text.lower()
                if ODD.search(text) or not unicodedata.is_normalized("NFC", low):
                    alone[k], low = self.whole(text), ""
            elif ODD.search(low):
                alone[k], low = self.whole(text), ""
            if any(x in low for x in self.named):  # an added token in other letters: the file finds it, or not, in the text itself
                alone[k], low = self.whole(text), ""
            lows.append(low)
        lists = pc.utf8_split_whitespace(pa.array(lows, pa.large_string()))
        numbered = lists.flatten().dictionary_encode()
        cache, words = self.cache, numbered.dictionary.to_pylist()
        missing = [w for w in words if w not in cache]
        if missing:
            self.learn(missing)
        blobs = [cache[w] for w in words]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(blobs), "<u4")
        code = numbered.indices.to_numpy(zero_copy_only=False)
        raw = every[ranges(starts[code], sizes[code])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[code])])[lists.offsets.to_numpy()] * 4
        ends -= ends[0]
        return [alone[k] if k in alone else raw[a:b] for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]


@lru_cache(maxsize=1)
def tokens_of(path: str, entries: int) -> WordTokens:
    """One for each Python worker, so that its cache serves all the worker's tasks."""
    return WordTokens(path, entries)


KEPT["packing"] = tokens_of.cache_clear


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, entries: int = CACHED, rows: int = 2048, mb: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are little-endian unsigned 32-bit integers.

    path: a file of the tokenizers library; the public word_bpe_49k.json if none is given. entries: of a worker's cache of
    words; rows and mb: of a batch of texts. They move time against memory and change no result.
    """
    tune(docs.sparkSession, rows, mb)  # pack() writes these rows, then sets the common bounds

    def run(batches):
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("word_bpe_49k.json")
        tokens = tokens_of(at, entries)
        for b in batches:
            out = ([], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist()), strict=True):
                ids += END
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for x, v in zip(out, (doc, piece, a // 4, len(part) // 4, part), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run, "packing"), "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number of ranks, ranks a sequence, first sequence, offset) for a histogram of lengths.

    Sequences with the same room are kept as runs (first, number); a run is split when only part of it is filled.
    """
    left, used, rows, new = {n: c for n, c in counts.items() if c}, {}, [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def free(room, first, number):
        if room and number:
            if room not in rooms:
                insort(order, room)
                rooms[room] = []
            rooms[room].append((first, number))

    def put(length, number, each, first, offset):
        rows.append((length, used.get(length, 0), number, each, first, offset))
        used[length] = used.get(length, 0) + number
        left[length] -= number

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and not (left[large[k]] - (large[k] == a)) > 0:
            k -= 1
        if k < 0:
            number = left[a]
            put(a, number, 1, new, 0)
            free(capacity - a, new, number)
        else:
            b = large[k]
            number = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, number, 1, new, 0)
            put(b, number, 1, new, a)
            free(capacity - a - b, new, number)
        new += number
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            k = bisect_left(order, a)
            if k == len(order):
                each = capacity // a
                full, rest = divmod(left[a], each)
                if full:
                    put(a, full * each, each, new, 0)
                    free(capacity - each * a, new, full)
                if rest:
                    put(a, rest, rest, new + full, 0)
                    free(capacity - rest * a, new + full, 1)
                new += full + bool(rest)
                continue
            room = order[k]
            first, number = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            each = room // a
            full, rest = divmod(left[a], each)
            if full >= number:
                put(a, number * each, each, first, capacity - room)
                free(room - each * a, first, number)
                continue
            if full:
                put(a, full * each, each, first, capacity - room)
                free(room - each * a, first, full)
            if rest:
                put(a, rest, rest, first + full, capacity - room)
                free(room - rest * a, first + full, 1)
            free(room, first + full + bool(rest), number - full - bool(rest))
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, buckets: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """items (a column length from 1 to capacity, any others) with sequence_id and offset.

    carried: columns that only come along; rows that differ in them alone are interchangeable.

    Ranks are counted within cells of (length, bucket), so that a length that a third of the pieces share is still dealt
    over many tasks; cells' offsets come from a sum over the cells' counts. The cell of a row follows from its columns,
    so a repeated task deals the same ranks; equal rows are interchangeable.
    """
    spark = items.sparkSession
    kept = written(items.drop("sequence_id", "offset"), "pack")
    tune(spark)
    names, keys = kept.columns, [c for c in kept.columns if c not in carried]
    total = kept.count()
    if not total:
        return kept.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = buckets or pieces(spark, total, 1_000_000, 16)
    celled = kept.withColumn(CELL, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = celled.groupBy("length", CELL).agg(F.count("*").alias("n")).checkpoint()
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = sizes.withColumn(BEFORE, F.sum("n").over(Window.partitionBy("length").orderBy(CELL)) - F.col("n")).drop("n")
    celled = celled.repartition(pieces(spark, total, 30_000 if carried else 1_000_000), "length", CELL)  # what the window and the join go by
    ranked = celled.withColumn(RANK, F.row_number().over(Window.partitionBy("length", CELL).orderBy(*keys)).cast("long") - 1)
    ranked = ranked.join(before, ["length", CELL]).withColumn(RANK, F.col(RANK) + F.col(BEFORE)).select(*names, RANK)
    steps = np.array(sorted(plan(counts, capacity)), np.int64)
    at = spark.sparkContext.broadcast((steps, {int(n): (int(np.searchsorted(steps[:, 0], n, "left")), int(np.searchsorted(steps[:, 0], n, "right"))) for n in counts}))

    @tidied
    def placed(batches):
        steps, spans = at.value
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own, (lo, hi) = length == n, spans[int(n)]
                row[own] = lo + np.searchsorted(steps[lo:hi, 1], rank[own], "right") - 1
            into, each = rank - steps[row, 1], steps[row, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(steps[row, 4] + into // each), pa.array(steps[row, 5] + into % each * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema_with(kept, ("sequence_id", "bigint"), ("offset", "bigint")))


def sequences(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their ids, a checksum of them, sequence_id and offset: what a training job reads."""
    return pack(tokens.withColumn("ids_crc32", F.crc32("ids")), capacity, carried=("ids",))


def digest(tokens: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return tokens.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(digest(tokenize(table(spark, sf_dir, "documents"))))
