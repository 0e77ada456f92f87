"""Near copies by similarity: SimHash tiles give the candidates, the texts' shingle sets decide.

A document's set holds its distinct shingles of `width` words, words as in simhash.py; a shorter text is one shingle. The
fingerprint has 256 bits: of four 64-bit mixes of each shingle's hash, the bits that over half of the set have. Tiles in
order of set size are compared as in simhash.py, by exclusive-or and bit counts; pairs of tiles and of blocks whose sizes
cannot reach the similarity or whose population counts differ beyond the radius are skipped. Candidates are pairs within
the radius; each is verified by its two sets, and only verified pairs link.
The radius follows from the similarity: bits of two sets at it differ with a probability known from their angle, and
the radius lies 3.4 standard deviations beyond (four for sets of under 16 shingles, whose bits are coarser). README.md
has the recall that was measured.
Groups of many near copies do not give all their pairs: a pair of tiles with more candidates than rows gives a forest of
its closest pairs. What such forests span is compared again, by fingerprints and sets in one task: pairs that links have
not put into one group yet are verified there, and only links leave.
Defined cases: null and blank texts have the empty set, all empty sets are equal; rows with a null doc_id stand for
themselves and are kept; equal sets are one, however many rows have them; rows that share a doc_id and not a set are
different documents, those that share both are one, of which the least text stays; a very long text is one set, sent
whole; an empty table gives no rows; extra columns are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, pieces, ranges, schema_with, tidied, tune, utf8
from .graph import components, roots
from .simhash import SEED, WORDS_AT_ONCE, banded, compared, planned, put, tile_size

WORDS = 4  # of 64 bits: a fingerprint
MIXES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
SMALL = 16  # shingles
#: Shingles of the sets and sets that a part of a component has, about: a larger one is dealt to several, a cell holds two.
CELL, CELL_ROWS = 1 << 20, 1 << 14
#: Rows up to which the ids to drop, or the words of a filter, are broadcast: 16 MB.
FEW = 1 << 20


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, grams = xxhash.xxh64_intdigest, np.zeros(0, np.uint64)
    for at in range(0, len(first), WORDS_AT_ONCE):
        some = np.array([digest(whole[a:b], SEED) for a, b in zip(first[at : at + WORDS_AT_ONCE], last[at : at + WORDS_AT_ONCE], strict=True)], np.uint64)
        grams = np.union1d(grams, some)
    return grams


def set_key(grams: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def set_bits(grams: np.ndarray) -> np.ndarray:
    """The fingerprint of a set, as WORDS unsigned integers."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(grams), 255):  # a byte counts to 255
        h = (grams[at : at + 255, None] ^ (grams[at : at + 255, None] >> np.uint64(31))) * MIXES
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").view("<u8")


BITS = [f"f{k}" for k in range(WORDS)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, size, f0 to f3) of each text: its set's key, number of shingles and fingerprint."""

    @tidied
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in utf8(b.column(1))]
            bits = np.array([set_bits(g) for g in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            key, size = pa.array([set_key(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), key, size, *(pa.array(bits[:, k]) for k in range(WORDS))], ["doc_id", "key", "size", *BITS])

    return docs.mapInArrow(run, "doc_id long, key long, size long, " + ", ".join(f"{f} long" for f in BITS))


def radii(similarity: float, bits: int) -> tuple[int, int]:
    """Of `bits` bits, how many two sets at the similarity differ in: almost never more; for sets from SMALL and under."""
    out = []
    for share, deviations in ((math.acos(2 * similarity / (1 + similarity)) / math.pi, 3.4), (3 / 16 if similarity >= 0.8 else 0.25, 4.0)):
        out.append(math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share))))
    return out[0], max(out)


class Close:
    """Compares two tiles: columns key, size and the fingerprint."""

    def __init__(self, similarity: float, block: int = 256):
        self.similarity, self.block = similarity, block
        self.whole, self.first = radii(similarity, 64 * WORDS), radii(similarity, 64)

    def sizes(self, low_a, high_a, low_b, high_b) -> np.ndarray:
        """Which ranges of sizes hold two that can reach the similarity, and of population counts two within the radius.

        Ranges are rows (size, population count)."""
        fits = (high_b[:, 0] >= self.similarity * low_a[0] - 1e-9) & (high_a[0] >= self.similarity * low_b[:, 0] - 1e-9)
        return fits & (np.maximum(low_a[1] - high_b[:, 1], low_b[:, 1] - high_a[1]) <= self.whole[1])

    def blocked(self, data: np.ndarray):
        x = data.reshape(2 + WORDS, -1)
        count = np.bitwise_count(x[2:].view(np.uint64)).sum(axis=0, dtype=np.int64)
        order = np.lexsort((count, x[1]))
        x, keyed = x[:, order], np.column_stack([x[1], count])[order]
        starts = np.arange(0, len(keyed), self.block)
        return x, np.ascontiguousarray(x[2:].T).view(np.uint64), np.minimum.reduceat(keyed, starts), np.maximum.reduceat(keyed, starts)

    def pairs(self, a, b, same: bool):
        """Yields (row of a, row of b, distance) of the candidates."""
        (xa, fa, low_a, high_a), (xb, fb, low_b, high_b) = a, b
        size = self.block
        for i in range(len(low_a)):
            fits = self.sizes(low_a[i], high_a[i], low_b, high_b)
            if same:
                fits[:i] = False
            f, near_by = fa[i * size : (i + 1) * size], np.flatnonzero(fits)
            first = self.first[bool(low_a[i][0] < SMALL)]
            for k in range(0, len(near_by), 4):
                rows = np.concatenate([np.arange(j * size, min((j + 1) * size, len(fb))) for j in near_by[k : k + 4].tolist()])
                u, v = np.nonzero(np.bitwise_count(f[:, :1] ^ fb[rows, 0][None]) <= first)
                if not len(u):
                    continue
                d = np.bitwise_count(f[u] ^ fb[rows[v]]).sum(axis=1, dtype=np.int64)
                u, v = u + i * size, rows[v]
                m, n = xa[1, u], xb[1, v]
                ok = (d <= np.where(np.minimum(m, n) < SMALL, self.whole[1], self.whole[0])) & (np.minimum(m, n) >= self.similarity * np.maximum(m, n) - 1e-9)
                if same:
                    ok &= u < v
                if ok.any():
                    yield u[ok], v[ok], d[ok]

    def __call__(self, band: int, a: np.ndarray, b: np.ndarray, same: bool):
        """(u, v, dense): keys of candidates, u < v; dense if they are the forest of more candidates."""
        a, b = self.blocked(a), self.blocked(b)
        shift, nodes = (0, len(a[1])) if same else (len(a[1]), len(a[1]) + len(b[1]))
        us, vs, ds, dense = [], [], [], False
        for u, v, d in self.pairs(a, b, same):
            us, vs, ds = [*us, u], [*vs, v + shift], [*ds, d]
            if sum(map(len, us)) > 2 * nodes + 1000:
                u, v, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
                keep, dense = nearest(nodes, u, v, d), True
                us, vs, ds = [u[keep]], [v[keep]], [d[keep]]
        if not us:
            return [pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64()), pa.nulls(0, pa.bool_())]
        u, v, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
        if dense:
            keep = nearest(nodes, u, v, d)
            u, v = u[keep], v[keep]
        keys = a[0][0] if same else np.concatenate([a[0][0], b[0][0]])
        return [pa.array(np.minimum(keys[u], keys[v])), pa.array(np.maximum(keys[u], keys[v])), pa.array(np.full(len(u), dense))]


class Cell:
    """Sets that meet in one task, and the links among those that no link has put into one group."""

    def __init__(self, keys, parts, roots_, sizes, bits, sets, similarity: float):
        self.keys, self.parts, self.root, self.sizes, self.bits, self.similarity = keys, parts, roots_.copy(), sizes, bits, similarity
        n = np.array([len(s) for s in sets], np.int64)
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.sets = grams[order], owner[order], sets

    def links(self, two: bool):
        """Yields (row, rows it links to). two: only sets of different parts are held against each other."""
        whole = radii(self.similarity, 64 * WORDS)
        for k in range(len(self.keys) - 1):
            rest = slice(k + 1, None)
            open_ = self.root[rest] != self.root[k]
            if two:
                open_ &= self.parts[rest] != self.parts[k]
            small, large = np.minimum(self.sizes[rest], self.sizes[k]), np.maximum(self.sizes[rest], self.sizes[k])
            open_ &= small >= self.similarity * large - 1e-9
            at = np.flatnonzero(open_) + k + 1
            d = np.bitwise_count(self.bits[at] ^ self.bits[k]).sum(axis=1, dtype=np.int64)
            at = at[d <= np.where(np.minimum(self.sizes[at], self.sizes[k]) < SMALL, whole[1], whole[0])]
            if not len(at):
                continue
            own = self.sets[k]
            lo, hi = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
            both = np.bincount(self.owner[ranges(lo, hi - lo)], minlength=len(self.keys))[at]
            at = at[both >= self.similarity * (self.sizes[at] + self.sizes[k] - both) - 1e-9]
            _, one = np.unique(self.root[at], return_index=True)
            for j in at[one].tolist():
                self.root[self.root == self.root[j]] = self.root[k]
            if len(one):
                yield k, at[one]


def nearest(nodes: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which edges form a minimum spanning forest, by Boruvka's rounds."""
    comp, taken = np.arange(nodes), np.zeros(len(u), bool)
    weight = d.astype(np.int64) * (len(u) + 1) + np.arange(len(u))
    live = np.arange(len(u))
    while len(live):
        live = live[comp[u[live]] != comp[v[live]]]
        best = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(best, comp[u[live]], weight[live])
        np.minimum.at(best, comp[v[live]], weight[live])
        picked = np.unique(best[best < np.iinfo(np.int64).max] % (len(u) + 1))
        taken[picked] = True
        comp = roots(nodes, u[picked], v[picked], comp)
    return np.flatnonzero(taken)


STEPS = 30  # size classes grow by a factor of 1 + 1 / STEPS


def _tiled(first: DataFrame, tile_rows: int):
    """(key, size, bits, tile) in order of size, and the least and greatest (size, population count) of each tile.

    Sets of under four shingles reach no similarity of 0.8 but with their equals. The histogram on the driver has a row
    for each class of sizes and each 16 population counts: some ten thousand, whatever the data.
    """
    count = sum((F.bit_count(f).cast("int") for f in BITS[1:]), F.bit_count(BITS[0]).cast("int"))
    size = F.floor(F.log("size") * STEPS).cast("int")
    keyed = first.select("key", "size", *BITS, F.array(size, F.floor(count / 16).cast("int")).alias("key_"), count.alias("count"))
    hist = keyed.groupBy("key_").agg(F.count("*").alias("n"), F.min("size").alias("a"), F.max("size").alias("b"), F.min("count").alias("c"), F.max("count").alias("d")).collect()
    hist.sort(key=lambda r: tuple(r["key_"]))
    plan, low, high = planned([(tuple(r["key_"]), r["n"]) for r in hist], tile_rows)
    bounds = {tuple(r["key_"]): r for r in hist}
    low, high = np.full((len(low), 2), np.iinfo(np.int64).max), np.zeros((len(low), 2), np.int64)
    for key, base, parts in plan:
        r = bounds[tuple(key)]
        for t in range(base, base + parts):
            low[t], high[t] = np.minimum(low[t], [r["a"], r["c"]]), np.maximum(high[t], [r["b"], r["d"]])
    keyed = keyed.select("key", "size", *BITS, F.col("key_").alias("class"))
    return put(keyed.select(F.col("key").alias("set"), "size", *BITS, F.col("class").alias("key")), plan, "set"), low, high


def _filtered(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """The rows of docs whose doc_id is in wanted (of about `rows` rows), and a few others, without moving a text.

    A bitmap of the hashes of the wanted ids, of bounded size, is joined by its words: beyond 4 million ids it only lets
    more of the others through.
    """
    bits = min(max(1 << (16 * max(rows, 1)).bit_length(), 1 << 10), 64 * FEW)
    at = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = wanted.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))
    hit = docs.withColumn("at", at).join(F.broadcast(words), F.shiftright("at", 6) == F.col("word"))
    return hit.where(one.bitwiseAND(F.col("mask")) != 0).select("doc_id", "text")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, grams): the shingle set of each text (doc_id, text)."""

    @tidied
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in utf8(b.column(1))]
            for at in range(0, len(sets), 64):
                some = sets[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in some], pa.int64()), pa.array([g.tobytes() for g in some], pa.binary())], ["key", "grams"])

    return docs.mapInArrow(run, "key long, grams binary")


def _celled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows (u, ...) with root, the component of u, and k, the parts that its sets are dealt to.

    comp: (node, root, size) of candidates.
    """
    k = F.greatest(F.ceil(F.sum("size") / CELL), F.ceil(F.count("*") / CELL_ROWS)).cast("int")
    whole = comp.groupBy("root").agg(k.alias("k"), F.count("*").alias("n"))
    named = joined_hot(comp.select("node", "root"), whole, "root", "n").select(F.col("node").alias("u"), "root", "k")
    degree = rows.groupBy("u").agg(F.count("*").alias("n"))
    return joined_hot(rows, named.join(degree, "u"), "u", "n")


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.col("k")).cast("int")


CELLED = ["root", "i", "j"]


def _verified(pairs: DataFrame, comp: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (u, v) whose sets reach the similarity.

    Pairs of one component of candidates meet in one cell, to which each of its sets is sent once; the keys of a large
    component are dealt to k parts, and a cell holds two of them.
    """
    spark = pairs.sparkSession
    cells = _celled(pairs, comp).select("u", "v", "root", F.least(_part("u"), _part("v")).alias("i"), F.greatest(_part("u"), _part("v")).alias("j")).checkpoint()
    needs = cells.select(*CELLED, F.explode(F.array("u", "v")).alias("key")).distinct()
    sent = needs.join(sets, "key").select(*CELLED, F.lit(0).alias("role"), F.col("key").alias("u"), F.lit(None).cast("long").alias("v"), "grams")
    asked = cells.select(*CELLED, F.lit(1).alias("role"), "u", "v", F.lit(None).cast("binary").alias("grams"))
    parts = pieces(spark, comp.agg(F.sum("size")).first()[0] or 0, CELL)
    together = sent.unionByName(asked).repartition(parts, *CELLED).sortWithinPartitions(*CELLED, "role", "u")

    @tidied
    def verify(batches):
        now, held = None, {}
        for b in batches:
            keep = []
            for k, (root, i, j, role, u, v) in enumerate(zip(*(c.to_pylist() for c in b.columns[:6]), strict=True)):
                if (root, i, j) != now:
                    now, held = (root, i, j), {}
                if not role:
                    held[u] = np.frombuffer(b.column(6)[k].as_py(), np.uint64)
                    continue
                x, y = held[u], held[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    keep.append(k)
            keep = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(4).take(keep), b.column(5).take(keep)], ["u", "v"])

    return together.mapInArrow(verify, "u long, v long").checkpoint()


def _rest(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links among nodes (u, root of the candidates, k, own root over links, size, fingerprint) of one component.

    Each set is sent to the k cells of its part; a cell gives fewer links than it has sets.
    """
    spark = nodes.sparkSession
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t")
    dealt = nodes.select("*", _part("u").alias("part"), other)
    dealt = dealt.select("root", F.least("part", "t").alias("i"), F.greatest("part", "t").alias("j"), "part", F.col("u").alias("key"), "own", "size", *BITS)
    total = nodes.agg(F.sum(F.col("size") * F.col("k"))).first()[0] or 0
    names = [*CELLED, "part", "key", "own", "size", *BITS]
    together = dealt.join(sets.groupBy("key").agg(F.first("grams").alias("grams")), "key").select(*names, "grams")
    together = together.repartition(pieces(spark, total, CELL), *CELLED).sortWithinPartitions(*CELLED, "key")

    def found(cell, rows):
        x = np.array([r[3:11] for r in rows], np.int64).reshape(-1, 4 + WORDS)
        held = Cell(x[:, 1], x[:, 0], x[:, 2], x[:, 3], np.ascontiguousarray(x[:, 4:]).view(np.uint64), [np.frombuffer(r[-1], np.uint64) for r in rows], similarity)
        pairs = [(k, j) for k, at in held.links(cell[1] != cell[2]) for j in at.tolist()]
        u, v = (held.keys[np.array([p[side] for p in pairs], np.int64)] for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    @tidied
    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if held:
                        yield found(now, held)
                    now, held = row[:3], []
                held.append(row)
        if held:
            yield found(now, held)

    return together.mapInArrow(run, "u long, v long").checkpoint()


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile_rows: int | None = None) -> DataFrame:
    """(doc_id, key, kept_id, kept_key) of every row of docs: its set, and the document that stays of its group.

    Groups are those that verified pairs form; of a group the least doc_id stays, and of two sets under it the least key.
    Rows with a null doc_id have a null kept_id.
    """
    spark = docs.sparkSession
    tune(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = signatures(given, width).checkpoint()
    known = signed.where("doc_id IS NOT NULL")
    first = known.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("size", *BITS))).checkpoint()
    large = first.where("size >= 4")
    rows, low, high = _tiled(large, tile_rows or tile_size(large.count()))
    rows, test, names = rows.checkpoint(), Close(similarity), ["set", "size", *BITS]

    def partners(k):
        return test.sizes(low[k], high[k], low, high)

    found = compared(banded(rows, names, len(low), partners, band=8), len(low), test, "u long, v long, dense boolean").checkpoint()
    pairs = found.groupBy("u", "v").agg(F.max("dense").alias("dense")).checkpoint()
    comp = components(pairs).join(first.select(F.col("key").alias("node"), "size", "least", *BITS), "node").checkpoint()
    tune(spark)
    sets = _sets(_filtered(given, comp.select(F.col("least").alias("doc_id")), comp.count()), width)
    links = _verified(pairs.select("u", "v"), comp, sets, similarity)
    groups = components(links)
    dense = pairs.where("dense").join(comp.select(F.col("node").alias("u"), "root"), "u").select("root").distinct()
    if dense.limit(1).count():
        some = joined_hot(comp, dense.withColumn("n", F.lit(1)), "root", "n")
        nodes = _celled(some.select(F.col("node").alias("u"), "size", *BITS), some.select("node", "root", "size"))
        nodes = nodes.join(groups.select(F.col("node").alias("u"), F.col("root").alias("own")), "u", "left").withColumn("own", F.coalesce("own", "u"))
        groups = components(links.union(_rest(nodes.checkpoint(), sets, similarity)))
    comp = groups
    kept = F.min(F.struct(F.col("least").alias("kept_id"), F.col("key").alias("kept_key"))).alias("kept")
    byroot = first.join(comp, first.key == comp.node).groupBy("root").agg(kept, F.count("*").alias("m"))
    named = joined_hot(comp, byroot, "root", "m").select(F.col("node").alias("key"), "kept")
    alone = F.struct(F.col("least").alias("kept_id"), F.col("key").alias("kept_key"))
    named = first.join(named, "key", "left").select("key", F.coalesce("kept", alone).alias("kept"), "n").checkpoint()
    out = joined_hot(known.select("doc_id", "key"), named, "key", "n").select("doc_id", "key", "kept.kept_id", "kept.kept_key")
    none = F.lit(None).cast("long")
    return out.unionByName(signed.where("doc_id IS NULL").select("doc_id", "key", none.alias("kept_id"), none.alias("kept_key")))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that near_copies() keeps, and all rows with a null doc_id."""
    spark = docs.sparkSession
    groups = near_copies(docs, width, similarity).where("doc_id IS NOT NULL").checkpoint()
    id_ = docs["doc_id"].cast("long")
    stays = (F.col("kept_id") == F.col("doc_id")) & (F.col("kept_key") == F.col("key"))
    by_id = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays.cast("int")).alias("stays")).checkpoint()
    gone = by_id.where("n = 1 AND stays = 0 OR n > 1").select(F.col("doc_id").alias("__gone"))
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    out = docs.join(gone, id_ == F.col("__gone"), "left_anti")
    several = by_id.where("n > 1 AND stays = 1").select(F.col("doc_id").alias("__gone"))
    if not several.limit(1).count():
        return out
    # rows that share a doc_id: the one whose set stays, by its least text
    names = docs.columns
    own = docs.join(several, id_ == F.col("__gone"), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), id_.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    @tidied
    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_key(shingle_set(t, width)) for t in utf8(b.column(2))], pa.int64())], [*b.schema.names, "key"])

    wanted = groups.where(stays).select("doc_id", "key").distinct()
    own = own.mapInArrow(keyed, schema_with(own, ("key", "bigint"))).join(wanted, ["doc_id", "key"], "left_semi")
    picked = own.groupBy("doc_id", "key").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    return out.unionByName(picked.select(*[F.col("row").getField(c).alias(c) for c in names]))
