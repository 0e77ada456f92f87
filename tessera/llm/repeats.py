"""Removes every byte of a string of `length` bytes that also starts earlier in the corpus.

The corpus order is doc_id, then the place in the text; matches never cross documents. The plan, whose steps move only
packed arrays:
1. Parse. In each batch of documents a rolling hash of 32 bytes makes triggers: the smallest hash among those that fit
   in a window of `length` bytes, so equal windows have equal triggers at equal places. A trigger that occurs once in
   the corpus has no repeated window; buckets by hash find those that occur more often.
2. Segments. The windows of repeated triggers go to the trigger's bucket. Those that a batch repeats within itself are
   settled there by step 3, and only their first copy is sent: a bucket gets at most one copy of a string from a batch,
   however many copies there are.
3. Order. Prefix-free parsing of segments: a second rolling hash cuts them into phrases; the suffixes of the distinct
   phrases and the suffixes of the parse are each sorted, and the pair of ranks puts all windows into the order of the
   corpus' suffix array. Neighbours that agree on `length` bytes are one string; all but its first are repeats. Buckets
   are settled in levels, of `fan_in` batches, of `fan_in` such groups and so on, each sending one copy on, so that no
   task meets a copy from every batch of the corpus.
4. Cut. Each batch joins the starts of its repeats into runs and hashes what is left of each document.
Defined cases: a null text is empty; a null doc_id comes before all others; rows that repeat a doc_id are ordered by the
place they are read in; texts shorter than `length` keep all bytes; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, pieces, ranges, table, tune, utf8, written

LENGTH = 100
GRAM = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
CHUNK = 1 << 18
FIRST = -(1 << 63)
PHRASE_WINDOW, PHRASE_EACH = 8, 16


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(STEP), n, 1 << 64))


def rolled(raw: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Rolling hashes, by doubling, of the strings of each size (powers of two) at every place of raw."""
    h, n, out = BYTES[raw], 1, {}
    while True:
        if n in sizes:
            out[n] = h
        if n >= max(sizes):
            return out
        h = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2


def triggers(raw: np.ndarray, ends: np.ndarray, length: int, wanted=None):
    """Yields, by chunks, the windows' starts that lie within a document, each one's trigger place and trigger hash.

    wanted: a test of trigger hashes; then only starts that pass it.
    """
    span = length - GRAM + 1
    begins = np.concatenate([[0], ends[:-1]])
    room = np.maximum(ends - begins - length + 1, 0)
    valid = ranges(begins, room)
    low = np.uint64(CHUNK - 1 | (CHUNK << 1) - 1)
    for at in range(0, len(raw), CHUNK):
        starts = valid[np.searchsorted(valid, at) : np.searchsorted(valid, at + CHUNK)]
        if not len(starts):
            continue
        gram = rolled(raw[at : at + CHUNK + length - 1], (GRAM,))[GRAM]
        key = gram ^ (gram >> np.uint64(32))
        key *= STEP
        key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        n = 1
        while 2 * n <= span:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < span:
            key = np.minimum(key[: n - span], key[span - n :])
        place = (key[starts - at] & low).astype(np.int64)
        got = gram[place]
        if wanted is not None:
            head = np.concatenate([[True], place[1:] != place[:-1]])  # neighbours share their trigger: it is tested once
            keep = wanted(got[head])[np.cumsum(head) - 1]
            starts, place, got = starts[keep], place[keep], got[keep]
        yield starts, place + at, got


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


def _grouped(batches, key: int):
    """(key, rows as tuples) of consecutive rows with one key."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


@cache
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [_codec()[0].compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(blob), kind)


def _runs(sorted_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of consecutive integers."""
    if not len(sorted_places):
        return sorted_places, sorted_places
    cut = np.flatnonzero(np.diff(sorted_places) != 1)
    return sorted_places[np.concatenate([[0], cut + 1])], sorted_places[np.concatenate([cut, [len(sorted_places) - 1]])] + 1


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of `length` bytes at a and b are equal."""
    views, out = np.lib.stride_tricks.sliding_window_view(raw, length), np.empty(len(a), bool)
    for k in range(0, len(a), 65536):
        out[k : k + 65536] = (views[a[k : k + 65536]] == views[b[k : k + 65536]]).all(axis=1)
    return out


def string_ranks(raw: np.ndarray, at: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """The ranks of strings raw[at : at + size] in lexicographic order of their first `limit` bytes at least; equals tie."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    masks = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)
    rank, live, depth = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live) and depth < limit:
        left = np.clip(size[live] - depth, 0, 8)
        word = np.ascontiguousarray(words[np.minimum(at[live] + depth, len(raw))]).view(">u8")[:, 0].astype(np.uint64) & masks[left]
        order = np.lexsort((left, word, rank[live]))
        word, left, old, live = word[order], left[order], rank[live][order], live[order]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], (word[1:] != word[:-1]) | (left[1:] != left[:-1])])
        index = np.arange(len(live))
        rank[live] = old + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        alone = part & np.concatenate([part[1:], [True]])
        live, depth = live[~alone & (left == 8)], depth + 8
    return rank


def parse_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a sequence by their first `depth` symbols or more, by prefix doubling; the end is smallest."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    n = 1
    while n < depth and rank.max(initial=0) < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-n] = rank[n:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        n *= 2
    return rank


def corpus_order(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The starts in the order of the suffixes there, up to `length` bytes at least, by prefix-free parsing of segments.

    Every start has `length` bytes before its segment ends.
    """
    h = rolled(raw, (PHRASE_WINDOW,))[PHRASE_WINDOW]
    cut = np.zeros(len(raw) + 1, bool)
    cut[: len(h)] = _mixed(h) % np.uint64(PHRASE_EACH) == 0
    ends = begins + sizes
    for k in range(1, PHRASE_WINDOW):  # no trigger may reach over the end of its segment
        cut[np.maximum(ends - k, begins)] = False
    cut[begins] = True
    first = np.flatnonzero(cut[:-1])
    segment = np.searchsorted(begins, first, "right") - 1
    last = np.minimum(np.concatenate([first[1:], [len(raw)]]) + PHRASE_WINDOW, ends[segment])
    text = raw.tobytes()
    phrases = [text[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    distinct = sorted(set(phrases))
    number = {p: k for k, p in enumerate(distinct)}
    parse = np.fromiter(map(number.__getitem__, phrases), np.int64, len(phrases))
    # a zero after each segment is the end of its parse
    place = np.arange(len(parse)) + segment
    symbols = np.zeros(len(parse) + len(begins) + 1, np.int64)
    symbols[place] = parse + 1
    suffix = parse_ranks(symbols, length)
    dictionary = np.frombuffer(b"".join(distinct), np.uint8)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    offsets = np.cumsum(lengths) - lengths
    mine = np.searchsorted(first, starts, "right") - 1
    pair, inverse = np.unique(parse[mine] << 32 | (starts - first[mine]), return_inverse=True)
    which, inside = pair >> 32, pair & 0xFFFFFFFF
    own = string_ranks(dictionary, offsets[which] + inside, lengths[which] - inside, length)[inverse]
    return np.lexsort((suffix[place[mine] + 1], own))


def _string_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, sums: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of raw[begin : end]: equal strings have equal ones."""
    return (sums[ends] - sums[begins]) * powers[len(raw) - begins]


def first_copies(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each segment the number of the first one with its bytes; of one that only its hash likens to another its own."""
    first, own = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    first = first[own]
    copy = np.flatnonzero((first != np.arange(len(first))) & (sizes[first] == sizes))
    if len(copy):
        n = sizes[copy]
        same = np.logical_and.reduceat(raw[ranges(begins[copy], n)] == raw[ranges(begins[first[copy]], n)], np.cumsum(n) - n)
        copy = copy[same]
    out = np.arange(len(first))
    out[copy] = first[copy]
    return out


def repeated(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The starts of strings of `length` bytes within the segments whose string also starts at an earlier one; segments
    follow each other in raw in corpus order.

    Equal segments are parsed and ordered once: a later copy's strings all start earlier. Strings that share their slot of
    a hash table with none are alone, and segments of only such strings are not parsed.
    """
    if not len(begins):
        return np.zeros(0, np.int64)
    powers = np.full(len(raw) + 1, STEP)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * powers[:-1])])
    first = first_copies(raw, begins, sizes, _string_hashes(raw, begins, begins + sizes, sums, powers))
    once = first == np.arange(len(first))
    copied = ranges(begins[~once], sizes[~once] - length + 1)
    begins, sizes = begins[once], sizes[once]
    starts = ranges(begins, sizes - length + 1)
    bits = max(8, int(len(starts)).bit_length() + 2)
    slot = (_mixed(_string_hashes(raw, starts, starts + length, sums, powers)) >> np.uint64(64 - bits)).astype(np.int64)
    del powers, sums
    starts = starts[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    if len(starts) < 2:
        return copied
    segment = np.searchsorted(begins, starts, "right") - 1
    used = np.zeros(len(begins), bool)
    used[segment] = True
    begins, sizes = begins[used], sizes[used]
    at = np.cumsum(sizes) - sizes
    moved = (begins - at)[(np.cumsum(used) - 1)[segment]]
    raw, starts = raw[ranges(begins, sizes)], starts - moved
    by = corpus_order(raw, at, sizes, starts, length)
    order, moved = starts[by], moved[by]
    new = np.concatenate([[True], ~_same(raw, order[1:], order[:-1], length)])
    least = np.minimum.reduceat(order, np.flatnonzero(new))
    later = order != least[np.cumsum(new) - 1]
    return np.sort(np.concatenate([copied, order[later] + moved[later]]))


def _parsed(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Rows (batch, ids, ends, text) of documents and rows (batch, bucket, hashes) of their triggers."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        task = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            order = sorted(range(len(ids)), key=lambda i: FIRST if ids[i] is None else ids[i])
            raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
            ends = np.cumsum([len(texts[i]) for i in order], dtype=np.int64)
            me = task << 32 | seq
            rows = [(me, -1, [ids[i] for i in order], *_packed(ends, raw), None)]
            got = []
            for _, p, g in triggers(raw, ends, length):  # a trigger of many windows is kept once
                head = np.concatenate([[True], p[1:] != p[:-1]])
                got.append((p[head], g[head]))
            if got:
                place, first = np.unique(np.concatenate([p for p, _ in got]), return_index=True)
                h, n = np.unique(np.concatenate([g for _, g in got])[first], return_counts=True)
                h = np.repeat(h, np.minimum(n, 2))  # one that the batch itself repeats counts twice
                mixed = _mixed(h)
                bucket = (mixed >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, small = bucket[order], mixed[order].astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                rows += [(me, int(bucket[x]), None, None, None, small[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["batch", "bucket", "ids", "ends", "text", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "batch long, bucket int, ids array<long>, ends binary, text binary, hashes binary")


def _often(batches):
    """Of a bucket's hashes those that occur more than once, for each batch that has them."""
    for bucket, rows in _grouped(batches, 1):
        h = [np.frombuffer(r[2], np.uint32) for r in rows]
        sizes = [len(x) for x in h]
        h = np.concatenate(h)
        values, n = np.unique(h, return_counts=True)
        values, out = values[n > 1], []
        if len(values):  # all batches in one pass: each on its own would go through the values again
            of, held = np.repeat(np.arange(len(rows), dtype=np.uint64), sizes), values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h
            both = np.unique(of[held] << np.uint64(32) | h[held])
            of, small = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            out = [(rows[of[x]][0], small[x:y].tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["batch", "bucket", "hashes"])


def _documents(rows):
    """Of a batch's rows the ids, ends and bytes of its documents."""
    ids, ends, text = next(r[2:5] for r in rows if r[4] is not None)
    return ids, _unpacked(ends, np.int64), _unpacked(text, np.uint8)


def _segments(length: int, hashed: int, buckets: int, groups: int):
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        for batch, rows in _grouped(batches, 0):
            often = [np.frombuffer(r[5], np.uint32).astype(np.uint64) | np.uint64(r[1]) << np.uint64(32) for r in rows if r[5] is not None]
            if not often:
                continue
            ids, ends, raw = _documents(rows)
            often = np.sort(np.concatenate(often))

            def wanted(gram, often=often):
                mixed = _mixed(gram)
                code = mixed.astype(np.uint32).astype(np.uint64) | ((mixed >> np.uint64(32)) % np.uint64(hashed)) << np.uint64(32)
                return often[np.minimum(np.searchsorted(often, code), len(often) - 1)] == code

            got = list(triggers(raw, ends, length, wanted))
            if not got:
                continue
            starts, place, gram = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(starts):
                continue
            head = np.concatenate([[True], place[1:] != place[:-1]])
            h, own, n = np.unique(gram[head], return_inverse=True, return_counts=True)
            twice = starts[(n[own] > 1)[np.cumsum(head) - 1]]  # only these can repeat within the batch
            a, b = _runs(twice)
            sizes = b - a + length - 1
            at = np.cumsum(sizes) - sizes
            later = repeated(raw[ranges(a, sizes)], at, sizes, length) if len(a) else twice
            segment = np.searchsorted(at, later, "right") - 1
            later = later - at[segment] + a[segment] if len(later) else later
            settled = np.zeros(len(starts), bool)
            settled[np.searchsorted(starts, later)] = True
            out = [(batch, -1, None, _packed(np.stack(_runs(later)))[0])] if len(later) else []
            starts, place, gram = starts[~settled], place[~settled], gram[~settled]
            if len(starts):
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(place) != 0)]))
                begin, count = starts[cut], np.diff(np.concatenate([cut, [len(starts)]]))
                key = np.array([FIRST if i is None else i for i in ids], np.int64)[np.searchsorted(ends, begin, "right")]
                bucket = (_mixed(gram[cut]) >> np.uint64(32)) % np.uint64(buckets)
                bucket = bucket.astype(np.int64)
                order = np.argsort(bucket % groups, kind="stable")
                edges = _edges((bucket % groups)[order])
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    s = order[x:y]
                    out.append((batch, int(bucket[s[0]] % groups), *_packed(np.stack([key[s], begin[s], count[s], bucket[s]]), raw[ranges(begin[s], count[s] + length - 1)])))
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 512], strict=True), kinds, strict=True)], ["batch", "bucket", "places", "payload"])

    return run


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    """Where the groups of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]])) if len(sorted_values) else np.zeros(1, np.int64)


def _settled(length: int, last: bool):
    """Of the segments of each part of a group of buckets, bucket by bucket: rows with bucket -1, the repeats of each batch,
    and unless this is the last level rows with what is left of the segments."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        for _, rows in _grouped(batches, 0):
            places = [_unpacked(r[3], np.int64).reshape(4, -1) for r in rows]
            batch = np.concatenate([np.full(p.shape[1], r[1], np.int64) for p, r in zip(places, rows, strict=True)])
            places = np.concatenate(places, axis=1)
            whole = np.concatenate([_unpacked(r[4], np.uint8) for r in rows])
            sizes = places[2] + length - 1
            at, group = np.cumsum(sizes) - sizes, rows[0][2]
            del rows
            order = np.lexsort((places[1], batch, places[0], places[3]))
            at, batch, places = at[order], batch[order], places[:, order]
            edges, gone, rest = _edges(places[3]), [], []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                key, begin, count, bucket = places[:, x:y]
                sizes, own = count + length - 1, batch[x:y]
                raw = whole[ranges(at[x:y], sizes)]
                here = np.cumsum(sizes) - sizes
                found = repeated(raw, here, sizes, length)
                segment = np.searchsorted(here, found, "right") - 1
                gone.append((found - here[segment] + begin[segment], own[segment]))
                if not last:
                    starts = ranges(here, count)
                    left = np.ones(len(starts), bool)
                    left[np.searchsorted(starts, found)] = False
                    a, b = _runs(starts[left])  # segments lie length - 1 bytes apart at least
                    segment = np.searchsorted(here, a, "right") - 1
                    inside = a - here[segment]
                    rest.append((np.stack([key[segment], begin[segment] + inside, b - a, bucket[segment]]), own[segment], at[x:y][segment] + inside))
            place, of = (np.concatenate(c) for c in zip(*gone, strict=True))
            order = np.lexsort((place, of))
            place, of = place[order], of[order]
            edges = _edges(of)
            out = [(int(of[x]), -1, None, _packed(np.stack(_runs(place[x:y])))[0]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            if not last:
                kept, of, at = np.concatenate([c[0] for c in rest], axis=1), *(np.concatenate([c[k] for c in rest]) for k in (1, 2))
                order = np.argsort(of, kind="stable")
                kept, of, at = kept[:, order], of[order], at[order]
                edges = _edges(of)
                out += [(int(of[x]), group, *_packed(kept[:, x:y], whole[ranges(at[x:y], kept[2, x:y] + length - 1)])) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 512], strict=True), kinds, strict=True)], ["batch", "bucket", "places", "payload"])

    return run


def _cut(length: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        for _, rows in _grouped(batches, 0):
            ids, ends, raw = _documents(rows)
            change = np.zeros(len(raw) + 1, np.int32)
            for r in rows:
                if r[5] is not None:
                    a, b = _unpacked(r[5], np.int64).reshape(2, -1)
                    np.add.at(change, a, 1)
                    np.add.at(change, b + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            out, begin = [], 0
            for doc, end in zip(ids, ends.tolist(), strict=True):
                own, text = gone[begin:end], raw[begin:end]
                removed = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
                kept = (text[~own] if removed else text).tobytes()
                out.append((doc, end - begin, removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                begin = end
            for k in range(0, len(out), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 2048], strict=True), kinds, strict=True)], names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True, mb: int = 3, fan_in: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept holds the remaining bytes, or null unless asked for.

    length: at least 64 and of the form that leaves a window of triggers, 64 to 256. mb: of texts in a batch; fan_in:
    batches that meet in one level.
    """
    if not 64 <= length <= 256:
        raise ValueError("length must be from 64 to 256")
    spark = docs.sparkSession
    tune(spark, rows=20_000, mb=mb)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = pieces(spark, size, 4e6)
    # a batch has a row for each group of hashes and of buckets: these stay few, as batches grow in number themselves
    hashed, groups = pieces(spark, size, 64e6), max(min(buckets, 256), -(-buckets // 8))
    tasks, parts_at_once = pieces(spark, size, 24e6), pieces(spark, size, 8e6)
    parsed = written(_parsed(docs, hashed, length), "repeats", "uncompressed")
    tune(spark)
    dealt = lambda df, n, *by: df.repartition(n, by[0]).sortWithinPartitions(*by)
    hashes = parsed.where("hashes IS NOT NULL").select("batch", "bucket", "hashes")
    often = dealt(hashes, hashed, "bucket").mapInArrow(_often, "batch long, bucket int, hashes binary")
    held = parsed.where("bucket = -1").select("batch", "bucket", "ids", "ends", "text")
    blank = lambda **kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    both = held.select("*", *blank(hashes="binary")).unionByName(often.select("batch", "bucket", *blank(ids="array<long>", ends="binary", text="binary"), "hashes"))
    segments = written(dealt(both, tasks, "batch", "bucket").mapInArrow(_segments(length, hashed, buckets, groups), "batch long, bucket int, places binary, payload binary"), "repeats", "uncompressed")
    found, level, fan = segments.where("bucket < 0").select("batch", "payload"), segments.where("bucket >= 0"), [held.count()]
    while fan[-1] > 1:  # groups of batches, groups of these groups and so on: a task meets fan_in copies of a string at most
        fan.append(-(-fan[-1] // fan_in))
    group = F.col("batch")
    for k, parts in enumerate(fan[1:]):
        last = k == len(fan) - 2
        group = F.pmod(F.xxhash64("batch") if not k else group, F.lit(parts))
        part = (F.col("bucket").cast("long") * parts + group).alias("part")
        some = level.select(part, "batch", "bucket", "places", "payload")
        settled = dealt(some, parts_at_once, "part").mapInArrow(_settled(length, last), "batch long, bucket int, places binary, payload binary")
        if not last:
            settled = written(settled, "repeats", "uncompressed")
            level = settled.where("bucket >= 0")
        found = found.unionByName(settled.where("bucket < 0").select("batch", "payload"))
    whole = held.select("*", *blank(payload="binary")).unionByName(found.select("batch", *blank(bucket="int", ids="array<long>", ends="binary", text="binary"), "payload"))
    return dealt(whole, tasks, "batch").mapInArrow(_cut(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")
