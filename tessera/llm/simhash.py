"""SimHash near-duplicates: fingerprints, then an exact tiled comparison that skips by population count.

Fingerprints: A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are `width` words
(repeats count; a shorter text is one shingle); bit b is set if it is set in over half the shingles' XXH64 (seed 42).
Defined cases: null and blank texts have fingerprint zero, which links like any other; repeated rows and ties each keep
their row; a null doc_id keeps its row and takes no part in the choice of component_id; an empty table gives no rows;
extra columns of the input are not read.
copies.py builds on these tiles: near copies by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, tidied, tune
from .graph import components, roots

SEED = 42
TILE_LEAST, TILE_MOST = 1 << 14, 1 << 17
WORDS_AT_ONCE = 1 << 18


def fingerprint(text: bytes, width: int) -> int:
    """Of one text, as an unsigned integer; long texts are counted in blocks of shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), WORDS_AT_ONCE):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(first[at : at + WORDS_AT_ONCE], last[at : at + WORDS_AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    tune(docs.sparkSession)

    @tidied
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.encode("utf-8", "surrogatepass") if t else b"", width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


SEGMENTS = 4  # of 16 bits: a tile's key is the population count of each
BAND = 2  # tiles that one task holds against its own, by default


def _counts(fp, n: int = SEGMENTS):
    bits = 64 // n
    return [F.bit_count(F.shiftrightunsigned(fp, bits * k).bitwiseAND((1 << bits) - 1)).cast("int") for k in range(n)]


def planned(hist: list[tuple[tuple, int]], rows: int) -> tuple[list[tuple[list, int, int]], list, list]:
    """Which tiles the rows of each key go to, (key, first tile, tiles), and the least and greatest key of each tile.

    hist: (key, rows), in the order in which neighbours share a tile of up to about `rows` rows; a key with more is split.
    """
    plan, low, high, room = [], [], [], 0
    for key, n in hist:
        parts = -(-n // rows) if n > rows else 1
        if parts > 1 or room < n:
            plan.append((list(key), len(low), parts))
            low += [list(key)] * parts
            high += [list(key)] * parts
            room = rows - n if parts == 1 else 0
        else:
            room -= n
            plan.append((list(key), len(low) - 1, 1))
            low[-1] = [min(x) for x in zip(low[-1], key, strict=True)]
            high[-1] = [max(x) for x in zip(high[-1], key, strict=True)]
    return plan, low, high


def put(keyed: DataFrame, plan: list, by: str) -> DataFrame:
    """keyed (column key) with tile; rows of a key that has several are dealt by a hash of `by`."""
    at = keyed.sparkSession.createDataFrame(plan, "key array<int>, base int, parts int")  # bounded by the keys there can be
    return keyed.join(F.broadcast(at), "key").withColumn("tile", (F.col("base") + F.pmod(F.xxhash64(by), F.col("parts"))).cast("int")).drop("key", "base", "parts")


def tiles(distinct: DataFrame, rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(fp, tile): tiles of neighbouring population counts, and each tile's least and greatest.

    Keys are the population counts of four 16-bit segments, in order of their total: at most 17^4 keys whatever the
    data, so the histogram on the driver is bounded.
    """
    keyed = distinct.select("fp", F.array(*_counts(F.col("fp"))).alias("key"))
    hist = [(tuple(r["key"]), r["n"]) for r in keyed.groupBy("key").agg(F.count("*").alias("n")).collect()]
    hist.sort(key=lambda x: (sum(x[0]), x[0][0] + x[0][1], x[0][0], x[0][2]))
    plan, low, high = planned([((*key, key[0] + key[1], key[2] + key[3], sum(key)), n) for key, n in hist], rows)
    bounds = [np.array(x, np.int16).reshape(-1, 7) for x in (low, high)]
    return put(keyed, [(key[:4], base, parts) for key, base, parts in plan], "fp"), *bounds


def tile_size(rows: int) -> int:
    """Rows a tile: what its partners are sent grows as rows squared over it, hence larger tiles for more rows."""
    return min(max(rows // 64, TILE_LEAST), TILE_MOST)


def banded(rows: DataFrame, names: list[str], count: int, partners, band: int = BAND) -> DataFrame:
    """(band, role, tile, data): what compared() reads, the tiles that each task holds against each other.

    rows: a column tile, from 0 to count - 1, and the long columns `names`. partners: of a tile, a test of all tiles, in
    order, which it is held against. A band is a tile (role 0) and up to `band` others from it on (role 1), itself among
    them; a tile's rows are sent once a band, not once a pair.
    """
    wide = -(-count // band)

    @tidied
    def deal(batches):
        for tile, columns in grouped(batches):
            data = np.stack(columns).tobytes()
            mine = np.flatnonzero(partners(tile))
            own = np.unique(mine[mine >= tile] // band) + tile * wide
            other = mine[mine <= tile] * wide + tile // band
            for role, bands in ((0, own), (1, other)):
                for number in bands.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.array([tile], pa.int32()), pa.array([data], pa.binary())], ["band", "role", "tile", "data"])

    spark = rows.sparkSession
    parts = min(max(count, int(spark.conf.get("spark.sql.shuffle.partitions"))), 20_000)
    whole = rows.select("tile", *names).repartition(parts, "tile").sortWithinPartitions("tile")
    return whole.mapInArrow(deal, "band long, role int, tile int, data binary")


def grouped(batches):
    """(tile, columns) of each run of rows with one tile, the first column."""
    now, held = None, []
    for b in batches:
        columns = [c.to_numpy() for c in b.columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for part in zip(*(np.split(c, cuts) for c in columns), strict=True):
            if not len(part[0]):
                continue
            if held and part[0][0] != now:
                yield int(now), [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = part[0][0]
            held.append(part[1:])
    if held:
        yield int(now), [np.concatenate(x) for x in zip(*held, strict=True)]


def compared(bands: DataFrame, count: int, compare, schema: str) -> DataFrame:
    """What compare(band, own columns, other's columns, same) gives of each pair of tiles of each band."""
    names = [f.name for f in pa_fields(schema)]
    spark = bands.sparkSession
    parts = min(max(count * 8, int(spark.conf.get("spark.sql.shuffle.partitions"))), 20_000)
    tune(spark)

    @tidied
    def run(batches):
        mine = None
        for batch in batches:
            for band, role, tile, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                columns = np.frombuffer(data.as_buffer(), np.int64)
                if not role:
                    mine = (tile, columns)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(band, mine[1], columns, mine[0] == tile)], names)

    return bands.repartition(parts, "band").sortWithinPartitions("band", "role", "tile").mapInArrow(run, schema)


def pa_fields(schema: str):
    from pyspark.sql import types as Ty

    return Ty.StructType.fromDDL(schema).fields


def _least(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The fewest bits in which rows of two ranges of counts can differ, for each pair of ranges."""
    gap = np.maximum(np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]), 0)
    return np.maximum(np.maximum(gap[:, :, :4].sum(axis=2), gap[:, :, 4:6].sum(axis=2)), gap[:, :, 6])


def _blocked(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x in order of population counts, and the least and greatest counts of each block of `size` rows.

    Seven counts: of the four 16-bit segments, of the two halves, of the whole.
    """
    quarter = np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)
    half = quarter[:, :2].sum(axis=1, dtype=np.int16)
    whole = quarter.sum(axis=1, dtype=np.int16)
    counts = np.column_stack([quarter, half, whole - half, whole])
    order = np.lexsort((quarter[:, 2], quarter[:, 0], half, whole))
    starts = np.arange(0, len(x), size)
    return x[order], np.minimum.reduceat(counts[order], starts), np.maximum.reduceat(counts[order], starts)


def close(a: np.ndarray, b: np.ndarray, radius: int, same: bool, block: int):
    """Yields (row of a, row of b) arrays of all pairs at up to `radius` bits, rows as _blocked() orders them.

    Two strings differ in at least as many bits as their segments' population counts do, added up: pairs of blocks in
    which even the nearest counts differ beyond the radius are skipped. same: a is b, and a pair comes once.
    """
    (a, low_a, high_a), (b, low_b, high_b) = _blocked(a, block), _blocked(b, block)
    least = _least(low_a, high_a, low_b, high_b)
    for i in range(len(low_a)):
        x, near_by = a[i * block : (i + 1) * block], np.flatnonzero(least[i] <= radius)
        near_by = near_by[near_by >= i] if same else near_by
        for k in range(0, len(near_by), 4):
            rows = np.concatenate([np.arange(j * block, min((j + 1) * block, len(b))) for j in near_by[k : k + 4].tolist()])
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ b[rows][None]) <= radius)
            if len(u):
                u, v = u + i * block, rows[v]
                other = (u < v) if same else np.ones(len(u), bool)
                yield u[other], v[other]


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of all links at up to `radius` bits between two tiles' rows.

    same: both tiles are one, and the links are those within it.
    """
    nodes, shift = (_blocked(a, block)[0], 0) if same else (np.concatenate([_blocked(a, block)[0], _blocked(b, block)[0]]), len(a))
    parent = np.arange(len(nodes))
    for u, v in close(a, b, radius, same, block):
        v = v + shift
        keep = parent[u] != parent[v]
        if keep.any():
            parent = roots(len(nodes), u[keep], v[keep], parent)
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def links(distinct: DataFrame, radius: int, tile_rows: int | None = None) -> DataFrame:
    """(u, v): edges between fingerprints that connect exactly what the links at up to `radius` bits connect.

    distinct: column fp, without repeats. Every pair of tiles within the radius is compared in full; each comparison
    gives a forest, fewer edges than rows, never all pairs of a group.
    """
    rows, low, high = tiles(distinct, tile_rows or tile_size(distinct.count()))

    def partners(k):
        return _least(low[k : k + 1], high[k : k + 1], low, high)[0] <= radius

    def compare(band, a, b, same):
        u, v = near(a.view(np.uint64), b.view(np.uint64), radius, same)
        return u.view(np.int64), v.view(np.int64)

    return compared(banded(rows, ["fp"], len(low), partners), len(low), compare, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, tile_rows: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): every row of docs with the smallest doc_id its fingerprint reaches over links."""
    fps = fingerprints(docs, width).checkpoint()
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).checkpoint()
    comp = components(links(first.select("fp"), radius, tile_rows))
    byroot = first.join(comp, first.fp == comp.node, "inner").groupBy("root").agg(F.min("least").alias("of_root"), F.count("*").alias("n"))
    named = joined_hot(comp, byroot, "root", "n").select(F.col("node").alias("fp"), "of_root")
    named = first.join(named, "fp", "left").select("fp", F.coalesce("of_root", "least").alias("component_id"), "n").checkpoint()
    return joined_hot(fps, named, "fp", "n").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
