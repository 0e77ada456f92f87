"""Exact top-k inner products over a bit-sliced index.

Each component is quantised to an integer; a block of rows keeps, for each component and bit, one bitmap of rows. A
query's scores are the sum of those bitmaps, weighted by the bits of the query's components: carry-save adders reduce
the bitmaps of each binary place to one, and what they leave are the slices of the score. The best rows are selected
from the most significant slice downward; rows that still tie at the last slice are taken by vec_id.
Defined cases: vectors that are null, hold a null or non-finite component, or have no vec_id take no part; components of
any finite size do, those of 2^24 and more in blocks of their own with as many slices as they need and in integers
without a bound; a score that a long cannot hold ranks by its exact value and is shown as the nearest long; shorter
vectors count as ended by zeros; a query meets no row with its own vec_id; equal scores go by the smaller vec_id and
repeated rows each count; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, tidied, tune

SCALE = 256
WIDE = 1 << 24
LONG = 1 << 63


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, x, wide): q holds floor(256 * x) of each component; x, not q, is set for wide vectors."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda v: v.cast("double"))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), x.alias("x"))
    wide = F.exists("x", lambda v: F.abs(v) >= (WIDE - 1) / SCALE)
    q = F.transform("x", lambda v: F.floor(v * SCALE).cast("int"))
    return kept.select("vec_id", F.when(~wide, q).alias("q"), F.when(wide, F.col("x")).alias("x"), wide.alias("wide"))


def exact(x: list[float]) -> list[int]:
    """floor(256 * x) of each component, in integers without a bound."""
    return [math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in x]


def _matrix(q: pa.Array, x: pa.Array) -> np.ndarray:
    """The quantised vectors as rows, ended by zeros up to the longest; of Python integers if some are wide."""
    if not x.null_count == len(x):
        rows = [exact(v) if v is not None else w for v, w in zip(x.to_pylist(), q.to_pylist(), strict=True)]
        out = np.zeros((len(rows), max(map(len, rows), default=0)), object)
        for k, row in enumerate(rows):
            out[k, : len(row)] = row
        return out
    sizes = np.asarray(q.value_lengths())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(q.flatten())
    return out


def sliced(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (component, bit, word) of rows in two's complement, the last bit being the sign; and how many bits."""
    bits = int(max(rows.max(initial=0), -rows.min(initial=0) - 1)).bit_length() + 1
    words = -(-max(len(rows), 1) // 64)
    out = np.zeros((rows.shape[1], bits, words), np.uint64)
    for b in range(bits):
        packed = np.packbits((rows.T >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b].view(np.uint8)[:, : packed.shape[1]] = packed
    return out, bits


def index(vectors: DataFrame, block_rows: int = 8192) -> DataFrame:
    """The index of quantised vectors: one row (block, n, bits, width, ids, slices) for about block_rows vectors.

    vectors should be stored or checkpointed, so that a repeated task deals rows to the same blocks.
    """
    counts = {r["wide"]: r["n"] for r in vectors.groupBy("wide").agg(F.count("*").alias("n")).collect()}
    narrow, wide = max(1, -(-counts.get(False, 0) // block_rows)), max(1, -(-counts.get(True, 0) // (block_rows // 32 or 1)))

    def build(key, rows):
        order = np.argsort(np.asarray(rows["vec_id"]), kind="stable")
        q = _matrix(rows["q"].combine_chunks(), rows["x"].combine_chunks())[order]
        slices, bits = sliced(q)
        ids = np.asarray(rows["vec_id"])[order]
        cells = [key[0].as_py(), len(ids), bits, q.shape[1], ids.astype("<i8").tobytes(), slices.tobytes()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], ["block", "n", "bits", "width", "ids", "slices"])

    # by row, not by vec_id: rows that share one must not share a block
    dealt = F.xxhash64("vec_id", F.monotonically_increasing_id())
    block = F.when(F.col("wide"), F.pmod(dealt, F.lit(wide)) + narrow).otherwise(F.pmod(dealt, F.lit(narrow)))
    put = vectors.withColumn("block", block.cast("int")).drop("wide")
    return put.groupBy("block").applyInArrow(build, "block int, n int, bits int, width int, ids binary, slices binary")


def added(places: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The slices of the sum of bitmaps, places[p] being those worth 2^p; full adders work on stacks of bitmaps."""
    out, p = [], 0
    while p < len(places):
        stack = [x if x.ndim == 2 else x[None] for x in places[p]]
        stack = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                ab = a ^ b
                total, carry = ab ^ c, (a & b) | (ab & c)
                stack = np.concatenate([total, stack[3 * third :]])
            else:
                total, carry = stack[:1] ^ stack[1:], stack[:1] & stack[1:]
                stack = total
            if p + 1 == len(places):
                places.append([])
            places[p + 1].append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        p += 1
    return out


def scores(slices: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of (inner product - base) for all rows of a block, and base.

    A bitmap with a negative weight enters as its complement: -w*B = w*(~B) - w.
    """
    width, bits, words = slices.shape
    places: list[list[np.ndarray]] = [[] for _ in range(bits)]
    base, size = 0, np.abs(query[:width])
    for k in range(int(size.max(initial=0)).bit_length()):
        bit = (size >> k & 1).astype(bool)
        for sign in (1, -1):
            at = np.flatnonzero(bit & (query[:width] * sign > 0))
            if not len(at):
                continue
            for b in range(bits):
                negative = (sign < 0) != (b == bits - 1)
                while len(places) <= b + k:
                    places.append([])
                places[b + k].append(~slices[at, b] if negative else slices[at, b])
                base -= (len(at) << (b + k)) if negative else 0
    return added(places, words), base


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the highest sums; ties at the boundary go to the first rows of the block, which are in order of vec_id."""
    sure, maybe = np.zeros_like(allowed), allowed
    for s in reversed(total):
        more = sure | (maybe & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure, maybe = more, maybe & ~s
            if n == k:
                break
    found = _rows(sure)
    return np.concatenate([found, _rows(maybe)[: k - len(found)]]) if len(found) < k else found


def _beyond(score: int) -> bytes:
    """What orders scores that show as the same long: bytes that ascend with the score."""
    if -LONG <= score < LONG:
        return b"\x80"
    raw = abs(score).to_bytes(288, "big")  # a product has 2064 bits at most, and a sum of 2^200 of them fits
    return b"\x81" + raw if score > 0 else b"\x7f" + bytes(255 - x for x in raw)


def _found(block: dict, queries: list[dict], k: int):
    """(query_id, vec_id, score, beyond) of the k best rows of a block for each query."""
    n, words = block["n"], -(-block["n"] // 64)
    slices = np.frombuffer(block["slices"], np.uint64).reshape(block["width"], block["bits"], words)
    ids = np.frombuffer(block["ids"], "<i8")
    present = np.packbits(np.ones(n, np.uint8), bitorder="little")
    every = np.zeros(words * 8, np.uint8)
    every[: len(present)] = present
    every = every.view(np.uint64)
    for q in queries:
        given = q["q"] if q["x"] is None else exact(q["x"])
        vector = np.zeros(max(block["width"], len(given)), np.int64 if q["x"] is None else object)
        vector[: len(given)] = given
        total, base = scores(slices, vector)
        allowed = every.copy()
        for own in range(*np.searchsorted(ids, [q["vec_id"], q["vec_id"] + 1])):
            allowed[own // 64] &= ~np.uint64(1 << own % 64)
        rows = best(total, allowed, k)
        score = [base] * len(rows)
        for p, s in enumerate(total):
            for at in np.flatnonzero(s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).tolist():
                score[at] += 1 << p
        for row, value in zip(rows.tolist(), score, strict=True):
            yield q["vec_id"], int(ids[row]), max(-LONG, min(LONG - 1, value)), _beyond(value)


def search(queries: DataFrame, indexed: DataFrame, k: int, query_rows: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised queries against every block of an index.

    Groups of queries are sent to the blocks: a block moves once, or once for each share of the queries while there are
    fewer blocks than the cluster has cores. indexed should be stored or checkpointed.
    """
    spark = queries.sparkSession
    names = [r["block"] for r in indexed.select("block").distinct().collect()]  # one a block, not one a row
    groups = max(1, -(-queries.count() // query_rows))
    shares = min(groups, max(1, 2 * spark.sparkContext.defaultParallelism // max(len(names), 1)))
    packed = queries.drop("wide").withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).groupBy("group").agg(F.collect_list(F.struct("vec_id", "q", "x")).alias("queries"))
    # the stated query set against all rows, in blocks
    at = spark.createDataFrame([(n,) for n in names], "block int")
    asked = packed.select((F.col("group") % shares).alias("share"), F.lit(1).alias("role"), "queries").join(F.broadcast(at))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in indexed.schema if f.name != "block"]
    asked = asked.select("block", "share", "role", *nothing, "queries")
    held = indexed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("block", "share", F.lit(0).alias("role"), *[c for c in indexed.columns if c != "block"])
    together = held.withColumn("queries", F.lit(None).cast(packed.schema["queries"].dataType)).unionByName(asked)

    @tidied
    def run(batches):
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["role"]:
                    block = row
                    continue
                hits = list(zip(*_found(block, row["queries"], k), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(hits, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "beyond"])

    tune(spark)
    parts = max(len(names) * shares, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = together.repartition(min(parts, 20_000), "block", "share").sortWithinPartitions("block", "share", "role")
    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    vectors = quantised(table(spark, sf_dir, "embeddings")).checkpoint()
    return search(vectors.where("vec_id % 50 = 0"), index(vectors).checkpoint(), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS HUGEINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, CAST(least(greatest(score, -9223372036854775808), 9223372036854775807) AS BIGINT) AS score FROM r WHERE rank <= 5
"""
