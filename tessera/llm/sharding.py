"""Contiguous shards of balanced bytes, cut from global prefix sums.

Rows are ordered by a hash of their text and then doc_id, so equal texts are neighbours. Each partition's totals give
every partition its global offset; a row's shard is the number of equal targets at or before its first byte, whatever text
it holds: a group of equal texts is cut where a target falls into it.
Defined cases: a null text has no bytes (checksum 0) and groups with empty texts; rows with a null doc_id come first
within their group; repeated rows are kept, each with its own slot; an empty table gives no rows; fewer rows than
shards leave shards empty; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, pieces, table, written

OVERHEAD = 16
FIELDS = "part int, doc_id long, size long, text_crc32 long, grp long"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, grp) of each document; one pass over the texts, in the JVM."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("grp"))


def shard_by_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """rows (doc_id, size, text_crc32, grp) with shard and slot."""
    spark = rows.sparkSession
    n = rows.count()
    ordered = rows.repartitionByRange(pieces(spark, n, 2_000_000), "grp", "doc_id").sortWithinPartitions("grp", "doc_id", "size", "text_crc32")
    # the partition number is stored with the rows: a reread may split or join files, the offsets must not
    ordered = written(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "size", "text_crc32", "grp"), "op2")
    totals = {r["part"]: (r["bytes"], r["n"]) for r in ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    offset, first, at, idx = {}, {}, 0, 0
    for part in sorted(totals):
        offset[part], first[part] = at, idx
        at, idx = at + totals[part][0], idx + totals[part][1]
    if not idx:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")

    def placed(batches):
        seen = {}
        for b in batches:
            part, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            begin, index = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for p in np.unique(part):
                own = part == p
                bytes_before, rows_before = seen.get(int(p), (offset[int(p)], first[int(p)]))
                ends = bytes_before + np.cumsum(size[own])
                begin[own], index[own] = ends - size[own], rows_before + np.arange(own.sum())
                seen[int(p)] = (int(ends[-1]), rows_before + int(own.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(begin), pa.array(index)], ["doc_id", "size", "text_crc32", "grp", "begin", "index"])

    # one task a partition of the sort: the files of a partition must be read whole and in order
    whole = ordered.repartition(len(totals), "part").sortWithinPartitions("part", "grp", "doc_id", "size", "text_crc32")
    spots = written(whole.mapInArrow(placed, "doc_id long, size long, text_crc32 long, grp long, begin long, index long"), "op2")
    dropped(ordered)
    targets = F.array(*[F.lit(at * k // shards).cast("long") for k in range(1, shards)]).cast("array<long>")
    shard = F.size(F.filter(targets, lambda t: t <= F.col("begin")))
    numbered = spots.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "index")
    starts = {r["shard"]: r["least"] for r in numbered.groupBy("shard").agg(F.min("index").alias("least")).collect()}
    least = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("index") - least[F.col("shard")]).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(measured(table(spark, sf_dir, "documents")), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
