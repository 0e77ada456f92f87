"""Streams over audit rows and incoming files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def windowed(rows: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Metrics of audit rows by tumbling window and kind; the batch and the streaming plan are the same."""
    d = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return d.groupBy(F.window(ts, size).alias("w"), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "kind", "n", "mean", "most")


def replayed(rows: DataFrame, arrival: str, folder: str, plan, mode: str = "append") -> tuple[DataFrame, int]:
    """(what a stream of these rows wrote, rows it dropped as too late): each number of `arrival` is a batch of its own.

    plan(stream) is what is run, over readStream to a table; the query ends after each batch and goes on from its checkpoint,
    as one does that is started by a clock. Rows are stored by arrival once; a batch's files are then put before the stream.
    """
    spark = rows.sparkSession
    at = folder.rstrip("/")
    rows.write.partitionBy(arrival).parquet(f"{at}/waiting")
    waiting = spark.read.schema(rows.schema).parquet(f"{at}/waiting")
    schema = waiting.drop(arrival).schema
    dropped = 0
    for (n,) in waiting.select(arrival).distinct().orderBy(arrival).collect():  # a row a batch
        waiting.where(F.col(arrival) == n).drop(arrival).write.mode("append").parquet(f"{at}/in")
        out = plan(spark.readStream.schema(schema).parquet(f"{at}/in"))
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.schema(out.schema).parquet(f"{at}/out"), dropped


def audit_tail(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(files.AUDIT).json(folder)


def new_files(spark: SparkSession, folder: str, write, checkpoint: str, card_dir: str | None = None):
    """Starts a query that hands every batch of new corpus files, parsed, to write(rows, batch_id)."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return stream.writeStream.foreachBatch(lambda rows, n: write(files.parsed(rows.where(files.wanted(F.col("path"), card_dir)).select("path", "content")), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_asker(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Of each question key the first row is a miss that stores its answer, every later one a hit on it."""
    stored = state.get[0] if state.exists else None
    for f in frames:
        f = f.sort_values("seq")
        out = []
        for seq, answer in zip(f["seq"], f["answer"], strict=True):
            hit = stored is not None
            stored = stored if hit else answer
            out.append((key[0], seq, stored, hit))
        if stored is not None:
            state.update((stored,))
        yield pd.DataFrame(out, columns=["key", "seq", "answer", "hit"])


def ordered_cache(rows: DataFrame) -> DataFrame:
    """rows (key, seq, answer) answered through a cache whose state depends on arrival order."""
    return rows.groupBy("key").applyInPandasWithState(first_asker, "key string, seq long, answer string, hit boolean", "answer string", "append", "NoTimeout")
