"""The semantic cache over a stream of questions: what is near is looked up in keyed state, who is served is settled in order.

A question's vector is hashed by random planes into one bucket of each of several tables. The state of a bucket is the list
of the vectors it has seen; a question is held against those exactly, and only pairs over the threshold leave the bucket.
Which questions are stored and which are served then follows batch by batch, by the rule of plans.run_eval.served, beside
what earlier batches stored; a store (sources.keyed) holds that and the last batch, so one that is run again changes nothing.
Two vectors at the threshold t share a bucket of one table with probability (1 - arccos(t) / pi) ** BITS: at 0.92 that misses 2 of
1000 pairs over TABLES tables, at 0.97 none of a million. Of equal vectors a bucket holds the first whose answer may be stored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import run_eval
from ..sources import keyed

TABLES, BITS = 16, 8
#: How long, by the time of the questions, a bucket that none of its corpus version reaches keeps its vectors.
KEEP_MS = 7 * 24 * 3600 * 1000
QUESTIONS = "query_id long, seq long, refused boolean, corpus_version string, vector array<double>, asked_at timestamp"
NEAR = "query_id long, seq long, refused boolean, other_id long, similarity double"
SERVED = "query_id long, seq long, refused boolean, served_by long, cache_similarity double, stored boolean"


def bucketed(questions: DataFrame, dimension: int, tables: int = TABLES, bits: int = BITS, seed: int = 1) -> DataFrame:
    """A row of each question for each table, with its bucket there; a vector of another dimension or with a null is in none."""
    planes = np.random.default_rng(seed).normal(size=(dimension, tables * bits))

    def run(batches):
        for b in batches:
            v = b.column(4)
            fine = [k for k, x in enumerate(v.to_pylist()) if x is not None and len(x) == dimension and all(y is not None and math.isfinite(y) for y in x)]
            b = b.take(pa.array(fine, pa.int64()))
            x = np.asarray(b.column(4).flatten(), np.float64).reshape(-1, dimension)
            code = ((x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype(np.int64)
            at = pa.array(np.repeat(np.arange(len(x)), tables))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(code.ravel())], [*b.schema.names, "part", "bucket"])

    return questions.select("query_id", "seq", "refused", "corpus_version", "vector", "asked_at").mapInArrow(run, QUESTIONS + ", part int, bucket long")


def bucket(threshold: float, keep_ms: int):
    """What a bucket of one table and corpus version does with its questions: gives the near pairs, keeps new vectors."""

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        given = pd.concat(list(frames)).sort_values(["seq", "query_id"], kind="stable")
        ids, matrix = [], np.zeros((0, 0))
        held = state.get if state.exists else None
        if held and held[2] > state.getCurrentWatermarkMs():  # a bucket whose time is over but who has questions isn't timed out
            ids = np.frombuffer(held[0], np.int64).tolist()
            matrix = np.frombuffer(held[1], np.float64).reshape(len(ids), -1)
        seen, out = {v.tobytes() for v in matrix}, []
        for q, seq, refused, v in zip(given["query_id"], given["seq"], given["refused"], given["vector"], strict=True):
            v = np.asarray(v, np.float64)
            if ids:
                s = matrix @ v / np.maximum(np.linalg.norm(matrix, axis=1) * np.linalg.norm(v), 1e-300)
                out += [(q, seq, refused, ids[k], float(s[k])) for k in np.flatnonzero(s >= threshold)]
            out.append((q, seq, refused, None, None))
            if not refused and v.tobytes() not in seen:
                seen.add(v.tobytes())
                matrix = np.vstack([matrix, v]) if ids else v[None, :]
                ids.append(int(q))
        if ids:
            until = max(int(given["asked_at"].max().timestamp() * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1)
            state.update((np.array(ids, np.int64).tobytes(), matrix.tobytes(), until))
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=["query_id", "seq", "refused", "other_id", "similarity"]).astype({"other_id": "Int64", "similarity": "float64"})

    return run


def near(questions: DataFrame, dimension: int, threshold: float = 0.92, tables: int = TABLES, bits: int = BITS, keep_ms: int = KEEP_MS) -> DataFrame:
    """NEAR: of a stream of questions the pairs (other_id the earlier one) that a bucket finds, and each question once a table.

    A question asked before the latest of the batches before it is late, and still answered.
    """
    rows = bucketed(questions, dimension, tables, bits).withWatermark("asked_at", "0 seconds").groupBy("corpus_version", "part", "bucket")
    return rows.applyInPandasWithState(bucket(threshold, keep_ms), NEAR, "ids binary, vectors binary, until long", "append", "EventTimeTimeout")


def settle(spark: SparkSession, path: str, found: DataFrame, batch: int, threshold: float, buckets: int = 64) -> None:
    """Adds a batch's questions to the store's table served (SERVED), beside those that earlier batches stored."""
    store = keyed.opened(spark, path)
    if not store.has("served"):
        store.create("served", SERVED, "query_id", buckets)
    if store.batch is not None and batch <= store.batch:
        return
    found = found.checkpoint()
    asked = found.groupBy("query_id").agg(F.first("seq").alias("seq"), F.first("refused").alias("refused"))
    pairs = found.where("other_id IS NOT NULL").groupBy("query_id", "other_id").agg(F.max("similarity").alias("similarity")).checkpoint()
    before = pairs.select(F.col("other_id").alias("query_id")).join(asked, "query_id", "left_anti").distinct()
    kept = store.table("served", store.touched("served", before)).where("stored").join(before, "query_id", "left_semi").select("query_id", "seq", "refused").checkpoint()
    rows = asked.unionByName(kept)  # those before have no pair of their own: they stay stored
    pairs = pairs.join(rows.select(F.col("query_id").alias("other_id")), "other_id", "left_semi")
    done = run_eval.served(rows, pairs, threshold).join(kept.select("query_id"), "query_id", "left_anti")
    store.upsert("served", done.select("query_id", "seq", "refused", "served_by", "cache_similarity", (~F.col("refused") & F.col("served_by").isNull()).alias("stored")))
    store.commit(batch)
    store.expire()


def served_stream(questions: DataFrame, path: str, checkpoint: str, dimension: int, threshold: float = 0.92, **how):
    """Starts a query that answers a stream of QUESTIONS through the cache; its rows are table served of the store at path.

    Questions are in order within a batch by seq, and batches in order of their seq.
    """
    spark = questions.sparkSession
    rows = near(questions, dimension, threshold, **how)
    return rows.writeStream.foreachBatch(lambda found, n: settle(spark, path, found, n, threshold)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
