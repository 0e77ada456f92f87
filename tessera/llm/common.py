"""What the operators share: tables, materialised steps, batch sizes and packed arrays."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 2048, mb: int = 8) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes: long texts must not pile up.

    Plans are lazy and the bounds are the session's, so all operators leave the same ones behind; one that needs others
    for a step writes that step's rows before it goes on.
    """
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if not LEFT:
        atexit.register(_leave, spark._jvm)
    LEFT.add(path)
    return out


#: What written() made and nothing has removed: lazy results read it, so it goes when the driver ends.
LEFT: set[str] = set()


def _remove(jvm, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _leave(jvm) -> None:
    import contextlib

    while LEFT:
        with contextlib.suppress(Exception):  # the JVM or its file system has gone first
            _remove(jvm, LEFT.pop())


def dropped(df: DataFrame) -> None:
    """Removes what written() made, once nothing reads it any more."""
    path = getattr(df, "_written", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        LEFT.discard(path)


def pieces(spark: SparkSession, amount: float, each: float, least: int = 0) -> int:
    """Partitions so that each holds at most about `each` of `amount`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount / each) + 1)


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column, null as empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after another."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def schema_with(df: DataFrame, *more: tuple[str, str]) -> Ty.StructType:
    """The schema of df and further columns (name, type)."""
    return Ty.StructType([*df.schema.fields, *Ty.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in more)).fields])


def carried(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns as one, so that none of their names can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), F.col("text").cast("string").alias("text"))


def restored(rows: DataFrame, like: DataFrame, **new) -> DataFrame:
    """The columns of `like` from what carried() made of it; text and the columns of `new` are as they are now."""
    pick = {c: F.col("row").getField(c) for c in like.columns} | {"text": F.col("text")} | new
    return rows.select(*[pick[f.name].cast(f.dataType).alias(f.name) for f in like.schema])


def joined_hot(rows: DataFrame, lookup: DataFrame, key: str, count: str, share: float = 0.002) -> DataFrame:
    """rows joined with lookup, which has each key once and says in `count` how many rows have it.

    Keys with over `share` of all rows, fewer than 1 / share whatever the data, are broadcast; the rest is shuffled.
    """
    seen = lookup.agg(F.sum(count).alias("all"), F.max(count).alias("most")).first()
    most = max(1000, int(share * (seen["all"] or 0)))
    if (seen["most"] or 0) <= most:
        return rows.join(lookup.drop(count), key)
    hot, rest = lookup.where(F.col(count) > most).drop(count), lookup.where(F.col(count) <= most).drop(count)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


#: By operator, what forgets that which a worker keeps for its next task of the same operator.
KEPT: dict = {}


def tidied(run, owner: str = ""):
    """run, a function of batches; after it the task's freed memory goes back to the system.

    Workers live on from task to task: what another operator kept in this one is dropped first, and what allocators hold
    back would add up beside the next operator's needs.
    """

    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa

        from tessera.llm import common

        for name, forget in common.KEPT.items():
            if name != owner:
                forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole
