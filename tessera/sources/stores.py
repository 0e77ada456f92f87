"""Tables that may not be there yet, listings of runs, and frozen bundles."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table, or an empty one of the schema if the path does not exist or cannot be read as one."""
    try:
        df = spark.read.format(kind).schema(schema).load(path)
        df.limit(1).count()
        return df
    except Exception as e:
        if re.search("PATH_NOT_FOUND|UNABLE_TO_INFER|FAILED_READ_FILE|CANNOT_READ|not a Parquet|FileNotFound", str(e)):
            return spark.createDataFrame([], schema)
        raise


def read_or_build(spark: SparkSession, path: str, schema: str, build) -> DataFrame:
    """The stored table, or build() written there and read back."""
    found = read_or_empty(spark, path, schema)
    if found.limit(1).count():
        return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: beside the old one first, which one renaming then replaces."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    at, beside = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = at.getFileSystem(conf)
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(beside), system.makeQualified(at), options)


def names(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names of the files and folders directly under a folder, newest name first; none if it is not there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted((f.getPath().getName() for f in found or []), reverse=True)


def runs(spark: SparkSession, audit_dir: str, evaluations_only: bool = True) -> list[str]:
    stems = [n.removesuffix(".jsonl") for n in names(spark, audit_dir, "*.jsonl")]
    return [s for s in stems if not evaluations_only or s.startswith("eval-")]


def _bundle(folder: str, run_id: str, condition: str | None) -> str:
    return f"{folder.rstrip('/')}/{run_id}-bundle{f'-{condition}' if condition else ''}.json"


def save_bundle(spark: SparkSession, folder: str, run_id: str, condition: str | None, bundle: dict) -> str:
    """Freezes a bundle for one reader: items and form of one run, which fit on the driver because a person reads them."""
    path = _bundle(folder, run_id, condition)
    spark.createDataFrame([(json.dumps(bundle, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_bundle(spark: SparkSession, folder: str, run_id: str, condition: str | None) -> dict | None:
    row = read_or_empty(spark, _bundle(folder, run_id, condition), "value string", "text").first()
    return json.loads(row["value"]) if row else None


def bundles(spark: SparkSession, folder: str) -> list[dict]:
    out = []
    for n in names(spark, folder, "*-bundle*.json"):
        run, _, tail = n.removesuffix(".json").partition("-bundle")
        out.append({"run_id": run, "condition": tail.lstrip("-") or None, "path": f"{folder.rstrip('/')}/{n}"})
    return out


def dated(rows: DataFrame) -> DataFrame:
    """rows with the UTC time of writing."""
    return rows.withColumn("ts", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
