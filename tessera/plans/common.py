"""Registration of queries with their DuckDB texts, and tables the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: str) -> DataFrame:
    """A literal table; the same VALUES text serves both engines."""
    return spark.sql(f"SELECT * FROM VALUES {values}")


def duck(values: str) -> str:
    return f"(SELECT * FROM (VALUES {values.rsplit(' AS ', 1)[0]}) AS {values.rsplit(' AS ', 1)[1]})"


def each(spark: SparkSession, sf_dir: str, values: str, *texts: str, source: str = "documents", key: str = "doc_id", text: str = "text", id: str = "id") -> DataFrame:
    """A row of `values` (numbered from 1 by `id`) for each row of a given table, by its key; `texts` have its text after their own."""
    given = rows(spark, values)
    n = given.count()  # as many as the text of the query lists
    own = table(spark, sf_dir, source).select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    at = own.join(F.broadcast(given), F.pmod("_key", F.lit(n)) + 1 == F.col(id))
    return at.select(F.col("_key").alias(id), *[F.concat(c, F.lit(" "), "_text").alias(c) if c in texts else F.col(c) for c in given.columns if c != id])


def each_sql(values: str, *texts: str, source: str = "documents", key: str = "doc_id", text: str = "text", id: str = "id") -> str:
    names = [c.strip() for c in values.rsplit("(", 1)[1].rstrip(") ").split(",")]
    cells = ", ".join(f"_g.{c} || ' ' || coalesce(_d.{text}, '') AS {c}" if c in texts else f"_g.{c} AS {c}" for c in names if c != id)
    return f"(SELECT _d.{key} AS {id}, {cells} FROM {source} _d JOIN {duck(values)} _g ON _d.{key} % (SELECT count(*) FROM {duck(values)}) + 1 = _g.{id})"


STOP_SQL = None


def words_sql(column: str) -> str:
    """Plain tokens of four letters or more."""
    return f"list_filter(regexp_extract_all(replace(lower({column}), '’', ''''), '[a-zà-ù0-9]+'), lambda w: length(w) >= 4)"
