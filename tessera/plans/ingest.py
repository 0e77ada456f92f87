"""Files to a versioned corpus: one job for each table, swapped in only when all are written."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import corpus, retrieval
from ..providers import Embedder, embedded
from ..sources import files, stores

#: Files that the manifest itself lists at most.
LISTED = 100_000
TABLES = ("docs", "chunks", "term_df", "phrases", "norms", "postings")


@dataclass
class Report:
    folder: str
    n_files: int
    n_chunks: int
    corpus_content_hash: str
    corpus_version: str
    embed_tokens: int
    embed_cost: float | None


def ingest(spark: SparkSession, settings: Settings, folder: str, target: str, embedder: Embedder | None = None, card_dir: str | None = None, pdf=None) -> Report:
    """Writes TABLES under a new folder of target and then points target/manifest.json at it.

    Nothing that is being read is ever overwritten: a run that fails leaves the last corpus as it was.
    """
    at = f"{target.rstrip('/')}/{uuid.uuid4().hex}"
    parsed = files.parsed(files.discovered(spark, folder, card_dir), pdf)
    docs = parsed.select(F.col("path").alias("doc_id"), "title", T.clean(F.col("text")).alias("text"))
    docs = docs.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    docs.write.parquet(f"{at}/docs")
    docs = spark.read.parquet(f"{at}/docs")
    chunks = corpus.chunks(docs, settings.chunk_tokens, settings.overlap_tokens)
    if embedder is not None:
        vectors = embedded(chunks.select(F.col("chunk_id").alias("id"), "content"), embedder, settings.embed_batch)
        chunks = corpus.with_metadata(chunks, vectors.select(F.col("id").alias("chunk_id"), "vector"), "chunk_id", "no vector for a chunk")
    chunks.write.parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    corpus.term_df(chunks.select(F.col("content").alias("text"))).write.parquet(f"{at}/term_df")
    corpus.phrase_index(docs, settings.phrase_min_documents).orderBy(F.desc("n_documents")).write.parquet(f"{at}/phrases")
    corpus.norm_index(docs, settings.phrase_min_documents).orderBy(F.desc("n_documents")).write.parquet(f"{at}/norms")
    retrieval.postings(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))).write.parquet(f"{at}/postings")
    h = corpus.corpus_hash(docs).withColumn("v", corpus.corpus_version(F.col("corpus_content_hash"), settings.chunk_tokens, settings.chunk_overlap_ratio, settings.embed_model, settings.embed_dim)).first()
    n = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    per = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))
    listed = docs.select(F.col("doc_id").alias("path"), "title", "content_hash").join(per.withColumnRenamed("doc_id", "path"), "path", "left").orderBy("path")
    listed.write.json(f"{at}/files")
    body = {"corpus_version": h["v"], "corpus_content_hash": h["corpus_content_hash"], "folder": at, "n_files": h["n_docs"], "n_chunks": n["n"]}
    # the list stands in the manifest too while one reader can hold it; beyond that it is the table beside the chunks
    body["files"] = [json.loads(x) for x in spark.read.schema(listed.schema).json(f"{at}/files").orderBy("path").toJSON().collect()] if h["n_docs"] <= LISTED else None
    stores.put_text(spark, f"{target.rstrip('/')}/manifest.json", json.dumps(body, ensure_ascii=False, sort_keys=True))
    price = settings.price_embed
    cost = n["t"] / 1e6 * price if embedder is not None and price > 0 and n["t"] else None
    return Report(at, h["n_docs"], n["n"], h["corpus_content_hash"], h["v"], n["t"] if embedder is not None else 0, cost)


def version(spark: SparkSession, target: str) -> str:
    """The version that the manifest names, or no-manifest."""
    try:
        return json.loads(spark.read.text(f"{target.rstrip('/')}/manifest.json", wholetext=True).first()["value"])["corpus_version"]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return "no-manifest"
        raise


def tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    at = json.loads(spark.read.text(f"{target.rstrip('/')}/manifest.json", wholetext=True).first()["value"])["folder"]
    return {name: spark.read.parquet(f"{at}/{name}") for name in TABLES}
