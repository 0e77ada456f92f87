"""Semantic and meta caches as tables, conversation windows and passage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import vector_topk

SEMANTIC = "id string, query string, vector array<double>, corpus_version string, answer string, cited string, claims string, stored_at timestamp"


def semantic_id(version: Column, query: Column) -> Column:
    return T.short_hash(F.concat(version, F.lit("\n"), query), 24)


def meta_key(version: Column, card_hash: Column, model: Column, query: Column) -> Column:
    return T.short_hash(F.concat_ws("|", version, card_hash, model, T.question_key(query)), 24)


def card_hash(text: Column) -> Column:
    return T.short_hash(F.coalesce(text, F.lit("")))


def semantic_lookup(queries: DataFrame, entries: DataFrame, version: str, threshold: float = 0.92) -> DataFrame:
    """(query_id, id, similarity): the nearest entry (id long, vector, corpus_version) of the version, if it is near enough."""
    own = entries.where(F.col("corpus_version") == version).select("id", "vector")
    return vector_topk(queries, own, 1, "cosine", threshold).select("query_id", "id", F.col("score").alias("similarity"))


def semantic_store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after an upsert by id; of several new rows with one id the last stored counts."""
    new = new.withColumn("id", semantic_id(F.col("corpus_version"), F.col("query")))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("stored_at")))
    new = new.withColumn("_r", last).where("_r = 1").drop("_r")
    return entries.join(new.select("id"), "id", "left_anti").unionByName(new.select(*entries.columns))


META = "key string, query string, model string, corpus_version string, card_hash string, answer string, claims string, cited_passages string, cited string, raw string"


def load_meta(spark, path: str) -> DataFrame:
    """Stored entries of the meta cache; one that is not there or cannot be read is empty."""
    from ..sources import stores

    return stores.read_or_empty(spark, path, META)


def meta_lookup(questions: DataFrame, entries: DataFrame, version: str, card: str, model: str) -> DataFrame:
    """questions (query_id, text) that an entry of this corpus, card and model answers, with the entry's columns."""
    key = meta_key(F.lit(version), F.lit(card), F.lit(model), F.col("text"))
    return questions.withColumn("key", key).join(entries.drop("query"), "key")


def meta_store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after a write-through of new ones (META but for the key); of several with one key one stays."""
    new = new.withColumn("key", meta_key(F.col("corpus_version"), F.col("card_hash"), F.col("model"), F.col("query")))
    new = new.groupBy("key").agg(F.min(F.struct(*entries.columns)).alias("e")).select("e.*")
    return entries.join(new.select("key"), "key", "left_anti").unionByName(new)


def storable(answers: DataFrame) -> DataFrame:
    """Answers that enter the cache: refused ones do not, uncertain ones do, hits are there already."""
    return answers.where(~F.col("refused") & ~F.col("from_cache"))


def purged(entries: DataFrame, version: str, card: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) entries of the meta cache for this corpus, card and model."""
    own = F.coalesce((F.col("corpus_version") == version) & (F.col("card_hash") == card) & (F.col("model") == model), F.lit(False))
    return entries.where(own), entries.where(~own)


def cached_lists(entries: DataFrame) -> DataFrame:
    """Entries with their JSON columns read; unreadable JSON gives empty lists."""
    claim = "array<struct<statement:string,passages:array<int>,verbatim:string>>"
    return entries.withColumn("cited", F.coalesce(F.from_json("cited", "array<string>"), F.array().cast("array<string>"))).withColumn("claims", F.coalesce(F.from_json("claims", claim), F.array().cast(claim)))


def document_metadata(meta: Column) -> Column:
    """(name, author) of a document's JSON metadata; what is missing or cannot be read is unknown."""
    p = F.from_json(meta, "name string, author string")
    return F.struct(*[F.coalesce(p[k], F.lit("unknown")).alias(k) for k in ("name", "author")])


def without_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def context_rows(found: DataFrame) -> DataFrame:
    """(query_id, n, chunk_id, source, content, in_index) of found passages (query_id, rank, id, text, metadata map)."""
    name = F.coalesce(F.try_element_at("metadata", F.lit("title")), F.try_element_at("metadata", F.lit("source")), F.lit("?"))
    return found.select("query_id", F.col("rank").cast("int").alias("n"), F.col("id").cast("string").alias("chunk_id"), name.alias("source"), F.col("text").alias("content"), F.lit(True).alias("in_index"))


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def numbered(passages: DataFrame) -> DataFrame:
    """(query_id, context): passages as `[n] (documento: source)` blocks in order, parted by ---."""
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] (documento: "), "source", F.lit(")\n"), "content")
    return passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def passages_of(hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, n, chunk_id, source, content, in_index) of the first k hits, numbered by rank."""
    d = docs.select("id", "content", "source")
    return hits.where(F.col("rank") <= k).join(d, "id").select("query_id", F.col("rank").cast("int").alias("n"), F.col("id").cast("string").alias("chunk_id"), "source", "content", F.lit(True).alias("in_index"))


def resolved(context: DataFrame, chunks: DataFrame, inline: DataFrame) -> DataFrame:
    """(query_id, chunk_id, content, missing): a passage's text from the index, else from the audit row itself."""
    c = context.join(chunks.select("chunk_id", F.col("content").alias("a")), "chunk_id", "left")
    c = c.join(inline.select("query_id", "chunk_id", F.col("content").alias("b")), ["query_id", "chunk_id"], "left")
    return c.select("query_id", "chunk_id", F.coalesce("a", "b").alias("content"), (F.col("a").isNull() & F.col("b").isNull()).alias("missing"))


def used_markers(text: Column, top: Column) -> Column:
    """Marker numbers up to `top` in the order in which they first appear."""
    return F.array_distinct(F.filter(T.marks(text), lambda x: (x >= 1) & (x <= top)))
