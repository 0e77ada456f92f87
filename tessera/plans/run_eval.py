"""Two conditions of one set of questions: without and with the semantic cache."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import evaluation, retrieval
from ..session import shared_dir
from ..sources import files, stores
from . import ask


#: Pairs of near questions that one task takes in order at most: 32 MB; more are decided in rounds.
AT_ONCE = 1 << 20


def run_id(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now(datetime.UTC)).strftime("eval-%Y%m%dT%H%M%SZ")


def served(answers: DataFrame, similar: DataFrame, threshold: float) -> DataFrame:
    """answers (query_id, seq, refused, ...) as an empty cache would have served them in order of seq.

    similar (query_id, other_id, similarity) holds the pairs of questions that are near each other. A question is a hit on
    the nearest earlier question whose answer was stored; refused answers and hits are not stored. A chain of hits is
    cut where it starts: who is stored is decided in order, or for many pairs round by round, by the earliest question
    still open.
    """
    shared_dir(answers.sparkSession)
    rows = answers.select("query_id", "seq", "refused")
    pairs = similar.where((F.col("similarity") >= threshold) & (F.col("query_id") != F.col("other_id")))
    if pairs.count() <= AT_ONCE:
        return _tagged(answers, _in_order(rows, pairs))
    near = pairs.join(rows.select("query_id", F.col("seq").alias("s")), "query_id").join(rows.select(F.col("query_id").alias("other_id"), F.col("seq").alias("os"), F.col("refused").alias("orf")), "other_id").where(F.col("os") < F.col("s")).checkpoint()
    stored = rows.select("query_id", F.lit(None).cast("boolean").alias("kept")).checkpoint()
    while True:
        # decided: no earlier neighbour can be stored, or one is
        state = near.join(stored.withColumnRenamed("query_id", "other_id"), "other_id")
        by = state.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("kept"), F.lit(False))).alias("hit"), F.bool_and(F.col("kept").isNotNull() | F.col("orf")).alias("known"))
        d = stored.join(by, "query_id", "left").join(rows.select("query_id", "refused"), "query_id")
        hit, known = F.coalesce("hit", F.lit(False)), F.coalesce("known", F.lit(True))
        new = d.select("query_id", F.coalesce(F.col("kept"), F.when(F.col("refused") | hit, F.lit(False)).when(known, F.lit(True))).alias("kept")).checkpoint()
        if new.where("kept IS NULL").count() in (0, stored.where("kept IS NULL").count()):
            stored = new
            break
        stored = new
    found = near.join(stored.where("kept").select(F.col("query_id").alias("other_id")), "other_id")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "os"))).where("r = 1")
    return _tagged(answers, best.select("query_id", F.col("other_id").alias("served_by"), F.col("similarity").alias("cache_similarity")))


def _tagged(answers: DataFrame, hits: DataFrame) -> DataFrame:
    return answers.join(hits, "query_id", "left").withColumn("from_cache_semantic", F.col("served_by").isNotNull())


def _in_order(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, served_by, cache_similarity) of the hits, by one task that reads the questions in order."""
    kind = rows.schema["query_id"].dataType.simpleString()
    own = rows.join(pairs.groupBy("query_id").agg(F.collect_list(F.struct("similarity", "other_id")).alias("near")), "query_id", "left")

    def run(batches):
        stored: dict = {}
        for b in batches:
            hits = []
            for q, seq, refused, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = [(-x["similarity"], stored[x["other_id"]], x["other_id"]) for x in near or [] if x["other_id"] in stored]
                if found:
                    less, _, other = min(found)
                    hits.append((q, other, -less))
                elif not refused:
                    stored[q] = seq
            kinds = (b.schema.types[0], b.schema.types[0], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], ["query_id", "served_by", "cache_similarity"])

    ordered = own.select("query_id", "seq", "refused", "near").orderBy("seq", "query_id").checkpoint().coalesce(1)
    return ordered.mapInArrow(run, f"query_id {kind}, served_by {kind}, cache_similarity double")


def report_rows(off: DataFrame, on: DataFrame) -> DataFrame:
    """Scored rows of both conditions in one table."""
    tag = lambda d, c: evaluation.scored_rows(d.withColumn("condition", F.lit(c)))
    return tag(off, "off").unionByName(tag(on, "on"), allowMissingColumns=True)


def scored(answers: DataFrame, items: DataFrame, settings: Settings, condition: str) -> DataFrame:
    """Answers of ask.answered() as the rows that metrics are made of. items (query_id, category, expect_refuse, route_expected, expected_value)."""
    c, zero = F.col, F.lit(0).cast("long")
    used = lambda k: F.coalesce(c(f"usage.{k}"), zero)
    d = answers.withColumns({k: used(k) for k in ("prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens")})
    d = d.withColumns({
        "condition": F.lit(condition), "n_citations": F.size(F.coalesce("valid", F.array().cast("array<int>"))).cast("long"), "invalid_citations": F.size(F.coalesce("invalid", F.array().cast("array<int>"))).cast("long"),
        "from_cache_semantic": F.coalesce(c("cache_kind") == "semantic", F.lit(False)), "from_cache_meta": F.coalesce(c("cache_kind") == "meta", F.lit(False)),
        "cost": evaluation.cost(c("prompt_tokens"), c("completion_tokens"), c("cached_tokens"), settings.price_input, settings.price_cached, settings.price_output),
        "latency_s": F.lit(None).cast("double"), "latency_wall_s": F.lit(None).cast("double"), "truncated": F.lit(False), "verbatim_valid_ratio": c("valid_ratio"), "verbatim_misattributed": F.coalesce("verbatim_misattributed", zero), "verbatim_not_found": F.coalesce("verbatim_not_found", zero),
        "provenance_sources": F.size(F.coalesce("provenance", F.array().cast(ask.SOURCES))), "router_llm_tokens": zero, "router_llm_cost": F.lit(0.0), "router_llm_error": c("router_error"),
    })
    return evaluation.scored_rows(d.join(items, "query_id"))


def conditions(spark: SparkSession, settings: Settings, c: ask.Corpus, questions: DataFrame, vectors: DataFrame, items: DataFrame, generator=None) -> tuple[DataFrame, DataFrame]:
    """(off, on): every question asked once, without the semantic cache, and as an empty cache would have served them in order.

    questions (query_id, seq, text). The answers of a question do not depend on the cache, so asking twice would say nothing.
    """
    off = ask.answered(spark, settings, c, questions, vectors, generator).checkpoint()
    own = off.where("route = 'pointwise'").select("query_id")
    each = vectors.join(own, "query_id").checkpoint()
    near = retrieval.vector_topk(each, each.select(F.col("query_id").alias("id"), "vector"), max(1, each.count()), "cosine", settings.cache_threshold)
    hits = served(off.join(questions.select("query_id", "seq"), "query_id").where("route = 'pointwise'").select("query_id", "seq", "refused"), near.select("query_id", F.col("id").alias("other_id"), F.col("score").alias("similarity")), settings.cache_threshold)
    first = off.select(F.col("query_id").alias("served_by"), F.col("answer").alias("a"), F.col("claims").alias("c"), F.col("cited_chunk_ids").alias("i"), F.col("text").alias("q"))
    on = off.join(hits.where("from_cache_semantic").select("query_id", "served_by", F.col("cache_similarity").alias("s")).join(first, "served_by"), "query_id", "left")
    hit, none = F.col("served_by").isNotNull(), lambda k: F.lit(None).cast(ask.COLUMNS[k])
    changed = {
        "answer": F.col("a"), "claims": F.col("c"), "cited_chunk_ids": F.col("i"), "matched_query": F.col("q"), "cache_similarity": F.col("s"), "from_cache": F.lit(True), "cache_kind": F.lit("semantic"), "refused": F.lit(False), "uncertain": F.lit(False),
        **{k: none(k) for k in ("usage", "raw", "error", "support", "reason", "valid", "invalid", "valid_ratio", "verbatim_misattributed", "verbatim_not_found", "provenance")},
    }
    on = on.select(*[F.when(hit, changed[k]).otherwise(F.col(k)).alias(k) if k in changed else F.col(k) for k in ask.COLUMNS])
    return scored(off, items, settings, "off"), scored(on, items, settings, "on")


#: What a run's table holds of each answer.
KEPT = ("condition", "query_id", "category", "text", "route", "refused", "uncertain", "reason", "answer", "computed_value", "from_cache_semantic", "cache_similarity", "n_citations", "invalid_citations", "valid_ratio", "prompt_tokens", "completion_tokens", "cached_tokens", "cost", "error")


def run(spark: SparkSession, settings: Settings, c: ask.Corpus, questions: DataFrame, vectors: DataFrame, items: DataFrame, folder: str, generator=None) -> dict:
    """Both conditions of a set of questions: a table, a report and audit rows under folder; paths, metrics and the run's name."""
    name, at = run_id(), folder.rstrip("/")
    off, on = conditions(spark, settings, c, questions, vectors, items, generator)
    rows = off.unionByName(on).checkpoint()
    metrics, categories = ([r.asDict() for r in d.collect()] for d in ask.evaluated(rows))
    lost = [r.asDict() for r in rows.where("error IS NOT NULL").select(F.col("query_id").alias("id"), "condition", "error").collect()]  # of a set of questions
    stores.put_text(spark, f"{at}/{name}.md", ask.report(metrics, categories, settings, c.version, lost))
    audit = rows.select(
        F.lit(name).alias("run_id"), F.current_timestamp().alias("ts"), F.col("text").alias("query"), "route", "refused", "uncertain", "from_cache", (F.col("condition") == "on").alias("cache_enabled"),
        F.col("answer").alias("answer_text"), F.col("raw").alias("raw_output"), F.col("support").alias("support_score"), "cited_chunk_ids", "claims", "total_tokens",
    )
    files.append_audit(audit.where("error IS NULL"), f"{at}/audit/{name}.jsonl")
    return {"run_id": name, "table": write(spark, rows.select(*KEPT), at, name), "report": f"{at}/{name}.md", "audit": f"{at}/audit/{name}.jsonl", "metrics": metrics, "categories": categories}


def write(spark: SparkSession, rows: DataFrame, folder: str, run: str) -> str:
    path = f"{folder.rstrip('/')}/{run}.csv"
    rows.repartition(1).write.option("header", True).option("escape", '"').csv(path)  # answers hold line ends and quotes
    return path
