"""Scored rows, metrics, judgements, calibration, audit and windows of audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caching, evaluation, guards, judging
from ..sources import files
from ..streaming import audit as stream
from . import run_eval
from .common import duck, each, each_sql, query, rows, table

# answers made of events: the kind of event is the category, k of the props the tokens
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
BASE = f"""b AS (SELECT event_id AS id, event_type AS category, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS condition, event_id % 11 = 0 AS refused, event_id % 13 = 0 AS uncertain, event_id % 17 = 0 AS truncated,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 10 < 2 END AS expect_refuse, CASE event_id % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'meta' WHEN 2 THEN 'uncovered' ELSE 'pointwise' END AS route,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 6 < 4 THEN 'structured' ELSE 'pointwise' END AS route_expected, CASE WHEN event_id % 2 = 0 THEN event_id % 9 END AS expected_value,
  CASE WHEN event_id % 4 = 0 THEN event_id % 8 END AS computed_value, event_id % 3 AS n_citations, event_id % 7 AS invalid_citations, CASE WHEN event_id % 11 = 0 THEN 0 ELSE coalesce({K}, 0) END AS prompt_tokens,
  coalesce({K}, 0) // 2 AS completion_tokens, coalesce({K}, 0) // 4 AS cached_tokens, event_id % 19 = 0 AS from_cache_semantic, event_id % 23 = 0 AS from_cache_meta,
  value AS latency_s, value + (event_id % 5) / 10.0::DOUBLE AS latency_wall_s, CASE WHEN event_id % 2 = 1 THEN (event_id % 4) / 4.0::DOUBLE END AS verbatim_valid_ratio, event_id % 2 AS verbatim_misattributed, event_id % 3 AS verbatim_not_found,
  event_id % 29 AS provenance_sources, CASE WHEN event_id % 2 = 0 THEN event_id % 40 ELSE 0 END AS router_llm_tokens, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'lexical' END AS router_source,
  CASE WHEN event_id % 31 = 0 THEN '429' ELSE '' END AS router_llm_error, CASE WHEN event_id % 37 = 0 THEN 'timeout' ELSE '' END AS error FROM events),
 p AS (SELECT *, prompt_tokens + completion_tokens AS total_tokens, (greatest(0, prompt_tokens - cached_tokens) * 2.0::DOUBLE + cached_tokens * 0.5::DOUBLE + completion_tokens * 6.0::DOUBLE) / 1e6 AS cost, router_llm_tokens * 2.0::DOUBLE / 1e6 AS router_llm_cost FROM b),
 w AS (SELECT *, refused OR uncertain AS declined, CASE WHEN error = '' AND expect_refuse IS NOT NULL THEN CAST((refused OR uncertain) = expect_refuse AS INTEGER) END AS refusal_correct,
  CASE WHEN error = '' AND NOT (refused OR uncertain) THEN CAST(route = 'structured' OR (route = 'meta' AND prompt_tokens = 0) OR n_citations > 0 AS INTEGER) END AS source_id_ok,
  CASE WHEN error = '' AND route_expected IS NOT NULL THEN CAST(route = route_expected AS INTEGER) END AS route_ok,
  CASE WHEN error = '' AND route = 'structured' AND expected_value IS NOT NULL AND computed_value IS NOT NULL THEN CAST(expected_value = computed_value AS INTEGER) END AS value_ok FROM p)"""


def _answers(spark, d):
    e = table(spark, d, "events")
    i, k = F.col("event_id"), F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0).cast("long"))
    x = e.select(
        i.alias("id"), F.col("event_type").alias("category"), F.when(i % 2 == 0, "on").otherwise("off").alias("condition"), (i % 11 == 0).alias("refused"), (i % 13 == 0).alias("uncertain"), (i % 17 == 0).alias("truncated"),
        F.when(i % 5 != 0, i % 10 < 2).alias("expect_refuse"), F.when(i % 4 == 0, "structured").when(i % 4 == 1, "meta").when(i % 4 == 2, "uncovered").otherwise("pointwise").alias("route"),
        F.when(i % 3 == 0, F.lit(None)).when(i % 6 < 4, "structured").otherwise("pointwise").alias("route_expected"), F.when(i % 2 == 0, i % 9).alias("expected_value"), F.when(i % 4 == 0, i % 8).alias("computed_value"),
        (i % 3).alias("n_citations"), (i % 7).alias("invalid_citations"), F.when(i % 11 == 0, 0).otherwise(k).cast("long").alias("prompt_tokens"), F.floor(k / 2).alias("completion_tokens"), F.floor(k / 4).alias("cached_tokens"),
        (i % 19 == 0).alias("from_cache_semantic"), (i % 23 == 0).alias("from_cache_meta"), F.col("value").alias("latency_s"), (F.col("value") + (i % 5) / F.lit(10.0)).alias("latency_wall_s"),
        F.when(i % 2 == 1, (i % 4) / F.lit(4.0)).alias("verbatim_valid_ratio"), (i % 2).alias("verbatim_misattributed"), (i % 3).alias("verbatim_not_found"), (i % 29).alias("provenance_sources"),
        F.when(i % 2 == 0, i % 40).otherwise(0).cast("long").alias("router_llm_tokens"), F.when(i % 2 == 0, "llm").otherwise("lexical").alias("router_source"), F.when(i % 31 == 0, "429").otherwise("").alias("router_llm_error"), F.when(i % 37 == 0, "timeout").otherwise("").alias("error"),
    )
    c = evaluation.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens"), 2.0, 0.5, 6.0)
    return evaluation.scored_rows(x.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "cost": c, "router_llm_cost": F.col("router_llm_tokens") * F.lit(2.0) / F.lit(1e6)}))


@query(f"WITH {BASE} SELECT id, declined, refusal_correct, source_id_ok, route_ok, value_ok, round(cost, 9) AS cost FROM w")
def eval_rows(spark, d):
    return _answers(spark, d).select("id", "declined", "refusal_correct", "source_id_ok", "route_ok", "value_ok", F.round("cost", 9).alias("cost"))


def _r(num, den, digits=3):
    return f"coalesce(round_even(CAST({num} AS DOUBLE) / nullif({den}, 0), {digits}), 0.0)"


def _n(cond):
    return f"count(*) FILTER (error = '' AND ({cond}))"


def _t(col):
    return f"CAST(coalesce(sum({col}) FILTER (error = ''), 0) AS BIGINT)"


CALL, ANS = "NOT from_cache_semantic AND prompt_tokens > 0", "NOT refused AND NOT uncertain"
METRICS = {
    "n": _n("true"), "refusal_accuracy": _r("sum(refusal_correct)", _n("refusal_correct IS NOT NULL")), "citation_validity": _r("sum(source_id_ok)", _n(ANS)), "invalid_citation_total": _t("invalid_citations"),
    "semantic_hit_rate": _r(_n("from_cache_semantic"), _n("true")), "provider_hit_rate": _r(_n(f"{CALL} AND cached_tokens > 0"), _n(CALL)), **{k: _t(k) for k in ("prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens")},
    "cost": "coalesce(round_even(sum(cost) FILTER (error = ''), 6), 0.0)", "latency_avg": "round_even(avg(latency_s) FILTER (error = ''), 3)", "latency_median": "round_even(median(latency_s) FILTER (error = ''), 3)",
    "latency_max": "round_even(max(latency_s) FILTER (error = ''), 3)", "suspend_drift_s": "round_even(sum(latency_wall_s - latency_s) FILTER (error = ''), 1)", "model_calls": _n(CALL), "n_refused": _n("refused"), "n_uncertain": _n("uncertain"),
    "n_answered": _n(ANS), "n_truncated": _n("truncated"), "routing_accuracy": _r("sum(route_ok)", _n("route_ok IS NOT NULL")),
    "router_recall": _r(_n("route = 'structured' AND route_expected = 'structured'"), _n("route_expected = 'structured'")), "router_false_positive": _r(_n("route <> 'pointwise' AND route_expected = 'pointwise'"), _n("route_expected = 'pointwise'")),
    "structured_value_accuracy": _r("sum(value_ok)", _n("value_ok IS NOT NULL")), "verbatim_valid_ratio": "coalesce(round_even(avg(verbatim_valid_ratio) FILTER (error = ''), 3), 0.0)",
    "verbatim_misattributed": _t("verbatim_misattributed"), "verbatim_not_found": _t("verbatim_not_found"), **{f"n_{r}": _n(f"route = '{r}'") for r in ("structured", "uncovered", "meta")}, "n_provenance": _n("provenance_sources > 0"),
    "n_cache_meta": _n("from_cache_meta"), "n_errors": "count(*) FILTER (error <> '')", "router_llm_calls": _n("router_llm_tokens > 0"), "router_llm_decisions": _n("router_source = 'llm'"), "router_llm_failed": _n("router_llm_error <> ''"),
    "router_llm_tokens": _t("router_llm_tokens"), "router_llm_cost": "coalesce(round_even(sum(router_llm_cost) FILTER (error = ''), 6), 0.0)",
}


@query(f"WITH {BASE} SELECT condition, " + ", ".join(f"{v} AS {k}" for k, v in METRICS.items()) + " FROM w GROUP BY condition")
def eval_metrics(spark, d):
    return evaluation.metrics(_answers(spark, d))


@query(f"WITH {BASE} SELECT condition, category, count(*) AS n, count(*) FILTER ({ANS}) AS answers, count(*) FILTER (uncertain) AS abstentions, count(*) FILTER (refused) AS refusals FROM w GROUP BY condition, category")
def eval_by_category(spark, d):
    return evaluation.by_category(_answers(spark, d))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS most, count(*) AS n FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("most"), F.count("*").alias("n"))


@query(f"WITH {BASE} SELECT category, round(sum(cost), 6) AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM w GROUP BY category")
def usage_cost(spark, d):
    return _answers(spark, d).groupBy("category").agg(F.round(F.sum("cost"), 6).alias("cost"), F.sum("total_tokens").cast("long").alias("tokens"), F.count("*").alias("calls"))


@query(f"SELECT event_id, CASE WHEN {K} > 0 THEN round({K} / 1e6 * 0.1::DOUBLE, 12) END AS priced, CAST(NULL AS DOUBLE) AS unpriced FROM events")
def embed_cost(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", F.round(evaluation.embed_cost(k, 0.1), 12).alias("priced"), evaluation.embed_cost(k, 0.0).alias("unpriced"))


@query(f"WITH {BASE} SELECT id, condition FROM w WHERE condition = 'off' UNION ALL SELECT id, condition FROM w WHERE condition = 'on'")
def set_union_conditions(spark, d):
    x = _answers(spark, d).select("id", "condition")
    return x.where("condition = 'off'").unionByName(x.where("condition = 'on'"))


EVENTS = {"source": "events", "key": "event_id", "text": "props"}
RECORDS = """(1, true, true, false, '', ''), (2, false, true, true, '', ''), (3, false, false, true, 'hit', ''), (4, false, false, false, ' text ', ''), (5, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), '', '{"answer": "from raw"}'),
(6, false, false, false, '', 'plain raw'), (7, false, false, false, '', '') AS t(id, refused, uncertain, from_cache, answer_text, raw_output)"""
_TYPE = "CASE WHEN refused THEN 'rifiuto' WHEN uncertain THEN 'astensione' WHEN from_cache THEN 'hit-cache' ELSE 'risposta' END"


@query(f"SELECT id, {_TYPE} AS kind FROM {each_sql(RECORDS, **EVENTS)}")
def record_type(spark, d):
    return each(spark, d, RECORDS, **EVENTS).select("id", evaluation.record_type(F.col("refused"), F.col("uncertain"), F.col("from_cache")).alias("kind"))


@query(f"SELECT id FROM {each_sql(RECORDS, **EVENTS)} WHERE {_TYPE} IN ('risposta', 'hit-cache')")
def judgeable(spark, d):
    return each(spark, d, RECORDS, **EVENTS).where(evaluation.record_type(F.col("refused"), F.col("uncertain"), F.col("from_cache")).isin("risposta", "hit-cache")).select("id")


@query(f"SELECT id, {_TYPE} AS tipo, '' AS fedele, CASE id % 7 + 1 WHEN 3 THEN 'hit' WHEN 4 THEN 'text' WHEN 5 THEN 'from raw' WHEN 6 THEN 'plain raw' ELSE '' END AS risposta FROM {each_sql(RECORDS, **EVENTS)}")
def form_rows(spark, d):
    return each(spark, d, RECORDS, **EVENTS).select("id", evaluation.record_type(F.col("refused"), F.col("uncertain"), F.col("from_cache")).alias("tipo"), F.lit("").alias("fedele"), evaluation.answer_text(F.col("answer_text"), F.col("raw_output")).alias("risposta"))


# a form of labelled documents: quality is the verdict, doc_id decides marks and causes
FORM = """f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' WHEN quality = 1 THEN 'Sì' ELSE 'no' END AS fedele, CASE doc_id % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'gen' WHEN 2 THEN 's' ELSE '?' END AS causa,
 CASE doc_id % 3 WHEN 0 THEN 'si' WHEN 1 THEN 'n' ELSE 'forse' END AS citazione_corretta, CASE doc_id % 5 WHEN 0 THEN '4,0' WHEN 1 THEN '3.6' WHEN 2 THEN '0' WHEN 3 THEN '6' ELSE '' END AS italiano_1_5, CASE WHEN doc_id % 6 = 0 THEN 'run-1' ELSE '' END AS ereditato_da FROM labels)"""


def _form(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "labels").select(
        "doc_id", F.when(i % 10 == 0, "").when(F.col("quality") == 1, "Sì").otherwise("no").alias("fedele"), F.when(i % 4 == 0, "r").when(i % 4 == 1, "gen").when(i % 4 == 2, "s").otherwise("?").alias("causa"),
        F.when(i % 3 == 0, "si").when(i % 3 == 1, "n").otherwise("forse").alias("citazione_corretta"), F.when(i % 5 == 0, "4,0").when(i % 5 == 1, "3.6").when(i % 5 == 2, "0").when(i % 5 == 3, "6").otherwise("").alias("italiano_1_5"),
        F.when(i % 6 == 0, "run-1").otherwise("").alias("ereditato_da"),
    )


PARSED = f"""{FORM}, g AS (SELECT *, CASE lower(fedele) WHEN 'sì' THEN true WHEN 'no' THEN false END AS v, CASE lower(citazione_corretta) WHEN 'si' THEN true WHEN 'n' THEN false END AS cc,
 CASE WHEN italiano_1_5 IN ('4,0', '3.6') THEN 4 END AS m, CASE causa WHEN 'r' THEN 'retrieval' WHEN 'gen' THEN 'generazione' WHEN 's' THEN 'strutturale' END AS k FROM f), j AS (SELECT *, v IS NOT NULL OR cc IS NOT NULL OR m IS NOT NULL AS seen FROM g)"""
_FID = "CAST(count(*) FILTER (v) AS DOUBLE) / nullif(count(*) FILTER (v) + count(*) FILTER (NOT v), 0)"


@query(
    f"""WITH {PARSED} SELECT count(*) AS n_totali, count(*) FILTER (seen) AS n_giudicati, count(*) FILTER (seen AND ereditato_da <> '') AS n_ereditati, count(*) FILTER (seen AND ereditato_da = '') AS n_riletti,
    round_even(CAST(count(*) FILTER (seen) AS DOUBLE) / count(*), 3) AS copertura, count(*) FILTER (v) AS n_fedeli, count(*) FILTER (NOT v) AS n_infedeli, count(*) FILTER (NOT v AND k = 'retrieval') AS causa_retrieval,
    count(*) FILTER (NOT v AND k = 'generazione') AS causa_generazione, count(*) FILTER (NOT v AND k = 'strutturale') AS causa_strutturale, count(*) FILTER (NOT v AND k IS NULL) AS infedeli_senza_causa, round_even({_FID}, 4) AS fedelta,
    round_even(CAST(count(*) FILTER (cc) AS DOUBLE) / count(cc), 4) AS citazione_corretta, count(*) FILTER (NOT cc) AS n_citazioni_sbagliate, round_even(avg(m), 2) AS italiano_medio, count(m) AS n_voti_italiano,
    CASE WHEN {_FID} >= 0.95 THEN 'ALTA' WHEN {_FID} >= 0.85 THEN 'MEDIA' ELSE 'BASSA' END AS banda FROM j"""
)
def human_fidelity(spark, d):
    return evaluation.fidelity(_form(spark, d))


_RATE = "CASE WHEN event_id % 50 <> 0 THEN CAST(event_id % 1001 AS DOUBLE) / 1000 END"


@query(f"SELECT id, CASE WHEN rate IS NULL THEN 'INSUFFICIENTE' WHEN rate >= 0.95 THEN 'ALTA' WHEN rate >= 0.85 THEN 'MEDIA' ELSE 'BASSA' END AS band FROM (SELECT event_id AS id, {_RATE} AS rate FROM events)")
def fidelity_band(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(_RATE).alias("rate")).select("id", T.band(F.col("rate")).alias("band"))


CAL = "c AS (SELECT event_type AS category, value AS score FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM c)"


@query(f"WITH {CAL} SELECT category, max(n) AS n, min(score) AS min, max(CASE WHEN r = n // 2 THEN score END) AS median, max(score) AS max FROM o GROUP BY category")
def threshold_calibration(spark, d):
    return evaluation.calibration(table(spark, d, "events").where("value IS NOT NULL").select(F.col("event_type").alias("category"), F.col("value").alias("score")))[0]


_CATEGORY = "CASE event_id % 3 WHEN 0 THEN 'in_corpus' WHEN 1 THEN 'out_of_corpus' ELSE 'vaga' END"
_SCORE = "CASE event_id % 3 WHEN 0 THEN CAST(0.8 AS DOUBLE) + value / 100000 ELSE CAST(0.7 AS DOUBLE) + value / 100000 END"


@query(f"""SELECT min(score) FILTER (category = 'in_corpus') AS least_inside, max(score) FILTER (category = 'out_of_corpus') AS most_outside,
    round_even((min(score) FILTER (category = 'in_corpus') + max(score) FILTER (category = 'out_of_corpus')) / 2, 2) AS threshold FROM (SELECT {_CATEGORY} AS category, {_SCORE} AS score FROM events WHERE value IS NOT NULL)""")
def threshold_proposal(spark, d):
    return evaluation.calibration(table(spark, d, "events").where("value IS NOT NULL").select(F.expr(_CATEGORY).alias("category"), F.expr(_SCORE).alias("score")))[1]


@query(
    """SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id, md5(d.text) AS content, false AS missing FROM benchmark b JOIN documents d ON doc_id = item_id
    UNION ALL SELECT item_id, 'card::' || item_id, md5(text), false FROM benchmark UNION ALL SELECT item_id, 'gone', NULL, true FROM benchmark"""
)
def audit_join_context(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    card = F.concat(F.lit("card::"), F.col("query_id").cast("string"))
    context = b.select("query_id", F.explode(F.array(F.col("query_id").cast("string"), card, F.lit("gone"))).alias("chunk_id"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.md5(F.col("text").cast("binary")).alias("content"))
    return caching.resolved(context, chunks, b.select("query_id", card.alias("chunk_id"), F.md5(F.col("text").cast("binary")).alias("content")))


@query(f"WITH {BASE} SELECT id, CASE WHEN refused THEN 'rifiuto' WHEN uncertain THEN 'astensione' WHEN from_cache_semantic OR from_cache_meta THEN 'hit-cache' ELSE 'risposta' END AS kind, route, round(cost, 9) AS cost, total_tokens FROM w")
def audit_projection(spark, d):
    return _answers(spark, d).select("id", evaluation.record_type(F.col("refused"), F.col("uncertain"), F.col("from_cache_semantic") | F.col("from_cache_meta")).alias("kind"), "route", F.round("cost", 9).alias("cost"), "total_tokens")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2")
def audit_window(spark, d):
    """The batch twin of the stream of audit rows; the same plan over a stream is held against it in the tests."""
    x = table(spark, d, "events").select("ts", F.col("event_type").alias("kind"), "value")
    return stream.windowed(x).withColumn("mean", F.round("mean", 6))


@query("SELECT n, greatest(10, CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT)) AS minimum FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT 10 UNION ALL SELECT 250 UNION ALL SELECT 270)")
def provenance_minimum(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n")).unionByName(rows(spark, "(10L), (250L), (270L) AS t(n)"))
    return n.select("n", guards.provenance_minimum(10, 0.05, F.col("n")).alias("minimum"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def sorted_manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).orderBy("doc_id")


AUDIT = """(1, 'q1', array('c1','c2','s1'), array('c2')), (2, 'q2', CAST(array() AS array<string>), array('c1','zz')), (3, 'q9', CAST(NULL AS array<string>), CAST(NULL AS array<string>)) AS t(record_id, query, retrieved_chunk_ids, cited_chunk_ids)"""


def _audit(spark):
    inline = F.create_map(F.lit("s1"), F.struct(F.lit(" stats ").alias("text"), F.lit("scheda").alias("source")))
    chunks = rows(spark, "('c1', 'uno', 'T1', 'S1'), ('c2', 'due', CAST(NULL AS STRING), 'S2') AS t(chunk_id, content, title, source)")
    return rows(spark, AUDIT).withColumn("passages_inline", inline), chunks


@query(
    """SELECT * FROM (VALUES (1, 1, 'c1', 'T1', 'uno', false, false), (1, 2, 'c2', 'S2', 'due', true, false), (1, 3, 's1', 'scheda', 'stats', false, false),
    (2, 1, 'c1', 'T1', 'uno', true, false), (2, 2, 'zz', '?', '', true, true)) AS t(record_id, n, chunk_id, title, text, cited, missing)"""
)
def judge_items(spark, d):
    return judging.shown_passages(*_audit(spark))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS record_id, text AS query, role, turn FROM conversations),
    i AS (SELECT query AS question, arg_max('i' || record_id, record_id) AS id, arg_max(role, record_id) AS category FROM t WHERE turn % 2 = 0 GROUP BY query)
    SELECT record_id, query, coalesce(id, '') AS id, coalesce(category, '') AS category FROM t LEFT JOIN i ON question = query"""
)
def audit_items(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), F.col("text").alias("query"), F.col("role").alias("category"), "turn")
    index = files.item_index(t.where("turn % 2 = 0").select(F.col("record_id").alias("line_no"), F.col("query").alias("question"), F.concat(F.lit("i"), F.col("record_id").cast("string")).alias("id"), "category"))
    return judging.identified(t.select("record_id", "query"), index).select("record_id", "query", "id", "category")


@query("SELECT item_id AS record_id, 0 AS pos, sha256(text) AS hash FROM benchmark")
def cited_hashes(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("record_id"), F.col("item_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return judging.cited_hashes(b.select("record_id", F.array("chunk_id", F.lit("gone")).alias("cited_chunk_ids")), b)


CLAIMED = "SELECT doc_id AS record_id, concat('s', CAST(doc_id % 2 AS VARCHAR(3))) AS statement, CASE WHEN doc_id % 4 <> 0 THEN substr(text, 1, 20) END AS verbatim FROM {0}"
#: Outcomes of two checks, the second of some claims only.
OUTCOME = """SELECT doc_id AS record_id, concat('s', CAST(doc_id % 2 AS VARCHAR(3))) AS statement, 0 AS pos, substr(text, 3, 9) AS verbatim, 'non_trovato' AS outcome, CAST(NULL AS INTEGER) AS matched_passage FROM {0} WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, concat('s', CAST(doc_id % 2 AS VARCHAR(3))), 1, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 2, 18) ELSE '' END, 'valido', CAST(doc_id % 4 AS INTEGER) FROM {0} WHERE doc_id % 6 = 1"""


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY record_id, statement ORDER BY pos DESC) AS r FROM ({OUTCOME.format('documents')}))
    SELECT c.record_id, c.statement, coalesce(nullif(o.verbatim, ''), c.verbatim, '') AS verbatim, coalesce(o.outcome, '') AS outcome, o.matched_passage
    FROM ({CLAIMED.format('documents')}) c LEFT JOIN o ON o.record_id = c.record_id AND o.statement = c.statement AND r = 1"""
)
def claims_outcomes(spark, d):
    docs = table(spark, d, "documents")
    return judging.shown_claims(spark.sql(CLAIMED.format("{docs}"), docs=docs), spark.sql(OUTCOME.format("{docs}"), docs=docs))


@query(f"WITH {FORM} SELECT 'd' || doc_id AS key, CASE WHEN doc_id = 10 THEN 'no' ELSE fedele END AS fedele, causa, citazione_corretta, italiano_1_5, '' AS note, CASE WHEN doc_id = 10 THEN '' ELSE ereditato_da END AS ereditato_da FROM f")
def form_update(spark, d):
    f = _form(spark, d).withColumns({"id": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "domanda": F.lit("q"), "note": F.lit("")})
    key = "d10"
    there = f.where("id = 'd10'").limit(1).count()
    return judging.form_state(judging.saved(f, key, {"fedele": "no"}) if there else f)


@query(
    f"""WITH {BASE} SELECT id, CASE WHEN route = 'meta' THEN CASE WHEN from_cache_meta THEN 'META (cache)' ELSE 'META' END WHEN route = 'structured' THEN 'CALCOLATA ' || coalesce(CAST(computed_value AS VARCHAR), '-')
    WHEN route = 'uncovered' THEN 'RIFIUTO DICHIARATO' WHEN from_cache_semantic THEN 'HIT-semantica' WHEN refused THEN 'RIFIUTO' WHEN uncertain THEN 'ASTENSIONE' ELSE 'risposta cit=' || n_citations || CASE WHEN truncated THEN ' TRONCATA' ELSE '' END END AS verdict FROM w"""
)
def verdicts(spark, d):
    return _answers(spark, d).select("id", judging.verdict().alias("verdict"))


# a turn is near some turns before it in its conversation; every fourth answer is refused
SERVED = "SELECT conv_id * 1000 + turn AS query_id, conv_id * 1000 + turn AS seq, (conv_id + turn) % 4 = 3 AS refused FROM {0}"
SIMILAR = """SELECT a.conv_id * 1000 + a.turn AS query_id, a.conv_id * 1000 + b.turn AS other_id, CAST(88 + (a.turn * 3 + b.turn * 5 + a.conv_id) % 12 AS DOUBLE) / 100 AS similarity
FROM {0} a JOIN {0} b ON a.conv_id = b.conv_id AND b.turn < a.turn"""


@query(
    f"""WITH RECURSIVE q AS ({SERVED.format('conversations')}), near AS (SELECT * FROM ({SIMILAR.format('conversations')}) WHERE similarity >= 0.92),
    one AS (SELECT q.query_id, q.refused, list({{'o': other_id, 's': similarity}}) FILTER (other_id IS NOT NULL) AS others FROM q LEFT JOIN near ON near.query_id = q.query_id GROUP BY ALL),
    w AS (SELECT DISTINCT conv_id * 1000 - 1 AS query_id, CAST(NULL AS BIGINT) AS served_by, CAST([] AS BIGINT[]) AS stored FROM conversations
      UNION ALL SELECT query_id, hit, CASE WHEN hit IS NULL AND NOT refused THEN list_append(stored, query_id) ELSE stored END FROM (
        SELECT one.query_id, one.refused, w.stored, list_sort(list_transform(list_filter(coalesce(others, []), lambda x: list_contains(w.stored, x.o)), lambda x: {{'s': -x.s, 'o': x.o}}))[1].o AS hit FROM w JOIN one ON one.query_id = w.query_id + 1))
    SELECT query_id, served_by IS NOT NULL AS from_cache_semantic, served_by FROM w WHERE query_id >= 0 AND query_id % 1000 <> 999"""
)
def cache_conditions(spark, d):
    x = table(spark, d, "conversations")
    near = spark.sql(SIMILAR.format("{x}"), x=x)
    return run_eval.served(spark.sql(SERVED.format("{x}"), x=x), near, 0.92).select("query_id", "from_cache_semantic", "served_by")
