"""Guards, claims, provenance, routing and structured answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caching, corpus, guards, router, structured
from .common import each, each_sql, duck, query, rows, table, words_sql
from .text_queries import PRINT, ROOTS, SENT, STOP

CT = f"list_filter(list_distinct({words_sql('text')}), lambda w: NOT list_contains({STOP}, w))"
# five documents in a row are the passages of a question, whose text is that of a benchmark item
PASSAGES = "p AS (SELECT doc_id // 5 AS query_id, CAST(doc_id % 5 + 1 AS INTEGER) AS n, text FROM documents), qs AS (SELECT query_id, text FROM (SELECT DISTINCT query_id FROM p) JOIN benchmark ON item_id = query_id % 40)"
MISSING = f"""{PASSAGES}, q AS (SELECT query_id, unnest({CT}) AS term FROM qs),
h AS (SELECT DISTINCT query_id, unnest({ROOTS}) AS root FROM p),
m AS (SELECT query_id, term, term[1:6] AS root FROM q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = q.query_id AND h.root = q.term[1:6]))"""


def _held(spark, d):
    p = table(spark, d, "documents").select(F.expr("doc_id div 5").alias("query_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("n"), F.col("text").alias("content"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), "text")
    return p.select("query_id").distinct().join(items, F.col("query_id") % 40 == F.col("i")).select("query_id", "text"), p


@query(f"WITH {MISSING} SELECT query_id, term, root FROM m")
def missing_terms(spark, d):
    return guards.missing_terms(*_held(spark, d))


ABSTAIN = f"""{MISSING}, df AS (SELECT root, count(*) AS df FROM (SELECT unnest({ROOTS}) AS root FROM documents) GROUP BY root), n AS (SELECT count(*) AS n FROM documents),
a AS (SELECT b.query_id, coalesce(max(CASE WHEN m.root IS NOT NULL THEN ln(n / (1 + coalesce(df, 0))) END), 0.0) AS signal, count(m.term) AS n_missing
  FROM n, qs b LEFT JOIN m ON m.query_id = b.query_id LEFT JOIN df ON df.root = m.root GROUP BY b.query_id)"""


def _abstain(spark, d):
    q, p = _held(spark, d)
    docs = table(spark, d, "documents")
    return guards.abstention(q, guards.missing_terms(q, p), corpus.term_df(docs), docs.count())


@query(f"WITH {ABSTAIN} SELECT query_id, round(signal, 6) AS signal, n_missing FROM a")
def abstention_signal(spark, d):
    return _abstain(spark, d).withColumn("signal", F.round("signal", 6))


@query(f"WITH {ABSTAIN} SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'refused' WHEN signal >= 5.5 THEN 'uncertain:termini_mancanti' WHEN query_id % 4 = 1 THEN 'uncertain:verbatim' ELSE 'answered' END AS outcome FROM a")
def guard_decision(spark, d):
    a = _abstain(spark, d)
    k = F.col("query_id") % 4
    support, ratio = F.when(k == 0, 0.1).otherwise(0.9), F.when(k == 1, 0.2).when(k == 2, 0.9)
    return a.select("query_id", guards.decision(support, F.lit(3), F.col("signal"), ratio, 0.55, 5.5, 0.5).alias("outcome"))


ANSWERS = "(1, 'a [1] b [3][9] [...]', '2,7', 5), (2, 'none', '', 3), (3, '[2][2][1]', '1', 2), (4, '', '0', 2) AS t(id, answer, claimed, k)"
_CITED = "list_distinct(list_concat(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), list_transform(list_filter(string_split(claimed, ','), lambda x: x <> ''), lambda x: CAST(x AS INTEGER))))"


@query(
    f"SELECT id, array_to_string(list_sort(list_filter({_CITED}, lambda x: x BETWEEN 1 AND k)), ',') AS valid, array_to_string(list_sort(list_filter({_CITED}, lambda x: NOT x BETWEEN 1 AND k)), ',') AS invalid FROM {each_sql(ANSWERS, 'answer')}"
)
def citations_valid(spark, d):
    claimed = F.transform(F.filter(F.split("claimed", ","), lambda x: x != ""), lambda x: x.cast("int"))
    ok, bad = guards.citations(F.col("answer"), claimed, F.col("k"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return each(spark, d, ANSWERS, "answer").select("id", join(ok).alias("valid"), join(bad).alias("invalid"))


@query(
    f"SELECT id, array_to_string(list_filter(list_filter(m, lambda x, i: list_position(m, x) = i), lambda x: x BETWEEN 1 AND k), ',') AS used FROM (SELECT id, k, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: try_cast(x AS INTEGER)) AS m FROM {each_sql(ANSWERS, 'answer')})"
)
def marker_distinct(spark, d):
    return each(spark, d, ANSWERS, "answer").select("id", F.array_join(F.transform(caching.used_markers(F.col("answer"), F.col("k")), lambda x: x.cast("string")), ",").alias("used"))


# a claim quotes words 3 to 14 of a passage of its question, of another passage, or words that stand nowhere
WSQL = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
VERB = r"trim(regexp_replace(replace(lower({0}), '’', ''''), '\s+', ' ', 'g'))"
CLAIMS = f"""{PASSAGES}, k AS (SELECT query_id, n AS claim_no, CASE WHEN n = 3 AND query_id % 3 = 0 THEN 'words that stand in no passage of this question at all' WHEN query_id % 7 = 0 THEN 'short' ELSE
   array_to_string(list_slice({WSQL}, 3, 14), ' ') END AS verbatim, CASE WHEN n = 2 THEN [1] ELSE [n] END AS cited FROM p),
 c AS (SELECT *, {VERB.format('verbatim')} AS key, length(verbatim) < 40 AS short FROM k), b AS (SELECT query_id, n, {VERB.format('text')} AS body FROM p),
 f AS (SELECT c.query_id, c.claim_no, any_value(short) AS short, min(CASE WHEN b.n = cited[1] AND contains(body, key) THEN b.n END) AS own, min(CASE WHEN contains(body, key) THEN b.n END) AS anywhere FROM c LEFT JOIN b ON b.query_id = c.query_id GROUP BY c.query_id, c.claim_no),
 o AS (SELECT query_id, claim_no, CASE WHEN short THEN 'troppo_corto' WHEN own IS NOT NULL THEN 'valido' WHEN anywhere IS NOT NULL THEN 'misattribuito' ELSE 'non_trovato' END AS outcome,
   CASE WHEN NOT short THEN coalesce(own, anywhere) END AS matched_passage FROM f)"""


def _claims(spark, d):
    _, p = _held(spark, d)
    w = F.filter(F.split(T.squeeze(F.col("content")), " "), lambda x: x != "")
    none = F.lit("words that stand in no passage of this question at all")
    span = F.when((F.col("n") == 3) & (F.col("query_id") % 3 == 0), none).when(F.col("query_id") % 7 == 0, "short").otherwise(F.array_join(F.slice(w, 3, 12), " "))
    return p.select("query_id", F.col("n").alias("claim_no"), span.alias("verbatim"), F.when(F.col("n") == 2, F.array(F.lit(1))).otherwise(F.array("n")).alias("passages")), p


@query(f"WITH {CLAIMS} SELECT query_id, claim_no, outcome, matched_passage FROM o")
def verbatim_outcomes(spark, d):
    return guards.check_claims(*_claims(spark, d)).drop("at_bounds")


@query(
    f"""WITH {CLAIMS} SELECT query_id, count(*) AS n_claims, count(*) FILTER (outcome = 'valido') AS n_valid, count(*) FILTER (outcome = 'misattribuito') AS n_misattributed,
    count(*) FILTER (outcome = 'non_trovato') AS n_not_found, count(*) FILTER (outcome = 'troppo_corto') AS n_too_short, CAST(count(*) FILTER (outcome = 'valido') AS DOUBLE) / count(*) AS valid_ratio FROM o GROUP BY query_id"""
)
def verbatim_ratio(spark, d):
    return guards.verbatim_outcomes(guards.check_claims(*_claims(spark, d))).drop("span_boundary_ratio")


PH = "trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '([\\p{{L}}\\p{{N}}_])-\\s+([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')), '\\p{{Nd}}+', '#', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_#]+', ' ', 'g'))"
BEST = (
    "WITH " + CLAIMS + ", " + SENT.strip()[5:].replace("\np AS (", "\npp AS (").replace("FROM p)", "FROM pp)")
    + f""", ss AS (SELECT doc_id // 5 AS query_id, CAST(doc_id % 5 + 1 AS INTEGER) AS n, pos, sentence, list_distinct(string_split({PH.format('sentence')}, ' ')) AS own FROM s),
    cc AS (SELECT query_id, claim_no, cited[1] AS n, list_distinct(string_split({PH.format('verbatim')}, ' ')) AS ws FROM k),
    jj AS (SELECT cc.query_id, claim_no, cc.n, sentence, CAST(len(list_intersect(ws, own)) AS DOUBLE) / len(ws) AS overlap, pos FROM cc JOIN ss ON ss.query_id = cc.query_id AND ss.n = cc.n WHERE len(ws) >= 5),
    bs AS (SELECT query_id, claim_no, n, sentence, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_no, n ORDER BY overlap DESC, pos) AS r FROM jj) WHERE r = 1 AND overlap >= 0.6)"""
)


@query(BEST + " SELECT query_id, claim_no, n, md5(sentence) AS sentence, round(overlap, 9) AS overlap FROM bs")
def provenance_best_sentence(spark, d):
    b = guards.best_sentences(*_claims(spark, d))
    return b.select("query_id", "claim_no", "n", F.md5(F.col("sentence").cast("binary")).alias("sentence"), F.round("overlap", 9).alias("overlap"))


@query(
    BEST + f""", fp AS (SELECT {PRINT} AS fp, count(DISTINCT doc_id) AS nd FROM s GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)
    SELECT query_id, fp.fp AS key, max(nd) AS n_documents, array_to_string(list_sort(list_distinct(list(n))), ',') AS passages FROM (SELECT *, {PRINT} AS k FROM bs) b JOIN fp ON fp.fp = b.k GROUP BY query_id, fp.fp"""
)
def provenance_sources(spark, d):
    docs = table(spark, d, "documents")
    out = guards.provenance(guards.best_sentences(*_claims(spark, d)), corpus.phrase_index(docs, 2), corpus.norm_index(docs, 2), 2)
    return out.select("query_id", "key", "n_documents", F.array_join(F.transform("passages", lambda x: x.cast("string")), ",").alias("passages"))


ASKED = """(1, 'Quante delibere nel 2019?'), (2, 'Elenca le delibere del CIPESS dal 2019 al 2021'), (3, 'Cosa dice la delibera n. 75/2021?'), (4, 'quante delibere nel 2019 e nel 2021'),
(5, 'di cosa parla il corpus?'), (6, 'quanti chilometri di ferrovia'), (7, 'importo in totale speso'), (8, 'delibere per anno del cipe, quante sono'), (9, 'quali sono gli obiettivi del piano'),
(10, 'quante delibere dal 2019 al 2021 e nel 2024'), (11, 'quanti atti del 2024'), (12, 'numero di provvedimenti dal 2019 al 2019 nel 2019'), (13, ''), (14, CAST(NULL AS STRING)), (15, 'quanto speso per la scuola') AS t(query_id, text)"""
_RX = {
    "forma_conteggio": r"\b(quant[ei]|numero\s+di|elenc\w+|quante\s+volte|lista\s+d)\b",
    "forma_massa": r"\b(in\s+totale|complessiv\w+|ammontare\s+totale|somma\s+totale|totale\s+d\w+|quanto\s+(?:è\s+stato\s+)?spes\w+)\b",
    "oggetto_coperto": r"\b(deliber\w+|atti|provvediment\w+)\b", "delibera_specifica": r"deliber\w*\s+(?:n\.?\s*)?\d+",
    "forma_meta": r"\b(di\s+cosa\s+(?:parla|tratta)|che\s+periodo|quale\s+periodo|cosa\s+puoi\s+(?:fare|dirmi)|come\s+sono\s+fatt\w+)\b",
    "oggetto_corpus": r"\b(corpus|archivio|raccolta|banca\s+dati|dataset|quest[oi]\s+document\w+)\b",
}
_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all(x, '\b(?:19[6-9]\d|20[0-9]\d)\b'), lambda y: CAST(y AS INTEGER))))"
_RNG = r"(?i)\b(?:dal|da)\s+(\d{4})\s+(?:al|a)\s+(\d{4})\b"
SIGNALS = (
    f"WITH q AS (SELECT query_id, text, coalesce(text, '') AS x FROM {duck(ASKED)}), y AS (SELECT *, {_YEARS} AS ys, regexp_matches(x, '{_RNG}') AS has FROM q), g AS (SELECT *, "
    + ", ".join(f"regexp_matches(x, '(?i){p}') AS {k}" for k, p in _RX.items())
    + rf""", CASE WHEN has THEN len(list_filter(ys, lambda v: v <> CAST(regexp_extract(x, '{_RNG}', 1) AS INTEGER) AND v <> CAST(regexp_extract(x, '{_RNG}', 2) AS INTEGER))) > 0 ELSE len(ys) > 1 END AS anni_multipli,
    regexp_matches(x, '(?i)\b(elenc\w+|quali\s+sono|lista\s+d)\b') AS lst, regexp_matches(x, '(?i)\b(per\s+anno|anno\s+per\s+anno|distribu\w+)\b') AS byy FROM y),
    r AS (SELECT *, CASE WHEN delibera_specifica THEN 'pointwise' WHEN forma_meta AND oggetto_corpus THEN 'meta' WHEN oggetto_coperto AND (forma_conteggio OR lst) AND anni_multipli THEN 'uncovered'
    WHEN oggetto_coperto AND (forma_conteggio OR lst) THEN 'structured' WHEN forma_conteggio OR forma_massa THEN 'uncovered' ELSE 'pointwise' END AS route FROM g)"""
)


# the questions, each before a document's text
EACH_SIGNALS = SIGNALS.replace(duck(ASKED), each_sql(ASKED, "text", id="query_id"))


@query(EACH_SIGNALS + " SELECT query_id, forma_conteggio, forma_massa, oggetto_coperto, delibera_specifica, anni_multipli, forma_meta, oggetto_corpus FROM r")
def router_signals(spark, d):
    return router.routed(each(spark, d, ASKED, "text", id="query_id")).select("query_id", *router.signals(F.col("text")))


@query(
    EACH_SIGNALS
    + rf""" SELECT query_id, route, CASE WHEN route = 'structured' THEN CASE WHEN byy THEN 'count_by_year' WHEN lst THEN 'list_delibere' ELSE 'count_delibere' END END AS intent,
    CASE WHEN route = 'uncovered' THEN CASE WHEN oggetto_coperto AND (forma_conteggio OR lst) AND anni_multipli THEN '{router.MANY_YEARS}' ELSE '{router.NO_AMOUNTS}' END END AS reason,
    CASE WHEN route = 'structured' AND NOT has AND len(ys) = 1 THEN ys[1] END AS anno, CASE WHEN route = 'structured' AND has THEN CAST(regexp_extract(x, '{_RNG}', 1) AS INTEGER) END AS anno_da,
    CASE WHEN route = 'structured' AND has THEN CAST(regexp_extract(x, '{_RNG}', 2) AS INTEGER) END AS anno_a,
    CASE WHEN route = 'structured' THEN CASE WHEN regexp_matches(x, '(?i)\bcipess\b') THEN 'CIPESS' WHEN regexp_matches(x, '(?i)\bcipe\b') THEN 'CIPE' END END AS comitato FROM r"""
)
def router_route(spark, d):
    return router.routed(each(spark, d, ASKED, "text", id="query_id")).select("query_id", "route", "intent", "reason", "anno", "anno_da", "anno_a", "comitato")


@query(EACH_SIGNALS + " SELECT route, count(*) AS n FROM r GROUP BY route")
def route_union(spark, d):
    r = router.routed(each(spark, d, ASKED, "text", id="query_id")).select("query_id", "route")
    # every question has one of ROUTES: a branch for each would read and match all texts once a route
    return r.groupBy("route").agg(F.count("*").alias("n"))


@query(EACH_SIGNALS + rf""" SELECT query_id, array_to_string(CASE WHEN has THEN list_filter(ys, lambda v: v <> CAST(regexp_extract(x, '{_RNG}', 1) AS INTEGER) AND v <> CAST(regexp_extract(x, '{_RNG}', 2) AS INTEGER)) ELSE ys END, ',') AS loose FROM r""")
def year_difference(spark, d):
    t = F.coalesce("text", F.lit(""))
    ends = F.array(F.regexp_extract(t, router.RANGE, 1).try_cast("int"), F.regexp_extract(t, router.RANGE, 2).try_cast("int"))
    left = F.when(t.rlike(router.RANGE), F.array_except(T.years(t), ends)).otherwise(T.years(t))
    return each(spark, d, ASKED, "text", id="query_id").select("query_id", F.array_join(F.transform(left, lambda x: x.cast("string")), ",").alias("loose"))


PROPOSED = """(1, '{"route":"structured","intent":"count_delibere","params":{"anno":2019}}', 'pointwise'), (2, '{"route":"meta"}', 'pointwise'), (3, '{broken', 'uncovered'), (4, '["structured"]', 'pointwise'),
(5, '{"route":"elsewhere"}', 'meta'), (6, '{"route":"structured","intent":"sum"}', 'pointwise'), (7, '{"route":"structured","intent":"count_delibere","params":{"anno":2019,"anno_da":2018,"anno_a":2020}}', 'pointwise'),
(8, '{"route":"structured","intent":"count_delibere","params":{"anno":"abc"}}', 'pointwise'), (9, '{"route":"structured","intent":"count_delibere","params":{"comitato":"OTHER"}}', 'pointwise'),
(10, '{"route":"structured","intent":"list_delibere","params":{"anno_da":2019,"anno_a":2021,"comitato":" cipess ","extra":1}}', 'pointwise'), (11, '{"route":"structured","intent":"list_delibere","params":{"anno_da":2019}}', 'pointwise'),
(12, '{"route":"structured","intent":"list_delibere","params":{"anno_da":2021,"anno_a":2019}}', 'pointwise'), (13, '{"route":"structured","intent":"count_by_year","params":{"anno":1800}}', 'pointwise'), (14, CAST(NULL AS STRING), 'meta') AS t(query_id, raw, lexical_route)"""


@query(
    f"""WITH p AS (SELECT *, CASE WHEN json_valid(raw) AND starts_with(ltrim(raw), '{{') THEN raw END AS j FROM {each_sql(PROPOSED, id="query_id")}),
    v AS (SELECT *, json_extract_string(j, '$.route') AS r, json_extract_string(j, '$.intent') AS i, json_extract_string(j, '$.params.anno') AS a, json_extract_string(j, '$.params.anno_da') AS f, json_extract_string(j, '$.params.anno_a') AS t,
      upper(trim(json_extract_string(j, '$.params.comitato'))) AS b FROM p),
    n AS (SELECT *, try_cast(a AS INTEGER) AS ai, try_cast(f AS INTEGER) AS fi, try_cast(t AS INTEGER) AS ti FROM v),
    k AS (SELECT *, coalesce(r IN ('structured','uncovered','pointwise','meta') AND (r <> 'structured' OR (coalesce(i IN ('count_delibere','list_delibere','count_by_year'), false)
      AND (a IS NULL OR coalesce(ai BETWEEN 1900 AND 2100, false)) AND (f IS NULL OR coalesce(fi BETWEEN 1900 AND 2100, false)) AND (t IS NULL OR coalesce(ti BETWEEN 1900 AND 2100, false))
      AND NOT (a IS NOT NULL AND (f IS NOT NULL OR t IS NOT NULL)) AND ((f IS NULL) = (t IS NULL)) AND (f IS NULL OR coalesce(fi <= ti, false)) AND (b IS NULL OR b IN ('CIPE','CIPESS')))), false) AS ok FROM n)
    SELECT query_id, CASE WHEN ok THEN r ELSE lexical_route END AS route, CASE WHEN ok THEN 'llm' ELSE 'lexical' END AS source, CASE WHEN ok AND r = 'structured' THEN ai END AS anno,
    CASE WHEN ok AND r = 'structured' THEN fi END AS anno_da, CASE WHEN ok AND r = 'structured' THEN ti END AS anno_a, CASE WHEN ok AND r = 'structured' THEN b END AS comitato FROM k"""
)
def param_sanitise(spark, d):
    return router.proposed(each(spark, d, PROPOSED, id="query_id")).drop("intent", "error")


def _acts(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.year("o_orderdate").alias("anno"), F.col("o_orderkey").alias("numero"), F.when(F.col("o_orderstatus") == "F", "CIPE").otherwise("CIPESS").alias("comitato"),
        F.concat(F.lit("act "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderpriority") != "5-LOW").alias("is_delibera"),
    )


ACTS = "d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS anno, o_orderkey AS numero, CASE WHEN o_orderstatus = 'F' THEN 'CIPE' ELSE 'CIPESS' END AS comitato, 'act ' || o_orderkey AS title, 'o/' || o_orderkey AS path, o_orderpriority <> '5-LOW' AS is_delibera FROM orders)"


@query(f"WITH {ACTS} SELECT count(*) AS n, min(numero) AS min_numero, max(numero) AS max_numero FROM d WHERE is_delibera AND anno = 1996 AND comitato = 'CIPE'")
def count_docs(spark, d):
    return structured.run(spark, _acts(spark, d), "count_delibere", {"anno": 1996, "comitato": "CIPE"})


@query(f"WITH {ACTS} SELECT anno, count(*) AS n FROM d WHERE is_delibera GROUP BY anno")
def count_by_year(spark, d):
    return structured.run(spark, _acts(spark, d), "count_by_year", {})


@query(f"WITH {ACTS} SELECT anno, numero, comitato, title, path FROM d WHERE is_delibera AND anno >= 1994 AND anno <= 1995 ORDER BY anno, numero LIMIT 1000")
def list_docs(spark, d):
    return structured.run(spark, _acts(spark, d), "list_delibere", {"anno_da": 1994, "anno_a": 1995})


@query(f"WITH {ACTS}, l AS (SELECT *, row_number() OVER (ORDER BY anno, numero) AS r, count(*) OVER () AS total FROM d WHERE is_delibera AND anno = 1995) SELECT title, path, total, total - 20 AS hidden FROM l WHERE r <= 20")
def list_truncated(spark, d):
    x = structured.run(spark, _acts(spark, d), "list_delibere", {"anno": 1995, "limit": 20})
    n = structured.run(spark, _acts(spark, d), "count_delibere", {"anno": 1995}).select(F.col("n").alias("total"))
    return x.join(F.broadcast(n)).select("title", "path", "total", (F.col("total") - 20).alias("hidden"))


@query(f"WITH {ACTS} SELECT comitato, count(*) AS n, min(anno) AS anno_min, max(anno) AS anno_max FROM d WHERE is_delibera GROUP BY comitato")
def corpus_stats(spark, d):
    return spark.sql(structured.STATS, docs=_acts(spark, d))


@query(
    SIGNALS.replace("WITH q AS", f"WITH {ACTS}, q AS")
    + rf""", z AS (SELECT query_id, CASE WHEN NOT has AND len(ys) = 1 THEN ys[1] - 25 END AS y, CASE WHEN has THEN CAST(regexp_extract(x, '{_RNG}', 1) AS INTEGER) - 25 END AS f, CASE WHEN has THEN CAST(regexp_extract(x, '{_RNG}', 2) AS INTEGER) - 25 END AS t,
      CASE WHEN regexp_matches(x, '(?i)\bcipess\b') THEN 'CIPESS' WHEN regexp_matches(x, '(?i)\bcipe\b') THEN 'CIPE' END AS b FROM r WHERE route = 'structured' AND NOT byy AND NOT lst)
    SELECT query_id, count(numero) AS n, min(numero) AS min_numero, max(numero) AS max_numero, CASE WHEN any_value(y) IS NOT NULL AND min(numero) IS NOT NULL THEN greatest(0, max(numero) - min(numero) + 1 - count(numero)) END AS gap
    FROM z LEFT JOIN d ON is_delibera AND (y IS NULL OR anno = y) AND (f IS NULL OR anno >= f) AND (t IS NULL OR anno <= t) AND (b IS NULL OR comitato = b) GROUP BY query_id"""
)
def completeness_gap(spark, d):
    r = router.routed(rows(spark, ASKED)).withColumns({k: F.col(k) - 25 for k in ("anno", "anno_da", "anno_a")})
    return structured.batch_counts(r, _acts(spark, d))


def _shifted(spark):
    """The routed questions of ASKED, their years moved to those of the acts."""
    return router.routed(rows(spark, ASKED)).withColumns({k: F.col(k) - 25 for k in ("anno", "anno_da", "anno_a")})


SHIFTED = (
    SIGNALS.replace("WITH q AS", f"WITH {ACTS}, q AS")
    + rf""", z AS (SELECT query_id, byy, lst, CASE WHEN NOT has AND len(ys) = 1 THEN ys[1] - 25 END AS y, CASE WHEN has THEN CAST(regexp_extract(x, '{_RNG}', 1) AS INTEGER) - 25 END AS f, CASE WHEN has THEN CAST(regexp_extract(x, '{_RNG}', 2) AS INTEGER) - 25 END AS t,
      CASE WHEN regexp_matches(x, '(?i)\bcipess\b') THEN 'CIPESS' WHEN regexp_matches(x, '(?i)\bcipe\b') THEN 'CIPE' END AS b FROM r WHERE route = 'structured'),
    sc AS (SELECT *, concat_ws(' ', 'del ' || b, 'nel ' || y, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 'dal ' || f || ' al ' || t END) AS sc FROM z),
    m AS (SELECT z.query_id, d.* FROM z JOIN d ON is_delibera AND (y IS NULL OR anno = y) AND (f IS NULL OR anno >= f) AND (t IS NULL OR anno <= t) AND (b IS NULL OR comitato = b)),
    k AS (SELECT query_id, count(*) AS n, min(numero) AS lo, max(numero) AS hi FROM m GROUP BY query_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY anno, numero, path) AS pos FROM m)"""
)
_HEAD = "rtrim('Nel corpus indicizzato ' || CASE WHEN {n} = 1 THEN 'risulta **1 delibera** ' ELSE 'risultano **' || {n} || ' delibere** ' END || sc)"
_NONE = f"rtrim('Nel corpus indicizzato non risulta nessuna delibera ' || sc) || '. {structured.NOTE}'"
_GAP = "CASE WHEN y IS NOT NULL AND lo IS NOT NULL THEN greatest(0, hi - lo + 1 - n) END"


@query(
    SHIFTED
    + f""", gg AS (SELECT *, {_GAP} AS gap FROM sc LEFT JOIN k USING (query_id) WHERE NOT byy AND NOT lst)
    SELECT query_id, CASE WHEN coalesce(n, 0) = 0 THEN {_NONE} ELSE {_HEAD.format(n='n')} || '.' || CASE WHEN coalesce(gap, 0) > 0 THEN ' La numerazione dell''anno arriva alla n. ' || hi || ': ' ||
      CASE WHEN gap = 1 THEN '1 delibera manca' ELSE gap || ' delibere mancano' END || ' dal corpus.' ELSE '' END || ' {structured.NOTE}' END AS text, coalesce(n, 0) AS computed_value, gap FROM gg"""
)
def answer_counts(spark, d):
    """The text of every counting question: number, scope, gap of the numbering, note."""
    r = _shifted(spark).where("intent = 'count_delibere'")
    return structured.answers(r, _acts(spark, d)).select("query_id", "text", "computed_value", "gap")


@query(
    SHIFTED
    + f""", l AS (SELECT query_id, least(count(*), 1000) AS n, string_agg('- ' || title || ' (`' || path || '`)', chr(10) ORDER BY pos) FILTER (pos <= 20) AS shown, md5(string_agg(path, ',' ORDER BY pos) FILTER (pos <= 1000)) AS cited FROM ranked GROUP BY query_id)
    SELECT query_id, CASE WHEN n IS NULL THEN {_NONE} ELSE {_HEAD.format(n='n')} || ':' || chr(10) || chr(10) || shown ||
      CASE WHEN n > 20 THEN chr(10) || chr(10) || '(…altre ' || (n - 20) || ' non mostrate qui; l''elenco completo è registrato insieme alla risposta.)' ELSE '' END || chr(10) || chr(10) || '{structured.NOTE}' END AS text,
      coalesce(n, 0) AS computed_value, coalesce(cited, md5('')) AS cited FROM sc LEFT JOIN l USING (query_id) WHERE lst AND NOT byy"""
)
def answer_lists(spark, d):
    """The text of every listing question: the first twenty acts, how many more, and all that are listed as cited."""
    r = _shifted(spark).where("intent = 'list_delibere'")
    out = structured.answers(r, _acts(spark, d))
    return out.select("query_id", "text", "computed_value", F.md5(F.array_join("cited", ",").cast("binary")).alias("cited"))


@query(
    SHIFTED
    + f""", u AS (SELECT query_id, anno, count(*) AS n FROM m GROUP BY query_id, anno), l AS (SELECT query_id, string_agg('- ' || anno || ': ' || n, chr(10) ORDER BY anno) AS lines FROM u GROUP BY query_id)
    SELECT query_id, rtrim('Nel corpus indicizzato le delibere ' || sc) || ' si distribuiscono per anno:' || chr(10) || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || '{structured.NOTE}' AS text FROM sc LEFT JOIN l USING (query_id) WHERE byy"""
)
def answer_years(spark, d):
    """The text of every by-year question."""
    return structured.answers(_shifted(spark).where("intent = 'count_by_year'"), _acts(spark, d)).select("query_id", "text")


_REFUSED = f"CASE WHEN oggetto_coperto AND (forma_conteggio OR lst) AND anni_multipli THEN '{structured.REFUSALS[router.MANY_YEARS]}' ELSE '{structured.REFUSALS[router.NO_AMOUNTS]}' END"


@query(
    SHIFTED
    + f""", gg AS (SELECT *, {_GAP} AS gap FROM sc LEFT JOIN k USING (query_id) WHERE NOT byy AND NOT lst),
    ll AS (SELECT query_id, least(count(*), 1000) AS n, string_agg('- ' || title || ' (`' || path || '`)', chr(10) ORDER BY pos) FILTER (pos <= 20) AS shown FROM ranked GROUP BY query_id),
    u AS (SELECT query_id, anno, count(*) AS n FROM m GROUP BY query_id, anno), yy AS (SELECT query_id, string_agg('- ' || anno || ': ' || n, chr(10) ORDER BY anno) AS lines FROM u GROUP BY query_id)
    SELECT query_id, 'structured' AS route, false AS refused, CASE WHEN coalesce(n, 0) = 0 THEN {_NONE} ELSE {_HEAD.format(n='n')} || '.' || CASE WHEN coalesce(gap, 0) > 0 THEN ' La numerazione dell''anno arriva alla n. ' || hi || ': ' ||
      CASE WHEN gap = 1 THEN '1 delibera manca' ELSE gap || ' delibere mancano' END || ' dal corpus.' ELSE '' END || ' {structured.NOTE}' END AS answer FROM gg
    UNION ALL SELECT query_id, 'structured', false, CASE WHEN n IS NULL THEN {_NONE} ELSE {_HEAD.format(n='n')} || ':' || chr(10) || chr(10) || shown ||
      CASE WHEN n > 20 THEN chr(10) || chr(10) || '(…altre ' || (n - 20) || ' non mostrate qui; l''elenco completo è registrato insieme alla risposta.)' ELSE '' END || chr(10) || chr(10) || '{structured.NOTE}' END FROM sc LEFT JOIN ll USING (query_id) WHERE lst AND NOT byy
    UNION ALL SELECT query_id, 'structured', false, rtrim('Nel corpus indicizzato le delibere ' || sc) || ' si distribuiscono per anno:' || chr(10) || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || '{structured.NOTE}' FROM sc LEFT JOIN yy USING (query_id) WHERE byy
    UNION ALL SELECT query_id, 'uncovered', true, {_REFUSED} FROM r WHERE route = 'uncovered'"""
)
def ask_computed(spark, d):
    """Questions end to end, as far as no model answers: counts, lists, distributions, declared refusals."""
    from ..config import Settings
    from . import ask

    routes = _shifted(spark).where(F.col("route").isin("structured", "uncovered"))
    chunks = spark.createDataFrame([], "id long, content string, source string, vector array<double>")
    vectors = spark.createDataFrame([], "query_id long, vector array<double>")
    out = ask.answered(spark, Settings(), ask.Corpus(chunks, _acts(spark, d)), rows(spark, ASKED), vectors, routes=routes)
    return out.select("query_id", "route", "refused", "answer")


CARD = "(1, '01-intro', 'Che cosa è'), (2, '02-blank', '  '), (3, '03-periodo', 'Dal 1967') AS t(section_no, name, text)"


@query(
    f"""WITH {ACTS}, c AS (SELECT section_no AS n, 'scheda::' || name AS chunk_id, text AS content FROM {duck(CARD)} WHERE trim(text) <> ''),
    s AS (SELECT comitato, count(*) AS k, min(anno) AS lo, max(anno) AS hi FROM d WHERE is_delibera GROUP BY comitato)
    SELECT n, chunk_id, content, false AS in_index FROM c UNION ALL SELECT (SELECT max(n) + 1 FROM c), 'scheda::perimetro', 'Perimetro indicizzato: ' || CAST(sum(k) AS BIGINT) || ' delibere interrogabili, così distribuite:' || chr(10) ||
    string_agg('- ' || comitato || ': ' || k || ' delibere, anni ' || lo || '–' || hi, chr(10) ORDER BY comitato) || chr(10) || '{structured.COMPUTED.replace(chr(39), chr(39) * 2)}', false FROM s"""
)
def meta_passages(spark, d):
    return structured.meta_passages(rows(spark, CARD), _acts(spark, d)).drop("source")


REASONS = f"(1, CAST(NULL AS STRING)), (2, '{router.MANY_YEARS}'), (3, 'unknown') AS t(id, reason)"


@query(f"SELECT id, CASE WHEN reason = '{router.MANY_YEARS}' THEN '{structured.REFUSALS[router.MANY_YEARS]}' ELSE '{structured.REFUSALS[router.NO_AMOUNTS]}' END AS text FROM {each_sql(REASONS)}")
def refusal_text(spark, d):
    from . import ask

    r = each(spark, d, REASONS).select(F.col("id").alias("query_id"), "reason", F.lit("uncovered").alias("route"), *[F.lit(None).cast(ask.COLUMNS[k]).alias(k) for k in ask.PASSED[1:]])
    return ask._uncovered(r).select(F.col("query_id").alias("id"), F.col("answer").alias("text"))


RAW = r"""(1, '{"answer": "tutto bene [1]", "claims": []}'), (2, '{"answer": "tagliato a metà", "claims": [{"statement": "x'), (3, '{"answer": "tagliato qui'), (4, 'nessun campo '), (5, '') AS t(id, raw)"""


@query(f"""SELECT id, CASE WHEN regexp_matches(raw, '"answer"\\s*:\\s*"') THEN trim(regexp_extract(raw, '"answer"\\s*:\\s*"([^"]*)', 1)) ELSE trim(raw) END AS answer FROM {each_sql(RAW, "raw")}""")
def json_salvage(spark, d):
    return each(spark, d, RAW, "raw").select("id", T.salvaged(F.col("raw")).alias("answer"))
