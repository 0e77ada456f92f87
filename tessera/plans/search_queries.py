"""Vector and keyword search, fusion, support and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ann, caching, retrieval
from ..session import shared_dir
from .common import each, each_sql, query, rows, table, words_sql
from .text_queries import ROOTS, STOP

# query k is the vector of row 20 * k and the text of item k
NV = "vec_id % 20 = 0"
DOT = "list_inner_product(a.v, b.v)"
V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
D2 = f"greatest(0.0, (2 - (list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * {DOT})) / 2)"


def vec_sql(k: int, cond: str = "", name: str = "x", rowcond: str = "") -> str:
    return f"""{name} AS (SELECT query_id, id, score, rank FROM (SELECT a.vec_id // 20 AS query_id, b.vec_id AS id, {D2} AS score,
      CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({D2}, 12) DESC, b.vec_id) AS INTEGER) AS rank FROM v a, v b WHERE a.{NV} {rowcond}) WHERE rank <= {k} {cond})"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    all_rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return all_rows.where("id % 20 = 0").select(F.expr("id div 20").alias("query_id"), "vector", "label"), all_rows


def _six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {V}, {vec_sql(10)} SELECT query_id, id, round(score, 6) AS score, rank FROM x")
def vector_topk(spark, d):
    q, r = _vectors(spark, d)
    return _six(retrieval.vector_topk(q, r, 10), "score")


def _stored_index(spark, d):
    """The index of all embeddings, written to the shared folder list by list and read back."""
    path = f"{shared_dir(spark)}/ann-{uuid.uuid4().hex}"
    ann.write(ann.build(_vectors(spark, d)[1].select("id", "vector")), path)
    return ann.read(spark, path)


@query()
def ann_topk(spark, d):
    """Ten of the lists nearest to each query are read."""
    return _six(ann.search(_stored_index(spark, d), _vectors(spark, d)[0], 10, probes=10), "score")


@query(f"WITH {V}, {vec_sql(10)} SELECT query_id, id, round(score, 6) AS score, rank FROM x")
def ann_all_lists(spark, d):
    """Every list is probed: the index must give what the search over all rows gives."""
    index = _stored_index(spark, d)
    return _six(ann.search(index, _vectors(spark, d)[0], 10, probes=len(index.centroids)), "score")


@query(f"WITH {V}, {vec_sql(5, rowcond='AND b.label = 3')} SELECT query_id, id, round(score, 6) AS score, rank FROM x")
def vector_topk_filtered(spark, d):
    q, r = _vectors(spark, d)
    return _six(retrieval.vector_topk(q, r.where("label = 3"), 5), "score")


@query(f"WITH {V}, {vec_sql(10, 'AND score >= 0.3')} SELECT query_id, id, round(score, 6) AS score, rank FROM x")
def vector_min_score(spark, d):
    q, r = _vectors(spark, d)
    return _six(retrieval.vector_topk(q, r, 10, least=0.3), "score")


@query(f"WITH {V}, {vec_sql(5, 'AND score >= 0.2')} SELECT query_id, count(*) AS total, max(round(score, 6)) AS best FROM x GROUP BY query_id")
def basic_retrieval(spark, d):
    q, r = _vectors(spark, d)
    return retrieval.vector_topk(q, r, 5, least=0.2).groupBy("query_id").agg(F.count("*").alias("total"), F.max(F.round("score", 6)).alias("best"))


WORDS = f"list_filter({words_sql('text')}, lambda w: NOT list_contains({STOP}, w))"


def bm25_sql(k: int, name: str = "y", words: str = WORDS) -> str:
    return f"""qt AS (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark),
    dw AS (SELECT doc_id AS id, {words} AS w FROM documents), ns AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
    po AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM dw) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    sc AS (SELECT query_id, id, sum((ln(n / (df + 1)) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS raw FROM qt JOIN po USING (term) JOIN df USING (term), ns GROUP BY query_id, id),
    {name} AS (SELECT query_id, id, raw, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS score, rank FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS INTEGER) AS rank FROM sc) WHERE rank <= {k})"""


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {bm25_sql(20)} SELECT query_id, id, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM y")
def keyword_bm25(spark, d):
    return _six(retrieval.keyword_topk(*_asked(spark, d), 20), "raw", "score")


@query(f"WITH {bm25_sql(20, words=f'list_filter({ROOTS}, lambda w: NOT list_contains({STOP}, w))')} SELECT query_id, id, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM y")
def keyword_stemmed(spark, d):
    """The keyword arm over first letters in place of words: morphology without a stemmer."""
    q, docs = _asked(spark, d)
    cut = lambda x: x.withColumn("text", F.array_join(T.roots(F.coalesce("text", F.lit(""))), " "))
    return _six(retrieval.keyword_topk(cut(q), cut(docs), 20), "raw", "score")


def norm_sql(source: str, method: str) -> str:
    own = "OVER (PARTITION BY query_id)"
    if method == "min_max":
        e = f"CASE WHEN max(score) {own} = min(score) {own} THEN 1.0::DOUBLE ELSE (score - min(score) {own}) / (max(score) {own} - min(score) {own}) END"
    else:
        e = f"CASE WHEN stddev_pop(score) {own} = 0 THEN 0.0::DOUBLE ELSE (score - avg(score) {own}) / stddev_pop(score) {own} END"
    return f"(SELECT *, {e} AS norm FROM {source})"


def fuse_sql(k: int, strategy: str, method: str = "min_max", each: int = 20) -> str:
    part = (lambda w: f"{w}::DOUBLE / (60 + rank)") if strategy == "rrf" else (lambda w: f"{w}::DOUBLE * norm")
    src = (lambda x: x) if strategy == "rrf" else (lambda x: norm_sql(x, method))
    return f"""WITH {V}, {vec_sql(each)}, {bm25_sql(each)},
    a AS (SELECT query_id, id, score AS vector_score, {part(0.7)} AS p FROM {src('x')}), b AS (SELECT query_id, id, score AS keyword_score, {part(0.3)} AS p FROM {src('y')}),
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(a.p, 0) + coalesce(b.p, 0) AS score, vector_score, keyword_score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.id = b.id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM f),
    h AS (SELECT query_id, id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score, rank FROM r WHERE rank <= {k})"""


def _fused(spark, d, k, **how):
    q, r = _vectors(spark, d)
    tq, docs = _asked(spark, d)
    each = 20
    f = retrieval.fused(retrieval.vector_topk(q, r, each), retrieval.keyword_topk(tq, docs, each), **how)
    return _six(f.where(F.col("rank") <= k), "score", "vector_score", "keyword_score")


@query(fuse_sql(40, "rrf") + " SELECT * FROM h")
def fusion_rrf(spark, d):
    return _fused(spark, d, 40)


@query(fuse_sql(40, "weighted") + " SELECT * FROM h")
def fusion_minmax(spark, d):
    return _fused(spark, d, 40, strategy="weighted")


@query(fuse_sql(40, "weighted", "z_score") + " SELECT * FROM h")
def fusion_zscore(spark, d):
    return _fused(spark, d, 40, strategy="weighted", method="z_score")


@query(fuse_sql(10, "rrf") + " SELECT * FROM h")
def hybrid_topk(spark, d):
    q, r = _vectors(spark, d)
    return _six(retrieval.hybrid(q, r, *_asked(spark, d), 10), "score", "vector_score", "keyword_score")


@query(fuse_sql(40, "rrf") + " SELECT query_id, count(*) AS n_ids, count(vector_score) AS from_vector, count(keyword_score) AS from_keyword FROM h GROUP BY query_id")
def id_union(spark, d):
    return _fused(spark, d, 40).groupBy("query_id").agg(F.count("*").alias("n_ids"), F.count("vector_score").alias("from_vector"), F.count("keyword_score").alias("from_keyword"))


@query(
    fuse_sql(10, "rrf")
    + """, s AS (SELECT item_id AS query_id, coalesce(max(vector_score), 0.0) AS support, count(h.id) AS n FROM benchmark LEFT JOIN h ON h.query_id = item_id GROUP BY item_id)
    SELECT query_id, support, (support < 0.55 OR n = 0) AS refused, CASE WHEN support < 0.55 OR n = 0 THEN 'support_score ' || printf('%.3f', support) || ' < soglia 0.550' END AS reason FROM s"""
)
def support_refusal(spark, d):
    q, r = _vectors(spark, d)
    hits = _six(retrieval.hybrid(q, r, *_asked(spark, d), 10), "vector_score")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return retrieval.support(hits, asked, 0.55)


@query(
    fuse_sql(10, "rrf")
    + " SELECT query_id, rank AS n, CAST(h.id AS VARCHAR) AS chunk_id, source, md5(text) AS content, true AS in_index FROM h JOIN documents ON doc_id = h.id WHERE rank <= 5"
)
def passage_numbering(spark, d):
    q, r = _vectors(spark, d)
    hits = retrieval.hybrid(q, r, *_asked(spark, d), 10)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("content"), "source")
    return caching.passages_of(hits, docs, 5)


@query(
    fuse_sql(10, "rrf")
    + ", p AS (SELECT query_id, rank, source FROM h JOIN documents ON doc_id = h.id), u AS (SELECT query_id, source, min(rank) AS f FROM p GROUP BY query_id, source), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS k FROM u) SELECT query_id, string_agg(source, '; ' ORDER BY f) AS sources FROM o WHERE k <= 5 GROUP BY query_id"
)
def sources_first5(spark, d):
    q, r = _vectors(spark, d)
    hits = retrieval.hybrid(q, r, *_asked(spark, d), 10)
    p = caching.passages_of(hits, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source"), 10)
    seen = F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"])
    return p.groupBy("query_id").agg(F.array_join(F.slice(F.array_distinct(seen), 1, 5), "; ").alias("sources"))


COS = f"{DOT} / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"


@query(
    f"""WITH {V}, x AS (SELECT a.vec_id // 20 AS query_id, b.vec_id AS id, {COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS r
    FROM v a, v b WHERE a.{NV} AND b.label = 1) SELECT query_id, id, round(s, 6) AS similarity FROM x WHERE r = 1 AND s >= 0.2"""
)
def cache_lookup(spark, d):
    q, r = _vectors(spark, d)
    entries = r.select("id", "vector", F.col("label").cast("string").alias("corpus_version"))
    return _six(caching.semantic_lookup(q, entries, "1", 0.2), "similarity")


@query(
    "SELECT item_id, substr(sha256('v1|c1|m1|' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 24) AS key, substr(sha256('v1' || chr(10) || text), 1, 24) AS semantic_id FROM benchmark"
)
def meta_cache_key(spark, d):
    x = table(spark, d, "benchmark")
    return x.select("item_id", caching.meta_key(F.lit("v1"), F.lit("c1"), F.lit("m1"), F.col("text")).alias("key"), caching.semantic_id(F.lit("v1"), F.col("text")).alias("semantic_id"))


# an entry of each turn: most of this corpus, card and model
ENTRIES = """SELECT concat('k', CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20))) AS key, CASE conv_id % 5 WHEN 0 THEN 'v0' WHEN 1 THEN NULL ELSE 'v1' END AS corpus_version,
CASE turn % 4 WHEN 3 THEN 'c2' ELSE 'c1' END AS card_hash, CASE role WHEN 'system' THEN 'm2' ELSE 'm1' END AS model FROM {0}"""


@query(f"SELECT key, coalesce(corpus_version = 'v1' AND card_hash = 'c1' AND model = 'm1', false) AS kept FROM ({ENTRIES.format('conversations')})")
def cache_purge(spark, d):
    kept, gone = caching.purged(spark.sql(ENTRIES.format("{turns}"), turns=table(spark, d, "conversations")), "v1", "c1", "m1")
    return kept.select("key", F.lit(True).alias("kept")).unionByName(gone.select("key", F.lit(False).alias("kept")))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def history_window(spark, d):
    return caching.last_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def history_last10(spark, d):
    return caching.last_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id AS query_id, string_agg('[' || turn || '] (documento: ' || role || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def numbered_context(spark, d):
    return caching.numbered(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("n"), F.col("role").alias("source"), F.col("text").alias("content")))


CACHED = """(1, '["x","y"]', '[{"statement":"s","passages":[1,2],"verbatim":"v"}]'), (2, 'broken', '[]'), (3, CAST(NULL AS STRING), 'no') AS t(id, cited, claims)"""


@query(
    f"""SELECT id, CASE WHEN json_type(TRY_CAST(cited AS JSON)) = 'ARRAY' THEN array_to_string(CAST(TRY_CAST(cited AS JSON) AS VARCHAR[]), ',') ELSE '' END AS cited,
    CASE WHEN json_type(TRY_CAST(claims AS JSON)) = 'ARRAY' THEN CAST(json_array_length(TRY_CAST(claims AS JSON)) AS INTEGER) ELSE 0 END AS n_claims FROM {each_sql(CACHED)}"""
)
def cached_lists(spark, d):
    return caching.cached_lists(each(spark, d, CACHED)).select("id", F.array_join("cited", ",").alias("cited"), F.size("claims").alias("n_claims"))


DOCMETA = """(1, '{"name":"a.txt","author":"z"}', 'document_metadata=x;k=v'), (2, CAST(NULL AS STRING), 'k=v'), (3, 'oops', 'document_metadata=x'), (4, '{"name":"b"}', 'j=1;document_metadata=2;k=3') AS t(id, meta, m)"""


@query(
    f"""SELECT id, coalesce(json_extract_string(TRY_CAST(meta AS JSON), '$.name'), 'unknown') AS name, coalesce(json_extract_string(TRY_CAST(meta AS JSON), '$.author'), 'unknown') AS author,
    array_to_string(list_filter(list_transform(string_split(m, ';'), lambda x: string_split(x, '=')[1]), lambda k: k <> 'document_metadata'), ',') AS keys FROM {each_sql(DOCMETA)}"""
)
def json_default_meta(spark, d):
    r = each(spark, d, DOCMETA).withColumn("p", caching.document_metadata(F.col("meta")))
    keys = F.map_keys(caching.without_key(F.str_to_map("m", F.lit(";"), F.lit("=")), "document_metadata"))
    return r.select("id", "p.name", "p.author", F.array_join(keys, ",").alias("keys"))
