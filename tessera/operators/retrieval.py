"""Vector and keyword arms, their fusion, and the support score.

A query table is a stated set held against all rows. Its vectors are packed into blocks of BLOCK rows, and each block is
sent once to every task; the block's size is the bound of what is broadcast, more queries only make more blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK = 4096
#: Queries and rows whose scores are in memory at once.
TILE = 256, 4096
K1, B = 1.2, 0.75


def _rank(by: list, *order: Column, name: str = "rank") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(name)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def kinds(queries: DataFrame, rows: DataFrame) -> list:
    """The Arrow types of query_id and id; both keep the type they have."""
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(d.schema[c].dataType) for d, c in ((queries, "query_id"), (rows, "id"))]


def _nearer(best, q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int, similarity: str):
    """best, a tile's (queries' places, scores, ids, floor of each query) so far or None, after rows x with their ids."""
    if similarity == "cosine":
        s = (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
    else:
        s = np.maximum(0.0, (2 - ((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T))) / 2)
    which, score, found, floor = best or (np.zeros(0, np.int64), np.zeros(0), ids[:0], np.full(len(q), -np.inf))
    if len(ids) >= k and np.isinf(floor).any():
        floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
    a, b = np.nonzero(~(s < floor[:, None] - 1e-11))  # what may tie once rounded
    if best and not len(a):
        return best
    which, score, found = np.concatenate([which, a]), np.concatenate([score, s[a, b]]), pa.concat_arrays([found, ids.take(pa.array(b))])
    place = np.unique(found.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # ids of any type in their order
    order = np.lexsort((place, -np.round(score, 12), which))
    nth = np.arange(len(order)) - np.searchsorted(which[order], which[order])
    order = order[nth < k]
    which, score = which[order], score[order]
    last = np.flatnonzero(nth[nth < k] == k - 1)
    floor = floor.copy()
    floor[which[last]] = np.maximum(floor[which[last]], score[last])
    return which, score, found.take(pa.array(order)), floor


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, similarity: str = "l2", least: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query, exactly; then those under `least` go.

    queries (query_id, vector), rows (id, vector). similarity: "l2" is max(0, (2 - squared distance) / 2), "cosine" the
    cosine. A task scores TILE by TILE and keeps its own k best, so a query's candidates grow with the tasks, not with the
    rows, and memory with neither. A query meets the rows of its own dimension; vectors that are null, empty or hold a null or NaN meet none.
    """
    spark, of = rows.sparkSession, kinds(queries, rows)
    queries, rows = (d.where(F.col("vector").isNotNull() & (F.size("vector") > 0)) for d in (queries, rows))
    n = queries.count()
    out = None
    for block in range(max(1, -(-n // BLOCK))):
        some = queries if n <= BLOCK else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))) == block)
        got = some.orderBy("query_id").collect()
        sizes = {}
        for r in got:
            if all(v is not None and v == v for v in r["vector"]):
                sizes.setdefault(len(r["vector"]), []).append(r)
        given = spark.sparkContext.broadcast({n: ([r["query_id"] for r in rs], np.array([r["vector"] for r in rs], np.float64)) for n, rs in sizes.items()})

        def run(batches, given=given):
            best = {}
            for b in batches:
                lengths = np.asarray(b.column(1).value_lengths())
                flat, starts = np.asarray(b.column(1).flatten(), np.float64), np.cumsum(lengths) - lengths
                for n, (_, q) in given.value.items():
                    at = np.flatnonzero(lengths == n)
                    for r in range(0, len(at), TILE[1]):
                        own = at[r : r + TILE[1]]
                        x = flat[starts[own][:, None] + np.arange(n)]  # a null is a NaN here
                        fine = ~np.isnan(x).any(axis=1)
                        own, x = b.column(0).take(pa.array(own[fine])), x[fine]
                        for c in range(0, len(q) if len(own) else 0, TILE[0]):
                            best[n, c] = _nearer(best.get((n, c)), q[c : c + TILE[0]], x, own, k, similarity)
            for (n, c), (which, score, found, _) in best.items():
                ids = pa.array(given.value[n][0][c : c + TILE[0]], of[0])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), found, pa.array(score)], ["query_id", "id", "score"])

        part = rows.select("id", "vector").mapInArrow(run, f"query_id {kind(queries, 'query_id')}, id {kind(rows, 'id')}, score double")
        out = part if out is None else out.unionByName(part)
    ranked = out.select("*", _rank(["query_id"], F.desc(F.round("score", 12)), F.col("id"))).where(F.col("rank") <= k)
    return ranked.where(F.col("score") >= least)


def words(t: Column) -> Column:
    """Words of the keyword index: plain tokens of four letters or more that are no function words, with repeats."""
    return F.filter(T.tokens(T.plain(F.coalesce(t, F.lit("")))), lambda w: ~w.isin(T.STOPWORDS))  # a hash set, once planned


def analysed(t: Column) -> Column:
    """Words by the Italian analysis: without elided articles and stop words, accents off, endings of number and gender off."""
    from pyspark.ml.feature import StopWordsRemover

    stop = sorted({*StopWordsRemover.loadDefaultStopWords("italian"), *T.STOPWORDS})
    bare = F.regexp_replace(T.plain(F.coalesce(t, F.lit(""))), r"(?U)\b(?:c|l|all|dall|dell|nell|sull|coll|pell|gl|agl|dagl|degl|negl|sugl|un|m|t|s|v|d)'(?=\w)", " ")
    found = F.filter(F.regexp_extract_all(bare, F.lit(r"(?U)[\w]{2,}"), F.lit(0)), lambda w: ~w.isin(stop))
    flat = lambda w: F.translate(w, "àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu")
    return F.transform(found, lambda w: F.when(F.length(w) < 6, flat(w)).otherwise(F.regexp_replace(flat(w), r"(?:[hi][ei]|i[ao]|[aeio])$", "")))


def postings(docs: DataFrame, words=words) -> DataFrame:
    """(term, id, tf, length): one row for each word of a document. words: words() or analysed()."""
    d = docs.select("id", words(F.col("text")).alias("w")).select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).where("term IS NOT NULL")
    return d.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def posted(old: DataFrame, docs: DataFrame, words=words) -> DataFrame:
    """An index after documents (id, text) were put in or replaced: only theirs are counted."""
    return unposted(old, docs.select("id")).unionByName(postings(docs, words))


def unposted(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti").select(*old.columns)


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int, index: DataFrame | None = None, words=words) -> DataFrame:
    """(query_id, id, raw, score, rank): the k best documents of each query by BM25 over any of its words; score is raw
    over the query's best.

    queries (query_id, text), docs (id, text), index: what postings() made of docs, if it is stored. Questions' words are
    few: at run time they are broadcast to the postings where they fit, and a frequent word's partition is split where not.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    if index is None:
        index, whole = postings(docs, words), docs.select(F.size(words(F.col("text"))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    else:
        whole = index.agg(F.sum("tf").alias("words")).join(docs.agg(F.count("*").alias("n"))).select("n", (F.coalesce("words", F.lit(0)) / F.greatest("n", F.lit(1))).alias("mean"))
    hits = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = F.col("n"), F.greatest(F.col("mean"), F.lit(1e-9))
    weight = (F.ln(n / (F.col("df") + 1)) + 1) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = asked.join(hits, "term").join(df, "term").join(F.broadcast(whole)).groupBy("query_id", "id").agg(F.sum(weight).alias("raw"))
    ranked = scored.select("*", _rank(["query_id"], F.desc(F.round("raw", 9)), F.col("id"))).where(F.col("rank") <= k)
    top = F.max("raw").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.when(top > 0, F.col("raw") / top).otherwise(0.0)).select("query_id", "id", "raw", "score", "rank")


def normalised(hits: DataFrame, method: str) -> DataFrame:
    """hits with norm: the score within its query's arm, by min_max (all equal: 1) or z_score (no spread: 0)."""
    own = Window.partitionBy("query_id")
    s = F.col("score")
    if method == "min_max":
        low, high = F.min("score").over(own), F.max("score").over(own)
        return hits.withColumn("norm", F.when(high == low, 1.0).otherwise((s - low) / (high - low)))
    if method == "z_score":
        spread = F.stddev_pop("score").over(own)
        return hits.withColumn("norm", F.when(spread == 0, 0.0).otherwise((s - F.avg("score").over(own)) / spread))
    raise ValueError(f"no such normalisation: {method}")


def fused(vector: DataFrame, keyword: DataFrame, strategy: str = "rrf", weights: tuple[float, float] = (0.7, 0.3), constant: int = 60, method: str = "min_max") -> DataFrame:
    """(query_id, id, score, vector_score, keyword_score, rank) of both arms' hits; equal scores go by id.

    strategy: "rrf" sums weight / (constant + rank), "weighted" sums weight * normalised score.
    """
    if strategy == "rrf":
        part = lambda w: F.lit(float(w)) / (constant + F.col("rank"))
    else:
        vector, keyword = normalised(vector, method), normalised(keyword, method)
        part = lambda w: F.lit(float(w)) * F.col("norm")
    v = vector.select("query_id", "id", F.col("score").alias("vector_score"), part(weights[0]).alias("v"))
    w = keyword.select("query_id", "id", F.col("score").alias("keyword_score"), part(weights[1]).alias("w"))
    both = v.join(w, ["query_id", "id"], "full_outer").withColumn("score", F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)))
    return both.select("query_id", "id", "score", "vector_score", "keyword_score", _rank(["query_id"], F.desc(F.round("score", 12)), F.col("id")))


def hybrid(vector_queries: DataFrame, vectors: DataFrame, text_queries: DataFrame, docs: DataFrame, k: int, least: tuple[float, float] = (0.0, 0.0), index: DataFrame | None = None, **how) -> DataFrame:
    """The k best of both arms; each arm gives min(2k, 50) hits, then those under its least score go."""
    each = min(2 * k, 50)
    v = vector_topk(vector_queries, vectors, each).where(F.col("score") >= least[0])
    w = keyword_topk(text_queries, docs, each, index).where(F.col("score") >= least[1])
    return fused(v, w, **how).where(F.col("rank") <= k)


def support(hits: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, support, refused, reason): the best dense score of a query's hits, 0 if none, held against a threshold."""
    best = hits.groupBy("query_id").agg(F.max("vector_score").alias("best"), F.count("*").alias("n"))
    out = queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("support"), F.coalesce("n", F.lit(0)).alias("n"))
    refused = (F.col("support") < threshold) | (F.col("n") == 0)
    reason = F.when(refused, F.format_string(f"support_score %.3f < soglia {threshold:.3f}", "support"))
    return out.select("query_id", "support", refused.alias("refused"), reason.alias("reason"))
