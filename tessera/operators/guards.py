"""Deterministic guards around an answer, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OUTCOMES = ("valido", "misattribuito", "non_trovato", "troppo_corto")


def missing_terms(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, term) of content terms whose root stands in none of the query's passages."""
    asked = queries.select("query_id", F.explode_outer(T.content_terms(F.coalesce("text", F.lit("")))).alias("term")).where("term IS NOT NULL").withColumn("root", F.substring("term", 1, T.ROOT))
    held = passages.select("query_id", F.explode_outer(T.roots(F.coalesce("content", F.lit("")))).alias("root")).where("root IS NOT NULL").distinct()
    return asked.join(held, ["query_id", "root"], "left_anti").select("query_id", "term", "root")


def abstention(queries: DataFrame, missing: DataFrame, df: DataFrame | None, n_chunks: int) -> DataFrame:
    """(query_id, signal, n_missing): the idf of the rarest missing term, 0 if none is missing or there are no statistics."""
    if df is None:
        weighed = missing.withColumn("idf", F.lit(0.0))
    else:
        weighed = missing.join(df, "root", "left").withColumn("idf", T.idf(F.lit(n_chunks), F.col("df")))
    best = weighed.groupBy("query_id").agg(F.max("idf").alias("signal"), F.count("*").alias("n_missing"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("signal", F.lit(0.0)).alias("signal"), F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))


def citations(answer: Column, claimed: Column, n_passages: Column) -> tuple[Column, Column]:
    """Sorted distinct (valid, invalid) passage numbers that an answer's marks and its claims cite."""
    cited = F.array_sort(F.array_distinct(F.concat(T.marks(answer), F.coalesce(claimed, F.array().cast("array<int>")))))
    fine = lambda x: (x >= 1) & (x <= n_passages)
    return F.filter(cited, fine), F.filter(cited, lambda x: ~fine(x))


def check_claims(claims: DataFrame, passages: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row a claim: (query_id, claim_no, outcome, matched_passage, at_bounds).

    claims (query_id, claim_no, verbatim, passages array<int>), passages (query_id, n, content). A span counts in the
    first cited passage that holds it, else in the first passage at all. The join is by query, so a span meets the few
    passages of its own query only.
    """
    span = T.span_cleaned(F.col("verbatim"))
    c = claims.select("query_id", "claim_no", span.alias("span"), F.coalesce("passages", F.array().cast("array<int>")).alias("cited"))
    c = c.withColumn("short", (F.col("span") == "") | (F.length("span") < min_chars)).withColumn("key", T.verbatim(F.col("span")))
    p = passages.select("query_id", "n", T.verbatim(F.col("content")).alias("body"))
    found = c.where(~F.col("short")).join(p, "query_id").where(F.contains("body", "key"))
    found = found.withColumn("place", F.array_position("cited", F.col("n")).cast("int")).withColumn("place", F.when(F.col("place") > 0, F.col("place")))
    found = found.withColumn("bounds", T.at_sentence_bounds(F.col("key"), F.col("body")))
    best = found.groupBy("query_id", "claim_no").agg(
        F.min(F.when(F.col("place").isNotNull(), F.struct("place", "n", "bounds"))).alias("own"), F.min("n").alias("any")
    )
    out = c.join(best, ["query_id", "claim_no"], "left")
    outcome = F.when(F.col("short"), OUTCOMES[3]).when(F.col("own").isNotNull(), OUTCOMES[0]).when(F.col("any").isNotNull(), OUTCOMES[1]).otherwise(OUTCOMES[2])
    matched = F.coalesce(F.col("own.n"), F.col("any"))
    return out.select("query_id", "claim_no", outcome.alias("outcome"), matched.alias("matched_passage"), F.coalesce(F.col("own.bounds"), F.lit(False)).alias("at_bounds"))


def verbatim_outcomes(checked: DataFrame) -> DataFrame:
    """Counts and ratios by query; a ratio without a denominator is null."""
    n = lambda k: F.count_if(F.col("outcome") == OUTCOMES[k])
    return checked.groupBy("query_id").agg(
        F.count("*").alias("n_claims"), n(0).alias("n_valid"), n(1).alias("n_misattributed"), n(2).alias("n_not_found"), n(3).alias("n_too_short"),
        F.try_divide(n(0), F.count("*")).alias("valid_ratio"),
        F.try_divide(F.count_if((F.col("outcome") == OUTCOMES[0]) & F.col("at_bounds")), n(0)).alias("span_boundary_ratio"),
    )


def decision(support: Column, n_passages: Column, signal: Column, ratio: Column, support_threshold: float, abstention_threshold: float, min_ratio: float) -> Column:
    """refused, uncertain (terms or verbatim) or answered, in the order in which the guards stand."""
    return (
        F.when((support < support_threshold) | (n_passages == 0), "refused")
        .when((F.lit(abstention_threshold) > 0) & (signal >= abstention_threshold), "uncertain:termini_mancanti")
        .when((F.lit(min_ratio) > 0) & ratio.isNotNull() & (ratio < min_ratio), "uncertain:verbatim")
        .otherwise("answered")
    )


def best_sentences(claims: DataFrame, passages: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, claim_no, n, sentence, overlap): the sentence of each cited passage that shares most words with a span.

    Spans of under five distinct words match nothing; equal overlaps go to the first sentence.
    """
    c = claims.select("query_id", "claim_no", F.trim("verbatim").alias("span"), F.explode("passages").alias("n"))
    c = c.withColumn("ws", F.array_distinct(F.split(T.phrase(F.col("span")), " "))).where((F.size("ws") >= 5) & (F.col("span") != ""))
    s = passages.select("query_id", "n", F.posexplode_outer(T.sentences(F.col("content"))).alias("pos", "sentence")).where("sentence IS NOT NULL")
    s = s.withColumn("own", F.array_distinct(F.split(T.phrase(F.col("sentence")), " ")))
    both = c.join(s, ["query_id", "n"]).withColumn("overlap", F.size(F.array_intersect("ws", "own")) / F.size("ws"))
    rank = F.row_number().over(Window.partitionBy("query_id", "claim_no", "n").orderBy(F.desc("overlap"), "pos"))
    return both.withColumn("r", rank).where((F.col("r") == 1) & (F.col("overlap") >= least)).select("query_id", "claim_no", "n", "span", "sentence", "overlap")


def provenance(best: DataFrame, phrases: DataFrame, norms: DataFrame, least: int) -> DataFrame:
    """(query_id, kind, key, sentence, n_documents, passages) of recurring sources behind an answer's claims.

    A sentence that recurs counts as itself; failing that, and if the span states no figure of its own, the legal acts
    that it cites and that are widespread.
    """
    listed = phrases["norms"] if "norms" in phrases.columns else F.array().cast("array<string>")
    b = best.withColumn("fp", T.phrase_print(F.col("sentence"))).join(phrases.select("fp", F.col("n_documents").alias("pn"), listed.alias("norms")), "fp", "left")
    own = b.where(F.col("pn") >= least).select("query_id", "claim_no", "n", F.lit("frase").alias("kind"), F.col("fp").alias("key"), "sentence", F.col("pn").alias("n_documents"), "norms")
    rest = b.where(F.coalesce(F.col("pn"), F.lit(0)) < least).where(~T.own_figure(F.col("span")))
    cited = rest.select("query_id", "claim_no", "n", "sentence", F.posexplode(T.references(T.rejoined_words(F.col("sentence")))).alias("at", "label"))
    wide = norms.where(F.col("n_documents") >= least).select("label", F.col("n_documents"))
    other = cited.join(wide, "label").select("query_id", "claim_no", "n", F.lit("norma").alias("kind"), F.concat(F.lit("norma::"), "label").alias("key"), "sentence", "n_documents", F.array("label").alias("norms"))
    return own.unionByName(other).groupBy("query_id", "kind", "key").agg(
        F.min_by("sentence", F.struct("claim_no", "n")).alias("sentence"), F.max("n_documents").alias("n_documents"), F.sort_array(F.collect_set("n")).alias("passages"),
        F.min_by("norms", F.struct("claim_no", "n")).alias("norms"), F.min(F.struct("claim_no", "n")).alias("first"),
    )


def notes(sources: DataFrame, n_documents: int) -> DataFrame:
    """(query_id, note, sources) of what provenance() found: the most widespread source in full, the others in one line."""
    one = F.struct((-F.col("n_documents")).alias("less"), "first", "key", "kind", "n_documents", "sentence", "passages", "norms")
    d = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    lead, others = F.col("s")[0], F.size("s") - 1
    number = lambda c: c.cast("string")
    share = F.concat(number(lead["n_documents"]), F.lit(f" delle {n_documents} delibere indicizzate"))
    acts = F.array_join(F.transform(F.slice(F.coalesce(lead["norms"], F.array().cast("array<string>")), 1, 2), lambda x: F.concat(F.lit("**"), x, F.lit("**"))), " e ")
    # The note's sentences.
    opening = F.when(acts != "", F.concat(F.lit("L'affermazione poggia sul richiamo a "), acts, F.lit(", che ne è la fonte: ricorre in "), share, F.lit("."))).otherwise(
        F.concat(F.lit("L'affermazione poggia su una formula che ricorre in "), share, F.lit("."))
    )
    marks = F.array_join(F.transform(lead["passages"], lambda x: F.concat(F.lit("["), number(x), F.lit("]"))), "")
    where = F.when(F.size(lead["passages"]) == 1, F.concat(F.lit("Il passaggio citato in "), marks, F.lit(" è uno di quelli"))).otherwise(F.concat(F.lit("I passaggi citati in "), marks, F.lit(" sono fra quelli")))
    closing = F.concat(where, F.lit(" — gli altri la riportano nei medesimi termini, e la risposta non cambia."))
    which = F.when(others == 1, F.lit("un'altra formula ricorrente")).otherwise(F.concat(F.lit("altre "), number(others), F.lit(" formule ricorrenti")))
    most = F.array_max(F.transform(F.slice("s", 2, F.greatest(others, F.lit(1))), lambda x: x["n_documents"]))
    rest = F.when(others > 0, F.concat(F.lit("La risposta poggia anche su "), which, F.lit(" (fino a "), number(most), F.lit(" delibere).")))
    shown = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["n_documents"].alias("n_documents"), x["norms"].alias("norms"), x["passages"].alias("passages"), x["sentence"].alias("sentence")))
    return d.select("query_id", F.concat_ws(" ", F.lit("**Provenienza.**"), opening, closing, rest).alias("note"), shown.alias("sources"))


def provenance_minimum(least: int, quota: float, n_documents: Column) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.bround(n_documents * quota, 0).cast("long"))
