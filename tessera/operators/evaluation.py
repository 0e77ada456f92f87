"""Scored rows, metrics by condition, judgements and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def rate(num: Column, den: Column, digits: int = 3) -> Column:
    """num / den, rounded half to even; 0 without a denominator."""
    return F.coalesce(F.bround(F.try_divide(num, den), digits), F.lit(0.0))


def cost(prompt: Column, completion: Column, cached: Column, p_in: float, p_cached: float, p_out: float) -> Column:
    fresh = F.greatest(F.lit(0).cast("long"), prompt - cached)
    return (fresh * F.lit(float(p_in)) + cached * F.lit(float(p_cached)) + completion * F.lit(float(p_out))) / F.lit(1e6)


def embed_cost(tokens: Column, price: float) -> Column:
    return F.when((F.lit(price) > 0) & (tokens > 0), tokens / F.lit(1e6) * F.lit(float(price)))


def scored_rows(answers: DataFrame) -> DataFrame:
    """answers with declined, refusal_correct, source_id_ok, route_ok and value_ok; null where a row is not scored.

    An answer from SQL has a source, and so has a meta answer that no model wrote; rows with an error score nothing.
    """
    declined = F.col("refused") | F.col("uncertain")
    route, dead = F.col("route"), F.coalesce(F.col("error"), F.lit("")) != ""
    sourced = (route == "structured") | ((route == "meta") & (F.col("prompt_tokens") == 0)) | (F.col("n_citations") > 0)
    score = lambda c: F.when(~dead, c.cast("int"))
    return answers.withColumns({
        "declined": declined,
        "refusal_correct": score(F.when(F.col("expect_refuse").isNotNull(), declined == F.col("expect_refuse"))),
        "source_id_ok": score(F.when(~declined, sourced)),
        "route_ok": score(F.when(F.col("route_expected").isNotNull(), route == F.col("route_expected"))),
        "value_ok": score(F.when((route == "structured") & F.col("expected_value").isNotNull() & F.col("computed_value").isNotNull(), F.col("expected_value") == F.col("computed_value"))),
    })


def metrics(rows: DataFrame) -> DataFrame:
    """One row of metrics a condition, in one aggregation; rows with an error stand outside every denominator."""
    live = F.coalesce(F.col("error"), F.lit("")) == ""
    on = lambda c: live & c
    n = lambda c: F.count_if(on(c))
    total = lambda c: F.coalesce(F.sum(F.when(live, c)), F.lit(0)).cast("long")
    c = F.col
    answered = ~c("refused") & ~c("uncertain")
    call = ~c("from_cache_semantic") & (c("prompt_tokens") > 0)
    lat = F.when(live, c("latency_s"))
    zero = lambda x, d: F.coalesce(F.bround(x, d), F.lit(0.0))
    return rows.groupBy("condition").agg(
        n(F.lit(True)).alias("n"),
        rate(F.sum(F.when(live, c("refusal_correct"))), n(c("refusal_correct").isNotNull())).alias("refusal_accuracy"),
        rate(F.sum(F.when(on(answered), c("source_id_ok"))), n(answered)).alias("citation_validity"),
        total(c("invalid_citations")).alias("invalid_citation_total"),
        rate(n(c("from_cache_semantic")), n(F.lit(True))).alias("semantic_hit_rate"),
        rate(n(call & (c("cached_tokens") > 0)), n(call)).alias("provider_hit_rate"),
        *[total(c(x)).alias(x) for x in ("prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens")],
        zero(F.sum(F.when(live, c("cost"))), 6).alias("cost"),
        zero(F.avg(lat), 3).alias("latency_avg"), zero(F.median(lat), 3).alias("latency_median"), zero(F.max(lat), 3).alias("latency_max"),
        zero(F.sum(F.when(live, c("latency_wall_s") - c("latency_s"))), 1).alias("suspend_drift_s"),
        n(call).alias("model_calls"), n(c("refused")).alias("n_refused"), n(c("uncertain")).alias("n_uncertain"), n(answered).alias("n_answered"), n(c("truncated")).alias("n_truncated"),
        rate(F.sum(F.when(live, c("route_ok"))), n(c("route_ok").isNotNull())).alias("routing_accuracy"),
        rate(n((c("route") == "structured") & (c("route_expected") == "structured")), n(c("route_expected") == "structured")).alias("router_recall"),
        rate(n((c("route") != "pointwise") & (c("route_expected") == "pointwise")), n(c("route_expected") == "pointwise")).alias("router_false_positive"),
        rate(F.sum(F.when(live, c("value_ok"))), n(c("value_ok").isNotNull())).alias("structured_value_accuracy"),
        zero(F.avg(F.when(live, c("verbatim_valid_ratio"))), 3).alias("verbatim_valid_ratio"),
        total(c("verbatim_misattributed")).alias("verbatim_misattributed"), total(c("verbatim_not_found")).alias("verbatim_not_found"),
        *[n(c("route") == r).alias(f"n_{r}") for r in ("structured", "uncovered", "meta")],
        n(c("provenance_sources") > 0).alias("n_provenance"), n(c("from_cache_meta")).alias("n_cache_meta"), F.count_if(~live).alias("n_errors"),
        n(c("router_llm_tokens") > 0).alias("router_llm_calls"), n(c("router_source") == "llm").alias("router_llm_decisions"),
        n(F.coalesce(c("router_llm_error"), F.lit("")) != "").alias("router_llm_failed"), total(c("router_llm_tokens")).alias("router_llm_tokens"),
        zero(F.sum(F.when(live, c("router_llm_cost"))), 6).alias("router_llm_cost"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.groupBy("condition", "category").agg(
        F.count("*").alias("n"), F.count_if(~c("refused") & ~c("uncertain")).alias("answers"), F.count_if(c("uncertain")).alias("abstentions"), F.count_if(c("refused")).alias("refusals")
    )


def record_type(refused: Column, uncertain: Column, from_cache: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(refused), "rifiuto").when(yes(uncertain), "astensione").when(yes(from_cache), "hit-cache").otherwise("risposta")


def answer_text(text: Column, raw: Column) -> Column:
    """The stored text, else the answer field of the raw output, else the raw output."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(blank(text), blank(F.get_json_object(raw, "$.answer")), blank(raw), F.lit(""))


def fidelity(form: DataFrame) -> DataFrame:
    """Coverage, fidelity and its band, causes and marks of a filled form; undefined rates are null."""
    d = form.select("*", T.judged(F.col("fedele")).alias("f"), T.judged(F.col("citazione_corretta")).alias("cc"), T.mark(F.col("italiano_1_5")).alias("v"), T.cause(F.col("causa")).alias("k"))
    seen = F.col("f").isNotNull() | F.col("cc").isNotNull() | F.col("v").isNotNull()
    carried = F.length(F.trim(F.coalesce("ereditato_da", F.lit("")))) > 0
    yes, no = F.count_if(F.col("f")), F.count_if(~F.col("f"))
    out = d.agg(
        F.count("*").alias("n_totali"), F.count_if(seen).alias("n_giudicati"), F.count_if(seen & carried).alias("n_ereditati"), F.count_if(seen & ~carried).alias("n_riletti"),
        rate(F.count_if(seen), F.count("*")).alias("copertura"), yes.alias("n_fedeli"), no.alias("n_infedeli"),
        *[F.count_if(~F.col("f") & (F.col("k") == k)).alias(f"causa_{k}") for k in T.CAUSES],
        F.count_if(~F.col("f") & F.col("k").isNull()).alias("infedeli_senza_causa"),
        F.bround(F.try_divide(yes, yes + no), 4).alias("fedelta"),
        F.bround(F.try_divide(F.count_if(F.col("cc")), F.count_if(F.col("cc").isNotNull())), 4).alias("citazione_corretta"),
        F.count_if(~F.col("cc")).alias("n_citazioni_sbagliate"), F.bround(F.avg("v"), 2).alias("italiano_medio"), F.count("v").alias("n_voti_italiano"),
        F.try_divide(yes, yes + no).alias("_exact"),
    )
    return out.withColumn("banda", T.band(F.col("_exact"))).drop("_exact")


def latest_judgements(forms: DataFrame, except_run: str | None = None) -> DataFrame:
    """(fp, run_id, judgement columns) of the newest judged row of each answer; rows without a verdict do not count."""
    kept = forms.where(F.length(F.trim(F.coalesce("fedele", F.lit("")))) > 0)
    kept = kept.where(F.col("run_id") != except_run) if except_run else kept
    kept = kept.withColumn("fp", T.answer_print(F.col("domanda"), F.col("risposta")))
    best = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("run_id"), F.desc("row_no")))
    return kept.withColumn("r", best).where("r = 1").select("fp", "run_id", "fedele", "causa", "citazione_corretta", "italiano_1_5", "note")


def inherited(form: DataFrame, earlier: DataFrame) -> DataFrame:
    """form with the judgements of identical answers carried forward and their run in ereditato_da."""
    cols = ["fedele", "causa", "citazione_corretta", "italiano_1_5", "note"]
    e = earlier.select("fp", F.col("run_id").alias("_run"), *[F.col(c).alias(f"_{c}") for c in cols])
    d = form.withColumn("fp", T.answer_print(F.col("domanda"), F.col("risposta"))).join(e, "fp", "left")
    return d.withColumns({c: F.when(F.col("_run").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols} | {"ereditato_da": F.coalesce("_run", "ereditato_da")}).drop("_run", *[f"_{c}" for c in cols])


def calibration(scores: DataFrame, inside: str = "in_corpus", outside: str = "out_of_corpus") -> tuple[DataFrame, DataFrame]:
    """(category, n, min, upper median, max) and one row with the proposed threshold, null if the two ranges overlap.

    The upper median is the row at place n div 2 of each category's order; no group's scores are gathered in one row.
    """
    own = Window.partitionBy("category")
    d = scores.withColumn("r", F.row_number().over(own.orderBy("score")) - 1).withColumn("n", F.count("*").over(own))
    by = d.groupBy("category").agg(F.max("n").alias("n"), F.min("score").alias("min"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("score"))).alias("median"), F.max("score").alias("max"))
    ends = by.agg(F.max(F.when(F.col("category") == inside, F.col("min"))).alias("least_inside"), F.max(F.when(F.col("category") == outside, F.col("max"))).alias("most_outside"))
    good = F.col("least_inside") > F.col("most_outside")
    return by, ends.select("least_inside", "most_outside", F.when(good, F.bround((F.col("least_inside") + F.col("most_outside")) / 2, 2)).alias("threshold"))
