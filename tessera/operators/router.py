"""Routing of questions by patterns, and the checks of a proposed route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The patterns that decide a route.
SPECIFIC = r"(?iU)deliber\w*\s+(?:n\.?\s*)?\d+"
COUNTING = r"(?iU)\b(quant[ei]|numero\s+di|elenc\w+|quante\s+volte|lista\s+d)\b"
MASS = r"(?iU)\b(in\s+totale|complessiv\w+|ammontare\s+totale|somma\s+totale|totale\s+d\w+|quanto\s+(?:è\s+stato\s+)?spes\w+)\b"
OBJECT = r"(?iU)\b(deliber\w+|atti|provvediment\w+)\b"
LISTING = r"(?iU)\b(elenc\w+|quali\s+sono|lista\s+d)\b"
BY_YEAR = r"(?iU)\b(per\s+anno|anno\s+per\s+anno|distribu\w+)\b"
RANGE = r"(?iU)\b(?:dal|da)\s+(\d{4})\s+(?:al|a)\s+(\d{4})\b"
META = (
    r"(?iU)\b(di\s+cosa\s+(?:parla|tratta)|che\s+cos'?[èe]|cosa\s+(?:contiene|c'?[èe])"
    r"|(?:che|quali|quant[ei])\s+(?:tipo\s+di\s+)?document\w+|che\s+periodo|quale\s+periodo"
    r"|cosa\s+(?:posso|si\s+può)\s+chieder\w*|cosa\s+puoi\s+(?:fare|dirmi)"
    r"|come\s+sono\s+fatt\w+)\b"
)
CORPUS = r"(?iU)\b(corpus|archivio|raccolta|banca\s+dati|dataset|quest[oi]\s+document\w+)\b"
ROUTES = ("structured", "uncovered", "pointwise", "meta")
INTENTS = ("count_delibere", "list_delibere", "count_by_year")
MANY_YEARS = "aggregazione fuori copertura: gli anni citati non stanno in un solo anno né in un solo intervallo"
NO_AMOUNTS = "aggregazione fuori copertura: nessuna tabella degli importi"
YEAR_MIN, YEAR_MAX = 1900, 2100


def signals(q: Column) -> dict[str, Column]:
    """The seven signals of a question."""
    has = q.rlike(RANGE)
    ends = F.when(has, F.array(F.regexp_extract(q, RANGE, 1).try_cast("int"), F.regexp_extract(q, RANGE, 2).try_cast("int")))
    many = F.when(has, F.size(F.array_except(T.years(q), ends)) > 0).otherwise(F.size(T.years(q)) > 1)
    return {
        "forma_conteggio": q.rlike(COUNTING), "forma_massa": q.rlike(MASS), "oggetto_coperto": q.rlike(OBJECT),
        "delibera_specifica": q.rlike(SPECIFIC), "anni_multipli": many, "forma_meta": q.rlike(META), "oggetto_corpus": q.rlike(CORPUS),
    }


def routed(questions: DataFrame) -> DataFrame:
    """questions (query_id, text) with the signals, route, intent, reason and the filters of the structured route.

    The first rule that holds decides; the last one always does.
    """
    q = F.coalesce("text", F.lit(""))
    d = questions.select("query_id", "text", *[c.alias(k) for k, c in signals(q).items()], q.rlike(LISTING).alias("_list"))
    s = F.col
    countable = s("oggetto_coperto") & (s("forma_conteggio") | s("_list"))
    route = (
        F.when(s("delibera_specifica"), "pointwise").when(s("forma_meta") & s("oggetto_corpus"), "meta")
        .when(countable & s("anni_multipli"), "uncovered").when(countable, "structured")
        .when(s("forma_conteggio") | s("forma_massa"), "uncovered").otherwise("pointwise")
    )
    d = d.withColumn("route", route)
    structured, text = s("route") == "structured", F.coalesce("text", F.lit(""))
    intent = F.when(text.rlike(BY_YEAR), INTENTS[2]).when(s("_list"), INTENTS[1]).otherwise(INTENTS[0])
    years, has = T.years(text), text.rlike(RANGE)
    reason = F.when(s("route") == "uncovered", F.when(countable & s("anni_multipli"), MANY_YEARS).otherwise(NO_AMOUNTS))
    end = lambda k: F.when(structured & has, F.regexp_extract(text, RANGE, k).try_cast("int"))
    return d.select(
        "*", F.when(structured, intent).alias("intent"), reason.alias("reason"),
        F.when(structured & ~has & (F.size(years) == 1), F.element_at(years, 1)).alias("anno"), end(1).alias("anno_da"), end(2).alias("anno_a"),
        F.when(structured, F.when(text.rlike(r"(?iU)\bcipess\b"), "CIPESS").when(text.rlike(r"(?iU)\bcipe\b"), "CIPE")).alias("comitato"),
    ).drop("_list")


PROPOSAL = "route string, intent string, params struct<anno:string,anno_da:string,anno_a:string,comitato:string>"


def prompt(card: str | None) -> str:
    """What a classifier is told: the closed sets, and the card."""
    return (
        "Classifica la domanda. Rispondi con un solo oggetto JSON: route, intent, params.\n"
        f"route: una fra {', '.join(ROUTES)}. intent, solo per structured: uno fra {', '.join(INTENTS)}.\n"
        f"params, solo per structured: anno, oppure anno_da e anno_a (da {YEAR_MIN} a {YEAR_MAX}); comitato: CIPE o CIPESS.\n"
        "pointwise: un fatto scritto in un atto. structured: contare, elencare o distribuire delibere. uncovered: somme sui testi, altri oggetti. meta: la raccolta stessa.\n\n"
        f"SCHEDA DEL CORPUS:\n\n{card or '(nessuna scheda)'}"
    )


def agentic(routes: DataFrame, classifier, card: str | None = None) -> DataFrame:
    """routes (of routed()) with source, router_raw and router_error, after a classifier was asked for a proposal.

    classifier: an object with classify(prompt, question) that gives JSON. A question that names an act is not asked; a call
    that fails or a proposal outside the closed sets leaves the lexical route, and says so.
    """
    system = prompt(card)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, failed = [], []
            for q in b.column(1).to_pylist():
                try:
                    raw.append(classifier.classify(system, q or ""))
                    failed.append(None)
                except Exception as e:  # no failure of routing may cost an answer
                    raw.append(None)
                    failed.append(f"chiamata fallita: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string()), pa.array(failed, pa.string())], ["query_id", "raw", "failed"])

    asked = routes.where(~F.col("delibera_specifica"))
    said = asked.select("query_id", "text").mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, raw string, failed string").checkpoint()
    p = proposed(said.join(asked.select("query_id", F.col("route").alias("lexical_route")), "query_id"))
    p = p.join(said, "query_id").select("query_id", F.col("raw").alias("router_raw"), F.coalesce("failed", "error").alias("router_error"), "source", *[F.col(k).alias(f"p_{k}") for k in ("route", "intent", "anno", "anno_da", "anno_a", "comitato")])
    d = routes.join(p, "query_id", "left").withColumn("source", F.coalesce("source", F.lit("lexical")))
    llm = F.col("source") == "llm"
    for k in ("route", "intent", "anno", "anno_da", "anno_a", "comitato"):
        d = d.withColumn(k, F.when(llm, F.col(f"p_{k}")).otherwise(F.col(k)))
    return d.withColumn("reason", F.when(~llm, F.col("reason"))).drop(*[f"p_{k}" for k in ("route", "intent", "anno", "anno_da", "anno_a", "comitato")])


def proposed(rows: DataFrame) -> DataFrame:
    """(query_id, route, source, intent, anno, anno_da, anno_a, comitato, error) of raw proposals held against the closed sets.

    rows (query_id, raw, lexical_route). Any breach of the contract falls back to the lexical route and is named.
    """
    p = F.from_json("raw", PROPOSAL)
    d = rows.select("query_id", "lexical_route", p.alias("p"), F.try_parse_json("raw").alias("parsed"), F.coalesce(F.col("raw").rlike(r"^\s*\{"), F.lit(False)).alias("object"))
    num = {k: F.col(f"p.params.{k}").try_cast("int") for k in ("anno", "anno_da", "anno_a")}
    given = {k: F.col(f"p.params.{k}").isNotNull() for k in num}
    fine = F.lit(True)
    for k, v in num.items():
        fine &= ~given[k] | F.coalesce(v.between(YEAR_MIN, YEAR_MAX), F.lit(False))
    fine &= ~(given["anno"] & (given["anno_da"] | given["anno_a"])) & (given["anno_da"] == given["anno_a"])
    fine &= ~given["anno_da"] | F.coalesce(num["anno_da"] <= num["anno_a"], F.lit(False))
    body = F.upper(F.trim("p.params.comitato"))
    fine &= body.isNull() | body.isin("CIPE", "CIPESS")
    route = F.col("p.route").isin(*ROUTES)
    intent = (F.col("p.route") != "structured") | F.coalesce(F.col("p.intent").isin(*INTENTS), F.lit(False))
    ok = F.coalesce(F.col("object") & route & intent & ((F.col("p.route") != "structured") | F.coalesce(fine, F.lit(False))), F.lit(False))
    used = ok & (F.col("p.route") == "structured")
    named = lambda what, c: F.concat(F.lit(f"{what} fuori insieme: "), F.coalesce(c, F.lit("")))
    error = (
        F.when(ok, F.lit(None).cast("string")).when(F.col("parsed").isNull(), "JSON non parsabile").when(~F.col("object"), "proposta non è un oggetto")
        .when(~F.coalesce(route, F.lit(False)), named("route", F.col("p.route"))).when(~F.coalesce(intent, F.lit(False)), named("intento", F.col("p.intent"))).otherwise("parametri non conformi")
    )
    return d.select(
        "query_id", F.when(ok, F.col("p.route")).otherwise(F.col("lexical_route")).alias("route"), F.when(ok, "llm").otherwise("lexical").alias("source"), F.when(used, F.col("p.intent")).alias("intent"),
        *[F.when(used, v).alias(k) for k, v in num.items()], F.when(used, body).alias("comitato"), error.alias("error"),
    )
