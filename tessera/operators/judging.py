"""Judging: what a person needs to see of an answer, the form they fill, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluation

JUDGEMENT = ("fedele", "causa", "citazione_corretta", "italiano_1_5", "note")


def selected(records: DataFrame, condition: str | None) -> DataFrame:
    """Records of the condition on or off; all for None."""
    return records.where(F.col("cache_enabled") == (condition == "on")) if condition in ("on", "off") else records


def kind() -> Column:
    return evaluation.record_type(F.col("refused"), F.col("uncertain"), F.col("from_cache"))


def identified(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with id and category of their question; unknown questions have empty ones."""
    d = records.join(index.select(F.col("question").alias("query"), F.col("id").alias("_i"), F.col("category").alias("_c")), "query", "left")
    return d.withColumns({"id": F.coalesce("_i", F.lit("")), "category": F.coalesce("_c", F.lit(""))}).drop("_i", "_c")


def context_ids(retrieved: Column, cited: Column) -> Column:
    """What stood before the model; older records know only what was cited."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(retrieved, none)) > 0, retrieved).otherwise(F.coalesce(cited, none))


def shown_passages(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, n, chunk_id, title, text, cited, missing) in the order of the context.

    chunks (chunk_id, content, title, source); passages that are in no index come from the record itself.
    """
    r = records.select("record_id", F.coalesce("cited_chunk_ids", F.array().cast("array<string>")).alias("c"), "passages_inline", F.posexplode(context_ids(F.col("retrieved_chunk_ids"), F.col("cited_chunk_ids"))).alias("pos", "chunk_id"))
    d = r.join(chunks.select("chunk_id", F.col("content").alias("a"), F.coalesce("title", "source").alias("t")), "chunk_id", "left")
    own = F.try_element_at("passages_inline", F.col("chunk_id"))
    return d.select(
        "record_id", (F.col("pos") + 1).alias("n"), "chunk_id", F.coalesce("t", own["source"], F.lit("?")).alias("title"), F.trim(F.coalesce("a", own["text"], F.lit(""))).alias("text"),
        F.array_contains("c", F.col("chunk_id")).alias("cited"), (F.col("a").isNull() & own.isNull()).alias("missing"),
    )


def shown_claims(claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Claims with the outcome the pipeline recorded for the same statement; of repeats the last counts."""
    last = outcomes.groupBy("record_id", "statement").agg(F.max_by(F.struct("verbatim", "outcome", "matched_passage"), "pos").alias("o"))
    d = claims.join(last, ["record_id", "statement"], "left")
    return d.select("record_id", "statement", F.coalesce(F.nullif(F.col("o.verbatim"), F.lit("")), "verbatim", F.lit("")).alias("verbatim"), F.coalesce("o.outcome", F.lit("")).alias("outcome"), F.col("o.matched_passage").alias("matched_passage"))


def cited_hashes(records: DataFrame, passages: DataFrame) -> DataFrame:
    """(record_id, pos, hash) of the cited passages that are at hand."""
    r = records.select("record_id", F.posexplode("cited_chunk_ids").alias("pos", "chunk_id"))
    return r.join(passages, ["record_id", "chunk_id"]).select("record_id", "pos", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def shown_rows(rows: Column, most: int = 10) -> Column:
    return F.slice(F.coalesce(rows, F.array().cast("array<string>")), 1, most)


def form(records: DataFrame, index: DataFrame, run_id: str) -> DataFrame:
    """One empty row for each record that can be judged."""
    d = identified(records.withColumn("tipo", kind()).where(F.col("tipo").isin("risposta", "hit-cache")), index)
    blank = {c: F.lit("") for c in (*JUDGEMENT, "ereditato_da")}
    given = {"run_id": F.lit(run_id), "condition": F.when(F.coalesce("cache_enabled", F.lit(False)), "on").otherwise("off"), "categoria": F.col("category"), "domanda": F.col("query"), "risposta": evaluation.answer_text(F.col("answer_text"), F.col("raw_output"))}
    return d.withColumns(given | blank).select("run_id", "condition", "id", "categoria", "tipo", "domanda", *JUDGEMENT, "ereditato_da", "risposta")


def form_key(id_: Column, question: Column) -> Column:
    return F.coalesce(F.nullif(id_, F.lit("")), question, F.lit(""))


def form_state(rows: DataFrame) -> DataFrame:
    return rows.select(form_key(F.col("id"), F.col("domanda")).alias("key"), *JUDGEMENT, "ereditato_da")


def saved(rows: DataFrame, key: str, values: dict) -> DataFrame:
    """The form after one row's judgement changed; it is then one's own. A key that no row has is an error."""
    mine = form_key(F.col("id"), F.col("domanda")) == key
    if not rows.where(mine).limit(1).count():
        raise KeyError(f"no row of the form: {key!r}")
    touched = {c: "" if v is None else str(v) for c, v in values.items() if c in JUDGEMENT}
    new = {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in touched.items()}
    return rows.withColumns(new | {"ereditato_da": F.when(mine, F.lit("")).otherwise(F.col("ereditato_da"))}) if touched else rows


def prints(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fp", T.answer_print(F.col("domanda"), F.col("risposta")))


# What each band of fidelity recommends.
ADVICE = {
    "INSUFFICIENTE": "Nessun giudizio compilato: non si può decidere.",
    "ALTA": "Promuovi. L'architettura attuale basta.",
    "MEDIA": "Promuovi con uno strato di verifica affermazione↔passaggio.",
    "BASSA": "Non promuovere su questo modello: rimisura prima di decidere.",
}


def fidelity_report(run_id: str, condition: str | None, f: dict) -> str:
    """Markdown of a row of evaluation.fidelity()."""
    pct = lambda x: "—" if x is None else f"{x * 100:.1f}%"
    n = f["n_fedeli"] + f["n_infedeli"]
    lines = [f"# Fedeltà — {run_id}", "", f"- condizione: {condition or 'tutte'}", f"- giudicati {f['n_giudicati']} di {f['n_totali']} ({pct(f['copertura'])}), ereditati {f['n_ereditati']}", ""]
    lines += [f"- fedeltà {pct(f['fedelta'])} ({f['n_fedeli']}/{n})", f"- citazione corretta {pct(f['citazione_corretta'])}", f"- italiano {f['italiano_medio'] or '—'} su {f['n_voti_italiano']} voti", "", f"## Fascia {f['banda']}", "", ADVICE[f["banda"]]]
    if f["n_infedeli"]:
        by = {k: f[f"causa_{k}"] for k in T.CAUSES}
        lines += ["", "| causa | item |", "|---|---|", *[f"| {k} | {v} |" for k, v in by.items()]]
        if f["infedeli_senza_causa"]:
            lines.append(f"\n{f['infedeli_senza_causa']} senza causa: non si sa dove intervenire.")
        if f["n_infedeli"] < 4:
            lines.append(f"\nSolo {f['n_infedeli']} infedeltà: la ripartizione è indicativa.")
        else:
            top = max(by.values())
            first = [k for k, v in by.items() if v == top]
            reading = "strutturale" if by["strutturale"] and by["strutturale"] >= max(by["retrieval"], by["generazione"]) else first[0] if len(first) == 1 else None
            lines.append(f"\nCausa prevalente: {reading}." if reading else "\nLe cause si bilanciano.")
    if n:
        lines.append(f"\nUn item vale {100 / n:.1f} punti." + (" Troppo pochi perché la fascia sia affidabile." if n < 20 else ""))
    if f["copertura"] < 1:
        lines.append("\nLe righe vuote sono escluse dal calcolo.")
    return "\n".join(lines)


# How a sheet is read.
GUIDE = (
    "**fedele**: l'affermazione è contenuta nel passaggio citato.",
    "**causa**, solo se non è fedele: retrieval se la risposta non sta in nessun passaggio mostrato, generazione se c'era, strutturale se nessun passaggio può bastare.",
    "**citazione_corretta**: il rimando punta al documento giusto.",
    "**italiano_1_5**: 5 è pubblicabile così, 1 inutilizzabile.",
)


def sheet(run_id: str, items: list[dict], passages: list[dict], condition: str | None = None, form_name: str | None = None) -> str:
    """Reading sheet of collected items and the passages that stood before the model.

    An item may tell why it was refused (reason), what it lacked (signal, missing_terms), where it was cached
    (cache_similarity, matched_query) and its claims (statement, passages, outcome).
    """
    judged_ = [i for i in items if i["tipo"] in ("risposta", "hit-cache")]
    lines = [f"# Scheda di lettura — {run_id}", "", f"- condizione: {condition or 'tutte'} · record: {len(items)} · da giudicare: {len(judged_)}"]
    lines += [f"- i giudizi si scrivono in {form_name}"] if form_name else []
    lines += ["", *[f"- {x}" for x in GUIDE]]
    for i in items:
        lines += ["", "---", "", f"## {i['id'] or '—'} · {i['categoria'] or '—'} · {i['tipo']}", "", f"**{i['domanda']}**"]
        if i["tipo"] == "rifiuto":
            lines += ["", f"_Rifiutata: {i.get('reason') or '—'}. Se la risposta c'è qui sotto, la soglia è troppo alta._"]
        elif i["tipo"] == "astensione":
            lacking = ", ".join(f"«{t}»" for t in i.get("missing_terms") or []) or "—"
            lines += ["", f"_Astenuta: segnale {i.get('signal') or 0:.2f}, mancano {lacking}. Se la risposta c'è qui sotto, è un falso allarme._"]
        elif i["tipo"] == "hit-cache":
            lines += ["", f"_Dalla cache, similarità {i.get('cache_similarity')}: domanda memorizzata «{i.get('matched_query')}»._"]
        lines += ["", i["risposta"] or "—"]
        for n, claim in enumerate(i.get("claims") or [], 1):
            cited = "".join(f"[{p}]" for p in claim.get("passages") or []) or "—"
            lines += ["", f"{n}. {claim.get('statement') or ''} (cita {cited}{', ' + claim['outcome'] if claim.get('outcome') else ''})"]
        if i["tipo"] == "risposta" and "claims" in i and not i["claims"]:
            lines += ["", "Nessuna affermazione strutturata."]
        for p in sorted((p for p in passages if p["record_id"] == i.get("record_id")), key=lambda p: p["n"]):
            state = "introvabile" if p["missing"] else "citato" if p["cited"] else "nel contesto"
            lines += ["", f"[{p['n']}] {p['title']} ({state})", "", "> " + (p["text"] or "—").replace("\n", "\n> ")]
    return "\n".join(lines)


def bundle(run_id: str, condition: str | None, records: DataFrame, index: DataFrame, chunks: DataFrame, outcomes: DataFrame, forms: DataFrame) -> dict:
    """What one reader needs of a run: items with passages, claims and their state in the form. A person reads it, so it is small.

    records as of an audit with record_id; outcomes (record_id, statement, pos, verbatim, outcome, matched_passage).
    """
    own = identified(selected(records, condition).withColumn("tipo", kind()), index)
    shown = {r["record_id"]: [] for r in own.select("record_id").collect()}
    claims = {k: [] for k in shown}
    for p in shown_passages(own, chunks).collect():
        shown[p["record_id"]].append(p.asDict())
    listed = own.select("record_id", F.explode("claims").alias("c")).select("record_id", "c.statement", "c.verbatim")
    for c in shown_claims(listed, outcomes).collect():
        claims[c["record_id"]].append(c.asDict())
    state = {r["key"]: {k: r[k] for k in (*JUDGEMENT, "ereditato_da")} for r in form_state(forms).collect()}
    items = own.select("record_id", "id", F.col("category").alias("categoria"), "tipo", F.col("query").alias("domanda"), evaluation.answer_text(F.col("answer_text"), F.col("raw_output")).alias("risposta"), form_key(F.col("id"), F.col("query")).alias("key"))
    out = []
    for r in items.orderBy("record_id").collect():
        passages = sorted(shown[r["record_id"]], key=lambda p: p["n"])
        out.append(r.asDict() | {"passages": passages, "claims": claims[r["record_id"]], "giudizio": state.get(r["key"])})
    return {"run_id": run_id, "condition": condition, "items": out}


def load_form(spark, pattern: str) -> DataFrame:
    """The forms of a run; a form that is not there is an error that says how one is made."""
    from ..sources import files

    try:
        rows = files.forms(spark, pattern)
        rows.limit(1).count()
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no form at {pattern}: write one with judging.form() and files.write_form(), fill it, then read it") from e
        raise


def write_report(spark, path: str, text: str) -> str:
    from ..sources import stores

    stores.put_text(spark, path, text)
    return path


def verdict() -> Column:
    """A line for the progress of a run, from route, refused, uncertain, cache and counts."""
    c = F.col
    return (
        F.when(c("route") == "meta", F.when(c("from_cache_meta"), "META (cache)").otherwise("META"))
        .when(c("route") == "structured", F.concat(F.lit("CALCOLATA "), F.coalesce(c("computed_value").cast("string"), F.lit("-"))))
        .when(c("route") == "uncovered", "RIFIUTO DICHIARATO").when(c("from_cache_semantic"), "HIT-semantica").when(c("refused"), "RIFIUTO").when(c("uncertain"), "ASTENSIONE")
        .otherwise(F.concat(F.lit("risposta cit="), c("n_citations").cast("string"), F.when(c("truncated"), " TRONCATA").otherwise("")))
    )
