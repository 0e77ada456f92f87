"""A batch of questions answered end to end, each by its route: router, caches, retrieval, guards, generation, provenance."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import caching, corpus, evaluation, guards, retrieval, router, structured
from ..providers import USAGE, FirstSentence, Generator, generated
from ..session import shared_dir
from ..sources import files, stores
from . import ingest

CLAIMS = "array<struct<statement:string,passages:array<int>,verbatim:string>>"
OUTPUT = f"answer string, claims {CLAIMS}"
SOURCES = "array<struct<kind:string,n_documents:bigint,norms:array<string>,passages:array<int>,sentence:string>>"
# The answers of a question that documents do not support, or not surely.
REFUSED = "Non posso rispondere: i documenti non contengono informazioni sufficienti a sostenere una risposta."
UNSURE_VERBATIM = (
    "Non posso rispondere con certezza: le affermazioni che avrei prodotto non risultano sostenute alla lettera dai documenti recuperati. "
    "Preferisco non presentarle piuttosto che presentarle senza una citazione verificata."
)
UNSURE_TERMS = (
    "Non posso rispondere con certezza: nei documenti che ho trovato non c'è un passaggio che risponda con precisione a questa domanda. "
    "Ho trovato però documenti in tema: ",
    ". Prova a riformulare in modo più specifico — per esempio indicando l'anno, il numero della delibera, o la denominazione esatta del fondo o dell'opera.",
)
NOTHING_FOUND = "Non ho trovato informazioni rilevanti per rispondere alla tua domanda."


@dataclass
class Corpus:
    """What questions are asked of: chunks (id, content, source, vector), documents of the structured route, card, phrases, norms.

    term_df and postings are what an ingest stored of the chunks; without them they are computed again.
    """

    chunks: DataFrame
    acts: DataFrame | None = None
    card: DataFrame | None = None
    phrases: DataFrame | None = None
    norms: DataFrame | None = None
    version: str = "no-manifest"
    term_df: DataFrame | None = None
    postings: DataFrame | None = None


def loaded(spark: SparkSession, target: str, card_dir: str | None = None) -> Corpus:
    """The corpus that an ingest left at target, by its manifest: chunks keep their ids, statistics are those it stored.

    card_dir: the folder of the collection's card. Without one, and with no document that has the name of an act, the meta
    and the structured route are closed.
    """
    t = ingest.tables(spark, target)
    vector = F.col("vector") if "vector" in t["chunks"].columns else F.lit(None).cast("array<double>")
    chunks = t["chunks"].select(F.col("chunk_id").alias("id"), "content", F.col("doc_id").alias("source"), vector.alias("vector"))
    acts = files.documents(files.manifest(spark, f"{target.rstrip('/')}/manifest.json"))
    acts = acts if not acts.where("is_delibera").isEmpty() else None
    card = files.card(spark, card_dir) if card_dir and stores.names(spark, card_dir) else None
    return Corpus(chunks, acts, card, t["phrases"], t["norms"], ingest.version(spark, target), t["term_df"], t["postings"])


@dataclass
class Caches:
    """Entries of the semantic cache (caching.SEMANTIC) and of the meta cache (caching.META); None is a cache that is off."""

    semantic: DataFrame | None = None
    meta: DataFrame | None = None


COLUMNS = {
    "query_id": "long", "text": "string", "route": "string", "proposed_route": "string", "router_source": "string", "router_error": "string", "signals": "map<string,boolean>",
    "refused": "boolean", "uncertain": "boolean", "reason": "string", "answer": "string", "computed_value": "long", "gap": "long", "support": "double", "signal": "double",
    "missing_terms": "array<string>", "valid": "array<int>", "invalid": "array<int>", "valid_ratio": "double", "verbatim_misattributed": "long", "verbatim_not_found": "long", "cited_chunk_ids": "array<string>", "claims": CLAIMS,
    "provenance": SOURCES, "from_cache": "boolean", "cache_kind": "string", "cache_similarity": "double", "matched_query": "string", "usage": USAGE, "raw": "string", "error": "string",
}
PASSED = ("query_id", "text", "proposed_route", "router_source", "router_error", "signals")


def _row(d: DataFrame, **given) -> DataFrame:
    """The columns of an answer: those that every exit passes on, those given, null."""
    given = {"from_cache": F.lit(False), "refused": F.lit(False), "uncertain": F.lit(False)} | {k: F.col(k) for k in PASSED} | given
    kinds = COLUMNS | {"query_id": d.schema["query_id"].dataType}  # a question keeps the type of its id
    return d.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def answered(
    spark: SparkSession, settings: Settings, c: Corpus, questions: DataFrame, vectors: DataFrame, generator: Generator | None = None,
    routes: DataFrame | None = None, caches: Caches | None = None, classifier=None,
) -> DataFrame:
    """One row of COLUMNS a question.

    questions (query_id, text), vectors (query_id, vector). routes may replace the lexical ones (columns of router.routed);
    a classifier may propose others. Routing comes before any cache, guards come before the provider is asked. A route whose
    tables are missing falls back to retrieval; proposed_route says so.
    """
    shared_dir(spark)
    generator, caches = generator or FirstSentence(), caches or Caches()
    r = routes if routes is not None else router.routed(questions)
    if classifier is not None and settings.router_enabled:
        r = router.agentic(r, classifier, _card_text(c))
    for name in ("source", "router_error"):
        r = r if name in r.columns else r.withColumn(name, F.lit("lexical" if name == "source" else None).cast("string"))
    names = [k for k in router.signals(F.lit("")) if k in r.columns]
    seen = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*names)) if names and settings.router_enabled else F.lit(None).cast("map<string,boolean>")
    r = r.withColumns({"signals": seen, "proposed_route": F.col("route"), "router_source": F.col("source")})
    there = {"structured": c.acts is not None, "meta": c.acts is not None or c.card is not None}
    lost = [k for k, v in there.items() if not v] if settings.router_enabled else list(router.ROUTES)
    r = r.withColumn("route", F.when(F.col("route").isin(lost), "pointwise").otherwise(F.col("route")) if lost else F.col("route"))
    known = (F.col("route") != "structured") | F.coalesce(F.col("intent").isin(*router.INTENTS), F.lit(False))
    r = r.withColumn("route", F.when(known, F.col("route")).otherwise("uncovered")).checkpoint()
    taken, out = {x["route"] for x in r.select("route").distinct().collect()}, _uncovered(r)  # four routes at most
    if "pointwise" in taken:
        out = out.unionByName(_pointwise(spark, settings, c, r, vectors, generator, caches))
    if "structured" in taken:
        out = out.unionByName(_structured(settings, c, r))
    return out.unionByName(_meta(settings, c, r, generator, caches)) if "meta" in taken else out


def _card_text(c: Corpus) -> str | None:
    return "\n\n".join(r["text"] for r in c.card.orderBy("section_no").collect()) if c.card is not None else None  # a few sections


def _uncovered(r: DataFrame) -> DataFrame:
    texts = F.create_map(*[F.lit(x) for k in structured.REFUSALS.items() for x in k])
    reason = F.coalesce("reason", F.lit(router.NO_AMOUNTS))
    text = F.coalesce(F.try_element_at(texts, reason), F.lit(structured.REFUSALS[router.NO_AMOUNTS]))
    return _row(r.where("route = 'uncovered'"), route=F.col("route"), refused=F.lit(True), reason=reason, answer=text)


def _structured(s: Settings, c: Corpus, r: DataFrame) -> DataFrame:
    own = r.where("route = 'structured'")
    if c.acts is None:
        return _row(own.where("false"))
    got = structured.answers(own, c.acts, s.structured_max_rows).withColumnRenamed("text", "said")
    d = own.join(got, "query_id", "left")
    return _row(d, route=F.col("route"), answer=F.col("said"), computed_value=F.col("computed_value"), gap=F.col("gap"), cited_chunk_ids=F.col("cited"))


def meta_passages(c: Corpus) -> DataFrame:
    """(n, chunk_id, source, content, in_index): the sections of the card and the computed statistics, as far as there are."""
    spark = c.chunks.sparkSession
    card = c.card if c.card is not None else spark.createDataFrame([], "section_no int, name string, text string")
    acts = c.acts if c.acts is not None else None
    if acts is None:
        return structured.meta_passages(card, spark.createDataFrame([], "comitato string, anno int, is_delibera boolean")).where("chunk_id <> 'scheda::perimetro'")
    return structured.meta_passages(card, acts)


def grounded(s: Settings, asked: DataFrame, passages: DataFrame, generator: Generator) -> DataFrame:
    """What a generator says of given passages, held against them.

    asked (query_id, text), passages (query_id, n, chunk_id, source, content). Returns query_id, raw, error, usage, answer,
    claims, valid, invalid, valid_ratio, verbatim_misattributed, verbatim_not_found, cited_chunk_ids. Output that breaks the contract gives its answer without claims.
    """
    raw = generated(asked.select("query_id", F.col("text").alias("question")).join(caching.numbered(passages), "query_id"), generator, s.item_retries, s.item_backoff_s).checkpoint()
    answer, claims = parsed(F.col("raw"))
    d = raw.withColumns({"answer": answer, "claims": claims})
    k = passages.groupBy("query_id").agg(F.count("*").cast("int").alias("k"), F.map_from_entries(F.collect_list(F.struct("n", "chunk_id"))).alias("ids"))
    listed = d.select("query_id", F.posexplode("claims").alias("claim_no", "c")).select("query_id", "claim_no", "c.verbatim", "c.passages")
    ratio = _spans(guards.check_claims(listed, passages, s.verbatim_min_chars))
    d = d.join(k, "query_id", "left").join(ratio, "query_id", "left")
    valid, invalid = guards.citations(F.coalesce("answer", F.lit("")), F.flatten(F.transform(F.coalesce("claims", F.array().cast(CLAIMS)), lambda x: x["passages"])), F.coalesce("k", F.lit(0)))
    d = d.withColumns({"valid": valid, "invalid": invalid})
    return d.withColumn("cited_chunk_ids", F.transform("valid", lambda x: F.try_element_at("ids", x))).drop("k", "ids")


def _spans(checked: DataFrame) -> DataFrame:
    """(query_id, valid_ratio, verbatim_misattributed, verbatim_not_found) of checked claims."""
    out = guards.verbatim_outcomes(checked)
    return out.select("query_id", "valid_ratio", F.col("n_misattributed").alias("verbatim_misattributed"), F.col("n_not_found").alias("verbatim_not_found"))


def parsed(raw: Column) -> tuple[Column, Column]:
    """(answer, claims) of raw output: by the contract, or the salvaged answer and no claims."""
    none = F.array().cast(CLAIMS)
    p = F.from_json(raw, OUTPUT)
    whole = F.coalesce(p["answer"].isNotNull() & F.forall(F.coalesce(p["claims"], none), lambda x: x["statement"].isNotNull()), F.lit(False))
    full = lambda x: F.struct(x["statement"].alias("statement"), F.coalesce(x["passages"], F.array().cast("array<int>")).alias("passages"), F.coalesce(x["verbatim"], F.lit("")).alias("verbatim"))
    return F.when(whole, p["answer"]).otherwise(T.salvaged(raw)), F.when(whole, F.transform(F.coalesce(p["claims"], none), full)).otherwise(none)


def cited(s: Settings, asked: DataFrame, passages: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, answer, used_markers, chunks_used, error): an answer with inline marks and no guard; nothing to read, a fixed text."""
    k = passages.groupBy("query_id").agg(F.count("*").cast("int").alias("k"))
    raw = generated(asked.select("query_id", F.col("text").alias("question")).join(caching.numbered(passages), "query_id"), generator, s.item_retries, s.item_backoff_s)
    d = asked.select("query_id").join(k, "query_id", "left").join(raw, "query_id", "left")
    answer = F.when(F.col("k").isNull(), NOTHING_FOUND).otherwise(F.coalesce("raw", F.lit("")))
    n = F.coalesce("k", F.lit(0))
    return d.select("query_id", answer.alias("answer"), caching.used_markers(answer, n).alias("used_markers"), n.alias("chunks_used"), "error")


def _meta(s: Settings, c: Corpus, r: DataFrame, generator: Generator, caches: Caches) -> DataFrame:
    own = r.where("route = 'meta'")
    if c.card is None and c.acts is None:
        return _row(own)
    passages = meta_passages(c).drop("in_index").checkpoint()  # a few sections, the same for every question
    every = own.select("query_id").join(F.broadcast(passages))
    kept = {k: F.col(k) for k in ("answer", "claims", "valid", "invalid", "valid_ratio", "verbatim_misattributed", "verbatim_not_found", "cited_chunk_ids", "usage", "raw", "error")}
    rest, hits = own, None
    if caches.meta is not None:
        found = caching.meta_lookup(own, caches.meta.drop("model", "corpus_version", "card_hash"), c.version, meta_card(c), s.model)
        found = caching.cached_lists(found).checkpoint()
        rest = own.join(found.select("query_id"), "query_id", "left_anti")
        # the claims of a stored answer are held against the passages of now
        listed = found.select("query_id", F.posexplode("claims").alias("claim_no", "x")).select("query_id", "claim_no", "x.verbatim", "x.passages")
        ratio = _spans(guards.check_claims(listed, every, s.verbatim_min_chars))
        marks = F.coalesce(F.from_json("cited_passages", "array<int>"), F.array().cast("array<int>"))
        hits = _row(
            found.join(ratio, "query_id", "left"), route=F.col("route"), answer=F.col("answer"), claims=F.col("claims"), valid=marks, valid_ratio=F.col("valid_ratio"), verbatim_misattributed=F.col("verbatim_misattributed"), verbatim_not_found=F.col("verbatim_not_found"),
            cited_chunk_ids=F.col("cited"), raw=F.col("raw"), from_cache=F.lit(True), cache_kind=F.lit("meta"),
        )
    said = grounded(s, rest.select("query_id", "text"), every.join(rest.select("query_id"), "query_id", "left_semi"), generator)
    whole = passages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n\n").alias("whole"))
    d = rest.join(said, "query_id", "left").join(F.broadcast(whole))
    # without a model's answer the passages themselves are the answer
    none = F.coalesce(F.nullif(F.col("whole"), F.lit("")), F.lit(structured.NO_CARD))
    out = _row(d, **kept | {"route": F.col("route"), "answer": F.coalesce(F.nullif(F.col("answer"), F.lit("")), none)})
    return out if hits is None else out.unionByName(hits)


def meta_card(c: Corpus) -> str:
    """What the card's text adds to the key of the meta cache."""
    return c.chunks.sparkSession.range(1).select(caching.card_hash(F.lit(_card_text(c)))).first()[0]


def _pointwise(spark: SparkSession, s: Settings, c: Corpus, r: DataFrame, vectors: DataFrame, generator: Generator, caches: Caches) -> DataFrame:
    own, served = r.where("route = 'pointwise'"), None
    if caches.semantic is not None:
        mine = vectors.join(own.select("query_id"), "query_id", "left_semi")
        entries = caches.semantic.withColumn("n", F.monotonically_increasing_id()).checkpoint()
        near = caching.semantic_lookup(mine, entries.select(F.col("n").alias("id"), "vector", "corpus_version"), c.version, s.cache_threshold)
        stored = caching.cached_lists(entries.select(F.col("n").alias("id"), F.col("query").alias("matched_query"), "answer", "cited", "claims"))
        found = own.join(near, "query_id").join(stored, "id").checkpoint()
        served = _row(
            found, route=F.lit("pointwise"), answer=F.col("answer"), claims=F.col("claims"), cited_chunk_ids=F.col("cited"), from_cache=F.lit(True),
            cache_kind=F.lit("semantic"), cache_similarity=F.col("similarity"), matched_query=F.col("matched_query"),
        )
        own = own.join(found.select("query_id"), "query_id", "left_anti")
    own = own.checkpoint()
    rows = c.chunks.select("id", "vector", F.col("content").alias("text"))
    asked = own.select("query_id", "text")
    hits = retrieval.hybrid(vectors.join(asked.select("query_id"), "query_id", "left_semi"), rows, asked, rows, s.top_k, index=c.postings, weights=(s.vector_weight, s.keyword_weight), constant=s.rrf_constant).checkpoint()
    passages = caching.passages_of(hits, c.chunks, s.top_k).checkpoint()
    sup = retrieval.support(hits, asked, s.support_threshold).withColumnsRenamed({"refused": "unsupported", "reason": "why"})
    docs = c.chunks.select(F.col("content").alias("text"))
    lacking = guards.missing_terms(asked, passages).checkpoint()
    signal = guards.abstention(asked, lacking, c.term_df if c.term_df is not None else corpus.term_df(docs, lacking), docs.count())
    terms = lacking.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("missing_terms"))
    state = own.join(sup, "query_id").join(signal, "query_id").join(terms, "query_id", "left").checkpoint()
    # the provider is asked only for what no guard before it stops
    open_ = state.where(~F.col("unsupported") & ((F.lit(s.abstention_threshold) <= 0) | (F.col("signal") < s.abstention_threshold)))
    said = grounded(s, open_.select("query_id", "text"), passages, generator).checkpoint()
    sources = _sources(s, c, said, passages)
    about = passages.groupBy("query_id").agg(F.count("*").cast("int").alias("k"), F.array_sort(F.collect_list(F.struct("n", "source"))).alias("p"))
    d = state.join(said, "query_id", "left").join(about, "query_id", "left")
    d = d.join(sources, "query_id", "left") if sources is not None else d.withColumns({"note": F.lit(None).cast("string"), "sources": F.lit(None).cast(SOURCES)})
    outcome = guards.decision(F.col("support"), F.coalesce("k", F.lit(0)), F.col("signal"), F.col("valid_ratio"), s.support_threshold, s.abstention_threshold, s.verbatim_min_ratio if s.verbatim_enabled else 0.0)
    d = d.withColumn("outcome", outcome)
    named = F.array_join(F.slice(F.array_distinct(F.transform("p", lambda x: x["source"])), 1, 5), "; ")
    unsure = F.concat(F.lit(UNSURE_TERMS[0]), F.coalesce(F.nullif(named, F.lit("")), F.lit("nessun documento")), F.lit(UNSURE_TERMS[1]))
    fine, doubt = F.col("outcome") == "answered", F.startswith("outcome", F.lit("uncertain"))
    text = F.when(F.col("outcome") == "refused", REFUSED).when(F.col("outcome") == "uncertain:verbatim", UNSURE_VERBATIM).when(doubt, unsure).otherwise(
        F.when(F.col("note").isNull(), F.col("answer")).otherwise(F.concat(F.col("answer"), F.lit("\n\n"), F.col("note")))
    )
    out = _row(
        d, route=F.lit("pointwise"), refused=F.col("outcome") == "refused", uncertain=doubt, reason=F.coalesce(F.when(doubt, F.substring_index("outcome", ":", -1)), F.col("why")),
        answer=text, support=F.col("support"), signal=F.col("signal"), missing_terms=F.col("missing_terms"), valid=F.when(fine, F.col("valid")), invalid=F.when(fine, F.col("invalid")),
        valid_ratio=F.col("valid_ratio"), verbatim_misattributed=F.col("verbatim_misattributed"), verbatim_not_found=F.col("verbatim_not_found"), cited_chunk_ids=F.when(fine, F.col("cited_chunk_ids")), claims=F.when(fine, F.col("claims")), provenance=F.when(fine, F.col("sources")),
        cache_kind=F.when(F.col("usage.cached_tokens") > 0, "provider"), usage=F.col("usage"), raw=F.col("raw"), error=F.col("error"),
    )
    return out if served is None else out.unionByName(served)


def _sources(s: Settings, c: Corpus, said: DataFrame, passages: DataFrame) -> DataFrame | None:
    """(query_id, note, sources) of recurring sources behind the claims; None without their indexes."""
    if not s.provenance_enabled or c.phrases is None:
        return None
    n = c.chunks.select("source").distinct().count()
    least = max(s.phrase_min_documents, round(s.provenance_min_quota * n))
    norms = c.norms if c.norms is not None else c.chunks.sparkSession.createDataFrame([], "label string, n_documents long")
    claims = said.select("query_id", F.posexplode("claims").alias("claim_no", "c")).select("query_id", "claim_no", "c.verbatim", "c.passages")
    return guards.notes(guards.provenance(guards.best_sentences(claims, passages), c.phrases, norms, least), n)


def stored(answers: DataFrame, vectors: DataFrame, c: Corpus, caches: Caches, model: str = "") -> Caches:
    """The caches after these answers: what came from one and what was refused is not stored again."""
    new, as_json = answers.where(~F.col("from_cache")), lambda x: F.to_json(F.coalesce(x, F.array().cast("array<string>")))
    claims = F.to_json(F.coalesce("claims", F.array().cast(CLAIMS)))
    out = replace(caches)
    if caches.semantic is not None:
        own = caching.storable(new.where("route = 'pointwise' AND answer IS NOT NULL AND error IS NULL")).join(vectors, "query_id")
        rows = own.select(F.col("text").alias("query"), "vector", F.lit(c.version).alias("corpus_version"), "answer", as_json(F.col("cited_chunk_ids")).alias("cited"), claims.alias("claims"), F.current_timestamp().alias("stored_at"))
        out.semantic = caching.semantic_store(caches.semantic, rows)
    if caches.meta is not None:
        own = new.where("route = 'meta' AND raw IS NOT NULL")
        marks = F.to_json(F.coalesce("valid", F.array().cast("array<int>")))
        rows = own.select(
            F.col("text").alias("query"), F.lit(model).alias("model"), F.lit(c.version).alias("corpus_version"), F.lit(meta_card(c)).alias("card_hash"), "answer", claims.alias("claims"),
            marks.alias("cited_passages"), as_json(F.col("cited_chunk_ids")).alias("cited"), "raw",
        )
        out.meta = caching.meta_store(caches.meta, rows)
    return out


def evaluated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics by condition, counts by category) of scored rows."""
    return evaluation.metrics(rows), evaluation.by_category(rows)


#: Metrics of a report, in order: label, column, whether it is a share.
SHOWN = (
    ("Accuratezza del rifiuto", "refusal_accuracy", True), ("Validità delle citazioni", "citation_validity", True), ("Citazioni invalide", "invalid_citation_total", False), ("Risposte troncate", "n_truncated", False),
    ("Hit della cache semantica", "semantic_hit_rate", True), ("Hit della cache del provider", "provider_hit_rate", True), ("Risposte", "n_answered", False), ("Astensioni", "n_uncertain", False), ("Rifiuti", "n_refused", False),
    ("Chiamate al modello", "model_calls", False), ("Token di prompt", "prompt_tokens", False), ("Token in cache", "cached_tokens", False), ("Token generati", "completion_tokens", False), ("Costo", "cost", False),
    ("Latenza mediana (s)", "latency_median", False), ("Latenza media (s)", "latency_avg", False), ("Latenza massima (s)", "latency_max", False),
)
ROUTED = (
    ("Accuratezza di routing", "routing_accuracy", True), ("Richiamo del router", "router_recall", True), ("Falsi positivi del router", "router_false_positive", True), ("Valori calcolati corretti", "structured_value_accuracy", True),
    ("Risposte calcolate", "n_structured", False), ("Rifiuti dichiarati", "n_uncovered", False), ("Risposte sulla raccolta", "n_meta", False), ("Con nota di provenienza", "n_provenance", False), ("Dalla cache meta", "n_cache_meta", False),
    ("Router agentico: chiamate", "router_llm_calls", False), ("Router agentico: decisioni", "router_llm_decisions", False), ("Router agentico: fallite", "router_llm_failed", False), ("Verbatim validi", "verbatim_valid_ratio", True),
    ("Span misattribuiti", "verbatim_misattributed", False), ("Span non trovati", "verbatim_not_found", False),
)


def report(metrics: list[dict], categories: list[dict], settings: Settings | None = None, version: str = "", errors: list[dict] | None = None) -> str:
    """Markdown of two conditions side by side, of the routes and of every category; rows are what evaluated() gives, collected.

    errors: (id, condition, error) of the items that no provider served.
    """
    by = {m["condition"]: m for m in metrics}
    off, on = by.get("off", {}), by.get("on", {})
    show = lambda m, k, share: "—" if m.get(k) is None else f"{m[k] * 100:.1f}%" if share else str(m[k])
    lines = ["# Cache spenta e accesa"]
    if settings:
        priced = any((settings.price_input, settings.price_output, settings.price_cached))
        lines += ["", f"- modello {settings.model or '—'}, embedding {settings.embed_model or '—'} ({settings.embed_dim})", f"- corpus {version or '—'}", f"- chunk {settings.chunk_tokens}/{settings.chunk_overlap_ratio}, top_k {settings.top_k}, pesi {settings.vector_weight}/{settings.keyword_weight}"]
        lines += [f"- soglie: supporto {settings.support_threshold}, cache {settings.cache_threshold}, astensione {settings.abstention_threshold}", f"- prezzi: {'configurati' if priced else 'non configurati, il costo è zero'}"]
    for title, rows in (("", SHOWN), ("## Instradamento e provenienza", ROUTED)):
        lines += ["", *([title, ""] if title else []), "| metric | off | on |", "|---|---|---|"]
        lines += [f"| {label} | {show(off, k, share)} | {show(on, k, share)} |" for label, k, share in rows if k in off or k in on]
    told = {k for _, k, _ in (*SHOWN, *ROUTED)} | {"condition"}
    lines += ["", "| metric | off | on |", "|---|---|---|", *[f"| {k} | {off.get(k, '—')} | {on.get(k, '—')} |" for k in (off or on) if k not in told]]
    lines += ["", "| condition | category | n | answers | abstentions | refusals |", "|---|---|---|---|---|---|"]
    lines += [f"| {c['condition']} | `{c['category']}` | {c['n']} | {c['answers']} | {c['abstentions']} | {c['refusals']} |" for c in sorted(categories, key=lambda c: (c["condition"], c["category"]))]
    if errors:
        kinds = ", ".join(sorted({e["error"] for e in errors}))
        lines += ["", f"Incomplete run: {len(errors)} questions not served ({kinds}): {', '.join(sorted({str(e['id']) for e in errors}))}. They stand outside every share above."]
    if any(abs(m.get("suspend_drift_s") or 0) > 60 for m in metrics):
        lines += ["", "Wall clock and monotonic clock differ by over a minute: the machine slept, read the medians."]
    return "\n".join(lines)
