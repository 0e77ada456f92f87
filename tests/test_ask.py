"""Questions end to end: every exit of the route, both caches, the classifier and the provenance note."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import caching, guards, router, structured
from tessera.plans import ask
from tessera.providers import OUTPUT_SCHEMA, Rejected, SchemaGenerator, Unavailable, client, usage_of

PHRASE = "Vista la legge 27 febbraio 1967, n. 48, recante attribuzioni e ordinamento del ministero del bilancio."
SETTINGS = Settings(top_k=3, support_threshold=0.5, abstention_threshold=3.0, verbatim_min_chars=20, phrase_min_documents=2, structured_max_rows=2, item_backoff_s=0.0, item_retries=0, model="m")


def Quoting(spans=None, down=False):
    class Own:  # made here, so that it travels to the workers whole
        def generate(self, question, context):
            if down:
                raise Unavailable("429")
            blocks = [b.split("\n", 1)[1] for b in context.split("\n\n---\n\n")]
            given = spans or [blocks[0]]
            claims = [{"statement": "s", "passages": [1], "verbatim": x} for x in given]
            return json.dumps({"answer": "Ecco [1] [9]", "claims": claims}, ensure_ascii=False), {"prompt_tokens": 7, "completion_tokens": 2, "cached_tokens": 3}

    return Own()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, f"{PHRASE} Il comitato approva il progetto numero {k} della ferrovia." if k < 4 else f"Testo {k} sopra altro.", f"doc{k % 6}", [1.0, 0.0] if k < 4 else [0.0, 1.0]) for k in range(8)]
    chunks = spark.createDataFrame(rows, "id long, content string, source string, vector array<double>")
    acts = [("CIPE", 2019, n, f"Delibera {n}", f"a/{n}", True) for n in (1, 2, 5)] + [("CIPESS", 2021, 7, "Delibera 7", "a/7", True), (None, None, None, "x", "x", False)]
    acts = spark.createDataFrame(acts, "comitato string, anno int, numero int, title string, path string, is_delibera boolean")
    card = spark.createDataFrame([(1, "01-intro", "La raccolta contiene le delibere del comitato."), (2, "02-blank", " ")], "section_no int, name string, text string")
    from tessera.operators import corpus as tables

    docs = chunks.select(F.col("source").alias("doc_id"), F.col("content").alias("text"))
    return ask.Corpus(chunks, acts, card, tables.phrase_index(docs, 2).checkpoint(), tables.norm_index(docs, 2).checkpoint(), version="v1")


def asked(spark, texts, near=True):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return q, q.select("query_id", F.array(F.lit(1.0 if near else -1.0), F.lit(0.0)).alias("vector"))


def run(spark, c, texts, settings=SETTINGS, near=True, **how):
    return {r["query_id"]: r for r in ask.answered(spark, settings, c, *asked(spark, texts, near), **how).collect()}


def test_spans_are_counted_by_outcome(spark, corpus):
    """One span of a passage, one that stands nowhere, one of a passage it isn't said to be from."""
    first, other = "Il comitato approva il progetto numero 0 della ferrovia.", "Il comitato approva il progetto numero 1 della ferrovia."
    got = run(spark, corpus, ["progetto della ferrovia"], SETTINGS.with_overrides(verbatim_min_ratio=0.0), generator=Quoting([first, "parole che non stanno in alcun passaggio", other]))[0]
    assert (got["verbatim_misattributed"], got["verbatim_not_found"]) == (1, 1) and abs(got["valid_ratio"] - 1 / 3) < 1e-9


def test_computed_answers(spark, corpus):
    got = run(spark, corpus, ["Quante delibere nel 2019?", "Elenca le delibere del CIPE nel 2019", "delibere per anno, quante sono", "quante delibere nel 1999", "quante delibere nel 2019 e nel 2021", "quanto speso in totale"])
    assert "**3 delibere** nel 2019." in got[0]["answer"] and "arriva alla n. 5: 2 delibere mancano" in got[0]["answer"] and got[0]["gap"] == 2 and got[0]["computed_value"] == 3
    assert "- Delibera 1 (`a/1`)\n- Delibera 2 (`a/2`)" in got[1]["answer"] and "(…altre 1 non" in got[1]["answer"] and got[1]["cited_chunk_ids"] == ["a/1", "a/2", "a/5"]
    assert "- 2019: 3\n- 2021: 1" in got[2]["answer"]
    assert "nessuna delibera nel 1999" in got[3]["answer"] and not got[3]["refused"]
    assert got[4]["refused"] and got[4]["reason"] == router.MANY_YEARS and got[5]["reason"] == router.NO_AMOUNTS and got[5]["answer"] == structured.REFUSALS[router.NO_AMOUNTS]
    assert all(r["proposed_route"] and r["signals"]["forma_conteggio"] is not None and r["router_source"] == "lexical" for r in got.values())


def test_an_answer_and_its_provenance(spark, corpus):
    got = run(spark, corpus, ["approva il progetto della ferrovia"], generator=Quoting([PHRASE]))[0]
    assert got["valid"] == [1] and got["invalid"] == [9] and got["valid_ratio"] == 1.0 and got["usage"]["total_tokens"] == 0 and got["cache_kind"] == "provider"
    assert got["answer"].startswith("Ecco [1] [9]\n\n**Provenienza.** L'affermazione poggia sul richiamo a **legge 27 febbraio 1967, n. 48**, che ne è la fonte: ricorre in 4 delle 6 delibere indicizzate. Il passaggio citato in [1] è uno di quelli")
    assert got["provenance"][0]["n_documents"] == 4
    off = run(spark, corpus, ["approva il progetto della ferrovia"], SETTINGS.with_overrides(provenance_enabled=False), generator=Quoting([PHRASE]))[0]
    assert off["answer"] == "Ecco [1] [9]" and off["provenance"] is None


def test_guards_decline_in_words(spark, corpus):
    far = run(spark, corpus, ["approva il progetto"], near=False)[0]
    assert far["refused"] and far["answer"] == ask.REFUSED and far["raw"] is None and "support_score" in far["reason"]
    odd = run(spark, corpus, ["approva la zootecnia"], SETTINGS.with_overrides(abstention_threshold=1.0))[0]
    assert odd["uncertain"] and odd["reason"] == "termini_mancanti" and odd["missing_terms"] == ["zootecnia"] and "doc0; doc1; doc2" in odd["answer"] and odd["raw"] is None and odd["usage"] is None
    loose = run(spark, corpus, ["approva il progetto"], SETTINGS.with_overrides(verbatim_min_ratio=0.5), generator=Quoting(["parole che non stanno da nessuna parte"]))[0]
    assert loose["uncertain"] and loose["reason"] == "verbatim" and loose["answer"] == ask.UNSURE_VERBATIM and loose["usage"]["prompt_tokens"] == 7 and loose["claims"] is None
    down = run(spark, corpus, ["approva il progetto"], generator=Quoting(down=True))[0]
    assert down["error"] == "429" and not down["refused"]


def test_the_semantic_cache(spark, corpus):
    caches = ask.Caches(semantic=spark.createDataFrame([], caching.SEMANTIC))
    texts = ["approva il progetto della ferrovia", "quante delibere nel 2019"]
    q, v = asked(spark, texts)
    first = ask.answered(spark, SETTINGS, corpus, q, v, Quoting([PHRASE]), caches=caches).checkpoint()
    assert not any(r["from_cache"] for r in first.collect())
    caches = ask.stored(first, v, corpus, caches, "m")
    assert caches.semantic.count() == 1  # computed answers are not stored
    again = {r["query_id"]: r for r in ask.answered(spark, SETTINGS, corpus, q, v, Quoting(["x"]), caches=caches).collect()}
    assert again[0]["from_cache"] and again[0]["cache_kind"] == "semantic" and again[0]["matched_query"] == texts[0] and "Provenienza" in again[0]["answer"] and again[0]["claims"][0]["verbatim"] == PHRASE
    assert not again[1]["from_cache"]
    other = ask.answered(spark, SETTINGS, ask.Corpus(corpus.chunks, version="v2"), q, v, Quoting(["x"]), caches=caches).where("query_id = 0").first()
    assert not other["from_cache"]


def test_questions_about_the_collection(spark, corpus):
    caches, text = ask.Caches(meta=spark.createDataFrame([], caching.META)), "di cosa parla il corpus?"
    q, v = asked(spark, [text])
    said = ask.answered(spark, SETTINGS, corpus, q, v, Quoting(["La raccolta contiene le delibere del comitato."]), caches=caches).checkpoint()
    r = said.first()
    assert r["route"] == "meta" and r["answer"] == "Ecco [1] [9]" and r["valid"] == [1] and r["valid_ratio"] == 1.0 and r["cited_chunk_ids"] == ["scheda::01-intro"]
    caches = ask.stored(said, v, corpus, caches, "m")
    hit = ask.answered(spark, SETTINGS, corpus, *asked(spark, ["  DI cosa parla  il corpus?"]), Quoting(["altro testo che nessuno ha scritto"]), caches=caches).first()
    assert hit["from_cache"] and hit["cache_kind"] == "meta" and hit["answer"] == "Ecco [1] [9]" and hit["valid"] == [1] and hit["valid_ratio"] == 1.0 and hit["error"] is None
    changed = ask.Corpus(corpus.chunks, corpus.acts, corpus.card.withColumn("text", F.concat("text", F.lit("!"))), version="v1")
    assert not ask.answered(spark, SETTINGS, changed, q, v, Quoting(), caches=caches).first()["from_cache"]
    down = ask.answered(spark, SETTINGS, corpus, q, v, Quoting(down=True), caches=ask.Caches()).first()
    assert down["answer"].startswith("La raccolta contiene le delibere del comitato.\n\nPerimetro indicizzato: 4 delibere") and structured.COMPUTED in down["answer"]
    alone = ask.answered(spark, SETTINGS, ask.Corpus(corpus.chunks, corpus.acts), q, v, Quoting(down=True)).first()
    assert alone["route"] == "meta" and alone["answer"].startswith("Perimetro")
    bare = ask.answered(spark, SETTINGS, ask.Corpus(corpus.chunks), q, v, Quoting()).first()
    assert bare["route"] == "pointwise" and bare["proposed_route"] == "meta"


def Saying(replies):
    class Own:
        def classify(self, prompt, question):
            if question not in replies:
                raise ValueError("no reply")
            return replies[question]

    return Own()


def test_a_classifier_proposes(spark, corpus):
    texts = ["ne ha fatti tanti il comitato nel 2021", "cosa dice la delibera n. 75/2021", "testo libero", "altro", "ancora", "e poi"]
    replies = {
        texts[0]: '{"route":"structured","intent":"count_delibere","params":{"anno":2021}}', texts[1]: '{"route":"meta"}', texts[2]: "{no", texts[3]: '{"route":"elsewhere"}', texts[4]: "[1]",
    }
    got = run(spark, corpus, texts, classifier=Saying(replies))
    assert got[0]["route"] == "structured" and got[0]["router_source"] == "llm" and "**1 delibera** nel 2021" in got[0]["answer"]
    assert got[1]["route"] == "pointwise" and got[1]["router_error"] is None and got[1]["router_source"] == "lexical"
    assert [got[k]["router_error"] for k in (2, 3, 4, 5)] == ["JSON non parsabile", "route fuori insieme: elsewhere", "proposta non è un oggetto", "chiamata fallita: ValueError"]
    assert all(got[k]["route"] == "pointwise" for k in (2, 3, 4, 5))


def test_router_off_and_bad_intents(spark, corpus):
    off = run(spark, corpus, ["quante delibere nel 2019"], SETTINGS.with_overrides(router_enabled=False))[0]
    assert off["route"] == "pointwise" and off["signals"] is None
    q, v = asked(spark, ["quante delibere nel 2019"])
    odd = router.routed(q).withColumn("intent", F.lit("sum"))
    r = ask.answered(spark, SETTINGS, corpus, q, v, routes=odd).first()
    assert r["route"] == "uncovered" and r["proposed_route"] == "structured" and r["refused"]


def test_the_output_contract(spark):
    rows = spark.createDataFrame([('{"answer":"a [1]","claims":[{"statement":"s","passages":[1]}]}',), ('{"answer":"a","claims":[{"passages":[1]}]}',), ('{"claims":[]}',), ('{"answer":"half',), (None,)], "raw string")
    answer, claims = ask.parsed(F.col("raw"))
    got = [(r["a"], [tuple(c) for c in r["c"]]) for r in rows.select(answer.alias("a"), claims.alias("c")).collect()]
    assert got == [("a [1]", [("s", [1], "")]), ("a", []), ('{"claims":[]}', []), ("half", []), (None, [])]


def test_a_provider_that_rejects_the_schema_is_asked_for_plain_json():
    kinds = []

    def call(messages, kind, key):
        kinds.append((kind["type"], key, messages[0]["content"]))
        if kind is OUTPUT_SCHEMA:
            raise Rejected
        return "{}", None

    assert SchemaGenerator(call, "v1").generate("q", "c") == ("{}", None) and [k[0] for k in kinds] == ["json_schema", "json_object"] and kinds[0][2] == kinds[1][2]
    with pytest.raises(Unavailable):
        SchemaGenerator(lambda *_: (_ for _ in ()).throw(Unavailable())).generate("q", "c")
    assert client(None, dict) is None and client(" ", dict) is None and client("k", lambda *a: a) == ("k", 60.0, 4)
    assert usage_of(None) is None and usage_of({"prompt_tokens": 3}) == {"prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 0, "cached_tokens": 0}


def test_cited_answers_without_guards(spark, corpus):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    p = spark.createDataFrame([(1, 1, "c", "s", "testo")], "query_id long, n int, chunk_id string, source string, content string")
    got = {r["query_id"]: r for r in ask.cited(SETTINGS, q, p, Quoting()).collect()}
    assert got[2]["answer"] == ask.NOTHING_FOUND and got[2]["chunks_used"] == 0 and got[1]["used_markers"] == [1]


def test_notes_of_several_sources(spark):
    rows = [(1, "frase", "k1", "s1", 9, [1, 3], [], (0, 1)), (1, "norma", "k2", "s2", 12, [2], ["legge x"], (1, 2)), (1, "frase", "k3", "s3", 4, [1], None, (2, 1)), (2, "frase", "k", "s", 3, [1, 2], [], (0, 1)), (2, "frase", "j", "s", 3, [1], [], (0, 2))]
    d = spark.createDataFrame(rows, "query_id long, kind string, key string, sentence string, n_documents long, passages array<int>, norms array<string>, first struct<claim_no:int,n:int>")
    got = {r["query_id"]: r["note"] for r in guards.notes(d, 50).collect()}
    assert got[1] == (
        "**Provenienza.** L'affermazione poggia sul richiamo a **legge x**, che ne è la fonte: ricorre in 12 delle 50 delibere indicizzate. Il passaggio citato in [2] è uno di quelli — "
        "gli altri la riportano nei medesimi termini, e la risposta non cambia. La risposta poggia anche su altre 2 formule ricorrenti (fino a 9 delibere)."
    )
    assert "su una formula che ricorre in 3 delle 50" in got[2] and "I passaggi citati in [1][2] sono fra quelli" in got[2] and "un'altra formula ricorrente (fino a 3 delibere)" in got[2]


def test_two_conditions_of_one_run(spark, corpus, tmp_path):
    from tessera.plans import run_eval
    from tessera.sources import files

    texts = ["approva il progetto della ferrovia", "approva il progetto della ferrovia ora", "quante delibere nel 2019", "quanto speso in totale"]
    q, v = asked(spark, texts)
    q = q.withColumn("seq", F.col("query_id") + 1)
    items = spark.createDataFrame([(0, "in", False, "pointwise", None), (1, "in", False, "pointwise", None), (2, "agg", False, "structured", 3), (3, "agg", True, "uncovered", None)], "query_id long, category string, expect_refuse boolean, route_expected string, expected_value long")
    off, on = (d.checkpoint() for d in run_eval.conditions(spark, SETTINGS, corpus, q, v, items, Quoting([PHRASE])))
    assert off.where("from_cache_semantic").count() == 0
    hit = on.where("from_cache_semantic").collect()
    assert [(r["query_id"], r["matched_query"], r["prompt_tokens"], r["valid"]) for r in hit] == [(1, texts[0], 0, None)]
    m = {r["condition"]: r.asDict() for d in (off, on) for r in ask.evaluated(d)[0].collect()}
    assert m["off"]["routing_accuracy"] == 1.0 and m["off"]["refusal_accuracy"] == 1.0 and m["off"]["structured_value_accuracy"] == 1.0 and m["off"]["model_calls"] == 2 and m["on"]["model_calls"] == 1
    categories = [r.asDict() for d in (off, on) for r in ask.evaluated(d)[1].collect()]
    text = ask.report(list(m.values()), categories, SETTINGS, "v1", [{"id": "x", "condition": "off", "error": "429"}])
    assert "| Accuratezza di routing | 100.0% | 100.0% |" in text and "| Hit della cache semantica | 0.0% | 25.0% |" in text and "1 questions not served (429): x" in text
    out = run_eval.run(spark, SETTINGS, corpus, q, v, items, str(tmp_path / "eval"), Quoting([PHRASE]))
    assert open(out["report"]).read().startswith("# Cache spenta e accesa") and out["run_id"].startswith("eval-")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["table"]).count() == 8 and files.audit(spark, out["audit"]).where("cache_enabled").count() == 4
