import pytest
from pyspark.sql import functions as F

from tessera.config import Settings, check_weights
from tessera.operators import caching, corpus, evaluation, guards, retrieval, router, structured


def test_windows(spark):
    n = spark.createDataFrame([(k,) for k in (0, 1, 9, 10, 11, 18, 19, 26)], "n int")
    got = {r["n"]: list(r["w"]) for r in n.select("n", corpus.window_starts(F.col("n"), 10, 2).alias("w")).collect()}
    assert got == {0: [], 1: [0], 9: [0], 10: [0], 11: [0, 8], 18: [0, 8], 19: [0, 8, 16], 26: [0, 8, 16]}


def test_chunks_share_words_and_skip_empty_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(25))), (2, ""), (3, None)], "doc_id long, text string")
    got = corpus.chunks(docs, 10, 2).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == ["1::0", "1::1", "1::2"] and got[1]["content"].startswith("w8 w9 ") and got[2]["end_index"] == 25


def test_token_chunks_agree_with_words(spark):
    class Words:
        def encode(self, text):
            self.words = text.split()
            return list(range(len(self.words)))

        def decode(self, ids):
            return " ".join(self.words[k] for k in ids)

    docs = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(25))), ("b", "uno"), ("c", None)], "doc_id string, text string")
    assert sorted(corpus.token_chunks(docs, Words(), 10, 2).collect()) == sorted(corpus.chunks(docs, 10, 2).collect())


def test_phrase_index_counts_documents(spark):
    s = "La legge istitutiva del comitato ricorre in molti documenti diversi."
    docs = spark.createDataFrame([(1, f"{s} {s}"), (2, s), (3, "Altro testo che non ricorre da nessuna parte nel corpus.")], "doc_id long, text string")
    got = corpus.phrase_index(docs, 2).collect()
    assert [(r["n_documents"], r["n_occurrences"]) for r in got] == [(2, 3)] and corpus.phrase_index(docs, 3).count() == 0


def test_mandatory_join_raises(spark):
    rows, docs = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, "t")], "doc_id long, title string")
    with pytest.raises(Exception, match="no document"):
        corpus.with_metadata(rows, docs).collect()


def test_char_windows_advance():
    text = "parola " * 500
    spans = corpus.char_windows(text, 100, 30)
    assert spans[0] == (0, 97 + 0) or spans[0][1] <= 100
    assert all(b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == len(text)
    assert corpus.char_windows("x" * 250, 100, 100)[-1][1] == 250 and corpus.char_windows("", 10, 2) == []


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, id long, score double, rank int")


def test_fusion(spark):
    v, k = hits(spark, (1, 10, 0.9, 1), (1, 11, 0.8, 2)), hits(spark, (1, 11, 1.0, 1), (1, 12, 0.5, 2))
    got = [(r["id"], round(r["score"], 6)) for r in retrieval.fused(v, k).orderBy("rank").collect()]
    assert got == [(11, round(0.7 / 62 + 0.3 / 61, 6)), (10, round(0.7 / 61, 6)), (12, round(0.3 / 62, 6))]
    got = {r["id"]: round(r["score"], 6) for r in retrieval.fused(v, k, "weighted").collect()}
    assert got == {10: 0.7, 11: 0.3, 12: 0.0}
    none = hits(spark).limit(0)
    assert retrieval.fused(none, k).count() == 2 and retrieval.fused(none, none).count() == 0


def test_normalisation_of_equal_scores(spark):
    same = hits(spark, (1, 1, 0.5, 1), (1, 2, 0.5, 2))
    assert [r["norm"] for r in retrieval.normalised(same, "min_max").collect()] == [1.0, 1.0]
    assert [r["norm"] for r in retrieval.normalised(same, "z_score").collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="normalisation"):
        retrieval.normalised(same, "other")


def test_vector_blocks_give_the_same_hits(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id long, vector array<double>")
    q = rows.where("id < 9").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(q, rows, 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    assert sorted(map(tuple, retrieval.vector_topk(q, rows, 4).collect())) == want


def test_blank_keyword_query_has_no_hits(spark):
    docs = spark.createDataFrame([(1, "delibera ferroviaria"), (2, "altro testo")], "id long, text string")
    q = spark.createDataFrame([(1, "  "), (2, "ferroviaria?!"), (3, None)], "query_id long, text string")
    got = retrieval.keyword_topk(q, docs, 5).collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [(2, 1, 1.0)]


def test_support_of_no_hits_is_a_refusal(spark):
    h = spark.createDataFrame([(1, 5, 0.9)], "query_id long, id long, vector_score double")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: (r["refused"], r["reason"]) for r in retrieval.support(h, q, 0.55).collect()}
    assert got == {1: (False, None), 2: (True, "support_score 0.000 < soglia 0.550")}


def test_abstention_without_statistics_is_zero(spark):
    q = spark.createDataFrame([(1, "ferrovia dolomiti"), (2, "testo")], "query_id long, text string")
    p = spark.createDataFrame([(1, "la ferroviaria"), (2, "testo")], "query_id long, content string")
    m = guards.missing_terms(q, p)
    assert [(r["query_id"], r["term"]) for r in m.collect()] == [(1, "dolomiti")]
    assert {r["signal"] for r in guards.abstention(q, m, None, 100).collect()} == {0.0}


def test_claims(spark):
    p = spark.createDataFrame([(1, 1, "La spesa è di dieci milioni di euro per la scuola."), (1, 2, "Il piano è approvato dal comitato nella seduta di ieri.")], "query_id long, n int, content string")
    c = spark.createDataFrame([(1, 1, "«La spesa è di dieci milioni»", [1]), (1, 2, "Il piano è approvato dal comitato", [1]), (1, 3, "mai scritto da nessuna parte qui", [2]), (1, 4, "breve", [1]), (1, 5, "…", [1]), (1, 6, "La spesa è di dieci milioni di euro per la scuola.", [2, 1, 9])], "query_id long, claim_no int, verbatim string, passages array<int>")
    got = {r["claim_no"]: (r["outcome"], r["matched_passage"]) for r in guards.check_claims(c, p, 10).collect()}
    assert got == {1: ("valido", 1), 2: ("misattribuito", 2), 3: ("non_trovato", None), 4: ("troppo_corto", None), 5: ("troppo_corto", None), 6: ("valido", 1)}
    r = guards.verbatim_outcomes(guards.check_claims(c, p, 10)).first()
    assert (r["n_claims"], r["n_valid"], round(r["valid_ratio"], 3), r["span_boundary_ratio"]) == (6, 2, 0.333, 0.5)
    assert guards.check_claims(c.where("claim_no = 5"), p, 0).first()["outcome"] == "troppo_corto"


def test_provenance_prefers_sentences_and_respects_figures(spark):
    law = "Vista la legge 27 febbraio 1967, n. 48, recante attribuzioni e ordinamento del ministero del bilancio"
    docs = spark.createDataFrame([(k, f"{law}; Numero {k}") for k in range(5)], "doc_id long, text string")
    p = spark.createDataFrame([(1, 1, f"{law}; Altro"), (2, 1, law + " e istituzione di un comitato per la programmazione economica nazionale")], "query_id long, n int, content string")
    c = spark.createDataFrame([(1, 1, "legge 27 febbraio 1967, n. 48, recante atribuzioni e ordinamento", [1]), (2, 1, "legge 27 febbraio 1967, n. 48, recante attribuzioni e istituzione del comitato", [1]), (2, 2, "due parole", [1])], "query_id long, claim_no int, verbatim string, passages array<int>")
    best = guards.best_sentences(c, p)
    assert best.count() == 2
    got = {r["query_id"]: (r["kind"], r["n_documents"]) for r in guards.provenance(best, corpus.phrase_index(docs, 3), corpus.norm_index(docs, 3), 3).collect()}
    assert got == {1: ("frase", 5), 2: ("norma", 5)}


@pytest.mark.parametrize(("text", "route", "intent"), [
    ("Quante delibere nel 2019?", "structured", "count_delibere"), ("Elenca le delibere del CIPE", "structured", "list_delibere"), ("quante delibere per anno", "structured", "count_by_year"),
    ("cosa dice la delibera 47", "pointwise", None), ("quanti chilometri", "uncovered", None), ("quanto è stato speso", "uncovered", None), ("di cosa parla l'archivio", "meta", None),
    ("di cosa parlano le delibere", "pointwise", None), ("quante delibere nel 2015 e nel 2023", "uncovered", None), ("quante delibere dal 2019 al 2021 e nel 2020", "uncovered", None), ("", "pointwise", None),
])
def test_routes(spark, text, route, intent):
    r = router.routed(spark.createDataFrame([(1, text)], "query_id long, text string")).first()
    assert (r["route"], r["intent"]) == (route, intent)


def acts(spark):
    return spark.createDataFrame([(2019, 1, "CIPE", "t1", "p1", True), (2019, 3, "CIPE", "t3", "p3", True), (2021, 5, "CIPESS", "t5", "p5", True), (None, None, None, "x", "px", False)], "anno int, numero int, comitato string, title string, path string, is_delibera boolean")


def test_structured_answers(spark):
    sql, args = structured.build("count_delibere", {"anno": 2019, "comitato": "x'; DROP"})
    assert "DROP" not in sql and args == [2019, "x'; DROP"] and structured.build("other", {}) is None
    rows = [r.asDict() for r in structured.run(spark, acts(spark), "count_delibere", {"anno": 2019}).collect()]
    out = structured.compose("count_delibere", {"anno": 2019}, rows)
    assert out["computed_value"] == 2 and out["completeness"]["gap"] == 1 and "manca dal corpus" in out["text"]
    assert structured.compose("count_delibere", {}, rows)["completeness"] == {}
    rows = [r.asDict() for r in structured.run(spark, acts(spark), "list_delibere", {}).collect()]
    out = structured.compose("list_delibere", {}, rows, 1)
    assert out["cited"] == ["p1", "p3", "p5"] and "altre 2 non mostrate" in out["text"]
    assert structured.compose("count_delibere", {}, [{"n": 0}])["text"].startswith("Nel corpus indicizzato non risulta nessuna")
    with pytest.raises(ValueError, match="template"):
        structured.compose("other", {}, [])


def test_every_reason_has_a_text():
    assert {router.NO_AMOUNTS, router.MANY_YEARS} <= set(structured.REFUSALS) and structured.refusal("new")["text"] == structured.REFUSALS[router.NO_AMOUNTS]


def test_semantic_cache(spark):
    empty = spark.createDataFrame([], caching.SEMANTIC)
    import datetime

    new = spark.createDataFrame([(None, "q", [1.0, 0.0], "v1", a, "[]", "[]", datetime.datetime(2024, 1, d)) for a, d in (("old", 1), ("new", 2))], caching.SEMANTIC)
    kept = caching.semantic_store(empty, new)
    assert [r["answer"] for r in kept.collect()] == ["new"]
    assert [r["answer"] for r in caching.semantic_store(kept, new.where("answer = 'old'")).collect()] == ["old"]
    q = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    entries = spark.createDataFrame([(7, [1.0, 0.0], "v1"), (8, [0.0, 1.0], "v0")], "id long, vector array<double>, corpus_version string")
    assert [(r["query_id"], r["id"]) for r in caching.semantic_lookup(q, entries, "v1").collect()] == [(1, 7)]


def test_fidelity_ignores_blank_rows_and_causes_of_good_ones(spark):
    form = spark.createDataFrame([("sì", "r", "si", "4", ""), ("no", "gen", "no", "", "run"), ("", "", "", "", ""), ("no", "", "", "9", "")], "fedele string, causa string, citazione_corretta string, italiano_1_5 string, ereditato_da string")
    r = evaluation.fidelity(form).first()
    assert (r["n_giudicati"], r["n_ereditati"], r["n_fedeli"], r["n_infedeli"], r["causa_retrieval"], r["causa_generazione"], r["infedeli_senza_causa"], r["fedelta"], r["banda"]) == (3, 1, 1, 2, 0, 1, 1, 0.3333, "BASSA")
    assert evaluation.fidelity(form.limit(0)).first()["banda"] == "INSUFFICIENTE"


def test_calibration_of_overlapping_ranges(spark):
    s = spark.createDataFrame([("in_corpus", 0.6), ("out_of_corpus", 0.7)], "category string, score double")
    assert evaluation.calibration(s)[1].first()["threshold"] is None


def test_settings():
    env = {"TESSERA_TOP_K": "7", "TESSERA_ROUTER_ENABLED": "falso", "TESSERA_MODEL": "# comment", "TESSERA_PRICE_INPUT": " "}
    s = Settings.from_env(env)
    assert (s.top_k, s.router_enabled, s.model, s.price_input, s.overlap_tokens) == (7, False, "", 0.0, 48)
    for bad in ({"TESSERA_TOP_K": "x"}, {"TESSERA_ROUTER_ENABLED": "flase"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)
    with pytest.raises(ValueError):
        s.with_overrides(vector_weight=0.9)
    with pytest.raises(ValueError):
        check_weights(-0.1, 1.1)


def test_ragged_and_broken_vectors_meet_nothing(spark):
    from tessera.operators import retrieval

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [None, 1.0]), (4, None), (5, []), (6, [float("nan"), 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0])], "id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [None])], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["id"], r["rank"]) for r in retrieval.vector_topk(q, rows, 5).collect())
    assert got == [(1, 1, 1), (1, 7, 2), (2, 2, 1)]
    assert retrieval.vector_topk(q.where("query_id = 3"), rows, 5).count() == 0


def test_a_stored_index_gives_the_same_scores(spark):
    from tessera.operators import retrieval

    texts = ["ferrovia veloce piano", "piano della ferrovia ferrovia", "altro testo", "", None, "veloce veloce piano nazionale"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    q = spark.createDataFrame([(1, "piano ferrovia"), (2, "veloce"), (3, "assente"), (4, "")], "query_id long, text string")
    key = lambda d: sorted((r["query_id"], r["id"], round(r["raw"], 9), r["rank"]) for r in d.collect())
    index = retrieval.postings(docs)
    assert key(retrieval.keyword_topk(q, docs, 5)) == key(retrieval.keyword_topk(q, docs, 5, index)) != []
    new = spark.createDataFrame([(2, "piano nuovo"), (9, "ferrovia")], "id long, text string")
    whole = docs.where("id <> 2").unionByName(new)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(retrieval.posted(index, new)) == key(retrieval.postings(whole)) and key(retrieval.unposted(index, new)) == key(retrieval.postings(docs.where("id <> 2")))


def test_the_italian_analysis(spark):
    from tessera.operators import retrieval

    rows = spark.createDataFrame([("Dell’opera ferroviaria e dell'opera ferroviarie: l'università, le città",), (None,)], "t string")
    got = [r["w"] for r in rows.select(retrieval.analysed(F.col("t")).alias("w")).collect()]
    assert got[0][0] == got[0][2] == "opera" and got[0][1] == got[0][3] and got[0][4:] == ["universit", "citta"] and got[1] == []


def test_chunks_follow_the_structure(spark):
    from tessera.operators import corpus

    text = "intro uno due\n\n# Primo\n\na b c d\ne f\n\ng h i\n## Secondo\n" + " ".join(f"w{k}" for k in range(23)) + "\n\nfine"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n\n "), (5, "solo")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["chunk_index"], r["section"], r["n_tokens"], r["content"]) for r in corpus.section_chunks(docs, 10, 3).collect())
    assert [g[0] for g in got] == [1] * 7 + [5] and max(g[3] for g in got) <= 10 and got[-1][4] == "solo"
    assert got[0][4] == "intro uno due\n\n# Primo" and got[0][2] is None and got[1][2] == "Primo" and "a b c d\ne f" in got[1][4]
    words = [w for g in got[:7] for w in g[4].split()]
    assert set(text.split()) <= set(words) and [g[2] for g in got[:7]][-1] == "Secondo"
    long = [g for g in got if g[4].startswith("w")]
    assert [g[4].split()[0] for g in long] == ["w0", "w7", "w14"] and all(g[2] == "Secondo" for g in long)


def test_vectors_are_kept_only_for_whole_documents(spark):
    from tessera.operators import corpus

    class Own:
        dim = 1

        def embed(self, texts):
            return [[9.0] for _ in texts]

    chunks = spark.createDataFrame([(1, "1::0", "a", [1.0]), (1, "1::1", "b", [2.0]), (2, "2::0", "c", [3.0]), (2, "2::1", "d", None)], "doc_id long, chunk_id string, content string, vector array<double>")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted((r["chunk_id"], r["vector"][0]) for r in corpus.with_vectors(docs, chunks, Own()).collect()) == [("1::0", 1.0), ("1::1", 2.0), ("2::0", 9.0), ("2::1", 9.0)]
    import pytest

    with pytest.raises(Exception, match="without chunks"):
        corpus.with_vectors(spark.createDataFrame([(1,), (3,)], "doc_id long"), chunks, Own()).collect()


def test_the_cache_in_order_and_in_rounds(spark, monkeypatch):
    import random

    from tessera.plans import run_eval

    rng = random.Random(4)
    rows = spark.createDataFrame([(k, k * 2, rng.random() < 0.2) for k in range(40)], "query_id long, seq long, refused boolean")
    near = spark.createDataFrame([(a, b, 0.9 + rng.random() / 10) for a in range(40) for b in range(40) if a != b and rng.random() < 0.08], "query_id long, other_id long, similarity double")
    key = lambda: sorted((r["query_id"], r["served_by"], r["from_cache_semantic"]) for r in run_eval.served(rows, near, 0.92).collect())
    want = key()
    monkeypatch.setattr(run_eval, "AT_ONCE", -1)
    assert key() == want and sum(x[2] for x in want) > 3


@pytest.mark.parametrize("similarity", ["l2", "cosine"])
def test_tiles_of_vectors_keep_the_best_with_their_ties(similarity):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(5, 3)), np.repeat(rng.normal(size=(90, 3)), 4, axis=0)[rng.permutation(360)]
    ids, best = np.array([f"v{k}" for k in rng.permutation(360)]), None
    for at in range(0, 360, 7):
        best = retrieval._nearer(best, q, x[at : at + 7], pa.array(ids[at : at + 7]), 10, similarity)
    got = [(int(w), i) for w, i in zip(best[0], best[2].to_pylist(), strict=True)]
    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    s = q @ x.T / norm if similarity == "cosine" else np.maximum(0, (2 - ((q[:, None] - x) ** 2).sum(2)) / 2)
    assert got == [(k, ids[i]) for k in range(5) for i in np.lexsort((ids, -np.round(s[k], 12)))[:10]]


def test_memory_of_a_vector_search_does_not_grow_with_queries(spark):
    import pyarrow as pa

    def used(batches):
        import resource

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], ["mb"])

    rows = spark.range(0, 10_000, 1, 1).selectExpr("id", "array(rand(1), rand(2), rand(3)) AS vector")
    assert retrieval.vector_topk(rows.where("id < 4000").withColumnRenamed("id", "query_id"), rows, 3).count() == 12_000
    assert spark.range(0, 64, 1, 64).mapInArrow(used, "mb long").agg({"mb": "max"}).first()[0] < 1000  # scores of all at once took 2 GB
