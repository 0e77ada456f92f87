import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, judging
from tessera.plans import run_eval
from tessera.sources import files, stores


def form(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, domanda string, fedele string, causa string, citazione_corretta string, italiano_1_5 string, note string, ereditato_da string, risposta string")


def test_saving_a_judgement_makes_it_ones_own(spark):
    f = form(spark, ("a", "q", "sì", "", "", "", "", "run-1", "r"), ("", "q2", "no", "r", "", "", "", "run-1", "r2"))
    got = {r["key"]: r for r in judging.form_state(judging.saved(f, "q2", {"fedele": "sì", "causa": None, "other": 1})).collect()}
    assert got["q2"]["fedele"] == "sì" and got["q2"]["causa"] == "" and got["q2"]["ereditato_da"] == "" and got["a"]["ereditato_da"] == "run-1"
    assert judging.form_state(judging.saved(f, "a", {"other": 1})).where("key = 'a'").first()["ereditato_da"] == "run-1"
    with pytest.raises(KeyError):
        judging.saved(f, "none", {"fedele": "no"})


def test_inheritance_needs_an_identical_answer(spark):
    forms = form(spark, ("a", "q", "sì", "", "", "4", "", "", "ri  sposta"), ("a", "q", "no", "r", "", "", "", "", "risposta 1"), ("a", "q", " ", "", "", "", "", "", "risposta 2"))
    old = evaluation.latest_judgements(forms.withColumns({"run_id": F.lit("eval-1"), "row_no": F.lit(1)}))
    new = form(spark, ("a", "q", "", "", "", "", "", "", "ri sposta"), ("b", "q", "", "", "", "", "", "", "risposta 2"), ("c", "q", "", "", "", "", "", "", "risposta  3"))
    got = {r["id"]: (r["fedele"], r["ereditato_da"]) for r in evaluation.inherited(new, old).collect()}
    assert got == {"a": ("sì", "eval-1"), "b": ("", ""), "c": ("", "")}
    assert evaluation.latest_judgements(forms.withColumns({"run_id": F.lit("eval-1"), "row_no": F.lit(1)}), "eval-1").count() == 0


def test_form_of_records(spark):
    r = spark.createDataFrame([("q", False, False, False, True, "t", ""), ("z", True, False, False, False, "", ""), ("y", False, False, True, None, "", '{"answer":"a"}')], "query string, refused boolean, uncertain boolean, from_cache boolean, cache_enabled boolean, answer_text string, raw_output string")
    index = spark.createDataFrame([("q", "1", "in")], "question string, id string, category string")
    got = {x["domanda"]: (x["id"], x["categoria"], x["tipo"], x["condition"], x["risposta"]) for x in judging.form(r, index, "run").collect()}
    assert got == {"q": ("1", "in", "risposta", "on", "t"), "y": ("", "", "hit-cache", "off", "a")}
    assert judging.selected(r, "on").count() == 1 and judging.selected(r, None).count() == 3


def test_reports(spark):
    f = form(spark, *[(str(k), "q", "sì" if k < 3 else "no", "s", "si", "4", "", "", "r") for k in range(8)])
    text = judging.fidelity_report("run", None, evaluation.fidelity(f).first().asDict())
    assert "Fascia BASSA" in text and "strutturale" in text and "Un item vale 12.5 punti" in text
    assert "INSUFFICIENTE" in judging.fidelity_report("run", "on", evaluation.fidelity(f.limit(0)).first().asDict())
    sheet = judging.sheet("run", [{"record_id": 1, "id": "", "categoria": "c", "tipo": "t", "domanda": "q", "risposta": ""}], [{"record_id": 1, "n": 1, "title": "T", "text": "a\nb", "cited": True, "missing": False}])
    assert "[1] T (citato)" in sheet and "> a\n> b" in sheet


def test_tables_that_are_not_there(spark, tmp_path):
    assert stores.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("broken")
    assert stores.read_or_empty(spark, str(tmp_path / "bad"), "a int").count() == 0
    built = []
    build = lambda: built.append(1) or spark.createDataFrame([(1,)], "a int")
    for _ in range(2):
        assert stores.read_or_build(spark, str(tmp_path / "t"), "a int", build).count() == 1
    assert built == [1]


def test_runs_and_bundles(spark, tmp_path):
    for n in ("eval-2.jsonl", "eval-1.jsonl", "run-3.jsonl"):
        (tmp_path / n).write_text("")
    assert stores.runs(spark, str(tmp_path)) == ["eval-2", "eval-1"] and stores.runs(spark, str(tmp_path), False)[0] == "run-3" and stores.runs(spark, str(tmp_path / "no")) == []
    stores.save_bundle(spark, str(tmp_path / "b"), "eval-1", "off", {"items": [1, "è"]})
    assert stores.load_bundle(spark, str(tmp_path / "b"), "eval-1", "off") == {"items": [1, "è"]} and stores.load_bundle(spark, str(tmp_path / "b"), "eval-1", None) is None
    assert [(b["run_id"], b["condition"]) for b in stores.bundles(spark, str(tmp_path / "b"))] == [("eval-1", "off")]


def test_forms_of_earlier_runs(spark, tmp_path):
    rows = spark.createDataFrame([tuple("x" for _ in files.FORM)], ", ".join(f"{c} string" for c in files.FORM))
    files.write_form(rows, str(tmp_path / "eval-1-giudizi-off.csv"))
    got = files.forms(spark, str(tmp_path / "*-giudizi-*.csv" / "*.csv")).first()
    assert got["domanda"] == "x" and got["run_id"] == "eval-1"


def test_two_conditions_meet_in_one_table(spark):
    a = spark.createDataFrame([(1, False, False, "pointwise", 3, 1, "", True, None, None, None)], "id int, refused boolean, uncertain boolean, route string, prompt_tokens int, n_citations int, error string, expect_refuse boolean, route_expected string, expected_value int, computed_value int")
    assert {r["condition"]: r["refusal_correct"] for r in run_eval.report_rows(a, a).collect()} == {"off": 0, "on": 0}
    assert run_eval.run_id().startswith("eval-")


def test_a_sheet_says_why(spark):
    base = {"id": "a", "categoria": "c", "domanda": "q", "risposta": "r"}
    items = [
        base | {"record_id": 1, "tipo": "rifiuto", "reason": "support_score 0.1"}, base | {"record_id": 2, "tipo": "astensione", "signal": 6.5, "missing_terms": ["binari"]},
        base | {"record_id": 3, "tipo": "hit-cache", "cache_similarity": 0.95, "matched_query": "z"}, base | {"record_id": 4, "tipo": "risposta", "claims": [{"statement": "s", "passages": [1, 2], "outcome": "valido"}]},
    ]
    text = judging.sheet("run", items, [], "off", "form.csv")
    assert "record: 4 · da giudicare: 2" in text and "form.csv" in text and "support_score 0.1" in text and "6.50, mancano «binari»" in text and "«z»" in text and "s (cita [1][2], valido)" in text


def test_a_bundle_holds_what_a_reader_needs(spark):
    records = spark.createDataFrame(
        [(1, "q", False, False, False, False, "t", "", ["c1", "zz"], ["c1"], [("s", [1], "v")]), (2, "z", True, False, False, True, "", "", [], [], [])],
        "record_id int, query string, refused boolean, uncertain boolean, from_cache boolean, cache_enabled boolean, answer_text string, raw_output string, retrieved_chunk_ids array<string>, cited_chunk_ids array<string>, claims array<struct<statement:string,passages:array<int>,verbatim:string>>",
    ).withColumn("passages_inline", F.create_map().cast("map<string,struct<text:string,source:string>>"))
    index = spark.createDataFrame([("q", "1", "in")], "question string, id string, category string")
    chunks = spark.createDataFrame([("c1", "testo", "T", "S")], "chunk_id string, content string, title string, source string")
    outcomes = spark.createDataFrame([(1, "s", 0, "v", "valido", 1)], "record_id int, statement string, pos int, verbatim string, outcome string, matched_passage int")
    got = judging.bundle("run", "off", records, index, chunks, outcomes, form(spark, ("1", "q", "sì", "", "", "4", "", "", "t")))
    assert [i["record_id"] for i in got["items"]] == [1] and got["items"][0]["giudizio"]["fedele"] == "sì" and got["items"][0]["claims"][0]["outcome"] == "valido"
    assert [(p["chunk_id"], p["cited"], p["missing"]) for p in got["items"][0]["passages"]] == [("c1", True, False), ("zz", False, True)]


def test_a_missing_form_says_how_one_is_made(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="write_form"):
        judging.load_form(spark, str(tmp_path / "none-giudizi-off.csv"))
    path = judging.write_report(spark, str(tmp_path / "report.md"), "testo")
    assert open(path).read() == "testo"
