import json

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import caching
from tessera.plans import ask, ingest
from tessera.providers import Unavailable, embedded, generated, with_retries
from tessera.sources import files
from tessera.streaming import audit

LAW = "Vista la legge 27 febbraio 1967, n. 48, recante attribuzioni e ordinamento del ministero del bilancio."


def Hashed():
    class Own:  # made here, so that it travels to the workers whole
        dim = 8

        def embed(self, texts):
            assert len(texts) <= 64 and all(t.strip() for t in texts)
            return [[float(t.count(c)) + 0.1 for c in "aeioustr"] for t in texts]

    return Own()


@pytest.fixture()
def folder(tmp_path):
    base = tmp_path / "corpus"
    (base / "a" / "b").mkdir(parents=True)
    (base / "card").mkdir()
    (base / "a" / "b" / "E190001.txt").write_text(LAW + " Il comitato approva il piano della ferrovia.")
    (base / "a" / "E210002.md").write_text("# Titolo del piano.\n" + LAW)
    (base / "a" / "page.html").write_text("<title>Pagina</title><script>x</script><p>" + LAW + "</p>")
    (base / "card" / "01-intro.md").write_text("Introduzione")
    (base / "card" / "02-blank.md").write_text(" ")
    (base / "README.md").write_text("no")
    (base / "a" / "x.docx").write_text("no")
    return str(base)


def test_discovery_and_parsing(spark, folder):
    got = {r["path"]: r for r in files.parsed(files.discovered(spark, folder, "card")).collect()}
    assert set(got) == {"a/b/E190001.txt", "a/E210002.md", "a/page.html"}
    assert got["a/b/E190001.txt"]["title"] == "Delibera CIPE n. 1/2019" and got["a/E210002.md"]["title"] == "Titolo del piano." and got["a/page.html"]["title"] == "Pagina"
    assert "x" not in got["a/page.html"]["text"].split() and len(files.discovered(spark, folder).collect()) == 5
    assert [(r["section_no"], r["name"]) for r in files.card(spark, folder + "/card").collect()] == [(1, "01-intro")]


def test_pdf_needs_an_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    rows = files.discovered(spark, str(tmp_path))
    with pytest.raises(Exception, match="no extractor"):
        files.parsed(rows).collect()
    assert files.parsed(rows, lambda raw: ("text", "")).first()["title"] == "a"


def test_ingest_and_ask(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    s = Settings(chunk_tokens=10, chunk_overlap_ratio=0.2, phrase_min_documents=2, top_k=3, support_threshold=-1.0, abstention_threshold=0.0, verbatim_min_chars=5)
    assert ingest.version(spark, target) == "no-manifest"
    first = ingest.ingest(spark, s, folder, target, Hashed(), "card")
    assert first.n_files == 3 and first.n_chunks > 3 and first.embed_cost is None and ingest.version(spark, target) == first.corpus_version
    again = ingest.ingest(spark, s, folder, target, Hashed(), "card")
    assert again.corpus_version == first.corpus_version and again.folder != first.folder
    t = ingest.tables(spark, target)
    assert t["phrases"].count() >= 1 and t["norms"].first()["label"] == "legge 27 febbraio 1967, n. 48"
    c = ask.loaded(spark, target, folder + "/card")
    assert c.version == first.corpus_version and c.acts.where("is_delibera").count() == 2 and c.chunks.count() == first.n_chunks
    q = spark.createDataFrame([("q-1", "Quante delibere nel 2019?"), ("q-2", "di cosa parla il corpus?"), ("q-3", "quanti chilometri di binari"), ("q-4", "approva il piano della ferrovia")], "query_id string, text string")
    v = embedded(q.select(F.col("query_id").alias("id"), F.col("text").alias("content")), Hashed()).select(F.col("id").alias("query_id"), "vector")
    answers = ask.answered(spark, s, c, q, v)
    got = {r["query_id"]: r for r in answers.collect()}
    assert {k: r["route"] for k, r in got.items()} == {"q-1": "structured", "q-2": "meta", "q-3": "uncovered", "q-4": "pointwise"}
    assert "1 delibera" in got["q-1"]["answer"] and got["q-3"]["refused"] and got["q-4"]["valid"] == [1] and not got["q-4"]["refused"]
    ids = {r["id"] for r in c.chunks.collect()}
    assert set(got["q-4"]["cited_chunk_ids"]) <= ids and "a/b/E190001.txt::0" in ids
    # the stored statistics say what the chunks themselves do
    plain = {r["query_id"]: r for r in ask.answered(spark, s, ask.Corpus(c.chunks, c.acts, c.card, c.phrases, c.norms, c.version), q, v).collect()}
    assert plain == got
    # the README's example: answers into caches, the same question out of them
    caches = ask.stored(answers, v, c, ask.Caches(spark.createDataFrame([], caching.SEMANTIC), spark.createDataFrame([], caching.META)), s.model)
    again = {r["query_id"]: r for r in ask.answered(spark, s, c, q, v, caches=caches).collect()}
    assert again["q-4"]["from_cache"] and again["q-4"]["cited_chunk_ids"] == got["q-4"]["cited_chunk_ids"] and again["q-2"]["from_cache"]
    strict = ask.answered(spark, s.with_overrides(support_threshold=2.0), ask.Corpus(c.chunks), q, v).collect()
    assert {r["route"] for r in strict} == {"pointwise", "uncovered"} and all(r["refused"] and r["raw"] is None for r in strict)


def test_a_corpus_without_vectors_card_and_acts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_text("Il comitato approva il piano della ferrovia.")
    s = Settings(chunk_tokens=10, support_threshold=-1.0, abstention_threshold=0.0, verbatim_enabled=False)
    ingest.ingest(spark, s, str(tmp_path / "in"), str(tmp_path / "out"))
    c = ask.loaded(spark, str(tmp_path / "out"))
    assert c.acts is None and c.card is None
    q = spark.createDataFrame([(7, "piano della ferrovia")], "query_id int, text string")
    v = spark.createDataFrame([(7, [1.0])], "query_id int, vector array<double>")
    got = ask.answered(spark, s, c, q, v).first()
    assert got["query_id"] == 7 and got["cited_chunk_ids"] == ["note.txt::0"]


def test_a_manifest_is_replaced_whole(spark, tmp_path):
    from tessera.sources import stores

    path = str(tmp_path / "manifest.json")
    for text in ("first", "second, longer è", "3"):
        stores.put_text(spark, path, text)
        assert (tmp_path / "manifest.json").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["manifest.json"]


def test_a_long_list_of_files_stands_beside_the_manifest(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LISTED", 1)
    target = str(tmp_path / "out")
    ingest.ingest(spark, Settings(chunk_tokens=10), folder, target, None, "card")
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["files"] is None
    assert files.documents(files.manifest(spark, target + "/manifest.json")).where("is_delibera").count() == 2


def test_a_chunk_without_a_vector_is_an_error(spark, folder, tmp_path, monkeypatch):
    real = ingest.embedded
    monkeypatch.setattr(ingest, "embedded", lambda rows, *a: real(rows, *a).limit(1))
    with pytest.raises(Exception, match="no vector"):
        ingest.ingest(spark, Settings(chunk_tokens=10), folder, str(tmp_path / "out"), Hashed(), "card")


def test_every_character_reference_is_decoded(spark):
    rows = spark.createDataFrame([("<title>citt&agrave; &#233;</title><p>perch&eacute; &amp;amp; &nbsp;&euro; &#x1F600; &unknown;</p>",), (None,)], "h string")
    got = rows.select(files.html_text(F.col("h")).alias("t"), files.html_title(F.col("h"), F.lit("n")).alias("n")).collect()
    assert got[0]["t"].split("\n")[3] == "perché &amp; \u00a0€ \U0001f600 &unknown;" and got[0]["n"] == "città é" and got[1]["t"] is None and got[1]["n"] == "n"


def test_retries_and_lost_rows(spark):
    pauses, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Unavailable
        return "ok"

    assert with_retries(call, 4, 20, pauses.append) == "ok" and pauses == [20, 40]

    class Down:
        def generate(self, question, context):
            if question == "b":
                raise Unavailable("429")
            return "x"

    rows = spark.createDataFrame([(1, "a", ""), (2, "b", "")], "query_id long, question string, context string")
    assert sorted((r["query_id"], r["raw"], r["error"]) for r in generated(rows, Down(), 1, 0).collect()) == [(1, "x", None), (2, None, "429")]


def test_blank_texts_get_zeros(spark):
    rows = spark.createDataFrame([(k, "" if k % 3 else f"testo {k}") for k in range(150)], "id long, content string").coalesce(1)
    got = {r["id"]: r["vector"] for r in embedded(rows, Hashed()).collect()}
    assert len(got) == 150 and got[1] == [0.0] * 8 and got[3] != got[1]


def test_audit_items_and_forms(spark, tmp_path):
    a = tmp_path / "audit"
    a.mkdir()
    (a / "r.jsonl").write_text(json.dumps({"run_id": "r", "query": "q", "refused": False, "passages_inline": {"k": {"text": "t", "source": "s"}}}) + "\n\n{broken\n")
    r = files.audit(spark, str(a)).first()
    assert r["query"] == "q" and r["passages_inline"]["k"]["text"] == "t" and files.audit(spark, str(a)).count() == 1
    (tmp_path / "items.jsonl").write_text('{"id":"1","category":"c","question":"q","expect_refuse":null}\n\n')
    assert files.items(spark, str(tmp_path / "items.jsonl")).count() == 1
    form = spark.createDataFrame([tuple("sì" if c == "fedele" else f"{c},\n\"x\"" for c in files.FORM)], ", ".join(f"{c} string" for c in files.FORM))
    at = str(tmp_path / "forms" / "eval-1-giudizi-off.csv")
    files.write_form(form, at)
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_form(form, at)


def test_report():
    m = [{"condition": c, "n": 2, "suspend_drift_s": d} for c, d in (("off", 0.0), ("on", 99.0))]
    text = ask.report(m, [{"condition": "on", "category": "vaga", "n": 1, "answers": 1, "abstentions": 0, "refusals": 0}])
    assert "| n | 2 | 2 |" in text and "`vaga`" in text and "clock" in text


def test_the_stream_and_its_batch_twin_agree(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("event_type").alias("kind"), "value").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = audit.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r["start"], r["kind"], r["n"], round(r["mean"], 6)) for r in d.collect())
    assert key(spark.table("w")) == key(audit.windowed(rows))


def test_new_files_are_parsed_once(spark, folder, tmp_path):
    seen = []
    run = lambda: audit.new_files(spark, folder, lambda rows, n: seen.extend(r["title"] for r in rows.collect()), str(tmp_path / "cp")).awaitTermination(120)
    run()
    run()
    assert sorted(seen)[:2] == ["01-intro", "02-blank"] and len(seen) == 5


def test_the_ordered_cache_answers_by_arrival(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "key string, seq long, answer string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, answer string").parquet(str(tmp_path / "in"))
    q = audit.ordered_cache(stream).writeStream.format("memory").queryName("oc").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("oc").collect())) == [("a", 1, "x", False), ("a", 2, "x", True), ("b", 3, "z", False)]
