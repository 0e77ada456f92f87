"""Statistics after changes, against those of the documents that are left, counted afresh."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import corpus
from tessera.sources import keyed
from tessera.streaming import statistics

S = Settings(chunk_tokens=12, chunk_overlap_ratio=0.25, phrase_min_documents=2)
SENTENCES = ["Vista la legge 27 febbraio 1967, n. 48, recante attribuzioni del comitato.", "Il comitato approva il piano della ferrovia meridionale.", "La spesa grava sul fondo delle infrastrutture strategiche.", "Visto il decreto legislativo 12 aprile 2006, n. 163, sui contratti.", "Breve.", "Una frase che ricorre in alcuni documenti della raccolta."]
CHANGES = "doc_id string, seq long, text string"


def batches(seed):
    rng, seq, out = random.Random(seed), 0, []
    for _ in range(4):
        rows = []
        for _ in range(12):
            seq += 1
            text = None if rng.random() < 0.25 else " ".join(rng.choices(SENTENCES, k=rng.randrange(7)))
            rows.append((f"d{rng.randrange(14)}", seq, text))
        out.append(rows)
    return out


def plain(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def afresh(spark, given):
    docs = {}
    for rows in given:
        for doc, _, text in rows:
            docs[doc] = text
    df = spark.createDataFrame([(k, v) for k, v in docs.items() if v is not None], "doc_id string, text string")
    chunks = corpus.chunks(df, S.chunk_tokens, S.overlap_tokens)
    out = statistics.counted(df, chunks)
    return {"docs": df, "chunks": chunks, "phrases": corpus.phrase_index(df, 2), "norms": corpus.norm_index(df, 2), "term_df": out["term_df"], "postings": out["postings"]}


def held(spark, path, given):
    got, want = statistics.tables(spark, path, S), afresh(spark, given)
    assert set(got) == set(want)
    for name in want:
        assert plain(got[name]) == plain(want[name]), name


def test_any_batches_one_of_them_again(spark, tmp_path):
    path, given = str(tmp_path / "s"), batches(5)
    for n, rows in enumerate(given):
        assert statistics.apply(spark, path, spark.createDataFrame(rows, CHANGES), n, S, buckets=4)
        if n == 1:
            assert not statistics.apply(spark, path, spark.createDataFrame(rows, CHANGES), n, S, buckets=4)
            assert not statistics.apply(spark, path, spark.createDataFrame(given[0], CHANGES), 0, S, buckets=4)
    held(spark, path, given)
    gone = [(f"d{k}", 999, None) for k in range(14)] + [(None, 1000, "nobody's"), ("never", 1001, None)]
    statistics.apply(spark, path, spark.createDataFrame(gone, CHANGES), 9, S, buckets=4)
    assert all(statistics.tables(spark, path, S)[n].isEmpty() for n in ("docs", "term_df", "postings", "norms", "phrases"))


def test_a_stream_of_changes_that_breaks_off(spark, tmp_path, monkeypatch):
    path, given = str(tmp_path / "s"), batches(8)[:2]
    stream = lambda: spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    run = lambda: statistics.kept_up(stream(), path, S, str(tmp_path / "cp"), buckets=4).awaitTermination(300)
    spark.createDataFrame(given[0], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame(given[1], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    real = keyed.Store.expire
    monkeypatch.setattr(keyed.Store, "expire", lambda *a: 1 / 0)  # the batch is committed, but the query ends before it knows
    try:
        run()
    except Exception:
        pass
    monkeypatch.setattr(keyed.Store, "expire", real)
    run()
    assert keyed.opened(spark, path).version == 2
    held(spark, path, given)


def test_a_store_of_phrase_counts_holds_no_text(spark, tmp_path):
    path, rng = str(tmp_path / "s"), random.Random(3)
    words = ["".join(rng.choices("abcdefghilmnopqrstuvz", k=8)) for _ in range(4000)]
    text = lambda: " ".join(" ".join(rng.choices(words, k=14)).capitalize() + "." for _ in range(60))
    docs = [(f"d{k}", 0, text() + " " + " ".join(SENTENCES)) for k in range(60)]
    given = [docs, [(d, 1, t + " " + t if k % 2 else None) for k, (d, _, t) in enumerate(docs[:20])], docs[15:40]]
    for n, rows in enumerate(given):
        assert statistics.apply(spark, path, spark.createDataFrame(rows, CHANGES), n, S, buckets=4, of=("phrase_counts",))
    got = statistics.tables(spark, path, S)
    assert set(got) == {"phrase_counts"}
    assert plain(got["phrase_counts"]) == plain(afresh(spark, given)["phrases"].drop("example", "norms"))
    kept = sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(path) for n in names)
    assert kept < sum(len(t) for _, _, t in docs) / 2  # two versions and their pointers; the changes are gone
    with pytest.raises(ValueError):
        statistics.apply(spark, path, spark.createDataFrame(docs, CHANGES), 9, S, of=("norms",))


def test_a_store_whose_sentences_are_dealt_by_print(spark, tmp_path):
    path, given = str(tmp_path / "s"), batches(4)[:2]
    statistics.apply(spark, path, spark.createDataFrame(given[0], CHANGES), 0, S, buckets=4)
    store = keyed.opened(spark, path)
    now = store.table("sentences").withColumn("first", F.struct(F.col("first").alias("pos"), F.lit("as spelled").alias("sentence")))
    store.create("sentences", "fp string, doc_id string, n long, first struct<pos:int,sentence:string>", "fp", 4)
    store.replace("sentences", None, now)
    store.commit()
    statistics.apply(spark, path, spark.createDataFrame(given[1], CHANGES), 1, S, buckets=4)
    held(spark, path, given)
