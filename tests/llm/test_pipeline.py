import zlib

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES


def test_stages_keep_columns_and_clean_rows(spark, sf, messy):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, messy, sf)
        assert out.schema.names == messy.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in messy.schema], name
        kept = {r["doc_id"] for r in out.collect()}
        assert {0, 6, 7} <= kept, name
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_secrets_leave_and_lengths_follow(spark, sf, messy):
    rows = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, messy, sf).collect()}
    assert rows[12]["text"] == "[SECRET] and [SECRET]" and rows[12]["n_chars"] == len(rows[12]["text"]) and rows[12]["row"] == "r"


def test_an_empty_table_passes_every_stage(spark, sf, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, sf).count() == 0


def test_the_ids_come_out(spark, sf, messy):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    rows = corpus_pipeline.pack_sequences(spark, messy, sf).collect()
    assert rows and all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    for doc in (0, 3, 6, 7, 11):
        pieces = sorted({(r["piece"], bytes(r["ids"])) for r in rows if r["doc_id"] == doc})
        assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == [*of.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(taken, taken[1:], strict=False))


def test_run_on_messy_and_empty_tables(spark, sf, messy, none, tmp_path):
    for name, docs in (("messy", messy), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / name / f"{t}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "messy")).collect()
    ids = {r["doc_id"] for r in rows}
    assert {0, 6, 7, 12, None} <= ids and 1 not in ids and sum(r["doc_id"] is None and r["piece"] == 0 for r in rows) == 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_run_packs_what_the_stages_kept(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in rows}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * docs < len(ids) <= docs and max(r["offset"] + r["length"] for r in rows) <= 2048


def test_every_query_is_registered():
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
