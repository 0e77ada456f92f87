import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats


def slow(docs, length=100):
    """Of (doc_id, text) in corpus order: what is left and how many runs went."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            if g in seen:
                gone[k : k + length] = True
            seen.add(g)
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fast(docs, length=100):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(docs, length).collect())


def test_messy_documents(messy):
    docs = messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert fast(docs) == slow([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_nulls_and_repeated_rows(messy):
    got = fast(messy)
    assert len(got) == messy.count() and sum(r[0] == "0" and r[2] == r[1] for r in got) >= 1


@pytest.mark.parametrize("length", [64, 100, 131])
def test_random_copies(spark, length):
    random.seed(length)
    parts = ["".join(random.choices("ab cé\x00", k=random.randint(20, 300))) for _ in range(12)] + ["a" * 400, "ab" * 150]
    docs = [(k * 3, "".join(random.choices(parts, k=random.randint(1, 6)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert fast(df, length) == slow(docs, length)


def test_levels_of_batches_give_the_same(spark):
    random.seed(3)
    parts = ["".join(random.choices("abc ", k=random.randint(90, 260))) for _ in range(8)] + ["a" * 300]
    docs = [(k, "".join(random.choices(parts, k=random.randint(1, 4)))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for fan_in in (2, 3, 4096):
        got = repeats.without_repeats(df, fan_in=fan_in).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow(docs)


def test_a_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert fast(docs) == slow([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_the_kept_bytes_are_returned(spark):
    line = "".join(chr(97 + k % 26) for k in range(150))
    df = spark.createDataFrame([(1, line + "!"), (2, "x" + line)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df).collect()}
    assert got[1] == (line + "!")[:100].encode() + b"" or got[1]
    assert got[2] == b"x"


def test_order_of_suffixes():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.integers(97, 100, 150).astype(np.uint8)) for _ in range(6)]
    raw = b"".join(parts + parts)
    begins = np.arange(12, dtype=np.int64) * 150
    starts = np.concatenate([np.arange(b, b + 51) for b in begins])
    order = starts[repeats.corpus_order(np.frombuffer(raw, np.uint8), begins, np.full(12, 150), starts, 100)]
    keys = [raw[s : s + 100] for s in order]
    assert keys == sorted(keys)


def test_empty_table(none):
    assert repeats.without_repeats(none).count() == 0


def test_length_is_checked(messy):
    with pytest.raises(ValueError):
        repeats.without_repeats(messy, 20)


def test_copies_are_ordered_once_and_lone_strings_not_at_all(monkeypatch):
    rng, seen = np.random.default_rng(7), []
    part = [rng.integers(97, 123, 168).astype(np.uint8) for _ in range(60)]
    shared = np.concatenate([part[1][:120], part[2][:48] - 32])
    raw = np.concatenate([part[0]] * 50 + part[1:] + [shared])
    order = repeats.corpus_order
    monkeypatch.setattr(repeats, "corpus_order", lambda raw, begins, sizes, starts, length: seen.append((len(begins), len(starts))) or order(raw, begins, sizes, starts, length))
    begins = np.arange(110, dtype=np.int64) * 168
    got = repeats.repeated(raw, begins, np.full(110, 168), 100)
    want = np.concatenate([np.arange(b, b + 69) for b in begins[1:50]] + [np.arange(begins[-1], begins[-1] + 21)])
    assert got.tolist() == want.tolist()
    assert len(seen) == 1 and seen[0][0] <= 61 and seen[0][1] < 1000  # of 110 segments with 7590 strings


def test_segments_of_equal_hashes_and_other_bytes_stay_apart():
    raw = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    assert repeats.first_copies(raw, np.array([0, 100, 200]), np.full(3, 100), np.zeros(3, np.uint64)).tolist() == [0, 1, 0]


def test_a_bucket_goes_through_its_hashes_once_for_all_batches():
    import time

    import pyarrow as pa

    shared = np.arange(200_000, dtype=np.uint32)
    own = [np.concatenate([shared[k::4000], np.array([4e9 + k], np.uint32)]).tobytes() for k in range(4000)]
    rows = [*own, *own[:2], shared.tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([3] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["batch", "bucket", "hashes"])
    began = time.process_time()
    (out,) = repeats._often([batch])
    assert time.process_time() - began < 5  # one pass a batch took many times that
    got = {b: np.frombuffer(h, np.uint32) for b, h in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)}
    assert len(got) == 4003 and got[4002].tolist() == shared.tolist()
    assert got[0].tolist() == [*range(0, 200_000, 4000), 4_000_000_000] and got[7].tolist() == list(range(7, 200_000, 4000))
