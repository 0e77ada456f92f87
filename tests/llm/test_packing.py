import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing

public = pytest.importorskip("public_tokenizers")


def test_ids_are_the_tokenizers_own(messy):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = defaultdict(dict)
    for r in packing.tokenize(messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect():
        got[r["doc_id"]][r["piece"]] = (r["start"], r["length"], bytes(r["ids"]))
    for r in messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        want = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [got[r["doc_id"]][k] for k in sorted(got[r["doc_id"]])]
        assert b"".join(p[2] for p in parts) == want.tobytes()
        assert [p[0] for p in parts] == list(range(0, len(want), 2048)) and all(p[1] == 2048 for p in parts[:-1])


@pytest.mark.parametrize("text", ["Σας ΣΟΦΟΣ", "J̌ x", "é café", "can't 'sun o're 'LL!!", "a\x1cb", "İstanbul", "x y z", "don't***!! 12ab34 ½ ²", "<|endoftext|> y", "x<|endoftext|>Y <|ENDOFTEXT|>", "<|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "a<|EndOfText|>b <|STARTOFTEXT|>", "É<|EndOfText|>", "́ lone", "ﬁ Ⅷ ǅ"])
def test_hard_words(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    words = packing.WordTokens(public.path("word_bpe_49k.json"))
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_fuzzed_texts():
    from tokenizers import Tokenizer

    t, words, rng = Tokenizer.from_file(public.path("word_bpe_49k.json")), packing.WordTokens(public.path("word_bpe_49k.json")), random.Random(4)
    parts = ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "endoftext", "Word", "don't", " ", "  ", "\n", "é", "É", "ß", "İ", "漢", "12", "!?", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(6000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_messy_documents_are_packed_whole(messy):
    rows = packing.pack(packing.digest(packing.tokenize(messy))).collect()
    assert len({(str(r["doc_id"]), r["piece"]) for r in rows}) < len(rows) and check(rows, 2048)
    one = next(r for r in packing.tokenize(messy.where("doc_id = 6")).collect())
    assert [r["ids_crc32"] for r in rows if r["doc_id"] == 6] == [zlib.crc32(bytes(one["ids"]))]


def test_random_lengths_are_packed_close_to_the_bound(spark):
    random.seed(3)
    lengths = [random.choice([random.randint(1, 100), random.randint(1, 60), random.randint(30, 40), 34, 51]) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "k long, length long")
    rows = packing.pack(items, 100, buckets=4).collect()
    assert sorted(r["k"] for r in rows) == list(range(4000))
    rooms = []  # best-fit decreasing, one by one
    for n in sorted(lengths, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(100 - n)
        else:
            rooms[k] -= n
    assert check(rows, 100) <= 1.01 * len(rooms)


def test_at_most_two_large_pieces(spark):
    items = spark.createDataFrame([(k, 34) for k in range(10)] + [(k, 66) for k in range(10, 15)], "k long, length long")
    assert check(packing.pack(items, 100).collect(), 100) == 8


def test_empty_table(none):
    assert packing.pack(packing.digest(packing.tokenize(none))).count() == 0


def test_the_plan_covers_every_rank():
    counts = {n: n % 7 + 1 for n in range(1, 101)}
    seen = defaultdict(int)
    for length, first, number, each, _, offset in packing.plan(counts, 100):
        assert seen[length] == first and offset + each * length <= 100
        seen[length] += number
    assert dict(seen) == counts


def test_extra_columns_are_carried(spark):
    items = spark.createDataFrame([(5, "a", None), (5, "a", None), (9, None, 1.0)], "length long, cell string, rank_in_length double")
    out = packing.pack(items.select("length", F.col("cell").alias("name"), F.col("rank_in_length").alias("x")), 10)
    assert sorted(str(r["name"]) for r in out.collect()) == ["None", "a", "a"]
    assert os.path.exists(public.path("word_bpe_49k.json"))
