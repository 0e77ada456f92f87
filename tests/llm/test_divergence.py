import os
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from tessera.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def slow(rows, least, top):
    """The audit by plain loops over dictionaries."""
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        n.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    terms = defaultdict(list)
    for (lang, w), k in sorted(docs.items()):
        if k >= least:
            terms[lang].append(w)
    share = {}
    for lang, source in groups:
        total = sum(n[lang, source, w] for w in terms[lang])
        share[lang, source] = {w: 1 + 10**9 * (n[lang, source, w] + 5) // (total + 5 * len(terms[lang])) for w in terms[lang]}
    out = []
    for lang, source in groups:
        own = [s for x, s in groups if x == lang]
        whole = {w: sum(n[lang, s, w] for s in own) for w in terms[lang]}
        q = {w: 1 + 10**9 * (whole[w] + 5) // (sum(whole.values()) + 5 * len(whole)) for w in whole}
        p = share[lang, source]
        found = {"pair": [(s, sum(abs(p[w] - share[lang, s][w]) for w in p)) for s in own if s != source], "term": [(w, p[w] - q[w]) for w in p if n[lang, source, w] and p[w] > q[w]]}
        for part, items in found.items():
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def run(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_messy_rows(spark, messy):
    rows = [(r["text"], r["lang"], r["source"]) for r in messy.collect()]
    assert run(messy, shards=3, least=1, top=5, piece=64, held=50) == slow(rows, 1, 5)
    assert run(messy) == slow(rows, 30, 50)  # nothing is kept: pairs only


def test_words_of_four_sources(spark):
    said = ["Ab cd-ef", "ab AB É é ÉTÉ", "x1y2z3 x", "漢字 漢字 cd", "", "zz\x00zz zz_zz", "ef ef ef ef ef É", None]
    rows = [(said[k % len(said)], ["en", "de", None][k % 3], ["a", "b", "Z", "é", None][k % 5]) for k in range(120)] + [(None, "it", "a"), ("only one word", "fr", "a"), ("word", "fr", None)]
    df = spark.createDataFrame([(t, g, s, 1, 2) for t, g, s in rows], "text string, lang string, source string, term int, shard int")
    for shards, held in ((1, 10_000), (5, 7)):
        assert run(df.repartition(4), shards=shards, least=8, top=3, held=held) == slow(rows, 8, 3)
    more = [*rows, *rows[:50]]  # rows that repeat count each time
    assert run(spark.createDataFrame(more, "text string, lang string, source string"), shards=2, least=8) == slow(more, 8, 50)


def test_a_long_text_in_pieces():
    text = "Äbc " * 500 + "x" * 5000 + " END"
    for piece in (16, 100, 4096, 1 << 20):
        row, parts = divergence.spaced(pa.array(["", text, None, "b"]), piece)
        words = Counter((k, w) for k, t in zip(row.tolist(), parts.to_pylist(), strict=True) for w in t.split())
        assert words == {(1, "Äbc"): 500, (1, "x" * 5000): 1, (1, "end"): 1, (3, "b"): 1}


def test_empty(spark, none):
    assert run(none) == []


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents.parquet')}'")
    want = con.execute(divergence.OP13_SQL).fetchall()
    assert run(spark.read.parquet(f"{sf}/documents.parquet")) == sorted(want) and {r[2] for r in want} == {"pair", "term"}
