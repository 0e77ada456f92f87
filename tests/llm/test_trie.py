import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, ids string, n int"


def slow(rows, mixed=True):
    """Every prefix of every rebuilt conversation in a dictionary, subtrees by looking at all nodes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple((own.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + t[h:]) if mixed else t)
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    end = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(m for m in members[p] if len(seqs[m]) == len(p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], end(p)) for p, m in members.items()), key=repr)


def run(df, local, mixed=True):
    own = trie.encoded(df)
    return sorted((tuple(r) for r in trie.trie(trie.rebuilt(own) if mixed else own, local).collect()), key=repr)


def talk(seed, convs=60, deep=6, many=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(deep)):
            rows.append((c - 5, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(["", "a b", "\tc  d e\n", "é x", None][:many]), "i", 1))
    return rows


def test_few_different_turns(spark):
    rows = talk(1)
    for local in (1, 10, 10_000):
        assert run(spark.createDataFrame(rows, SCHEMA).repartition(3), local) == slow(rows)


def test_other_orders_and_nulls(spark):
    rows = [*talk(2, 40, 9, 5), (None, 1, "user", "x", "", 1), (500, None, None, None, "", 1), (500, None, None, None, "", 1), (2000, -3, "b", "late", "", 1), (2000, 7, "a", "later", "", 1), (2000, 7, "a", "late " * 30_000, "", 1), (41, 0, "user", "no base", "", 1)]
    rows += rows[:20]  # rows that repeat are turns
    assert run(spark.createDataFrame(rows, SCHEMA), 8) == slow(rows)


def test_long_common_beginning_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}", "", 1) for c in range(30) for t in range(40 if c < 20 else 35)]  # twenty equal ones, ten that end earlier
    rows += [(c, 40 + t, "user", f"own {c % 4} {t}", "", 1) for c in range(10, 20) for t in range(c % 3 + 1)]
    rows += [(100 + c, 0, "user", f"other {c}", "", 1) for c in range(5)] + [(200, t, "x", f"long {t}", "", 1) for t in range(900)]
    for local in (5, 1000):
        assert run(spark.createDataFrame(rows, SCHEMA), local, mixed=False) == slow(rows, mixed=False)


def test_quicksort_alone():
    rows = [([7, 1, 2], [1, 2, 3], 4, 1, "a"), ([7], [1], 9, 2, "b"), ([7, 1], [1, 2], 2, 5, "c"), ([7, 3], [1, 4], 1, 1, "d")]
    none = trie.NO_ENDS
    assert sorted(trie.quicksorted(rows, 3, 0)) == sorted([(1, 3, 0, 9, 2, 2, 18, "b", True), (2, 4, 1, 6, 1, 1, 10, "c", False), (4, 5, 2, 1, 0, 1, 0, "a", False), (1, 4, 1, 1, 0, 1, 0, "d", False)]) and none not in "abcd"


def test_turnless_and_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA), 10) == []
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "gone", "", 1)]  # its first turns go, no other conversation gives any
    assert run(spark.createDataFrame(rows, SCHEMA), 10) == slow(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(sf, 'conversations.parquet')}'")
    assert sorted(map(tuple, trie.op11_trie(spark, sf).collect()), key=repr) == sorted(con.execute(trie.OP11_SQL).fetchall(), key=repr)
