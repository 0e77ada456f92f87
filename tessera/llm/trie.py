"""The prefix trie of conversations: radix partitioning from the first turn on, buckets finished by multikey quicksort.

Turns become numbers by a dictionary of their digests; a conversation is the row of its numbers. Equal conversations are
one row with its copies counted. From the root on, buckets of conversations that share their first turns are split by the
next number: a split counts its parts, parts that fit into a task go to the pool, larger ones are split again. What all of
a bucket share is passed in one step, so a long common beginning costs no rounds. Tasks sort the pool's buckets by three-way
quicksort on the next number, and each group of equal numbers is a node. Sums over subtrees are made in the tasks and
carried up the few buckets above them.
Defined cases: rows without conv_id take no part; null turns come first, then by number; rows of a conversation that share
a turn go by role, then by the text's first 64 characters, then by the dictionary; a null role or text is empty; rows that
repeat are turns of their own; an empty table gives no nodes; extra columns are not read. A conversation is a row of 12
bytes a turn, and the digest of those that end at a node is one stream by its definition: sorted outside memory, one task
reads it batch by batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_hot, pieces, table, tidied, tune, written

#: Turns of a bucket that a task finishes.
LOCAL = 200_000
#: What a node has that no conversation ends at.
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
TIE = 64


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order, as numbers of a dictionary, and how many words each has."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).where("conv_id IS NOT NULL")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    turns = written(turns.select("conv_id", "turn", "role", F.left("text", F.lit(TIE)).alias("tie"), F.unhex(F.sha2(said, 256)).alias("key"), words), "op11")
    # one row for each different turn; its number is its place in the stored table
    known = written(turns.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.monotonically_increasing_id().alias("id")), "op11")
    coded = joined_hot(turns, known, "key", "n")
    one = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "role", "tie", F.col("id").alias("id"), F.col("words").alias("words"))
    return coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations c whose first h turns are those of conversation c - c % every, h the checksum of c modulo `most`."""
    base = F.col("conv_id") - F.col("conv_id") % every
    first = lambda c: F.slice(c, 1, most - 1)
    heads = own.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("base"), first("ids").alias("b_ids"), first("words").alias("b_words"))
    joined = own.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).join(heads, "base", "left")
    mixed = lambda c, b: F.concat(F.slice(F.coalesce(b, F.expr(f"slice({c}, 1, 0)")), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return joined.select("conv_id", mixed("ids", F.col("b_ids")), mixed("words", F.col("b_words")))


@tidied
def _ended(batches):
    """(seq, conv_id, n, ends) of rows (seq, conv_id) that are sorted by both."""
    seq, first, n, digest = None, 0, 0, None
    out: list = []
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != seq:
                if digest:
                    out.append((seq, first, n, digest.hexdigest()))
                seq, first, n, digest = s, c, 1, hashlib.sha256(str(c).encode())
            else:
                n += 1
                digest.update(b",%d" % c)
        if len(out) > 50_000:
            yield _batch(out, ENDED)
            out = []
    if digest:
        out.append((seq, first, n, digest.hexdigest()))
    if out:
        yield _batch(out, ENDED)


ENDED = pa.schema([("seq", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
NODE = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in NODES.split(", ")])
FOUND = NODE.append(pa.field("entry", pa.bool_()))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def distinct(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, ids, words): different conversations, the smallest conv_id, number and digest of those that are it."""
    convs = written(convs.withColumn("seq", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))), "op11")
    parts = pieces(convs.sparkSession, convs.count(), 1_000_000)
    ends = convs.select("seq", "conv_id").repartition(parts, "seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ended, "seq binary, conv_id long, n long, ends string")
    out = written(convs.join(ends, ["seq", "conv_id"]).select("conv_id", "n", "ends", "ids", "words"), "op11")
    dropped(convs)
    return out


def quicksorted(rows: list, depth: int, parent: int) -> list:
    """The nodes of a bucket whose rows (ids, words, conv_id, n, ends) share ids[0], which is the turn of `depth`.

    Three-way partition by the next number; what equals the pivot is a child and is sorted by the number after it.
    """
    conv, deep, above, convs, children, leaves, saved, ends, up = [], [], [], [], [], [], [], [], []

    def node(d, first, n, words, end, at):
        conv.append(first)
        deep.append(depth + d - 1)
        above.append(conv[at] if at >= 0 else parent)
        convs.append(n)
        children.append(0)
        leaves.append(0)
        saved.append((n - 1) * words)
        ends.append(end)
        up.append(at)
        if at >= 0:
            children[at] += 1
        return len(conv) - 1

    stack = [(rows, 1, -1)]
    while stack:
        group, d, at = stack.pop()
        if len(group) == 1:  # alone from here to its end
            ids, words, first, n, end = group[0]
            for k in range(d, len(ids) + 1):
                at = node(k, first, n, words[k - 1], end if k == len(ids) else NO_ENDS, at)
            continue
        end = next((r[4] for r in group if len(r[0]) == d), NO_ENDS)
        at = node(d, min(r[2] for r in group), sum(r[3] for r in group), group[0][1][d - 1], end, at)
        parts = [[r for r in group if len(r[0]) > d]]
        while parts:
            part = parts.pop()
            pivot = part[len(part) // 2][0][d]
            less, more = [r for r in part if r[0][d] < pivot], [r for r in part if r[0][d] > pivot]
            stack.append(([r for r in part if r[0][d] == pivot], d + 1, at))
            parts += [p for p in (less, more) if p]
    for k in range(len(conv) - 1, -1, -1):  # children stand after their parents
        leaves[k] = leaves[k] or 1
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    return [*zip(conv, deep, above, convs, children, leaves, saved, ends, [u < 0 for u in up], strict=True)]


@tidied
def _pooled(batches):
    """Nodes of the pool's buckets: rows sorted by (round, bucket, digit)."""
    out, rows, key, entry = [], [], None, None
    for b in batches:
        for r in b.to_pylist():
            now = (r["round"], r["bucket"], r["digit"])
            if now != key:
                if rows:
                    out += quicksorted(rows, *entry)
                key, entry, rows = now, (r["depth"], r["parent"]), []
                while len(out) > 50_000:
                    yield _batch(out[:50_000], FOUND)
                    out = out[50_000:]
            rows.append((r["ids"], r["words"], r["conv_id"], r["n"], r["ends"]))
    if rows:
        out += quicksorted(rows, *entry)
    for k in range(0, len(out), 50_000):
        yield _batch(out[k : k + 50_000], FOUND)


@tidied
def _chains(batches):
    """Nodes of the buckets above the pool: from the depth a bucket is entered at to that where it parts."""
    for b in batches:
        for r in b.to_pylist():
            words = np.array(r["words"] or [0], np.int64)
            below = (r["saved"] or 0) + np.cumsum(words[::-1])[::-1] * (r["n"] - 1)
            last = len(words) - 1
            rows = [(r["conv_id"], r["depth"] + k, r["parent"] if not k else r["conv_id"], r["n"], r["n_children"] if k == last else 1, r["leaves"] or 1, int(below[k]), r["ends"] or NO_ENDS if k == last else NO_ENDS, not k) for k in range(last + 1)]
            for k in range(0, len(rows), 50_000):
                yield _batch(rows[k : k + 50_000], FOUND)


def trie(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """NODES of conversations (conv_id, ids, words), one row each conv_id."""
    spark = convs.sparkSession
    tune(spark)
    rows = distinct(convs)
    turns = rows.agg(F.sum(F.size("ids"))).first()[0]
    if turns is None:
        return spark.createDataFrame([], NODES)
    active = rows.select("*", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"))
    pool, uppers = [], []
    while active is not None:
        # a bucket's least and greatest rows agree as far as all of its rows do
        seen = active.groupBy("bucket", "depth", "parent").agg(F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi"), F.sum("n").alias("n"), F.min("conv_id").alias("node"))
        common = F.expr("coalesce(nullif(array_position(zip_with(lo.ids, hi, (a, b) -> a <=> b), false), 0), size(hi) + 1) - 1").cast("long")
        seen = written(seen.withColumn("shared", common), "op11")
        # buckets that are split have over `local` turns each: no more than turns / local
        at = active.drop("depth", "parent").join(F.broadcast(seen.select("bucket", "node", "shared")), "bucket")
        at = at.withColumn("digit", F.get("ids", F.col("shared").cast("int")))
        parts = written(at.where("digit IS NOT NULL").groupBy("bucket", "digit").agg(F.sum(F.size("ids") - F.col("shared")).alias("turns"), F.count("*").alias("rows")), "op11")
        large = written(parts.where(f"turns > {local} AND rows > 1").select("bucket", "digit", F.monotonically_increasing_id().alias("next")), "op11")
        ends = at.where("digit IS NULL").select("bucket", "ends")
        few = seen.join(parts.groupBy("bucket").agg(F.count("*").alias("n_children")), "bucket", "left").join(ends, "bucket", "left")
        words = F.expr("slice(concat(array(0), lo.words), cast(depth + 1 AS int), cast(shared - depth + 1 AS int))").alias("words")
        uppers.append(written(few.select(F.col("node").alias("conv_id"), "depth", "shared", "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends", words), "op11"))
        child = at.where("digit IS NOT NULL")
        rest = lambda c: F.slice(c, F.col("shared").cast("int") + 1, F.size(c)).alias(c)
        small = child.join(F.broadcast(large), ["bucket", "digit"], "left_anti")
        pool.append(small.select(F.lit(len(pool)).alias("round"), "bucket", "digit", (F.col("shared") + 1).alias("depth"), F.col("node").alias("parent"), "conv_id", "n", "ends", rest("ids"), rest("words")))
        if large.isEmpty():
            break
        again = child.join(F.broadcast(large), ["bucket", "digit"])
        active = written(again.select("conv_id", "n", "ends", "ids", "words", F.col("next").alias("bucket"), (F.col("shared") + 1).alias("depth"), F.col("node").alias("parent")), "op11")
    together = pool[0]
    for p in pool[1:]:
        together = together.unionByName(p)
    dealt = together.repartition(pieces(spark, turns, 500_000), "round", "bucket", "digit").sortWithinPartitions("round", "bucket", "digit")
    found = NODES + ", entry boolean"
    nodes = [written(dealt.mapInArrow(_pooled, found), "op11")]
    below = nodes[0]
    for upper in reversed(uppers):  # sums go up: what enters a bucket's children is counted where the bucket parts
        if len(nodes) > 1:
            below = nodes[0].unionByName(nodes[-1])
        sums = below.where("entry").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("shared")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes.append(written(upper.join(sums, ["conv_id", "shared"], "left").mapInArrow(_chains, found), "op11"))
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    return out.drop("entry")


def op11_trie(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    return trie(rebuilt(encoded(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL
), w AS (SELECT id, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM t GROUP BY id),
o AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_prepend(ord(c)::BIGINT, list_transform(range(8), lambda i: (-1)::BIGINT))))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS INTEGER) AS h
  FROM o
), r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(p.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS seq FROM h LEFT JOIN o p ON p.conv_id = h.base
), m AS (SELECT conv_id, len(seq) AS size, depth, list_slice(seq, 1, depth) AS key FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM r)),
n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY depth, key
), p AS (
  SELECT n.*, a.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND list_slice(c.key, 1, n.depth) = n.key) AS n_children,
    (n.n_convs - 1) * coalesce(w.words, 0) AS saved
  FROM n LEFT JOIN n a ON a.depth = n.depth - 1 AND a.key = list_slice(n.key, 1, n.depth - 1) LEFT JOIN w ON w.id = n.key[len(n.key)]
), s AS (
  SELECT a AS depth, list_slice(key, 1, a) AS key, sum(saved) AS saved_tokens, sum((n_children = 0)::INTEGER) AS n_leaves
  FROM (SELECT key, saved, n_children, unnest(range(0, depth + 1)) AS a FROM p) GROUP BY ALL
)
SELECT p.conv_id, p.depth, p.parent_conv_id, p.n_convs, p.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, p.ends_sha256 FROM p JOIN s ON p.depth = s.depth AND p.key = s.key
"""
