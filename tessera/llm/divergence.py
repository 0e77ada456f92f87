"""How far the sources of a language differ in their words: DuckDB counts shards, Spark merges sums and rankings.

Each task counts the terms of its own texts (one row for each language, source and term), so what is shuffled follows the
vocabulary, not the words. Counts are dealt to shards by a hash of language and term; a shard knows all about its terms:
in how many documents they are, and so which are kept, their share in each source, the sums of differences for pairs of
sources, and its own candidates for the rankings. Spark adds the sums and ranks what the shards propose.
Pairs are summed sparsely: a term that neither source has differs by what two empty counts differ, so a shard only adds
what terms that occur change of that, and pairs of sources are made only where both have the term.
Defined cases: a null text, language or source is an empty one; a document without terms still makes its group known; rows
that repeat a document count each time; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; very long texts are cut at separators while they are counted, and still are one document; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, tidied, tune, written

#: Documents a term is in at least, what is added to each count, the unit of a share, and terms ranked for each group.
LEAST, MORE, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a text that are split into terms at once, and rows a task holds before it sums them or hands them on.
PIECE, HELD = 1 << 20, 500_000
COUNTS = "lang string, source string, term string, n long, docs long"
#: A term's bytes are letters of ASCII, lower-cased, and all beyond ASCII; the rest separates.
BYTES = np.full(256, 32, np.uint8)
BYTES[128:] = np.arange(128, 256)
BYTES[97:123] = BYTES[65:91] = np.arange(97, 123)


def duck():
    """A database of its own in memory, of one thread."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "preserve_insertion_order": False})


def spaced(texts: pa.Array, piece: int = PIECE) -> tuple[np.ndarray, pa.Array]:
    """(row, text): terms parted by blanks, a long text in several pieces."""
    flat = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    at = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
    data = BYTES[np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: at[-1]]]
    cuts = [np.arange(0)]
    for k in np.flatnonzero(np.diff(at) > piece):
        gaps = at[k] + np.flatnonzero(data[at[k] : at[k + 1]] == 32)
        wanted = np.searchsorted(gaps, np.arange(at[k] + piece, at[k + 1], piece), "right") - 1
        cuts.append(np.unique(gaps[wanted[wanted >= 0]]))
    cuts = np.concatenate(cuts).astype(np.int64)
    ends = np.sort(np.concatenate([at[1:], cuts]), kind="stable")
    row = np.concatenate([np.arange(len(flat)), np.searchsorted(at, cuts, "right") - 1])[np.argsort(np.concatenate([at[1:], cuts]), kind="stable")]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return row, pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))


def counts(docs: DataFrame, piece: int = PIECE, held: int = HELD) -> DataFrame:
    """COUNTS: occurrences of a term in a group and its documents there; a group's rows add up, it has one of the term ''."""

    @tidied
    def run(batches):
        con = duck()
        con.execute("CREATE TABLE c (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        summed, most = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM c GROUP BY lang, source, term", held
        for b in batches:
            row, text = spaced(b.column(2), piece)
            groups = pa.table({"row": np.arange(b.num_rows), "lang": b.column(0), "source": b.column(1)})  # noqa: F841  named in the SQL
            pieces = pa.table({"row": row, "text": text})  # noqa: F841
            con.execute("""
                INSERT INTO c
                SELECT lang, source, term, sum(n), count(*) FROM (
                  SELECT row, term, count(*) AS n FROM (SELECT row, unnest(string_split(text, ' ')) AS term FROM pieces) WHERE term <> '' GROUP BY row, term
                ) JOIN groups USING (row) GROUP BY lang, source, term
                UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM groups""")
            if number(con) > most:  # summed first; handed on only if that doesn't help
                con.execute(f"CREATE OR REPLACE TABLE c AS {summed}")
                most = held + 2 * number(con)
                if most > 5 * held:
                    yield from handed(con, "SELECT * FROM c")
                    con.execute("DELETE FROM c")
                    most = held
        yield from handed(con, summed)
        con.close()

    tune(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTS)


def number(con) -> int:
    """Rows of table c."""
    return con.execute("SELECT count(*) FROM c").fetchall()[0][0]


def handed(con, sql: str):
    """The rows of a query as batches."""
    yield from con.sql(sql).to_arrow_reader(1 << 16)


def kept(found: DataFrame, shards: int, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(shard, lang, source, term, n): kept terms by group; the term '' for each group; a null source for the number of terms kept."""

    @tidied
    def run(batches):
        con = duck()
        con.execute("CREATE TABLE c (shard INTEGER, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        summed = "SELECT shard, lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM c GROUP BY shard, lang, source, term"
        most = 4 * held
        for b in batches:
            part = pa.Table.from_batches([b])  # noqa: F841
            con.execute("INSERT INTO c SELECT * FROM part")
            if number(con) > most:  # parts of one count become one
                con.execute(f"CREATE OR REPLACE TABLE c AS {summed}")
                most = 4 * held + 2 * number(con)
        con.execute(f"""
            CREATE TABLE k AS
            WITH s AS ({summed}), d AS (SELECT lang, term FROM s GROUP BY lang, term HAVING sum(docs) >= {least})
            SELECT shard, lang, source, term, n FROM s SEMI JOIN d USING (lang, term) WHERE term <> ''
            UNION ALL SELECT shard, lang, source, term, n FROM s WHERE term = ''""")
        yield from handed(con, "SELECT * FROM k UNION ALL SELECT shard, lang, NULL, '', count(DISTINCT term) FROM k WHERE term <> '' GROUP BY shard, lang")
        con.close()

    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    dealt = found.select(shard, "lang", "source", "term", "n", "docs").repartitionById(shards, "shard")
    return dealt.mapInArrow(run, "shard int, lang string, source string, term string, n long")


def totals(terms: DataFrame) -> DataFrame:
    """(lang, source, total, terms, whole): occurrences of kept terms in each group, their number and occurrences in its language."""
    each = terms.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang = each.groupBy("lang").agg(F.sum("total").alias("whole"))
    number = terms.where("source IS NULL").groupBy("lang").agg(F.sum("n").alias("terms"))
    return each.join(lang, "lang").join(number, "lang", "left").select("lang", "source", "total", F.coalesce("terms", F.lit(0)).alias("terms"), "whole")


def share(count: str, total: str) -> str:
    return f"(1 + {UNIT}::HUGEINT * ({count} + {MORE}) // ({total} + {MORE} * terms))"


def partial(terms: DataFrame, groups: DataFrame, shards: int, top: int = TOP) -> DataFrame:
    """(part, lang, source, item, value): a shard's sums for pairs of sources, and its best terms of each group."""

    @tidied
    def run(batches):
        con = duck()
        con.execute("CREATE TABLE r (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, terms BIGINT, whole BIGINT)")
        for b in batches:
            part = pa.Table.from_batches([b])  # noqa: F841
            con.execute("INSERT INTO r SELECT * EXCLUDE (shard) FROM part")
        con.execute(f"""
            CREATE TABLE g AS SELECT DISTINCT lang, source, total, terms, whole, {share('0', 'total')} AS none FROM r WHERE total IS NOT NULL AND terms > 0;
            CREATE TABLE p AS SELECT r.lang, r.source, r.term, g.none, {share('n', 'g.total').replace('terms', 'g.terms')} AS p,
              {share('sum(n) OVER (PARTITION BY r.lang, r.term)', 'g.whole').replace('terms', 'g.terms')} AS q
            FROM r JOIN g ON r.lang = g.lang AND r.source = g.source WHERE r.n > 0""")
        yield from handed(con, f"""
            WITH one AS (SELECT lang, source, none, p, count(*) AS m FROM p GROUP BY lang, source, none, p), moved AS (
              SELECT one.lang, least(one.source, g.source) AS a, greatest(one.source, g.source) AS b, sum(m * (abs(p - g.none) - abs(one.none - g.none))) AS v
              FROM one JOIN g ON one.lang = g.lang AND one.source <> g.source GROUP BY ALL
              UNION ALL
              SELECT x.lang, x.source, y.source, sum(abs(x.p - y.p) - abs(x.p - y.none) - abs(x.none - y.p) + abs(x.none - y.none))
              FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL)
            SELECT 'pair' AS part, lang, a AS source, b AS item, sum(v)::BIGINT AS value FROM moved GROUP BY lang, a, b
            UNION ALL
            SELECT 'term', lang, source, term, (p - q)::BIGINT FROM p WHERE p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}""")
        con.close()

    no = F.lit(None).cast("long")
    rows = terms.where("source IS NOT NULL AND term <> ''").select("shard", "lang", "source", "term", "n", no.alias("total"), no.alias("terms"), no.alias("whole"))
    at = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")  # every shard needs the totals of the groups
    known = groups.select(at, "lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), "total", "terms", "whole")
    dealt = rows.unionByName(known).repartitionById(shards, "shard")
    return dealt.mapInArrow(run, "part string, lang string, source string, item string, value long")


def audit(docs: DataFrame, shards: int | None = None, least: int = LEAST, top: int = TOP, piece: int = PIECE, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to each other source, and the terms it has too many of."""
    spark = docs.sparkSession
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 50_000 + 1)
    terms = written(kept(counts(docs, piece, held), shards, least, held), "op13")
    groups = totals(terms).checkpoint()
    sums = written(partial(terms, groups, shards, top), "op13")
    # sources of a language are paired in the result itself; here with what two empty counts differ, for every kept term
    none = F.expr(f"1 + {UNIT}L * {MORE} DIV greatest(total + {MORE} * terms, 1)")
    a, b = groups.select("lang", "source", "terms", none.alias("none")), groups.select("lang", F.col("source").alias("item"), none.alias("other"))
    empty = a.join(b, "lang").where("source < item").select("lang", "source", "item", F.expr("terms * abs(none - other)").alias("value"))
    half = empty.unionByName(sums.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    best = sums.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return pairs.unionByName(best)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), t AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30), g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, t.term, count(w.id) AS n FROM g JOIN t ON g.lang = t.lang
  LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = t.term GROUP BY g.lang, g.source, t.term
), s AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n::HUGEINT + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c
), l AS (
  SELECT lang, term, 1 + 1000000000 * (m::HUGEINT + 5) // (sum(m) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS m FROM c GROUP BY lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 50
"""
