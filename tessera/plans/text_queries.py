"""Text kernel, chunks, statistics, phrases and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..sources import files
from .common import each, each_sql, duck, query, rows, table, words_sql

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))"
ROOTS = f"list_distinct(list_transform({words_sql('text')}, lambda w: w[1:6]))"


@query(f"SELECT doc_id, sha256({CLEAN}) AS content_hash, length({CLEAN}) AS n_chars FROM documents")
def txt_clean_hash(spark, d):
    x = table(spark, d, "documents").withColumn("c", T.clean(F.col("text")))
    return x.select("doc_id", F.sha2(F.col("c").cast("binary"), 256).alias("content_hash"), F.length("c").cast("long").alias("n_chars"))


@query("SELECT doc_id, md5(replace(lower(text), '’', '''')) AS normal FROM documents")
def base_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.plain(F.col("text")).cast("binary")).alias("normal"))


@query(
    f"WITH h AS (SELECT doc_id, sha256({CLEAN}) AS content_hash FROM documents) "
    "SELECT sha256(string_agg(doc_id || ':' || content_hash, chr(10) ORDER BY doc_id)) AS corpus_content_hash, count(*) AS n_docs FROM h"
)
def corpus_version(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2(T.clean(F.col("text")).cast("binary"), 256).alias("content_hash"))
    return corpus.corpus_hash(x)


WINDOWS = f"""
WITH w AS (SELECT doc_id, list_filter(string_split({CLEAN}, ' '), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, CASE WHEN len(w) <= 0 THEN 0 WHEN len(w) <= 400 THEN 1 ELSE CAST(ceil((len(w) - 400) / 352.0) AS INTEGER) + 1 END AS n FROM w),
k AS (SELECT doc_id, w, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS i FROM c WHERE n > 0),
x AS (SELECT doc_id, doc_id || '::' || i AS chunk_id, i AS chunk_index, CAST(i * 352 AS INTEGER) AS start_index, CAST(least(len(w), i * 352 + 400) AS INTEGER) AS end_index,
  CAST(least(400, len(w) - i * 352) AS INTEGER) AS n_tokens, sha256(array_to_string(list_slice(w, i * 352 + 1, i * 352 + 400), ' ')) AS content_hash FROM k)
"""


@query(WINDOWS + "SELECT * FROM x")
def chunk_windows(spark, d):
    return corpus.chunks(table(spark, d, "documents"), 400, 48).drop("content")


@query(WINDOWS + "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, max(n_tokens) AS longest FROM x")
def chunk_stats(spark, d):
    return corpus.chunks(table(spark, d, "documents"), 400, 48).agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.max("n_tokens").alias("longest"))


@query(f"SELECT root, count(*) AS df FROM (SELECT unnest({ROOTS}) AS root FROM documents) GROUP BY root")
def term_df(spark, d):
    return corpus.term_df(table(spark, d, "documents"))


@query(
    f"WITH t AS (SELECT root, count(*) AS df FROM (SELECT unnest({ROOTS}) AS root FROM documents) GROUP BY root), n AS (SELECT count(*) AS n FROM documents) "
    "SELECT root, df, round(ln(n / (1 + df)), 9) AS idf FROM t, n"
)
def term_idf(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))
    return corpus.term_df(docs).join(F.broadcast(n)).select("root", "df", F.round(T.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct({words_sql('text')}), lambda w: NOT list_contains({STOP}, w))), ' ') AS terms FROM benchmark")
def content_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


SENT = r"""
WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.;:])\s+([A-ZÀÈÉÌÒÙ«“"])', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_.])(\.*(?:' || array_to_string(list_transform(%s, lambda a: array_to_string(string_split(a, ''), '\.*')), '|') || ')\.*[.;:])' || chr(1), '\1\2 ', 'g') AS t FROM m),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 40 AND 800) AS l FROM u),
s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM p)
""" % ("[" + ", ".join(f"'{a}'" for a in sorted(T.ABBREVIATIONS, key=len, reverse=True)) + "]")
PHRASE = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g')), '\p{{Nd}}+', '#', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_#]+', ' ', 'g'))"
PRINT = "substr(sha256(" + PHRASE.format("sentence") + "), 1, 16)"


@query(SENT + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(sentence) AS sentence FROM s")
def sentence_split(spark, d):
    return corpus.sentence_rows(table(spark, d, "documents")).select("doc_id", "pos", F.md5(F.col("sentence").cast("binary")).alias("sentence"))


@query(
    SENT + f", f AS (SELECT *, {PRINT} AS fp FROM s) SELECT fp, arg_min(sentence, (doc_id, pos)) AS example, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences, '' AS norms FROM f GROUP BY fp HAVING count(DISTINCT doc_id) >= 3"
)
def recurring_phrases(spark, d):
    return corpus.phrase_index(table(spark, d, "documents"), 3).withColumn("norms", F.array_join("norms", ";"))


@query(
    SENT + f", f AS (SELECT *, {PRINT} AS fp FROM s), i AS (SELECT fp, count(DISTINCT doc_id) AS n_documents FROM f GROUP BY fp HAVING count(DISTINCT doc_id) >= 3) "
    "SELECT DISTINCT doc_id AS passage_id, fp, n_documents FROM f JOIN i USING (fp)"
)
def phrases_in_passage(spark, d):
    docs = table(spark, d, "documents")
    return corpus.phrases_in(docs.select(F.col("doc_id").alias("passage_id"), "text"), corpus.phrase_index(docs, 3))


LAWS = """(1, 'Vista la legge 27 febbraio 1967, n. 48, e il decreto-legge 31 maggio 2010, n. 78.'), (2, 'Vista la Legge 27 Febbraio 1967 n.48 per euro 120.000,50'),
(3, 'Decreto legge 8 aprile 2013, n. 35 e decreto legislativo n. 163'), (4, 'nessun richiamo'), (5, 'legge costituzionale 18 ottobre 2001, n. 3; spesa di 7 euro'), (6, '') AS t(id, text)"""
REF = f"(?i)({T.ACT_KINDS})" + r"\s+(\d{1,2})\s+" + f"({T.MONTHS})" + r"\s+(\d{4}),?\s*n\.?\s*(\d+)"
LABEL = (
    "lower(regexp_replace(regexp_replace(m, '" + REF + r"', '\1'), '\s+', ' ', 'g'))"
).replace("lower(", "replace(lower(", 1) + ", 'decreto legge', 'decreto-legge')"
PART = lambda k: f"regexp_replace(m, '{REF}', '\\{k}')"
REFS = f"SELECT id, unnest(regexp_extract_all(text, '{REF}')) AS m FROM {each_sql(LAWS, 'text')}"
LABELLED = f"SELECT DISTINCT id, {LABEL} || ' ' || CAST({PART(2)} AS INTEGER) || ' ' || lower({PART(3)}) || ' ' || {PART(4)} || ', n. ' || {PART(5)} AS label FROM ({REFS})"


@query(LABELLED)
def legal_refs(spark, d):
    return each(spark, d, LAWS, "text").select("id", F.explode(T.references(F.col("text"))).alias("label"))


@query(f"SELECT label, count(*) AS n_documents FROM ({LABELLED}) GROUP BY label HAVING count(*) >= 1")
def norm_df(spark, d):
    return corpus.norm_index(each(spark, d, LAWS, "text").withColumnRenamed("id", "doc_id"), 1)


@query(
    f"""SELECT id, len(list_filter(regexp_extract_all(regexp_replace(text, '(?i)(?:legge|decreto[-\\s]legge|decreto legislativo|decreto del Presidente[^,;]*)\\s+\\d{{1,2}}\\s+[\\p{{L}}\\p{{N}}_]+\\s+\\d{{4}},?\\s*n\\.?\\s*\\d+', ' ', 'g'), '\\d[\\d.,]*'),
    lambda x: length(translate(x, '.,', '')) >= 2)) > 0 AS own FROM {each_sql(LAWS, 'text')}"""
)
def own_figure(spark, d):
    return each(spark, d, LAWS, "text").select("id", T.own_figure(F.col("text")).alias("own"))


SPLIT = "(1, 'intel- ligenza del com- ma'), (2, 'Attri- Buzioni'), (3, 'a - b'), (4, 'x-y'), (5, 'perché- così') AS t(id, text)"


@query(rf"SELECT id, regexp_replace(text, '([a-zà-ù])-\s+([a-zà-ù])', '\1\2', 'g') AS lower_only, regexp_replace(text, '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS any_word FROM {each_sql(SPLIT, 'text')}")
def dehyphenate(spark, d):
    return each(spark, d, SPLIT, "text").select("id", T.rejoined(F.col("text")).alias("lower_only"), T.rejoined_words(F.col("text")).alias("any_word"))


def _decoded(x: str) -> str:
    """SQL that decodes the references that pages hold, & last."""
    for a, b in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{a};?', '{b}', 'g')"
    return x


_T = "trim(" + _decoded("regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '<[^>]*>', '', 'g')") + ")"


@query(f"SELECT page_id, coalesce(nullif({_T.format('title')}, ''), nullif({_T.format('h1')}, ''), 'page') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_title(F.col("html"), F.lit("page")).alias("title"))


_S = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g')"
_S = rf"regexp_replace(regexp_replace({_S}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
_S = _decoded(_S)


@query(f"SELECT page_id, md5({_S}) AS text, length({_S}) AS n_chars FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("text"), F.length("t").cast("long").alias("n_chars"))


# names of acts and other names, of each document
STEM = "concat(CASE doc_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'e' ELSE 'E' END, lpad(CAST(doc_id * 7 % 100 AS VARCHAR(9)), 2, '0'), lpad(CAST(doc_id % 10000 AS VARCHAR(9)), CASE WHEN doc_id % 9 = 4 THEN 2 ELSE 4 END, '0'), CASE doc_id % 4 WHEN 0 THEN '_bis' WHEN 1 THEN coalesce(source, '') ELSE '' END)"


@query(
    rf"""WITH x AS (SELECT stem, regexp_matches(stem, '^[Ee]\d{{6}}') AS ok FROM (SELECT {STEM} AS stem FROM documents)),
    y AS (SELECT stem, ok, CASE WHEN ok THEN CAST(substr(stem, 2, 2) AS INTEGER) END AS yy, CASE WHEN ok THEN CAST(substr(stem, 4, 4) AS INTEGER) END AS number FROM x),
    z AS (SELECT *, CASE WHEN yy >= 67 THEN 1900 + yy ELSE 2000 + yy END AS year FROM y)
    SELECT stem, CASE WHEN ok THEN 'E' || substr(stem, 2, 6) END AS code, number, year, CASE WHEN ok THEN CASE WHEN year >= 2021 THEN 'CIPESS' ELSE 'CIPE' END END AS body,
    CASE WHEN ok THEN 'Delibera ' || CASE WHEN year >= 2021 THEN 'CIPESS' ELSE 'CIPE' END || ' n. ' || number || '/' || year END AS title FROM z"""
)
def code_metadata(spark, d):
    return table(spark, d, "documents").select(F.expr(STEM).alias("stem")).select("stem", *[c.alias(k) for k, c in corpus.code_fields(F.col("stem")).items()])


PATH = "concat(CASE WHEN page_id % 7 = 0 THEN 'card/' WHEN page_id % 7 = 1 THEN 'cardx/' ELSE 'a/' END, CAST(page_id AS VARCHAR(9)), CASE page_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.HTM' WHEN 4 THEN '/README.md' WHEN 5 THEN '.markdown' WHEN 6 THEN '/readme.MD' ELSE '.md' END)"


@query(f"SELECT path FROM (SELECT {PATH} AS path FROM pages) WHERE regexp_matches(lower(path), '\\.(pdf|md|markdown|html|htm|txt)$') AND lower(string_split(path, '/')[-1]) <> 'readme.md' AND NOT starts_with(path, 'card/')")
def path_filter(spark, d):
    return table(spark, d, "pages").select(F.expr(PATH).alias("path")).where(files.wanted(F.col("path"), "card"))


MD = "(1, 'intro' || chr(10) || '## second' || chr(10) || '# Title one' || chr(10) || '# Two'), (2, 'no heading'), (3, '   # Padded  ') AS t(id, text)"


@query(f"SELECT id, coalesce(nullif(trim(regexp_extract(text, '(?m)^\\s*#\\s+(.+)$', 1)), ''), 'stem') AS title FROM {each_sql(MD, 'text')}")
def markdown_title(spark, d):
    return each(spark, d, MD, "text").select("id", files.markdown_title(F.col("text"), F.lit("stem")).alias("title"))


@query(
    f"""WITH l AS (SELECT id AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {each_sql(MD, 'text')}),
    h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS head, trim(line) = '' AS blank FROM l),
    g AS (SELECT *, sum(CASE WHEN head OR blank OR coalesce(p, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g,
      last_value(CASE WHEN head THEN trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section
      FROM (SELECT *, lag(head OR blank) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM h))
    SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, max(section) AS section, trim(string_agg(line, chr(10) ORDER BY pos)) AS block FROM g WHERE NOT blank GROUP BY doc_id, g"""
)
def block_sections(spark, d):
    return files.blocks(each(spark, d, MD, "text").withColumnRenamed("id", "doc_id"))


SPANS = """(1, '  «La delibera approva il piano [2] finanziario…» '), (2, '"«nested quote» ..."'), (3, '... edge [1][2] end'), (4, '[...] kept'), (5, 'plain'), (6, ''), (7, '“curly” text'), (8, '„low high“') AS t(id, span)"""


@query(
    """SELECT * FROM (VALUES (1, 'La delibera approva il piano finanziario'), (2, 'nested quote'), (3, 'edge end'), (4, '[...] kept'), (5, 'plain'), (6, ''), (7, '“curly” text'), (8, 'low high')) AS t(id, span)"""
)
def span_cleanup(spark, d):
    return rows(spark, SPANS).select("id", T.span_cleaned(F.col("span")).alias("span"))


# of each document the second sentence, a part of it, its first words, or what it doesn't hold
BOUNDS = "SELECT doc_id AS id, {0} AS span, {1} AS body FROM documents"
_SPAN = "CASE doc_id % 5 WHEN 0 THEN split_part({0}, '. ', 2) WHEN 1 THEN substr(split_part({0}, '. ', 2), 4, 30) WHEN 2 THEN substr({0}, 1, 25) WHEN 3 THEN 'no document holds this' ELSE concat(split_part({0}, '. ', 3), '.') END"
_ONE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(
    f"""WITH x AS (SELECT *, strpos(body, span) AS i FROM ({BOUNDS.format(_SPAN.format(_ONE), _ONE)}) WHERE span <> ''), y AS (SELECT *, ltrim(substr(body, i + length(span))) AS rest FROM x)
    SELECT id, CASE WHEN i = 0 THEN false ELSE (i = 1 OR (substr(body, i - 1, 1) = ' ' AND (i < 3 OR substr(body, i - 2, 1) IN ('.', '!', '?', ':', ';'))))
    AND (rest = '' OR right(span, 1) IN ('.', '!', '?', ':', ';') OR left(rest, 1) IN ('.', '!', '?', ':', ';')) END AS at_bounds FROM y"""
)
def boundary_diagnostic(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("body"))
    return x.select(F.col("doc_id").alias("id"), F.expr(_SPAN.format("body")).alias("span"), "body").where("span <> ''").select("id", T.at_sentence_bounds(F.col("span"), F.col("body")).alias("at_bounds"))


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0")
def doc_delete(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", "lang")
    return corpus.delete(x, x.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END AS source FROM documents")
def doc_upsert(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "source")
    return corpus.upsert(x, x.where("doc_id % 5 = 0").withColumn("source", F.lit("new")), "doc_id")


# a document's lines as paragraphs under a heading of its source; the fold over them by a recursion over their token counts
_BLOCKS = r"""
WITH RECURSIVE t AS (SELECT doc_id, '# ' || coalesce(source, '') || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents),
l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(t, '\r\n|\n|\r')), ' ') AS b, generate_subscripts(regexp_split_to_array(t, '\r\n|\n|\r'), 1) AS pos FROM t),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, len(regexp_extract_all(b, '\S+\s*|\s+'))::INTEGER AS n FROM l WHERE b <> ''),
f AS (
  SELECT doc_id, 0::BIGINT AS k, 0 AS held, 0 AS start, []::STRUCT(n INTEGER, pl INTEGER)[] AS made FROM t
  UNION ALL
  SELECT doc_id, k, CASE WHEN n > 60 THEN 0 ELSE tail + (tail > 0)::INTEGER + n END, CASE WHEN n > 60 THEN pl + n ELSE pl END,
    list_concat(CASE WHEN closes THEN [{'n': held, 'pl': start}] ELSE [] END, CASE WHEN n > 60 THEN list_transform(range(0, greatest(n - 10, 1), 50), lambda i: {'n': least(60, n - i)::INTEGER, 'pl': (pl + i)::INTEGER}) ELSE [] END)
  FROM (SELECT *, CASE WHEN NOT closes THEN start ELSE start + held - tail END AS pl FROM (SELECT *, CASE WHEN NOT closes THEN held WHEN n > 60 THEN 0 ELSE least(held, 10) END AS tail FROM
    (SELECT f.doc_id, b.k, f.held, f.start, b.n, f.held > 0 AND (b.n > 60 OR f.held + 1 + b.n > 60) AS closes FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)))
), c AS (
  SELECT doc_id, unnest(made) AS c FROM f
  UNION ALL SELECT doc_id, {'n': held, 'pl': start} FROM f WHERE held > 0 AND k = (SELECT max(x.k) FROM f x WHERE x.doc_id = f.doc_id)
)
SELECT doc_id, count(*) AS n_chunks, sum(c.n)::BIGINT AS n_tokens, sum(c.pl)::BIGINT AS starts, max(c.n) AS longest FROM c GROUP BY doc_id"""


@query(_BLOCKS)
def section_chunks(spark, d):
    x = table(spark, d, "documents")
    apart = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    c = corpus.section_chunks(x.select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n"), apart).alias("text")), 60, 10)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.sum("start_index").cast("long").alias("starts"), F.max("n_tokens").alias("longest"))


@query("SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)")
def mandatory_meta_join(spark, d):
    return corpus.with_metadata(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang", "source"))


@query("SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def chunk_lookup(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct()
    return table(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_docs(spark, d):
    return table(spark, d, "documents").where("source IS NOT NULL").select("source").distinct()


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1')")
def doc_meta_lookup(spark, d):
    x = table(spark, d, "documents").where("source = 'src1'")
    return x.orderBy("doc_id").limit(1).select("doc_id", "lang", "source")


@query(f"SELECT question, arg_max(id, line_no) AS id, arg_max(category, line_no) AS category FROM (SELECT conv_id * 100 + turn AS line_no, role AS question, md5(text) AS id, substr(text, 1, 8) AS category FROM conversations) GROUP BY question")
def eval_index(spark, d):
    return files.item_index(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), F.col("role").alias("question"), F.md5(F.col("text").cast("binary")).alias("id"), F.substring("text", 1, 8).alias("category")))


_END = "CASE WHEN least(a + 1000, n) < n AND length(w) - instr(reverse(w), ' ') > 0 AND contains(w, ' ') THEN a + length(w) - instr(reverse(w), ' ') ELSE least(a + 1000, n) END"
_BARE = r"regexp_replace(text[a + 1 : e], '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


@query(
    f"""WITH RECURSIVE s AS (SELECT doc_id, text, length(text) AS n, 0 AS k, 0 AS a, text[1:1000] AS w FROM documents WHERE text <> ''
      UNION ALL SELECT doc_id, text, n, k + 1, greatest(a + 1, e - 200), text[greatest(a + 1, e - 200) + 1 : greatest(a + 1, e - 200) + 1000] FROM (SELECT *, {_END} AS e FROM s) WHERE e < n)
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(a AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index, {_BARE} AS content FROM (SELECT *, {_END} AS e FROM s) WHERE {_BARE} <> ''"""
)
def char_chunks(spark, d):
    """Character windows of 1000 with 200 shared, cut at a space where there is one."""
    return corpus.char_chunks(table(spark, d, "documents").select("doc_id", "text"))
