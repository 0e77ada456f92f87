"""Files to rows and rows to files. Readers have explicit schemas; writers go to a folder, never to one machine."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators import corpus

# File kinds that are read.
SUFFIXES = (".pdf", ".md", ".markdown", ".html", ".htm", ".txt")
AUDIT = (
    "run_id string, ts timestamp, query string, route string, refused boolean, uncertain boolean, from_cache boolean, cache_enabled boolean, "
    "answer_text string, raw_output string, support_score double, retrieved_chunk_ids array<string>, cited_chunk_ids array<string>, "
    "passages_inline map<string,struct<text:string,source:string>>, claims array<struct<statement:string,passages:array<int>,verbatim:string>>, "
    "latency_s double, total_tokens long, _corrupt_record string"
)
ITEMS = "id string, category string, expect_refuse boolean, question string, route_attesa string, expected_value long"
FORM = ("run_id", "condition", "id", "categoria", "tipo", "domanda", "fedele", "causa", "citazione_corretta", "italiano_1_5", "note", "ereditato_da", "risposta")


def wanted(path: Column, card_dir: str | None = None) -> Column:
    """Whether a path is a corpus file: a known suffix, no README.md, not under the card's folder."""
    name, low = F.element_at(F.split(path, "/"), -1), F.lower(path)
    keep = low.rlike(r"\.(pdf|md|markdown|html|htm|txt)$") & (F.lower(name) != "readme.md")
    return keep & ~F.startswith(path, F.lit(card_dir.rstrip("/") + "/")) if card_dir else keep


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def discovered(spark: SparkSession, folder: str, card_dir: str | None = None) -> DataFrame:
    """(path, content) of the corpus files under a folder; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = re.sub(r"^\w+:/*", "/", folder.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    return files.select(path.alias("path"), "content").where(wanted(F.col("path"), card_dir))


def html_title(raw: Column, name: Column) -> Column:
    """The page's title, else its first top heading, else the file's name."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    inner = lambda p: blank(unescaped(F.regexp_replace(F.regexp_extract(raw, p, 1), "<[^>]*>", "")))
    return F.coalesce(inner(r"(?is)<title[^>]*>(.*?)</title>"), inner(r"(?is)<h1[^>]*>(.*?)</h1>"), name)


def html_text(raw: Column) -> Column:
    """Text nodes outside scripts and styles, one a line; character references are decoded."""
    t = F.regexp_replace(raw, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    return unescaped(F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\n"))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Every character reference that HTML names, and numeric ones; a batch of texts at a time."""
    return texts.map(html.unescape, na_action="ignore")


def markdown_title(raw: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(raw, r"(?m)^\s*#\s+(.+)$", 1)), F.lit("")), name)


def parsed(files: DataFrame, pdf=None) -> DataFrame:
    """(path, text, title) of files (path, content). PDF files need an extractor: a function of bytes to (text, title)."""
    low, name = F.lower("path"), stem(F.col("path"))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    code = corpus.code_fields(name)["title"]
    plain = files.where(~low.rlike(r"\.pdf$")).select(
        "path",
        F.when(low.rlike(r"\.html?$"), html_text(raw)).otherwise(raw).alias("text"),
        F.when(low.rlike(r"\.html?$"), html_title(raw, name)).when(low.rlike(r"\.(md|markdown)$"), markdown_title(raw, name)).when(low.rlike(r"\.txt$"), F.coalesce(code, name))
        .otherwise(F.raise_error(F.concat(F.lit("no such format: "), F.col("path")))).alias("title"),
    )
    books = files.where(low.rlike(r"\.pdf$"))
    if pdf is None:
        return plain.unionByName(books.select("path", F.raise_error(F.concat(F.lit("no extractor for "), F.col("path"))).cast("string").alias("text"), F.lit(None).cast("string").alias("title")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [pdf(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["path", "text", "title"])

    read = books.select("path", "content").mapInArrow(run, "path string, text string, title string")
    return plain.unionByName(read.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), name)))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, section, block): paragraphs and headings of a text, with the heading they stand under."""
    head = r"^(#{1,6})\s+(.+)$"
    line = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("at", "line"))
    from pyspark.sql import Window

    own = Window.partitionBy("doc_id").orderBy("at")
    is_head, blank = F.col("line").rlike(head), F.trim("line") == ""
    cut = is_head | blank | F.coalesce(F.lag(is_head | blank).over(own), F.lit(True))
    d = line.withColumns({"head": is_head, "blank": blank, "g": F.sum(cut.cast("int")).over(own), "section": F.last(F.when(is_head, F.trim(F.regexp_extract("line", head, 2))), ignorenulls=True).over(own)})
    d = d.where(~F.col("blank")).groupBy("doc_id", "g").agg(F.min("at").alias("pos"), F.max("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return d.select("doc_id", "pos", "section", F.trim("block").alias("block"))


def card(spark: SparkSession, folder: str) -> DataFrame:
    """(section_no, name, text) of the card's files that begin with a digit, in order of name; blank ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = stem(F.col("path"))
    d = files.select(name.alias("name"), F.trim(F.make_valid_utf8(F.col("content").cast("string"))).alias("text")).where(F.col("name").rlike("^[0-9]") & (F.col("text") != ""))
    from pyspark.sql import Window

    return d.select(F.row_number().over(Window.orderBy("name")).alias("section_no"), "name", "text")  # a card has a few sections


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content_hash, n_chunks) and the code's fields of a manifest's files; is_delibera tells coded ones."""
    one = "path string, title string, content_hash string, n_chunks int"
    rows = spark.read.schema(f"files array<struct<{one.replace(' ', ':').replace(',:', ',')}>>, folder string").option("multiLine", True).json(path)
    beside = rows.where("files IS NULL AND folder IS NOT NULL").select("folder").first()
    if beside:
        return documents(spark.read.schema(one).json(f"{beside['folder']}/files"))
    return documents(rows.select(F.explode("files").alias("f")).select("f.*"))


def documents(files: DataFrame) -> DataFrame:
    c = corpus.code_fields(stem(F.col("path")))
    return files.withColumns({"codice": c["code"], "numero": c["number"], "anno": c["year"], "comitato": c["body"], "is_delibera": c["code"].isNotNull()})


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).json(path).where("question IS NOT NULL")


def audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL OR query IS NOT NULL").drop("_corrupt_record")


def item_index(rows: DataFrame) -> DataFrame:
    """(question, id, category): of repeated questions the last line counts."""
    return rows.groupBy("question").agg(F.max_by(F.struct("id", "category"), "line_no").alias("x")).select("question", "x.id", "x.category")


def forms(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of judgement forms; the run is what the file or its folder is called before -giudizi-."""
    d = spark.read.schema(", ".join(f"{c} string" for c in FORM)).option("header", True).option("multiLine", True).csv(pattern)
    return d.select(*[c for c in FORM if c != "run_id"], F.regexp_extract("_metadata.file_path", r"([^/]+?)-giudizi-[^/]*", 1).alias("run_id"), F.monotonically_increasing_id().alias("row_no"))


def write_form(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A form once; human work is never overwritten unless asked for."""
    rows.select(*[F.col(c).cast("string") for c in FORM]).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
