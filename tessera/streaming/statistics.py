"""A corpus and its statistics kept up as documents come, change and go; each batch is applied once.

A batch takes out what the documents it names have counted for so far and puts in what they count for now: roots and legal
acts as signed sums, postings and sentences as rows of their documents. All tables are of one store (sources.keyed), whose
pointer also names the batch, so that they move together, and a batch that comes again changes nothing. A store keeps up the
statistics it was made for, all or some, and the tables these rest on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import corpus, retrieval
from ..sources import keyed

#: By table: its columns, the key it is dealt by.
TABLES = {
    "docs": ("doc_id string, text string", "doc_id"),
    "chunks": ("doc_id string, chunk_id string, chunk_index int, start_index int, end_index int, n_tokens int, content string, content_hash string", "doc_id"),
    "term_df": ("root string, df long", "root"),
    "norms": ("label string, n_documents long", "label"),
    "sentences": ("fp string, doc_id string, n long, first int", "doc_id"),
    "postings": ("term string, id string, tf long, length int", "term"),
}
#: By statistic: the tables it rests on. Sentences go by their document, so that no text of before is needed to take them out, and
#: are places without text; the documents have it. phrase_counts: phrases without example and norms, for which no document is kept.
KEPT = {"docs": ("docs",), "chunks": ("chunks",), "term_df": ("chunks", "term_df"), "norms": ("docs", "norms"), "phrases": ("docs", "sentences"), "phrase_counts": ("sentences",), "postings": ("chunks", "postings")}


def counted(docs: DataFrame | None, chunks: DataFrame | None) -> dict[str, DataFrame]:
    """What documents (doc_id, text) and their chunks count for, by table; of one of them, what rests on it."""
    out = {}
    if docs is not None:
        out |= {"norms": corpus.norm_index(docs, 1), "sentences": corpus.phrase_rows(docs)}
    if chunks is not None:
        rows = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
        out |= {"term_df": corpus.term_df(rows), "postings": retrieval.postings(rows)}
    return out


def _tables(store: keyed.Store, of: tuple[str, ...] | None, buckets: int) -> list[str]:
    """The tables that the store keeps up; those of a new store are made."""
    asked = [name for name in TABLES if any(name in KEPT[k] for k in (KEPT if of is None else of))]
    there = [name for name in TABLES if store.has(name)]
    if there and of is not None and asked != there:
        raise ValueError(f"{store.path} keeps up {there}, not {asked}")
    for name in there or asked:
        schema, key = TABLES[name]
        if not store.has(name):
            store.create(name, schema, key, buckets)
        elif store.key(name) != key:  # a store of before, whose sentences were dealt by fp and had their text
            rows = store.table(name).withColumn("first", F.col("first.pos"))
            store.create(name, schema, key, buckets)
            store.replace(name, None, rows)
    return there or asked


def apply(spark: SparkSession, path: str, changes: DataFrame, batch: int, settings: Settings, buckets: int = 64, keep: int = 2, of: tuple[str, ...] | None = None) -> bool:
    """Applies changes (doc_id, seq, text) to the store at path, unless a batch of this number or a later one has been.

    The change of a document with the greatest seq counts; a null text removes it, whether it is there or not. False if
    there was nothing to do. of: the statistics (of KEPT) that a new store is made for; without, all. A store that is there
    keeps up its own.
    """
    store = keyed.opened(spark, path)
    if store.batch is not None and batch <= store.batch:
        return False
    kept = _tables(store, of, buckets)
    last = store.aside(changes.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max_by("text", F.struct("seq", "text")).alias("text")))
    new, ids = last.where("text IS NOT NULL"), last.select("doc_id")
    at = {name: store.touched(name, ids) for name in kept if TABLES[name][1] == "doc_id"}
    before = {name: store.table(name, at[name]).join(ids, "doc_id", "left_semi") for name in ("docs", "chunks") if name in kept}
    chunks = None
    if "chunks" in kept:
        chunks, before["chunks"] = corpus.chunks(new, settings.chunk_tokens, settings.overlap_tokens).checkpoint(), before["chunks"].checkpoint()
    was, now = counted(before.get("docs"), before.get("chunks")), counted(new, chunks)
    for name, number in (("term_df", "df"), ("norms", "n_documents")):
        if name in kept:
            store.add(name, now[name].unionByName(was[name].withColumn(number, -F.col(number))))
    if "postings" in kept:
        store.replace("postings", was["postings"].select("term", "id"), now["postings"])
    for name, rows in (("sentences", now["sentences"]), ("docs", new), ("chunks", chunks)):
        if name in kept:
            store.replace(name, ids, rows, at[name])
    store.commit(batch)
    store.expire(keep)
    return True


def tables(spark: SparkSession, path: str, settings: Settings) -> dict[str, DataFrame]:
    """docs, chunks, term_df, phrases, norms and postings of the store's version now, as an ingest writes them; those it keeps up, phrase_counts without docs."""
    store = keyed.opened(spark, path)
    out = {name: store.table(name) for name in TABLES if store.has(name)}
    least = settings.phrase_min_documents
    if "sentences" in out:
        counts = corpus.phrase_counts(out.pop("sentences"), least)
        out |= {"phrases": corpus.phrases_spelled(counts, out["docs"])} if "docs" in out else {"phrase_counts": counts.drop("at")}
    if "norms" in out:
        out["norms"] = out["norms"].where(F.col("n_documents") >= least)
    return out


def kept_up(changes: DataFrame, path: str, settings: Settings, checkpoint: str, buckets: int = 64, of: tuple[str, ...] | None = None):
    """Starts a query that applies a stream of changes (doc_id, seq, text) batch by batch; a batch run again is known by its number."""
    spark = changes.sparkSession
    return changes.writeStream.foreachBatch(lambda rows, n: apply(spark, path, rows, n, settings, buckets, of=of) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
