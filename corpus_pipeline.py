"""The corpus pipeline: five stages from raw documents to packed sequences; counted as part of tessera.llm.

Each stage takes all its predecessor kept; all but the last return the columns of documents.
Defined cases, of every stage: a null or empty text is scored, kept and packed as the single id 0; rows with a null doc_id
stand for themselves and are kept if they are clean; rows that repeat a doc_id and a text are one document, rows that share
a doc_id alone are different ones; extra columns come along to the last stage, whatever their names; a text of many
megabytes is read whole; an empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import copies, decontam, packing, secrets, toxicity
from tessera.llm.common import carried, dropped, restored, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model learned from labels (the held-out fold stays unseen)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return restored(toxicity.scored(carried(docs), model).where("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group at a similarity of 0.8 over five words.

    Candidates come from SimHash tiles, links from the texts' shingle sets.
    """
    return copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return restored(decontam.scan(carried(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted again."""
    out = secrets.scan(carried(docs)).withColumn("text", secrets.redacted())
    return restored(out, docs, **{"n_chars": F.length("text")} if "n_chars" in docs.columns else {})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, sequence and offset."""
    # a smaller cache and smaller batches than op3_packing's: the workers are those of four stages before
    return packing.sequences(packing.tokenize(docs, entries=300_000, rows=1024, mb=4))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        dropped(docs)
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)  # has written what it packs
    dropped(docs)
    return out
