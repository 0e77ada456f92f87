"""Chunks, versions, document frequencies, phrase and norm indexes, table-level upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over n tokens: the last is the first to reach the end; none for no tokens."""
    step = max(1, size - overlap)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.lit(1), count), lambda i: i * step)


def chunks(docs: DataFrame, size: int = 400, overlap: int = 48) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, start_index, end_index, n_tokens, content, content_hash) of windows over words."""
    words = docs.select("doc_id", F.filter(F.split(T.clean(F.col("text")), " "), lambda w: w != "").alias("w"))
    at = words.select("doc_id", "w", F.posexplode(window_starts(F.size("w"), size, overlap)).alias("chunk_index", "start_index"))
    content = F.array_join(F.slice("w", F.col("start_index") + 1, F.lit(size)), " ")
    n = F.least(F.lit(size), F.size("w") - F.col("start_index"))
    out = at.select("doc_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "start_index", (F.col("start_index") + n).alias("end_index"), n.alias("n_tokens"), content.alias("content"))
    return out.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def corpus_hash(hashes: DataFrame) -> DataFrame:
    """(corpus_content_hash, n_docs), one row: sha256 of `id:hash` lines in order of id.

    The lines are sorted over all machines and stored; then one task reads them in order and holds one batch at a time.
    """
    import hashlib

    import pyarrow as pa

    from ..session import shared_dir

    shared_dir(hashes.sparkSession)
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("content_hash"))
    lines = hashes.select("doc_id", line.alias("line")).orderBy("doc_id", "line").select("line").checkpoint()

    def digest(batches):
        state, n = hashlib.sha256(), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                state.update(("\n" + x if n else x).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()]), pa.array([n], pa.int64())], ["corpus_content_hash", "n_docs"])

    return lines.coalesce(1).mapInArrow(digest, "corpus_content_hash string, n_docs long")


def corpus_version(content_hash: Column, size: int, ratio: float, model: str, dim: int) -> Column:
    fixed = f'"chunk_overlap_ratio": {ratio}, "chunk_tokens": {size}, "corpus_content_hash": "'
    return F.sha2(F.concat(F.lit("{" + fixed), content_hash, F.lit(f'", "embed_dim": {dim}, "embed_model": "{model}"' + "}")).cast("binary"), 256)


#: Keys that a statistic is asked for, sent to every task at most; more of them are joined.
ASKED = 1 << 20


def _only(rows: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """The rows with one of the keys, before they move; all rows without keys."""
    if keys is None:
        return rows
    keys = keys.select(key).distinct().checkpoint()
    return rows.join(F.broadcast(keys) if keys.count() <= ASKED else keys, key, "left_semi")


def term_df(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(root, df): documents that hold each root, of all or of the roots asked for. Counting is partial before the shuffle."""
    rows = docs.select(F.explode_outer(T.roots(F.coalesce("text", F.lit("")))).alias("root")).where("root IS NOT NULL")
    rows = _only(rows, only, "root")
    return rows.groupBy("root").agg(F.count("*").alias("df"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    # the outer form: an inner explode makes the optimizer test the array's size first, that is split the text twice
    return docs.select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "sentence")).where("sentence IS NOT NULL")


def phrase_index(docs: DataFrame, threshold: int, only: DataFrame | None = None) -> DataFrame:
    """(fp, example, n_documents, n_occurrences, norms) of the sentences that recur in `threshold` documents or more.

    only: of the fingerprints (fp) asked for.
    """
    rows = _only(sentence_rows(docs).withColumn("fp", F.coalesce(T.phrase_print(F.col("sentence")), F.lit(""))), only, "fp")  # never null: no second print to test it
    return _phrases_of(_by_document(rows), threshold)


def _by_document(rows: DataFrame) -> DataFrame:
    # first by document, so that a sentence a third of all documents share is summed before it meets
    return rows.groupBy("fp", "doc_id").agg(F.count("*").alias("n"), F.min(F.struct("pos", "sentence")).alias("first"))


def phrase_rows(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, n, first) of each sentence of a document: how often it is there and its first place, not its text."""
    rows = sentence_rows(docs).select("doc_id", "pos", F.coalesce(T.phrase_print(F.col("sentence")), F.lit("")).alias("fp"))
    return rows.groupBy("fp", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def phrase_counts(each: DataFrame, threshold: int) -> DataFrame:
    """(fp, n_documents, n_occurrences, at) of what phrase_rows() gives, for the sentences of `threshold` documents or more; at: the first place."""
    out = each.groupBy("fp").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_occurrences"), F.min(F.struct("doc_id", F.col("first").alias("pos"))).alias("at"))
    return out.where(F.col("n_documents") >= threshold)


def phrases_spelled(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """The phrase index of what phrase_counts() gives; the documents at first places are split once more for the examples."""
    at = counts.select("fp", "n_documents", "n_occurrences", "at.*")
    there = sentence_rows(docs.join(at.select("doc_id"), "doc_id", "left_semi"))
    return _with_norms(at.join(there, ["doc_id", "pos"]).select("fp", F.col("sentence").alias("example"), "n_documents", "n_occurrences"))


def _phrases_of(each: DataFrame, threshold: int) -> DataFrame:
    out = each.groupBy("fp").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_occurrences"), F.min(F.struct("doc_id", "first")).alias("e"))
    out = out.where(F.col("n_documents") >= threshold).select("fp", F.col("e.first.sentence").alias("example"), "n_documents", "n_occurrences")
    return _with_norms(out)


def _with_norms(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("norms", T.references(T.rejoined_words(F.col("example"))))


def norm_index(docs: DataFrame, threshold: int) -> DataFrame:
    """(label, n_documents) of the legal acts that `threshold` documents or more cite in full."""
    rows = docs.select("doc_id", F.explode_outer(T.references(T.rejoined_words(F.coalesce("text", F.lit(""))))).alias("label")).where("label IS NOT NULL")
    return rows.groupBy("label").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= threshold)


def phrases_in(passages: DataFrame, index: DataFrame) -> DataFrame:
    """(passage_id, fp, n_documents) of the indexed phrases of each passage, each once."""
    rows = passages.select("passage_id", F.explode_outer(T.sentences(F.col("text"))).alias("s")).where("s IS NOT NULL").select("passage_id", T.phrase_print(F.col("s")).alias("fp")).distinct()
    return rows.join(index.select("fp", "n_documents"), "fp").select("passage_id", "fp", "n_documents")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after new rows replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def with_metadata(rows: DataFrame, docs: DataFrame, key: str = "doc_id", message: str = "no document for a chunk") -> DataFrame:
    """rows with their documents' columns; a row without a document is an error."""
    found = docs.withColumn("_there", F.lit(True))
    out = rows.join(found, key, "left")
    return out.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def code_fields(stem: Column) -> dict[str, Column]:
    """Fields of a file code: letter, two digits of the year (67 and above are of the last century), four of the number."""
    pattern = r"^[Ee](\d{2})(\d{4})"
    there = stem.rlike(pattern)
    yy, number = F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)
    year = F.when(yy.cast("int") >= 67, yy.cast("int") + 1900).otherwise(yy.cast("int") + 2000)
    body = F.when(year >= 2021, "CIPESS").otherwise("CIPE")
    when = lambda c: F.when(there, c)
    return {
        "code": when(F.concat(F.lit("E"), yy, number)), "number": when(number.try_cast("int")), "year": when(year),
        "body": when(body), "title": when(F.concat(F.lit("Delibera "), body, F.lit(" n. "), number.try_cast("int").cast("string"), F.lit("/"), year.cast("string"))),
    }


def char_windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of character windows that end at a space if they hold one; each start is at least one further on."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            space = text.rfind(" ", at, end)
            end = space if space > at else end
        out.append((at, end))
        if end >= n:
            break
        at = max(at + 1, end - overlap)
    return out


def char_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start_index, end_index, content): blank chunks are left out."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [(d, k, a, e, (t or "")[a:e].strip()) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (a, e) in enumerate(char_windows(t or "", size, overlap))]
            out = [x for x in out if x[4]]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "chunk_index", "start_index", "end_index", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, start_index long, end_index long, content string")


def packed(blocks: Column, gap: Column, size: int, overlap: int) -> Column:
    """Chunks (tokens, start, section) of a document's blocks (tokens, section), in order; a fold that Catalyst plans.

    Its state is the chunks that are done, the tokens of the open one, where that starts, and the section of its first new
    block. A block that would take the open chunk over `size` closes it, and the last `overlap` tokens begin the next; one
    over `size` by itself is cut into windows. Places count the document's tokens, without the gaps between blocks.
    """
    step = max(1, size - overlap)
    chunk = lambda t, at, of: F.struct(t.alias("t"), at.alias("start"), of.alias("section"))

    def put(state, block):
        held, t = state["held"], block["t"]
        open_, n, h = F.size(held) > 0, F.size(t), F.size(held)
        wide = n > size
        closes = open_ & (wide | (h + 1 + n > size))
        tail = F.when(closes, F.when(wide, F.slice(held, 1, 0)).otherwise(F.slice(held, F.greatest(h - overlap + 1, F.lit(1)), F.lit(max(overlap, 0))))).otherwise(held)
        begin = F.when(closes, state["begin"] + h - F.size(tail)).otherwise(state["begin"])
        windows = F.transform(F.sequence(F.lit(0), F.greatest(n - size + step, F.lit(1)) - 1, F.lit(step)), lambda at: chunk(F.slice(t, at + 1, F.lit(size)), begin + at, block["section"]))
        none = F.slice(state["done"], 1, 0)
        done = F.concat(state["done"], F.when(closes, F.array(chunk(held, state["begin"], state["of"]))).otherwise(none), F.when(wide, windows).otherwise(none))
        now = F.when(wide, F.slice(t, 1, 0)).otherwise(F.concat(tail, F.when(F.size(tail) > 0, gap).otherwise(F.slice(gap, 1, 0)), t))
        of = F.when(closes | ~open_, block["section"]).otherwise(state["of"])
        return F.struct(done.alias("done"), now.alias("held"), F.when(wide, begin + n).otherwise(begin).alias("begin"), of.alias("of"))

    first = F.element_at(blocks, 1)
    start = F.struct(F.slice(F.array(chunk(first["t"], F.lit(0), first["section"])), 1, 0).alias("done"), F.slice(first["t"], 1, 0).alias("held"), F.lit(0).alias("begin"), first["section"].alias("of"))
    return F.aggregate(blocks, start, put, lambda s: F.concat(s["done"], F.when(F.size(s["held"]) > 0, F.array(chunk(s["held"], s["begin"], s["of"]))).otherwise(F.slice(s["done"], 1, 0))))


def section_chunks(docs: DataFrame, size: int = 400, overlap: int = 48, tokenizer=None) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, start_index, end_index, n_tokens, section, content, content_hash) along a text's structure.

    docs (doc_id, text) with line ends as they are; tokenizer is a providers.Tokenizer, words with the white space after them
    by default, for which no row leaves the JVM. Blank chunks are left out; a document without blocks has none.
    """
    import pyarrow as pa

    from ..sources import files

    rows = files.blocks(docs)
    if tokenizer is None:
        rows, gap = rows.withColumn("t", F.regexp_extract_all("block", F.lit(r"(?U)\S+\s*|\s+"), F.lit(0))), F.array(F.lit("\n\n"))
    else:
        one = pa.array([tokenizer.encode("\n\n")]).type  # tokens are words or numbers
        kind = "string" if pa.types.is_string(one.value_type) else "long"

        def encoded(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([tokenizer.encode(x) for x in b.column(3).to_pylist()], pa.list_(pa.string() if kind == "string" else pa.int64()))], [*b.schema.names, "t"])

        schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos int, section string, block string, t array<{kind}>"
        rows, gap = rows.select("doc_id", "pos", "section", "block").mapInArrow(encoded, schema), F.array(*[F.lit(x) for x in tokenizer.encode("\n\n")]).cast(f"array<{kind}>")
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "section"))).alias("blocks"))
    d = whole.select("doc_id", F.posexplode(packed(F.col("blocks"), gap, size, overlap)).alias("n", "c")).select("doc_id", "n", "c.*")
    if tokenizer is None:
        d = d.withColumn("content", F.array_join("t", ""))
    else:

        def decoded(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([tokenizer.decode(x) for x in b.column(2).to_pylist()], pa.string())], [*b.schema.names, "content"])

        d = d.mapInArrow(decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", content string")
    d = d.withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).where("content <> ''")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1
    d = d.withColumn("chunk_index", k)
    return d.select(
        "doc_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", F.col("start").alias("start_index"), (F.col("start") + F.size("t")).alias("end_index"),
        F.size("t").alias("n_tokens"), "section", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
    )


def with_vectors(docs: DataFrame, chunks: DataFrame, embedder, batch: int = 64) -> DataFrame:
    """chunks (doc_id, chunk_id, content, vector, ...) of whole documents, every one with its vector.

    A document keeps its vectors only if all its chunks have one; else all are embedded again. A document without chunks
    is an error.
    """
    from ..providers import embedded

    there = chunks.groupBy("doc_id").agg(F.bool_and(F.col("vector").isNotNull()).alias("_whole"))
    known = with_metadata(docs.select("doc_id"), there, "doc_id", "a document without chunks")
    marked = chunks.join(known, "doc_id")
    new = embedded(marked.where("NOT _whole").select(F.col("chunk_id").alias("id"), "content"), embedder, batch).select(F.col("id").alias("chunk_id"), F.col("vector").alias("_new"))
    return marked.join(new, "chunk_id", "left").withColumn("vector", F.when(F.col("_whole"), F.col("vector")).otherwise(F.col("_new"))).drop("_whole", "_new").select(*chunks.columns)


def token_chunks(docs: DataFrame, tokenizer, size: int = 400, overlap: int = 48) -> DataFrame:
    """chunks() over a tokenizer's tokens in place of words; tokenizer is a providers.Tokenizer that can be pickled."""
    import hashlib

    import pyarrow as pa

    step = max(1, size - overlap)

    def run(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text)
                count = 0 if not ids else 1 if len(ids) <= size else -(-(len(ids) - size) // step) + 1
                for k in range(count):
                    part = ids[k * step : k * step + size]
                    content = tokenizer.decode(part).strip()
                    out.append((doc, f"{doc}::{k}", k, k * step, k * step + len(part), len(part), content, hashlib.sha256(content.encode()).hexdigest()))
            kinds = (b.schema.types[0], pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["doc_id", "chunk_id", "chunk_index", "start_index", "end_index", "n_tokens", "content", "content_hash"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", T.clean(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_id string, chunk_index int, start_index int, end_index int, n_tokens int, content string, content_hash string")
