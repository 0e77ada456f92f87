"""WARC archives whose records are compressed one by one with a dictionary that leads each file.

A task writes its pages to archives of bounded size. Each begins with a Zstandard dictionary, built from a bounded sample
of the archive's own records and put into a skippable frame; every record is a frame of its own, so one can be read
without the others. Pages with equal payloads are found by their digests alone, of which only small rows are shuffled;
later copies become revisit records that name the response. Archives are written under a temporary name and renamed; a
task's rows come in one order and give the same bytes each time, so a lost executor's files are written again.
Defined cases: a null payload is an empty one; payloads under `least` bytes are responses, however often they come; of
equal payloads that with the smallest page_id is the response, null ids come last, and of rows that share this id exactly
one; a null url is left out; line breaks and blanks in a url are escaped; a page of many megabytes is one record; an archive
of records too few or too alike to build a dictionary from has none; an empty table gives no archives and no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import shared_dir
from . import common
from .common import joined_hot, table, tidied, tune, written

#: Payloads of fewer bytes are always written out.
LEAST = 100
#: Compressed bytes of an archive before the next begins.
ROLL = 16 << 20
#: A dictionary's size, and what it is built from: an archive's first records up to SAMPLE bytes, the first EACH of each.
DICTIONARY, SAMPLE, EACH = 64 << 10, 4 << 20, 16 << 10
#: Fixed values of the formats: magic numbers of the skippable frame that holds a dictionary, and names of the record's fields.
DICT_MAGIC, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORDS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_record string, refers_to long, payload binary"


def staged(pages: DataFrame) -> DataFrame:
    """(rid, page_id, url, payload, payload_bytes, payload_digest) of each page, stored: rid is its own number from now on."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    more = [F.monotonically_increasing_id().alias("rid"), "*", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")]
    return written(rows.select(*more), "warc-pages")


def revisits(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(rid, refers_to, refers_rid) of the pages whose payload another page's response holds."""
    long = rows.where(F.col("payload_bytes") >= least).select("rid", "page_id", "payload_digest")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "rid")).alias("first")
    groups = long.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").checkpoint()
    found = joined_hot(long, groups, "payload_digest", "n").where("rid <> first.rid")
    return written(found.select("rid", F.col("first.page_id").alias("refers_to"), F.col("first.rid").alias("refers_rid")), "warc-revisits")


def name(page_id, rid) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{rid}>"


def record(row: dict, date: str) -> bytes:
    """A page as a WARC record: a response with its payload, or a revisit with the head of the response alone."""
    from urllib.parse import quote

    again = row["refers_rid"] is not None
    head = HTTP.format(row["payload_bytes"]).encode()
    block = head if again else head + row["payload"]
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", name(row["page_id"], row["rid"])), ("WARC-Date", date)]
    if row["url"]:
        fields.append(("WARC-Target-URI", quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")))
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"], row["refers_rid"]))]
    fields += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most `size` bytes from records' first bytes; none, if they give none."""
    import zstandard

    samples = [r[:EACH] for r in records]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def archives(records, roll: int = ROLL, sample: int = SAMPLE, level: int = 3):
    """(bytes, number of records) of one archive after another; held are its sample and what is compressed of it."""
    import zstandard

    def begun(waiting):
        known = dictionary(waiting)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known)) if known else zstandard.ZstdCompressor(level=level)
        return packer, [struct.pack("<II", DICT_MAGIC, len(known)) + known] if known else []

    waiting, held, packer, frames, size, n = [], 0, None, [], 0, 0
    for r in records:
        waiting.append(r)
        held += len(r)
        if not packer and held < sample:
            continue
        if not packer:
            packer, frames = begun(waiting)
            size = sum(map(len, frames))
        for w in waiting:
            frames.append(packer.compress(w))
            size, n = size + len(frames[-1]), n + 1
        waiting = []
        if size >= roll:
            yield b"".join(frames), n
            held, packer, frames, size, n = 0, None, [], 0, 0
    if waiting:
        packer, frames = begun(waiting)
        frames += [packer.compress(w) for w in waiting]
        n += len(waiting)
    if frames:
        yield b"".join(frames), n


def frames(data: bytes, step: int = 1 << 16):
    """The contents of an archive's frames, by the dictionary in its first."""
    import zstandard

    view, at, opener = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            size = struct.unpack_from("<I", view, at + 4)[0]
            if magic == DICT_MAGIC and not at:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        one, parts = opener.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            chunk = view[at : at + step]
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """A record's fields and, of a response, its payload, held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} isn't what was written")
    page = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
    refers = fields.get("WARC-Refers-To")
    return {"record_id": fields["WARC-Record-ID"], "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to_record": refers, "refers_to": page(refers), "payload": payload if kind == "response" else None}


def placed(folder: str, called: str, data: bytes) -> str:
    """Writes a file whole, under another name first; any file system that Arrow opens."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    early, last = f"{at}/.{uuid.uuid4().hex}", f"{at}/{called}"
    with store.open_output_stream(early) as f:
        f.write(data)
    if store.get_file_info(last).type != fs.FileType.NotFound:
        store.delete_file(last)
    store.move(early, last)
    return called


def write(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL, sample: int = SAMPLE, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as archives into a shared folder; (file, records, bytes) of each archive."""
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    tune(spark)
    rows = staged(pages)
    again = revisits(rows, least)

    @tidied
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        records = (record(row, date) for b in batches for piece in _few(b) for row in piece.to_pylist())
        for k, (data, n) in enumerate(archives(records, roll, sample)):
            called = placed(folder, f"pages-{part:06d}-{k:05d}.warc.zst", data)
            yield pa.RecordBatch.from_pydict({"file": [called], "records": [n], "bytes": [len(data)]})

    # few revisits are broadcast by their files' size; rows stay in the order of rid, so that a second attempt gives the same files
    whole = rows.join(again, "rid", "left").sortWithinPartitions("rid")
    out = written(whole.mapInArrow(run, "file string, records long, bytes long"), "warc-files")
    common.dropped(rows)
    common.dropped(again)
    return out


def _few(batch: pa.RecordBatch, rows: int = 64):
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS: the records of all archives in a folder, each response's payload checked by its digest."""
    schema = Ty.StructType.fromDDL(RECORDS)
    keep = [f.name for f in schema if payloads or f.name != "payload"]

    @tidied
    def run(batches):
        for b in batches:
            for data in b.column(0):
                some, size = [], 0
                for frame in frames(data.as_py()):
                    some.append({k: v for k, v in parsed(frame).items() if k in keep})
                    size += len(frame) if payloads else 400
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, arrow)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, arrow)

    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema if f.name in keep])
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, Ty.StructType([f for f in schema if f.name in keep]))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    common.LEFT.add(folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
    row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS least
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN least END AS refers_to
FROM d
"""
