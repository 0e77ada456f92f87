import hashlib
import os

import duckdb
import pytest
import zstandard

from tessera.llm import warc

PAGE = "<html><head><title>page</title></head><body><p>A paragraph of some length, the same on many pages of this site.</p>"
SCHEMA = "page_id long, url string, html string, rid long, payload string, n int"


def pages():
    texts = [PAGE * 2 + str(k % 7) for k in range(60)] + [None, "", "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "z\x00" * 80, "big " * 700_000]
    urls = [None, "", "https://a.example/x y?q=1\r\nWARC-Type: fake", "https://b.example/é", "http://c"]
    rows = [(k, urls[k % 5], t, None, "p", 1) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], rows[67], (None, None, "y" * 100, None, None, None), (None, "u", "n" * 200, 1, "", 2), (None, "u", "n" * 200, 1, "", 2), (-5, "", PAGE * 2 + "1", None, None, 3)]


def slow(rows, least=100):
    """Rows by plain loops; of rows that share the smallest id the first is the response."""
    out, seen = [], set()
    for page_id, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        first = sorted((r[0] is None, r[0] or 0, r[0]) for r in rows if (r[2] or "") == (html or ""))[0][2]
        again = len(data) >= least and data in seen
        seen.add(data)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "roll"), [(1, 1 << 30), (5, 2000)])
def test_round_trip(spark, tmp_path, parts, roll):
    df, at = spark.createDataFrame(pages(), SCHEMA).repartition(parts), f"{tmp_path}/a"
    files = warc.write(df, at, roll=roll, sample=10 * roll).collect()
    assert {f["file"] for f in files} == {n for n in os.listdir(at) if n.endswith(".zst")}
    got = warc.read(spark, at).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == slow(pages())
    assert sum(f["records"] for f in files) == len(got) == len({r["record_id"] for r in got})
    held = {r["record_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    whole = sorted((repr(r["page_id"]), bytes(held[r["refers_to_record"] or r["record_id"]])) for r in got)
    assert whole == sorted((repr(r[0]), (r[2] or "").encode()) for r in pages())
    assert all("\n" not in (r["url"] or "") for r in got)


def test_dictionary_leads_and_frames_stand_alone():
    rows = [{"rid": k, "page_id": k, "url": f"https://site/{k}", "payload": (PAGE + str(k)).encode(), "payload_bytes": len(PAGE + str(k)), "payload_digest": hashlib.sha256((PAGE + str(k)).encode()).hexdigest(), "refers_to": None, "refers_rid": None} for k in range(400)]
    records = [warc.record(r, "2020-01-01T00:00:00Z") for r in rows]
    made = list(warc.archives(iter(records), roll=20_000, sample=30_000))
    assert sum(n for _, n in made) == 400 and len(made) > 1
    assert [x for data, _ in made for x in warc.frames(data, 97)] == records
    for data, _ in made[:-1]:
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and one.unused_data  # a frame a record
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert sum(len(d) for d, _ in made) < plain
    assert list(warc.archives(iter([]))) == []


def test_damage_is_found():
    row = {"rid": 1, "page_id": 1, "url": None, "payload": b"abc", "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest(), "refers_to": None, "refers_rid": None}
    good = warc.record(row, "2020-01-01T00:00:00Z")
    assert warc.parsed(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="written"):
        warc.parsed(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.frames(zstandard.compress(good)[:-3]))


def test_second_attempt_writes_the_same_files(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA).coalesce(2)
    for at in ("a", "b"):
        warc.write(df, f"{tmp_path}/{at}", roll=3000, sample=4000)
    read = lambda at: {n: open(f"{tmp_path}/{at}/{n}", "rb").read() for n in os.listdir(f"{tmp_path}/{at}") if n.endswith(".zst")}  # noqa: E731, SIM115
    assert read("a") == read("b") and len(read("a")) > 2


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.write(df, f"{tmp_path}/a").count() == 0 and warc.read(spark, f"{tmp_path}/a").count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(sf, 'pages.parquet')}'")
    assert sorted(map(tuple, warc.op12_warc(spark, sf).collect())) == sorted(con.execute(warc.OP12_SQL).fetchall())
