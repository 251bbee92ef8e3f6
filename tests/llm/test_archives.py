"""Archives: the converter against hand-made ones, exact round trips, and a plain choice of responses."""

import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import archives
from tidemark.llm.archives import (
    arc_entries, arc_entry, arc_opening, convert_arc, read_warc, unpacked, warc_date, warc_records, write_arc,
)


def plain(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), sorted."""
    bodies = [(page, (html or "").encode()) for page, _, html in pages]
    out, given = [], set()
    for page, body in sorted(bodies, key=lambda x: (x[0] is None, x[0] or 0)):
        again = len(body) >= 100 and body in given
        same = [p for p, b in bodies if b == body and p is not None]
        given.add(body)
        refers = min(same) if again and same else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", refers))
    return sorted(out, key=repr)


def round_trip(spark, tmp_path, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("value", "item_id", "body", "archive", "offset")})
    arc = write_arc(df, str(tmp_path / "arc"))
    return read_warc(spark, convert_arc(spark, arc, str(tmp_path / "warc")), payloads=True)


def narrow(records):
    columns = ("item_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, records.select(*columns).collect()), key=repr)


NASTY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x 0.0.0.0 20000101000000 text/html 5\n" * 3


def test_edge_cases(spark, tmp_path):
    long = "ü" * 80
    pages = [
        (1, "http://a/", None), (2, "http://a/", ""), (3, None, "short"), (4, "", "short"), (None, "http://n/", long),
        (9, "http://b/x y\nz\r\n", long), (5, "ftp://ü/", long), (5, "http://c/", long), (6, "http://d/", "x" * 99),
        (7, "http://d/", "x" * 99), (8, "http://d/", "x" * 100), (-2, "http://d/", "x" * 100), (10, "-", NASTY),
        (11, "HTTP/1.1 200", NASTY), (12, "u", "HTTP/1.1 404 No\r\n\r\n" * 20), (None, None, "only null ids " * 20),
        (None, None, "only null ids " * 20), (13, "u", "\n\r\n\n" * 40), (14, "u", "big " * 500_000),
    ]
    records = round_trip(spark, tmp_path, pages)
    assert narrow(records) == plain(pages)
    rows = records.collect()
    assert len({r["record_id"] for r in rows}) == len(rows)
    by_id = {r["record_id"]: r for r in rows}
    for r in rows:
        if r["record_type"] == "revisit":
            first = by_id[r["refers_to_id"]]
            assert first["record_type"] == "response" and first["payload_digest"] == r["payload_digest"]
            assert r["payload"] is None
        else:
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
        assert r["date"] == "2000-01-01T00:00:00Z"
    bodies = {(p, (h or "").encode()) for p, _, h in pages}
    assert {(r["item_id"], bytes(r["payload"])) for r in rows if r["payload"] is not None} <= bodies


def test_empty_table(spark, tmp_path):
    assert narrow(round_trip(spark, tmp_path, [])) == []


def test_archives_are_cut_and_take_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 5000)
    rng = random.Random(2)
    bodies = ["".join(rng.choices("abc \n\r", k=rng.randrange(50, 900))) for _ in range(60)]
    pages = [(i, f"http://h/{i}", rng.choice(bodies[: 3 + i])) for i in range(200)]
    pages += [(300 + i, "http://h/", bodies[0] + "y" * 100) for i in range(100)]
    assert narrow(round_trip(spark, tmp_path, pages)) == plain(pages)
    opened = [unpacked(open(f, "rb").read()) for f in glob.glob(str(tmp_path / "arc" / "*.gz"))]
    assert len(opened) > 20 and all(len(a) < 7000 for a in opened)
    assert {a.split(b"\n")[1][:1] for a in opened} == {b"1", b"2"}


def archive(version):
    block = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody\n\n"
    if version == 1:
        lines = [b"http://a/b c 1.2.3.4 199912312359 text/html %d\n" % len(block), b"dns:a 1.2.3.4 1999 text/dns 4\n"]
    else:
        lines = [
            b"http://a/b 1.2.3.4 19991231235958 text/html 200 - - 10 file.arc %d\n" % len(block),
            b"dns:a 1.2.3.4 1999 text/dns 0 - - 20 file.arc 4\n",
        ]
    return arc_opening(version) + b"\n" + lines[0] + block + b"\n" + lines[1] + b"a\r\nb\n"


@pytest.mark.parametrize("version", [1, 2])
def test_hand_made_archives(spark, tmp_path, version):
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "one.arc.gz").write_bytes(gzip.compress(archive(version)))
    # Archives are commonly compressed record by record.
    (folder / "two.arc.gz").write_bytes(gzip.compress(archive(version)[:60]) + gzip.compress(archive(version)[60:]))
    rows = read_warc(spark, convert_arc(spark, str(folder), str(tmp_path / "warc")), payloads=True).collect()
    got = sorted((r["record_type"], r["url"], r["date"], bytes(r["payload"])) for r in rows)
    page = ("response", "http://a/b c", "1999-12-31T23:59:00Z") if version == 1 else ("response", "http://a/b", "1999-12-31T23:59:58Z")
    assert got == [("resource", "dns:a", "1999-01-01T00:00:00Z", b"a\r\nb")] * 2 + [(*page, b"body\n\n")] * 2
    name = glob.glob(str(tmp_path / "warc" / "*.gz"))[0]
    _, fields, block = next(warc_records(unpacked(open(name, "rb").read())))
    assert fields["warc-type"] == "warcinfo" and b"isPartOf" in block


def test_broken_archives():
    good = archive(1)
    assert len(list(arc_entries(good))) == 2
    for bad in (good[:-3], good[20:], good.replace(b"1 0 tidemark", b"7 0 tidemark"), good + b"no header line\n"):
        with pytest.raises(ValueError):
            list(arc_entries(bad))
    with pytest.raises(ValueError):
        unpacked(gzip.compress(good)[:-20])
    with pytest.raises(ValueError):
        list(warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_header_lines():
    entry = arc_entry(2, 99, None, b"a b\tc", b"text")
    assert entry.split(b"\n")[1].split(b" ")[0] == b"a%20b%09c"
    (read,) = arc_entries(arc_opening(2) + entry)
    assert (read.url, read.block.partition(b"\r\n\r\n")[2]) == ("a%20b%09c", b"text")
    assert warc_date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        warc_date("20x1")
