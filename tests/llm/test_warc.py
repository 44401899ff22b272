"""WARC archives: read back, record by record, and against a plain reading of the pages."""

import base64
import hashlib
import io
import random
import struct
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from clickfold.llm import warc_files as wf
from tests.llm.tables import CLASHES

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows, parts=3):
    names = [*CLASHES, "payload", "sha1", "sha256", "n_bytes", "first_row", "archive", "seq", "frame"]
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return table.withColumns({c: F.lit("clash") for c in names})


def plain(rows, least=0):
    """The contract; of equal (page_id, payload) rows one is the response."""
    ranked = sorted((i is None, i or 0, n) for n, (i, _, _) in enumerate(rows))
    first, out = {}, []
    for _, _, n in ranked:
        page_id, _, html = rows[n]
        payload = (html or "").encode()
        again = len(payload) >= least and payload in first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = "revisit" if again else "response"
        out.append((page_id, len(payload), digest, kind, first[payload] if again else None))
        first.setdefault(payload, page_id)
    return sorted(out, key=str)


def told(df):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


AWKWARD = [
    (5, "http://a.example/x y\r\nWARC-Type: response", "same"),
    (3, "http://a.example/ü?q=1#top", "same"),
    (4, None, "same"),
    (9, "http://b.example/", None),
    (8, "http://b.example/", ""),
    (None, "http://c.example/", "same"),
    (None, None, "only here"),
    (10, "", "x" * 3_000_000),
    (11, "http://d.example/", "ünï \U0001f600 \r\n\r\nWARC/1.1\r\n"),
    (-2, "http://d.example/", "P*M\x18\x00\x00\x00\x00"),
    (3, "http://a.example/ü?q=1#top", "same"),
    (12, "http://e.example/", "alone"),
    (12, "http://e.example/", "alone"),
]


def test_awkward_pages(spark):
    assert told(wf.round_trip(pages(spark, AWKWARD))) == plain(AWKWARD)
    assert told(wf.round_trip(pages(spark, AWKWARD), least_bytes=5)) == plain(AWKWARD, 5)
    assert told(wf.round_trip(pages(spark, []))) == []


def test_payloads_and_urls_come_back(spark):
    got = wf.round_trip(pages(spark, AWKWARD)).collect()
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert texts[10] == "x" * 3_000_000 and texts[11] == AWKWARD[8][2] and texts[-2] == AWKWARD[9][2]
    urls = {r.page_id: r.url for r in got}
    assert urls[5] == "http://a.example/x%20y%0D%0AWARC-Type:%20response"
    assert urls[3] == "http://a.example/ü?q=1#top" and urls[4] is None


def test_a_third_of_the_pages_share_a_payload(spark):
    draw = random.Random(1)
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{draw.random()}</p>") for i in range(200)]
    rows += [(1000 - i, "http://copy.example/", "<p>copied</p>") for i in range(100)]
    draw.shuffle(rows)
    got = told(wf.round_trip(pages(spark, rows)))
    assert got == plain(rows)
    assert sum(r[3] == "revisit" and r[4] == 901 for r in got) == 99


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    draw = random.Random(2)
    words = [f"word{draw.randrange(500)}" for _ in range(3000)]
    rows = [
        (i, f"http://h.example/{i}", "<html><body>" + " ".join(draw.choices(words, k=120)) + f"{i}</body></html>")
        for i in range(3000)
    ]
    path = str(tmp_path_factory.mktemp("warc") / "out")
    # Small limits, so that a task fills several archives.
    wf.write_archives(pages(spark, rows, 2), path, archive_bytes=100_000, sample_bytes=200_000)
    return rows, path, sorted(Path(path).rglob("part-*.txt"))


def test_archives_are_cut_by_size(spark, archives):
    rows, path, files = archives
    assert len(files) > 4 and all(f.stat().st_size < 400_000 for f in files)
    got = wf.read_archives(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, h) for i, _, h in rows]


def test_every_record_is_read_alone(archives):
    _, _, files = archives
    content = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and content[8:12] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    at, types = 8 + size, []
    while at < len(content):
        if content[at : at + 8] == b"P*M\x18\0\0\0\0":
            at += 8
            continue
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = one.decompress(content[at:])
        assert one.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(content[at:])
        at = len(content) - len(one.unused_data)
        head = dict(l.split(": ", 1) for l in record.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        types.append(head["WARC-Type"])
        assert int(head["Content-Length"]) == len(record.split(b"\r\n\r\n", 1)[1]) - 4
    assert types[0] == "warcinfo" and set(types[1:]) == {"response"} and len(types) > 20


def test_the_dictionary_pays(archives):
    rows, _, _ = archives
    records = [
        wf.page_record(
            {"page_id": i, "row": i, "url": url, "payload": h.encode(), "n_bytes": len(h),
             "first_row": None, "first_page": None, "sha1": hashlib.sha1(h.encode()).hexdigest()}
        )
        for i, url, h in rows
    ]
    one = sum(map(len, wf.archive_frames("a", iter(records))))
    single = zstandard.ZstdCompressor(level=wf.LEVEL, write_checksum=True)
    assert one < 0.8 * sum(len(single.compress(r)) for r in records)


def test_damage_is_found():
    record = wf.page_record(
        {"page_id": 1, "row": 0, "url": "u", "payload": b"abc", "n_bytes": 3, "first_row": None,
         "first_page": None, "sha1": hashlib.sha1(b"abc").hexdigest()}
    )
    content = b"".join(wf.archive_frames("a", iter([record])))
    found = list(wf.archive_records(content))
    assert [f["warc-type"] for f, _ in found] == ["warcinfo", "response"]
    assert wf.page_of_record(*found[1])[:4] == (1, "u", 3, found[1][0]["warc-payload-digest"][5:])
    with pytest.raises(ValueError, match="digest"):
        wf.page_of_record(found[1][0], found[1][1].replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="not a WARC"):
        list(wf.archive_records(zstandard.compress(b"junk\r\n")))
    cut = zstandard.compress(record[:-6])
    with pytest.raises(ValueError, match="cut off"):
        list(wf.archive_records(cut))
    assert list(wf.archive_records(b"")) == []
    assert io.BytesIO(content).read(4) == struct.pack("<I", 0x184D2A5D) or len(record) < 1000
