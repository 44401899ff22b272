"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive is a series of Zstandard frames. The first is a skippable frame that holds a
dictionary trained on the archive's first records; every record after it is one frame made
with that dictionary, so that a record is read alone, given the head of its file. Spark's text
sink writes the frames: a line is a frame, and the line separator is an empty skippable frame,
which readers of Zstandard pass over. A lost executor thus leaves no half-written archive:
files appear when the sink commits its tasks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 0
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 16 * 1024**2
#: The dictionary of an archive is built from its first records, so many bytes of them.
SAMPLE_BYTES = 4 * 1024**2
DICTIONARY_BYTES = 64 * 1024
#: A sample of few records is cut into pieces of so many bytes, since training needs several.
PIECE = 512
LEVEL = 3
#: Goes into every record, so that repeated runs write the same bytes.
DATE = "2000-01-01T00:00:00Z"

# --- fixed values of the formats ---------------------------------------------------
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"
RECORD_ID = "urn:x-page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

_COLUMNS = "archive string, seq long, frame binary"
_RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


# --- records ---------------------------------------------------------------------------


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """The address with white space and control characters escaped, as a header needs it."""
    return "".join(
        c if c > " " and not "\x7f" <= c <= "\xa0" else "".join(f"%{b:02X}" for b in c.encode())
        for c in url
    )


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_uri(page_id: int | None, row: int) -> str:
    return f"<{RECORD_ID}:{'' if page_id is None else page_id}:{row}>"


def _page_of(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(f"{RECORD_ID}:").split(":")[0]
    return int(number) if number else None


def page_record(row: dict, date: str = DATE) -> bytes:
    """A response with the payload, or a revisit with the head of the response alone."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['n_bytes']}\r\n\r\n"
    ).encode()
    again = row["first_row"] is not None
    fields = [
        ("WARC-Type", REVISIT if again else RESPONSE),
        ("WARC-Record-ID", _page_uri(row["page_id"], row["row"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _uri(row["url"])))
    if again:
        fields.append(("WARC-Profile", PROFILE))
        fields.append(("WARC-Refers-To", _page_uri(row["first_page"], row["first_row"])))
    block = head if again else head + row["payload"]
    return _header([*fields, ("WARC-Block-Digest", _digest(block))], block)


def info_record(archive: str, date: str = DATE) -> bytes:
    block = f"software: clickfold\r\nformat: WARC/1.1\r\nfilename: {archive}.warc.zst\r\n".encode()
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:x-archive:{archive}>"),
        ("WARC-Date", date),
        ("WARC-Filename", f"{archive}.warc.zst"),
        ("Content-Type", "application/warc-fields"),
    ]
    return _header(fields, block)


# --- writing ---------------------------------------------------------------------------


def train(sample: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; None where they are too little to learn from."""
    pieces = sample
    if len(sample) < 100:
        pieces = [s[i : i + PIECE] for s in sample for i in range(0, len(s), PIECE)]
    size = max(256, min(size, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive_frames(
    name: str, records: Iterator[bytes], limit: int = ARCHIVE_BYTES, sample: int = SAMPLE_BYTES
) -> Iterator[bytes]:
    """The frames of one archive; takes records until ``limit`` compressed bytes are out.

    Held in memory are the sample, the dictionary and one record.
    """
    head, taken = [], 0
    for record in records:
        head.append(record)
        taken += len(record)
        if taken >= sample:
            break
    if not head:
        return
    dictionary = train(head)
    options = {}
    if dictionary is not None:
        dictionary.precompute_compress(level=LEVEL)
        options["dict_data"] = dictionary
        data = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    yield compressor.compress(info_record(name))
    out = 0
    # The sample is written whole, also where it is more than the limit.
    for record in head:
        frame = compressor.compress(record)
        out += len(frame)
        yield frame
    head.clear()
    while out < limit:
        record = next(records, None)
        if record is None:
            return
        frame = compressor.compress(record)
        out += len(frame)
        yield frame


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _frame_rows(limit: int, sample: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (page_record(row, date) for row in _rows(batches))
        names = ["archive", "seq", "frame"]
        number = 0
        while True:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:05d}"
            held, size, seq = [], 0, 0
            for frame in archive_frames(name, records, limit, sample):
                held.append(frame)
                size += len(frame)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pydict(
                        {names[0]: [name] * len(held), names[1]: range(seq, seq + len(held)), names[2]: held}
                    )
                    seq, held, size = seq + len(held), [], 0
            if held:
                yield pa.RecordBatch.from_pydict(
                    {names[0]: [name] * len(held), names[1]: range(seq, seq + len(held)), names[2]: held}
                )
            if not seq and not held:
                return
            number += 1

    return run


def with_revisits(
    pages: DataFrame,
    scratch: Scratch,
    least_bytes: int = LEAST_BYTES,
    columns: tuple[str, str, str] = ("page_id", "url", "html"),
) -> DataFrame:
    """(row, page_id, url, payload, n_bytes, sha1, first_row, first_page) of every page.

    ``first_row`` and ``first_page`` name the response that the page revisits; both null for a
    response. Payloads are equal when their length and SHA-256 are.
    """
    page_id, url, html = columns
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    plain = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("n_bytes"),
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Stored, since row numbers hold for one reading only.
    rows = scratch.put(plain, "pages", compression="zstd")
    narrow = rows.select("row", "page_id", "n_bytes", "sha256").filter(F.col("n_bytes") >= least_bytes)
    # Counted before the shuffle, so a payload that very many pages share costs a row per task.
    first = narrow.groupBy("n_bytes", "sha256").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
    )
    shared = first.filter("copies > 1").select(
        "n_bytes", "sha256", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page")
    )
    # Stored, so that Spark can split the join where very many pages share a payload.
    again = narrow.join(scratch.put(shared, "shared"), ["n_bytes", "sha256"]).filter(
        F.col("row") != F.col("first_row")
    )
    marked = rows.drop("sha256").join(again.select("row", "first_row", "first_page"), "row", "left")
    unsent = F.when(F.col("first_row").isNull(), F.col("payload"))
    return marked.withColumn("payload", unsent)


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
    date: str = DATE,
) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives in new folders under ``path``.

    Every row gives one record: a response with the html in UTF-8, or, where an equal payload
    of at least ``least_bytes`` bytes has a smaller page_id, a revisit of that page. A null html
    is an empty payload, a null url has no target address. A null page_id comes after all
    others; of rows with the same page_id and payload one is the response and the others
    revisit it. An empty table writes no archive, other columns are not read.

    Each task writes archives of about ``archive_bytes`` one after the other. Page rows move
    once, keyed by row number; the search for equal payloads moves digests alone.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    marked = with_revisits(pages, scratch, least_bytes)
    ordered = marked.select(
        "row", "page_id", "url", "payload", "n_bytes", "sha1", "first_row", "first_page"
    )
    frames = ordered.mapInArrow(_frame_rows(archive_bytes, sample_bytes, date), _COLUMNS)
    # The sink wants its folders one after the other; a text of any bytes is written as it is.
    lines = frames.sortWithinPartitions("archive", "seq").select(
        F.col("frame").cast("string").alias("value"), "archive"
    )
    lines.write.partitionBy("archive").option("lineSep", EMPTY_FRAME).text(path)


# --- reading ---------------------------------------------------------------------------


def dictionary_of(content: bytes) -> bytes | None:
    """The dictionary in an archive's leading skippable frame, if it has one."""
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_FRAME:
            return bytes(content[8 : 8 + size])
    return None


def _record(stream: BinaryIO) -> tuple[dict[str, str], bytes] | None:
    """Header fields, in small letters, and block of the next record."""
    line = stream.readline()
    if not line:
        return None
    if line != b"WARC/1.1\r\n":
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    block = stream.read(int(fields["content-length"]))
    if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
    return fields, block


def archive_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive; one at a time is decompressed."""
    data = dictionary_of(content)
    options = {} if data is None else {"dict_data": zstandard.ZstdCompressionDict(data)}
    reader = zstandard.ZstdDecompressor(**options).stream_reader(
        io.BytesIO(content), read_across_frames=True
    )
    stream = io.BufferedReader(reader, 1 << 16)
    while (record := _record(stream)) is not None:
        yield record


def page_of_record(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of :func:`read_archives` for a response or revisit record.

    A response is checked against its digests; the length and digest of a revisit are those of
    the payload that it stands for.
    """
    if fields["warc-block-digest"] != _digest(block):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(
        int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length:")
    )
    again = fields["warc-type"] == REVISIT
    if not again and (len(payload) != length or fields["warc-payload-digest"] != _digest(payload)):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return (
        _page_of(fields["warc-record-id"]),
        fields.get("warc-target-uri"),
        length,
        fields["warc-payload-digest"].removeprefix("sha1:"),
        fields["warc-type"],
        _page_of(fields["warc-refers-to"]) if again else None,
        None if again else payload,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every
    page record in the archives under ``path``; no rows where there are none.

    Files are dealt to tasks whole, an archive of bounded size being the unit of reading.
    """
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for fields, block in archive_records(content.as_buffer()):
                    if fields["warc-type"] in (RESPONSE, REVISIT):
                        held.append(page_of_record(fields, block))
                        size += len(block)
                    if size > 1 << 22 or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema
                        )
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema
                    )

    files = (
        spark.read.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("content").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read them back."""
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'archives').root}/warc"
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)


SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads
)
SELECT page_id,
       CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER)
                    >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
