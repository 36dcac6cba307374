r"""WARC archives with a Zstandard dictionary built from their own records.

An archive is one file: a leading skippable frame that holds the dictionary, then one independently compressed frame per record.
Spark's own text writer writes it, to any Hadoop file system and under Spark's commit protocol, so a lost executor leaves no half
archive: each row is one frame, and the line separator is itself an empty skippable frame, which every Zstandard reader passes over.

Each task makes one archive from the rows it holds, streaming; only the sample for the dictionary (at most `sample_bytes`) is kept.
Of rows with equal payloads (same SHA-1 and length), the one with the largest id is a response and the others revisit it; payloads
under `revisit_from` bytes are always responses. A null payload is empty; a null id is written as such, and revisits or is revisited
only as the smallest of ids. Rows repeated with the largest id are all responses. An empty table gives no archive and no rows. Columns
other than page_id, url and html aren't read and may have any name. An archive is as large as its task's rows and is read back as one
value, so a partition has to hold less than 2 GB of compressed records; Spark's default of 128 MB of input for each is well below.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, columns, shared_dir, slices, small_batches, tidy, written

#: Fixed values of the Zstandard and WARC-Zstandard formats.
FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame (magic 0x184D2A50, length 0), as text.
SEPARATOR = "P*M\x18\0\0\0\0"
#: Repeated payloads (some 100 bytes each) that are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode("utf-8", "surrogatepass")


def uri(url: str | None) -> str:
    """The URL without characters that would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return head("WARC/1.1", [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def build_dictionary(sample: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too few or too short records, their raw ends serve as one."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, sample)) // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:] or b"WARC/1.1\r\n"


def archive(records: Iterator[bytes], *, dictionary_size: int, sample_bytes: int, level: int) -> Iterator[bytes]:
    """The frames of one archive. Records in the sample count whole, up to `sample_bytes` in all."""
    sample: list[bytes] = []
    held = 0
    compress = None

    def start() -> Iterator[bytes]:
        nonlocal compress
        raw = build_dictionary(sample, dictionary_size)
        compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw)).compress
        yield skippable(DICTIONARY_FRAME, raw)
        yield from map(compress, sample)

    for r in records:
        if compress:
            yield compress(r)
            continue
        sample.append(r)
        held += len(r)
        if held >= sample_bytes:
            yield from start()
    if sample and not compress:
        yield from start()


def write_archives(pages: DataFrame, path: str, *, revisit_from: int = 0, dictionary_size: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of page_id, url and html under `path`. The table of repeated payloads has a row per payload that occurs twice."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    repeated = rows.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("size") >= revisit_from)).drop("n")
    repeated = written(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, ["sha", "size"], "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))) < F.col("first"), F.col("first")))
    schema = pa.schema([("frame", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for part in slices(b, "payload"):
                    for row in zip(*columns(part, "page_id", "url", "payload", "refers_to"), strict=True):
                        yield record(*row, date)

        out: list[bytes] = []
        for frame in archive(records(), dictionary_size=dictionary_size, sample_bytes=sample_bytes, level=level):
            out.append(frame)
            if len(out) >= 1000:
                yield batch(schema, out)
                out = []
        if out:
            yield batch(schema, out)

    frames = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(tidy(task), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and the sizes of its blocks."""
    flags = data[at + 4]
    single, content, check, dictionary = flags >> 5 & 1, flags >> 6, flags >> 2 & 1, flags & 3
    at += 5 + (not single) + (0, 1, 2, 4)[dictionary] + ((single, 2, 4, 8)[content])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * check


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at = memoryview(data), 0
    decompress = zstandard.ZstdDecompressor()
    while at + 4 <= len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME:
                decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(view, at)
            yield decompress.decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def fields_of(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:] if line)


def parse(raw: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null of a revisit)."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    f = fields_of(top)
    block = rest[: int(f["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    size, own = int(fields_of(http)["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
    if f["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != own):
        raise ValueError(f"damaged record {f['WARC-Record-ID']}")
    return number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], number(f.get("WARC-Refers-To")), size, own, payload if f["WARC-Type"] == "response" else None


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """One row per record. The digest of every response is computed anew and must match its header."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payload)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, held = [], 0
                for raw in read_archive(content.as_buffer()):
                    out.append(parse(raw)[: 6 + payload])
                    held += len(raw) if payload else 200
                    if held > 4_000_000:
                        yield batch(schema, *zip(*out, strict=True))
                        out, held = [], 0
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(tidy(task), RECORDS + ", payload binary" * payload)


def op2_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][CAST(strpos('0123456789abcdef', substr(sha, CAST(i AS INTEGER), 1)) AS INTEGER)]), '') AS bits,
        max(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER) + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
