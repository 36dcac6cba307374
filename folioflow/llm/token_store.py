"""Token ids in one concatenated array with Elias-Fano encoded document boundaries.

A file holds shards one after another, each self-describing: header, Elias-Fano sequence of the documents' ends, Elias-Fano sequence
of the document ids (ascending, less the first), ids of 2 or 4 bytes. An Elias-Fano sequence of n values up to u takes about
2 + log2(u / n) bits a value; select samples give any value without decoding the others.

Documents are dealt to tasks by ranges of doc_id, among rows of one id by the beginnings of their texts, a hash, and where they came
from, and sorted there, so file order is id order and an id that very many rows share fills several files; a shard is cut when it holds
`shard_ids` ids, so a task never holds more than that and one document. Spark's text writer writes the files (see warc.py on why) and
the separator after each shard is part of the format. Offsets before each shard come from a table with one row per shard, in the order
of the partitions that wrote the files; offsets within a shard come from select.

Columns of docs other than doc_id and text aren't read and may have any name. A null text has no ids but its end id. Rows with equal ids are kept, ordered by the first 64 characters of
their texts and then by a hash. Very long texts are batches of their own. A null id sorts first and reads back as null. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, columns, gathered, shared_dir, small_batches, tidy, written
from .encoding import default_path, encoder

MAGIC = b"EFTOKEN1"
SEPARATOR = "\n"
#: Bytes of text for each file, about.
FILE_BYTES = 32 << 20
#: Bytes of text that a task encodes at a time; a worker needs some 30 times as much beside the tokenizer.
ENCODED = 2_000_000
#: Characters of a text that order rows of one id.
HEAD = 64
#: Every this many-th value has its place in the high bits noted.
STEP = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        k = max(0, (top // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)
        places = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> k) + n + 1, dtype=np.uint8)
        high[places] = 1
        return cls(n, k, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::STEP].astype("<u8").tobytes())

    def _low(self, i: int) -> int:
        k = self.low_bits
        a, b = i * k, (i + 1) * k
        return int.from_bytes(self.low[a >> 3 : (b + 7) >> 3], "little") >> (a & 7) & ((1 << k) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest noted place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u8", 1, 8 * (i // STEP))[0])
        missing = i % STEP
        byte = at >> 3
        bits = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= missing:
            missing -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(missing):
            bits &= bits - 1
        place = 8 * byte + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (places - np.arange(self.n)) << self.low_bits | low

    def to_bytes(self) -> bytes:
        return struct.pack("<QBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, k, *sizes = struct.unpack_from("<QBIII", data, at)
        at += 21
        parts = []
        for s in sizes:
            parts.append(bytes(data[at : at + s]))
            at += s
        return cls(n, k, *parts), at


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard. ids: each document's, with its end id."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum([len(x) // width for x in ids]))
    body = b"".join(ids)
    head = ends.to_bytes() + EliasFano.encode((known - base).astype(np.uint64)).to_bytes()
    return MAGIC + struct.pack("<BQqIQ", width, nulls, base, len(head), len(body)) + head + body


class Shard:
    def __init__(self, data, at: int = 0):
        if bytes(data[at : at + 8]) != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        self.width, self.nulls, self.base, head, body = struct.unpack_from("<BQqIQ", data, at + 8)
        at += 8 + 29
        self.ends, mid = EliasFano.from_bytes(data, at)
        self.docs, _ = EliasFano.from_bytes(data, mid)
        at += head
        self.ids = np.frombuffer(data, f"<u{self.width}", body // self.width, at)
        self.end = at + body

    def start(self, i: int) -> int:
        """Where document i begins, by select; for i the number of documents, where the last one ends."""
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.start(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.decode() + self.base).tolist()


def shards(data) -> Iterator[Shard]:
    at = 0
    while at < len(data):
        shard = Shard(data, at)
        yield shard
        at = shard.end + len(SEPARATOR)


def write_store(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = 1_000_000, partitions: int | None = None) -> None:
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = partitions or max(spark.sparkContext.defaultParallelism * 2, -(-total // FILE_BYTES))
    # Rows of one id, and equal rows, can be dealt to several tasks; the keys are short, for Spark draws a sample of them.
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_")).withColumns({"head_": F.substring("text", 1, HEAD), "hash_": F.xxhash64("text")})
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("head_"), F.asc("hash_"), F.asc("row_")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("shard", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0
        for part in gathered(batches, "text", ENCODED):
            for d, ids in zip(columns(part, "doc_id")[0], enc.many(part.column(1)), strict=True):
                names.append(d)
                held.append(ids + end)
                size += len(held[-1]) // enc.dtype.itemsize
                if size >= shard_ids:
                    yield batch(schema, [pack(names, held, enc.dtype.itemsize)])
                    names, held, size = [], [], 0
        if names:
            yield batch(schema, [pack(names, held, enc.dtype.itemsize)])

    ordered.mapInArrow(tidy(task), "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def part_number(file: str) -> Column:
    """The partition a file was written by, from its name, where numbers beyond five digits aren't padded."""
    return F.regexp_extract(F.element_at(F.split(file, "/"), -1), r"part-(\d+)", 1).cast("long")


def read_store(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int), of every document in the files."""
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("first", pa.int64()), ("shard_tokens", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, s in enumerate(shards(content.as_buffer())):
                    doc_ids, bounds = s.doc_ids(), np.array([s.start(i) for i in range(s.ends.n + 1)], dtype=np.int64)
                    wide = s.ids.astype("<u4")
                    cells = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                    crc = [zlib.crc32(wide[i:j]) for i, j in cells]
                    one = [name] * len(cells), [k] * len(cells), [doc_ids[0]] * len(cells), [len(wide)] * len(cells)
                    more = [[wide[i:j].astype(np.int32) for i, j in cells]] if ids else []
                    yield batch(schema, *one, doc_ids, bounds[:-1], np.diff(bounds), crc, *more)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = written(files.mapInArrow(tidy(task), "file string, shard int, first long, shard_tokens long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids), "read")
    table = rows.filter(F.col("within") == 0).groupBy("file", "shard").agg(F.max("shard_tokens").alias("shard_tokens"))
    before = Window.orderBy(part_number("file"), "file", "shard").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("base", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0))).drop("shard_tokens")
    return rows.join(table, ["file", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op9_elias_fano_tokens(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
