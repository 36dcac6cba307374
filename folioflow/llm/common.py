"""What the operators share: the shared scratch folder, word rules, Arrow helpers and hashing."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; everything else stays.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Rows that are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; where that is unset (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/folioflow-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, written once as a Parquet table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing to come reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def few(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on from task to task and from query to query."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(task):
    """The task, releasing memory when it ends."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def small_batches(spark: SparkSession, rows: int = 300) -> None:
    """Fewer rows in each Arrow batch than Spark's default, unless the session has its own: whole texts are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def crc_mod(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def free_name(taken: list[str], name: str) -> str:
    """The name, with as many underscores after it as no name taken has in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    r"""Runs of [^\x20\x09-\x0D] of the text in UTF-8, A-Z lower-cased. bytes.split() cuts at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batch(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, text: str, most: int = 8_000_000):
    """The batch in pieces of about `most` bytes of text each, so that very long texts don't add up in memory; a text is never cut."""
    at = batch.schema.get_field_index(text)
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(at)).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def gathered(batches, text: str, most: int = 8_000_000):
    """The batches again, small ones together and large ones cut, at about `most` bytes of text each."""
    held, size = [], 0
    for b in batches:
        for part in slices(b, text, most):
            held.append(part)
            size += part.column(part.schema.get_field_index(text)).nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size or held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def spans(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Offsets, one more than lengths."""
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))


def chain(lists) -> list:
    return list(itertools.chain.from_iterable(lists))
