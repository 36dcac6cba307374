r"""Benchmark decontamination: a hash set of the benchmark's normalised n-grams is sent to every task, which scans the windows of its
training words, verifies each hit word by word and marks, cuts out or drops what it found.

The set goes out as a broadcast only up to `most_windows` windows, which Spark counts first. A larger benchmark stays a table: a bitmap of
its windows' hashes, of bounded size, goes out instead, and the windows of the training words that it doesn't rule out meet those of the
benchmark in one join by hash and words. Either way the corpus is scanned once for windows; the second way writes it down first, with a
number for each row, so that rows that repeat an id, or have none, stay apart.

Words: A-Z lower-cased, runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] (letters, digits, everything beyond ASCII). A window is 10 consecutive
words of an item; an item with fewer, but at least one, is one window. Null texts have no words; an item with a null id counts as
named ''. Repeated items count once by id. Very long texts are batches of their own. Columns of docs called as marked()'s are replaced there,
and pass through decontaminate() untouched. An empty benchmark leaves all documents clean; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chain, columns, few, free_name, mix, slices, small_batches, spans, tidy, written
from .jaccard import Hashes
from .trees import partition_states, tree

WINDOW = 10
#: Windows that one broadcast may hold, some 50 MB in each worker; bits of the bitmap for more of them.
MOST_WINDOWS, MOST_BITS = 100_000, 1 << 29

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The benchmark's windows, by length: hashes sorted for the scan, and the words and items of each for the check."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[bytes, set[str]] = defaultdict(set)
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)], dtype=np.int32)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found[ids[i : i + n].tobytes()].add(name)
        self.items = {k: tuple(sorted(v)) for k, v in found.items()}
        self.lengths = sorted({len(k) // 4 for k in self.items})
        self.hashes = {n: np.unique(np.concatenate([self.roll(np.frombuffer(k, np.int32), n) for k in self.items if len(k) == 4 * n])) for n in self.lengths}

    @staticmethod
    def roll(ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)
        return out

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[dict[int, tuple[str, ...]]]]:
        """Words of each text; whether each word, in a row over all texts with a gap after each, is hit; the items of each text."""
        get = self.vocabulary.get
        lists = [plain_words(t) for t in texts]
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.array(chain([*[get(w, -1) for w in x], -1] for x in lists), dtype=np.int32)
        starts = spans(counts + 1)
        marks = np.zeros(len(ids) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in texts]
        gaps = spans(ids < 0)
        for n in self.lengths:
            if len(ids) < n:
                continue
            at = np.flatnonzero(gaps[n:] == gaps[:-n])
            if n > 1 and len(at):
                rolled = np.zeros(len(at), dtype=np.uint64)
                for k in range(n):
                    rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
                known = self.hashes[n]
                at = at[known[np.minimum(np.searchsorted(known, rolled), len(known) - 1)] == rolled]
            for i in at.tolist():
                if names := self.items.get(ids[i : i + n].tobytes()):
                    marks[i] += 1
                    marks[i + n] -= 1
                    items[int(np.searchsorted(starts, i, side="right")) - 1].update(names)
        return counts, np.cumsum(marks[:-1]) > 0, items


def ranges(hit: np.ndarray) -> np.ndarray:
    """Starts and ends, by turns, of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))


def cut(text: str, runs: list[int]) -> str:
    """The text without the words of the runs, from the first word of each to its last; what stands between stays."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def without_runs(b: pa.RecordBatch, runs: list[np.ndarray]) -> pa.RecordBatch:
    """The batch, with the words of each row's runs cut out of its text."""
    if not any(map(len, runs)):
        return b
    at = b.schema.get_field_index("text")
    fixed = [cut(t, r.tolist()) if len(r) else t for t, r in zip(b.column(at).to_pylist(), runs, strict=True)]
    return b.set_column(at, "text", pa.array(fixed, b.column(at).type))


def window_counts(benchmark: DataFrame, window: int) -> int:
    """How many windows the benchmark has, counted by Spark."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    each = F.when(words > 0, F.greatest(words - window + 1, F.lit(1))).otherwise(0)
    return benchmark.agg(F.sum(each.cast("long")).alias("n")).first()["n"] or 0


MARKS = "n_words long, runs array<int>, items array<string>"


def marked(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, most_windows: int = MOST_WINDOWS, cut_out: bool = False) -> DataFrame:
    """All columns of docs with n_words, runs (word positions: start, end, start, end ...) and items (sorted); a column of docs of one of these names gives way.
    With cut_out the texts come without their runs, cut in the same pass: a second one would keep a second Python worker for each task."""
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "runs", "items")])
    small_batches(docs.sparkSession)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    if window_counts(benchmark, window) > most_windows:
        return _joined(docs, named, window, cut_out)
    items = [(r["name"], r["text"]) for r in named.toLocalIterator()]
    return _scan(docs, docs.sparkSession.sparkContext.broadcast(Windows(items, window)), cut_out)


def hashed(tokens: list[bytes], n: int, hashes: Hashes) -> np.ndarray:
    """A hash of each n consecutive words."""
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out)


def _windows(named: DataFrame, window: int) -> DataFrame:
    """n, hash, words, name of each window of the benchmark, once for each item."""
    schema = pa.schema([("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("name", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for name, text in zip(*columns(b, "name", "text"), strict=True):
                tokens = plain_words(text)
                n = min(window, len(tokens))
                if n:
                    h = hashed(tokens, n, hashes).view(np.int64)
                    yield batch(schema, [n] * len(h), h, [b" ".join(tokens[i : i + n]) for i in range(len(h))], [name] * len(h))

    return written(named.mapInArrow(tidy(task), "n int, hash long, words binary, name string").distinct(), "windows")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash modulo the number of bits, as bytes."""

    def step(state: np.ndarray | None, b: pa.RecordBatch) -> np.ndarray:
        state = np.zeros(bits // 8, np.uint8) if state is None else state
        at = b.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
        np.bitwise_or.at(state, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        return state

    def merge(states: list[bytes]) -> bytes:
        out = np.frombuffer(states[0], np.uint8).copy()
        for s in states[1:]:
            out |= np.frombuffer(s, np.uint8)
        return out.tobytes()

    return np.frombuffer(tree(partition_states(hashes.select("hash"), step, lambda s: s.tobytes()), merge, 4), np.uint8)


def _joined(docs: DataFrame, named: DataFrame, window: int, cut_out: bool) -> DataFrame:
    """What marked() gives, by a join of windows."""
    spark = docs.sparkSession
    ours = _windows(named, window)
    lengths = sorted(r["n"] for r in ours.select("n").distinct().collect())  # at most `window`
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (16 * ours.count()).bit_length()))
    sent = spark.sparkContext.broadcast(bitmap(ours, bits))
    names = docs.columns
    number = free_name(names, "row_")
    whole = written(docs.withColumn(number, F.monotonically_increasing_id()), "docs")
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), sent.value
        for whole in batches:
            for b in slices(whole, "text"):
                for row, text in zip(*columns(b, number, "text"), strict=True):
                    tokens = plain_words(text)
                    for n in lengths:
                        if len(tokens) >= n:
                            h = hashed(tokens, n, hashes)
                            bit = h & np.uint64(bits - 1)
                            at = np.flatnonzero(seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                            if len(at):
                                yield batch(schema, [row] * len(at), at, [n] * len(at), h[at].view(np.int64), [b" ".join(tokens[i : i + n]) for i in at.tolist()])

    likely = whole.select(number, "text").mapInArrow(tidy(find), "row long, at int, n int, hash long, words binary")
    # Both sides are tables, so that adaptive execution can split a passage that very many documents share.
    hits = written(likely, "likely").join(ours, ["hash", "n", "words"]).select("row", "at", "n", "name")
    found = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.array_sort(F.collect_set("name")).alias("items"))
    found = written(found.select(F.col("row").alias(f"{number}_"), F.col("hits.at").alias(f"{number}at"), F.col("hits.n").alias(f"{number}n"), F.col("items").alias(f"{number}items")), "hits")
    both = whole.join(few(found), F.col(number) == F.col(f"{number}_"), "left").select(*names, f"{number}at", f"{number}n", f"{number}items")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, ats, ns, items = columns(b, "text", f"{number}at", f"{number}n", f"{number}items")
                counts, runs = [], []
                for text, at, n in zip(texts, ats, ns, strict=True):
                    counts.append(len(plain_words(text)))
                    edges = np.zeros(counts[-1] + 1, np.int64)
                    np.add.at(edges, np.array(at or [], np.int64), 1)
                    np.add.at(edges, np.array(at or [], np.int64) + np.array(n or [], np.int64), -1)
                    runs.append(ranges(np.cumsum(edges[:-1]) > 0))
                kept = (without_runs(b, runs) if cut_out else b).columns[:-3]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array([x or [] for x in items], pa.list_(pa.string()))], names=[*names, "n_words", "runs", "items"])

    return both.mapInArrow(tidy(mark), _with_marks(docs).schema)


def _with_marks(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))


def _scan(docs: DataFrame, windows, cut_out: bool) -> DataFrame:
    """What marked() gives, by a broadcast set of windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                counts, hit, items = windows.value.scan(columns(b, "text")[0])
                starts = spans(counts + 1)
                runs = [ranges(hit[i : i + n]) for i, n in zip(starts[:-1].tolist(), counts.tolist(), strict=True)] if hit.any() else [np.zeros(0, np.int64)] * len(counts)
                names = [sorted(x) for x in items]
                b = without_runs(b, runs) if cut_out else b
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=[*b.schema.names, "n_words", "runs", "items"])

    return docs.mapInArrow(tidy(task), _with_marks(docs).schema)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document what of it is hit and by which items."""
    found = marked(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate(F.expr("transform(filter(runs, (x, i) -> i % 2 = 1), (x, i) -> x - runs[2 * i])"), F.lit(0), lambda a, x: a + x).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"), "runs", "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", **options) -> DataFrame:
    """The documents, all columns kept. remove="spans" cuts the hit words out of the texts, "documents" drops the contaminated."""
    names = docs.columns
    found = marked(docs.withColumnsRenamed({c: f"c{i}_" for i, c in enumerate(names) if c != "text"}), benchmark, cut_out=remove == "spans", **options)
    back = {f"c{i}_": c for i, c in enumerate(names) if c != "text"}  # so no column can clash with the marks
    if remove == "documents":
        return found.filter(F.size("runs") == 0).drop("n_words", "runs", "items").withColumnsRenamed(back).select(*names)
    return found.drop("n_words", "runs", "items").withColumnsRenamed(back).select(*names)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, bench).drop("runs", "items")


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM bw WHERE len(ws) > 0)),
l AS (SELECT DISTINCT n FROM b),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS i FROM dw, l WHERE len(ws) >= n)),
h AS (SELECT doc_id, dg.n, i, item FROM dg JOIN b ON dg.n = b.n AND dg.g = b.g),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
