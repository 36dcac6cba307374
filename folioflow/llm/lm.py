r"""Language-model scoring by deleted interpolation.

A word's probability after its predecessor mixes three maximum-likelihood estimates: uniform, 1 / (V + 1); unigram, c(w) / N; bigram,
c(v, w) / c(v). The weights depend on the bucket, by powers of two, of the context's frequency c(v), and are learned by expectation-
maximisation on counts held out from the estimates: a seventh of the training documents is scored with the counts of the others. With
the weights fixed, the estimates take all training counts.

Lower-case A-Z; tokens are runs of [^\x20\x09-\x0D] and one end, which is a token and also the context of the next text's first word.

Documents go through as chunks of some million tokens. A chunk sends each distinct word and word pair once, with its counts, as a
64-bit hash, to the bucket of that hash; a bucket, whose size is set by the size of the corpus, sums the counts and answers each chunk in
the chunk's own order. So a frequent word costs one number a chunk, whatever its frequency, and nothing but sums by bucket and the
histogram for the weights (bounded by its grid) reaches the driver. Statistics cover every token of every training document.

A null text is empty: one end. A null id counts as the empty text in the fold rule. Rows that repeat an id are documents of their own.
Without training documents base_score and score are those of an untrained uniform model. An empty table gives an empty result. A very
long text is one document of its chunk, which then exceeds its usual size by that text. Columns other than doc_id and text aren't read
and may have any name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_bounds, pack, pack_counts, pack_sorted, unpack, unpack_sorted
from .common import batch, columns, mix, slices, small_batches, spans, tidy, words, written

#: Tokens a chunk holds at least, bytes of text for each bucket of keys, steps of the histogram to a factor of two.
CHUNK, BUCKET_BYTES, GRID = 1_500_000, 24 << 20, 8
#: Buckets of the context frequency, by powers of two; 0 is a context never seen.
CONTEXTS = 24
SCORED, HELD, TRAIN = 0, 1, 2

_END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: int | None, by: int, scored: int, held: int) -> int:
    r = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by
    return SCORED if r == scored else HELD if r == held else TRAIN


class Chunk:
    """Tokens of some documents, as ranks in the chunk's sorted distinct word hashes."""

    def __init__(self, lengths: np.ndarray, folds: np.ndarray, keys: np.ndarray, ranks: np.ndarray):
        self.lengths, self.folds, self.keys, self.ranks = lengths, folds, keys, ranks

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pair hashes, sorted; each token's pair; the ranks before each token; the document fold of each token."""
        end = int(np.searchsorted(self.keys, _END))
        before = np.concatenate(([end], self.ranks[:-1]))  # the end of one text stands before the next
        h = mix(self.keys[before] * _STEP + self.keys[self.ranks])
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        at = np.empty(len(h), np.int32)
        at[order] = np.cumsum(new) - 1
        return s[new], at, before, np.repeat(self.folds, self.lengths)


def chunks(docs: DataFrame, by: int, scored: int, held: int, chunk: int) -> DataFrame:
    """chunk, held (whether it holds the held-out documents), doc_ids, lengths, folds, keys, ranks."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), ("held", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("lengths", "folds", "keys", "ranks")]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 24)
        state = {False: ([], [], [], {}, []), True: ([], [], [], {}, [])}
        sizes = {False: 0, True: 0}

        def close(kind: bool) -> pa.RecordBatch:
            ids, lengths, folds, seen, stream = state[kind]
            raw = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
            keys, rank = np.unique(np.append(raw, _END), return_inverse=True)
            ranks = rank[np.concatenate(stream)].astype(np.uint32)
            row = batch(schema, [next(number)], [kind], [ids], [pack(np.array(lengths, np.uint32))], [pack(np.array(folds, np.uint8))], [pack_sorted(keys)], [pack(ranks)])
            state[kind] = ([], [], [], {}, [])
            sizes[kind] = 0
            return row

        for b in batches:
            for part in slices(b, "text"):
                for d, t in zip(*columns(part, "doc_id", "text"), strict=True):
                    f = fold(d, by, scored, held)
                    kind = f == HELD
                    ids, lengths, folds, seen, stream = state[kind]
                    tokens = words(t)
                    at = [seen.setdefault(w, len(seen)) for w in tokens]
                    at.append(-1)  # the end, appended last to the distinct words
                    stream.append(np.array(at, np.int32))
                    ids.append(d)
                    lengths.append(len(at))
                    folds.append(f)
                    sizes[kind] += len(at)
                    if sizes[kind] >= chunk:
                        yield close(kind)
        for kind in (False, True):
            if sizes[kind]:
                yield close(kind)

    kinds = "chunk long, held boolean, doc_ids array<long>, lengths binary, folds binary, keys binary, ranks binary"
    return written(docs.select("doc_id", "text").mapInArrow(tidy(task), kinds), "chunks")


def opened(b: pa.RecordBatch | pa.Table, r: int) -> Chunk:
    get = lambda c: unpack(b.column(c)[r].as_py())
    return Chunk(get("lengths").astype(np.int64), get("folds"), unpack_sorted(b.column("keys")[r].as_py()), get("ranks").astype(np.int64))


def requests(table: DataFrame, buckets: int) -> DataFrame:
    """kind (1 word, 2 pair), bucket, chunk, keys, train and held counts of the chunk's distinct words and pairs."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("held", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                c = opened(b, r)
                pairs, at, _, folds = c.pairs()
                for kind, keys, place in ((1, c.keys, c.ranks), (2, pairs, at)):
                    counts = [np.bincount(place[folds == f], minlength=len(keys)) for f in (TRAIN, HELD)]
                    ends = bucket_bounds(keys, buckets)
                    rows = [(k, pack_sorted(keys[i:j]), *(pack_counts(x[i:j]) for x in counts)) for k, (i, j) in enumerate(itertools.pairwise(ends.tolist())) if j > i]
                    n = len(rows)
                    yield batch(schema, [kind] * n, [x[0] for x in rows], [b.column("chunk")[r].as_py()] * n, *[[x[k] for x in rows] for k in (1, 2, 3)])

    return table.select("chunk", "lengths", "folds", "keys", "ranks").mapInArrow(tidy(task), "kind int, bucket int, chunk long, keys binary, train binary, held binary")


def answers(asked: DataFrame) -> DataFrame:
    """For each request, the corpus counts of its keys, in its order; and, with chunk -1, the sums of a bucket of words."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("train", pa.binary()), ("held", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])

    def serve(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        parts = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        s = every[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        group = np.empty(len(s), np.int64)
        group[order] = np.cumsum(new) - 1
        sums = [np.bincount(group, np.concatenate([unpack(x) for x in table.column(c).to_pylist()]).astype(np.float64)).astype(np.int64) for c in ("train", "held")]
        at = spans([len(p) for p in parts])
        mine = [[pack_counts(x[group[i:j]]) for i, j in itertools.pairwise(at.tolist())] for x in sums]
        n = len(parts)
        types = int(((sums[0] + sums[1]) > 0).sum()) if kind == 1 else 0
        tokens = int((sums[0] + sums[1]).sum()) if kind == 1 else 0
        chunk = table.column("chunk").to_pylist()
        empty = pack_counts(np.zeros(0, np.int64))
        return pa.Table.from_batches([batch(schema, [*chunk, -1], [kind] * (n + 1), [bucket] * (n + 1), [*mine[0], empty], [*mine[1], empty], [0] * n + [types], [0] * n + [tokens])])

    return written(asked.groupBy("kind", "bucket").applyInArrow(serve, "chunk long, kind int, bucket int, train binary, held binary, types long, tokens long"), "answers")


class Estimates:
    """A chunk's tokens with the corpus counts of what they are made of."""

    def __init__(self, chunk: pa.Table, found: pa.Table):
        self.c = opened(chunk, 0)
        pairs, self.pair, self.before, self.folds = self.c.pairs()
        rows = sorted(zip(*(found.column(k).to_pylist() for k in ("kind", "bucket", "train", "held")), strict=True), key=lambda r: r[:2])
        self.word, self.two = ([np.concatenate([unpack(r[k]).astype(np.int64) for r in rows if r[0] == kind]) for k in (2, 3)] for kind in (1, 2))
        if len(self.word[0]) != len(self.c.keys) or len(self.two[0]) != len(pairs):
            raise ValueError("answers don't match the chunk")

    def probabilities(self, tokens: int, types: int, held_out: bool) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Context bucket, uniform, unigram and bigram estimate of each token; held_out: without the held counts."""
        word, two = (x[0] if held_out else x[0] + x[1] for x in (self.word, self.two))
        context = word[self.before]
        bucket = np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), CONTEXTS - 1)
        return bucket, 1 / (types + 1), word[self.c.ranks] / max(tokens, 1), two[self.pair] / np.maximum(context, 1)


def em(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of uniform, unigram and bigram for each context bucket. cells: bucket, steps of unigram and bigram over uniform, count."""
    weights = np.tile([0.1, 0.45, 0.45], (CONTEXTS, 1))
    weights[0] = [0.5, 0.5, 0]
    for k in range(CONTEXTS):
        x = cells[cells[:, 0] == k]
        if not len(x):
            continue
        n = x[:, 3].astype(float)
        ratio = np.stack([np.ones(len(x)), *(np.where(x[:, j] == NEVER, 0.0, np.exp2(x[:, j] / GRID)) for j in (1, 2))], 1) * uniform
        w = weights[k]
        for _ in range(rounds):
            share = ratio * w
            share /= np.maximum(share.sum(1), 1e-300)[:, None]
            w = (share * n[:, None]).sum(0) + [0.5, 0.5, 0.5 if k else 0]
            w /= w.sum()
        weights[k] = w
    seen = [k for k in range(1, CONTEXTS) if (cells[:, 0] == k).any()]
    for k in range(1, CONTEXTS):  # a bucket without held-out tokens takes the weights of the nearest that has some
        if seen and k not in seen:
            weights[k] = weights[min(seen, key=lambda s: (abs(s - k), s))]
    return weights


NEVER = -(1 << 20)


def steps(p: np.ndarray, uniform: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300) / uniform)), NEVER).astype(np.int64)


def learn_weights(table: DataFrame, found: DataFrame, tokens: int, types: int, held_tokens: int) -> np.ndarray:
    schema = pa.schema([("bucket", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64())])

    def task(key, chunk, given):
        uniform = 1 / (types + 1)
        e = Estimates(chunk, given)
        bucket, _, one, two = e.probabilities(tokens - held_tokens, types, True)
        cells, n = np.unique(np.stack([bucket, steps(one, uniform), steps(two, uniform)], 1), axis=0, return_counts=True)
        return pa.Table.from_batches([batch(schema, *cells.T, n)])

    held = table.filter("held")
    mine = found.filter("chunk >= 0").join(held.select("chunk"), "chunk", "left_semi")
    cells = held.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(task, "bucket long, one long, two long, n long")
    rows = cells.groupBy("bucket", "one", "two").agg(F.sum("n").alias("n")).collect()
    return em(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4), 1 / (types + 1))


def score(docs: DataFrame, *, by: int = 7, scored: int = 2, held: int = 3, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    table = chunks(docs, by, scored, held, chunk)
    found = answers(requests(table, buckets))
    sums = found.filter("chunk < 0").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, tokens = sums["types"] or 0, sums["tokens"] or 0
    held_tokens = table.filter("held").select(F.col("lengths")).mapInArrow(tidy(_lengths), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    weights = learn_weights(table, found, tokens, types, held_tokens)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def task(key, chunk, given):
        e = Estimates(chunk, given)
        bucket, uniform, one, two = e.probabilities(tokens, types, False)
        w = weights[bucket]
        p = w[:, 0] * uniform + w[:, 1] * one + w[:, 2] * two
        count = (e.word[0] + e.word[1])[e.c.ranks]
        starts = spans(e.c.lengths)[:-1]
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((count + 1) / (tokens + (types + 1)))
        ids = chunk.column("doc_ids")[0].as_py()
        n = len(ids)
        return pa.Table.from_batches([batch(schema, ids, e.c.folds == SCORED, e.c.lengths, add((count > 0).astype(np.int64)), [tokens] * n, add(base), add(np.log10(p)))])

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.groupBy("chunk").cogroup(found.filter("chunk >= 0").groupBy("chunk")).applyInArrow(task, kinds)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(pa.schema([("n", pa.int64())]), [int(unpack(x).sum()) for x in b.column(0).to_pylist()])


def op4_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
