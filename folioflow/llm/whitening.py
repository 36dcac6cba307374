"""Embedding whitening by TSQR, without forming a covariance.

Components become integers x = floor(64 c) + 1000000, whose sums per dimension are exact. Each partition centres its rows with these sums
and keeps the R factor of their QR decomposition, a batch at a time; R factors are merged in a tree, a few of them in a task, until one
is left. Its singular values and right singular vectors are those of all centred rows: they whiten, and no Gram matrix squares the
condition number. The driver holds d sums and one matrix of d x d, whatever the number of rows; no key groups rows, so nothing is skewed.

deviation (the sum over dimensions of (n x - S)^2) is exact, in Python's integers where 64 bits don't hold it. The covariance that
identity_error looks at is merged in a tree of means and centred products, too.

Left out are vectors that are null, hold null or non-finite components, or components whose x a long can't hold (2^56 or more), and
vectors of another length than most have (of lengths equally frequent, the longest counts). Rows that repeat a vec_id, or have none, are
rows of their own. Components of no variance (constant dimensions, fewer rows than dimensions) have nothing to be divided by and are
left out; the rest keep their numbers. So a table of one row, of equal rows only, or of no rows, gives no rows. Equal eigenvalues may be
turned among themselves. Columns other than the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, tidy, written
from .trees import partition_states, tree

COMPONENTS = 32
SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 56)
#: Rows that go into a QR step together with the R so far, as a multiple of the dimension, and at least.
TIMES, LEAST = 4, 2048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the vectors that count, of any length."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"))
    return rows.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < BOUND, F.lit(False))) & (F.size("v") > 0))


def matrix(b: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, all of one length, as longs x."""
    flat = b.column(b.schema.get_field_index("v")).flatten().to_numpy()
    return np.floor(flat * SCALE).astype(np.int64).reshape(b.num_rows, -1) + SHIFT


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension over the vectors of the commonest length; (0, []) where there are none."""
    sized = rows.withColumn("d", F.size("v"))
    top = sized.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return 0, []
    schema = pa.schema([("at", pa.int32()), ("s", pa.decimal128(38, 0))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * top["d"]
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                fits = int(np.abs(x).max()) < (1 << 62) // len(x)
                total = [t + int(s) for t, s in zip(total, (x if fits else x.astype(object)).sum(0), strict=True)]
        yield batch(schema, range(len(total)), [Decimal(t) for t in total])

    parts = rows.filter(F.size("v") == top["d"]).mapInArrow(tidy(task), "at int, s decimal(38,0)")
    found = {r["at"]: int(r["s"]) for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect()}
    return top["count"], [found[i] for i in range(top["d"])]


class Centre:
    """x - S / n and n x - S, both from S split into whole and remaining parts, so that nothing cancels."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in total], dtype=np.int64)
        self.rest = np.array([s % n for s in total], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        y = x - self.whole
        far = int(np.abs(y).max(initial=0)) + 1
        if (far * self.n) ** 2 * x.shape[1] < 1 << 63:
            z = y * self.n - self.rest
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - self.rest.astype(object)
        return [int(v) for v in (z * z).sum(1)]


def triangle(*parts: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def r_factor(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The R factor of all centred rows; fewer rows than dimensions where the rows are fewer."""
    d = len(centre.whole)
    many = max(TIMES * d, LEAST)

    def step(r: np.ndarray | None, b: pa.RecordBatch) -> np.ndarray:
        for i in range(0, b.num_rows, many):
            c = centre.centred(matrix(b.slice(i, many)))
            r = triangle(c) if r is None else triangle(r, c)
        return r

    load = lambda s: np.frombuffer(s, np.float64).reshape(-1, d)
    state = tree(partition_states(rows, step, lambda r: r.tobytes()), lambda states: triangle(*map(load, states)).tobytes())
    return load(state)


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two sets of rows together."""
    (na, ma, pa_), (nb, mb, pb) = a, b
    gap = mb - ma
    return na + nb, ma + gap * (nb / (na + nb)), pa_ + pb + np.outer(gap, gap) * (na * nb / (na + nb))


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of w, centred before multiplying, minus the identity."""

    def step(state: tuple | None, b: pa.RecordBatch) -> tuple:
        w = b.column(0).flatten().to_numpy().reshape(-1, k)
        m = w.mean(0)
        now = len(w), m, (w - m).T @ (w - m)
        return now if state is None else merged_moments(state, now)

    pack = lambda s: np.concatenate(([s[0]], s[1], s[2].ravel())).astype(np.float64).tobytes()

    def load(s: bytes) -> tuple:
        v = np.frombuffer(s, np.float64)
        return v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)

    def merge(states: list[bytes]) -> bytes:
        out = load(states[0])
        for s in states[1:]:
            out = merged_moments(out, load(s))
        return pack(out)

    n, _, p = load(tree(partition_states(rows.select("w"), step, pack), merge))
    return float(np.abs(p / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error of each vector that counts and each component."""
    kind = dict(vectors.dtypes)[key]
    shape = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(vectors, key, vector)
    n, total = sums(rows)
    nothing = vectors.sparkSession.createDataFrame([], shape)
    if not n:
        return nothing
    rows = rows.filter(F.size("v") == len(total))
    centre = Centre(n, total)
    _, s, turn = np.linalg.svd(r_factor(rows, centre), full_matrices=False)
    k = min(components, int((s > s[0] * np.finfo(np.float64).eps * max(n, len(total)) ** 0.5 * 8).sum())) if s[0] > 0 else 0
    if not k:
        return nothing
    explained = (s[:k] ** 2 / (s**2).sum()).tolist()
    turn = turn[:k].T
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(k)] < 0, -1.0, 1.0) / (s[:k] / np.sqrt(n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                w = pa.ListArray.from_arrays(np.arange(0, k * len(x) + 1, k, dtype=np.int32), pa.array((centre.centred(x) @ turn).ravel()))
                far = pa.array([Decimal(v) for v in centre.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), far, w], names=["id", "deviation", "w"])

    table = written(rows.mapInArrow(tidy(task), f"id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    error = identity_error(table, k)
    out = table.select(F.col("id").alias(key), "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_tsqr_whitening(spark, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
