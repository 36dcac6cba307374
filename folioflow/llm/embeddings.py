"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors cosine >= c is a Euclidean distance of at most eps = sqrt(2 - 2c). Vectors are turned onto the principal axes of a
bounded sample (a rotation: distances stay), and sorted by the order of their grid cells of width eps on the leading axes. Blocks of
consecutive vectors are the leaves of a tree of sequence intervals, each with its bounding box on the leading axes. Pairs of intervals
are joined recursively from the top, passing over those whose boxes lie further apart than eps; pairs of blocks that remain meet in one
task, where the recursion goes on in halves down to small products of double-precision matrices. A task returns link counts and a
spanning star for each local group, never all pairs, so a cluster of copies costs rows in proportion to its size.

Every row is a vector of its own, whether its vec_id is null, stands in other rows, too, or neither: rows are numbered in a written table
and linked by these numbers. A null, zero or non-finite vector, or one that holds a null, links with nothing and is a component of its own. Vectors link only with
vectors of the same length. component_id is the smallest vec_id of a component, null where none of its rows has one; there the row of
the least number is kept, elsewhere those that bear the component's id. Columns other than vec_id and embedding aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, columns, few, tidy, written
from .components import components, local_groups, with_roots

#: Rows for the principal axes (they only order vectors; any axes give the same links), leading axes, vectors a block, fan-out.
SAMPLE, AXES, BLOCK, FAN, LEAF = 4000, 12, 4096, 64, 96


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def axes(vectors: DataFrame, sample: int = SAMPLE) -> tuple[int, np.ndarray] | None:
    """The length most vectors of the sample have, and their principal axes, leading first."""
    rows = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("v").collect()]
    if not rows:
        return None
    lengths = [len(r) for r in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = unit(np.array([r for r in rows if len(r) == d]))
    return d, np.linalg.eigh(np.cov(x, rowvar=False, bias=True).reshape(d, d))[1][:, ::-1]


def projected(x: np.ndarray, turn: tuple[int, np.ndarray] | None) -> np.ndarray:
    """Coordinates of unit vectors on the leading axes."""
    y = x @ turn[1][:, :AXES] if turn and x.shape[1] == turn[0] else x[:, :AXES]
    return np.pad(y, ((0, 0), (0, AXES - y.shape[1])))


def grid_order(y: np.ndarray, eps: float) -> np.ndarray:
    """The grid cells of the leading axes, the first most significant, in one number of 62 bits."""
    side = max(2, int(np.ceil(2 / eps)) + 1)
    bits = int(side).bit_length()
    key = np.zeros(len(y), np.int64)
    for k in range(min(AXES, 62 // bits)):
        key = key << bits | np.clip(np.floor((y[:, k] + 1) / eps), 0, side).astype(np.int64)
    return key


class Join:
    """The recursion between two sorted runs of unit vectors; fills a boolean matrix of links."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, cosine: float, eps: float):
        self.a, self.b, self.ya, self.yb, self.cosine, self.eps2 = a, b, ya, yb, cosine, (eps * (1 + 1e-9)) ** 2
        self.links = np.zeros((len(a), len(b)), dtype=bool)

    def run(self, i: int, j: int, k: int, m: int) -> None:
        gap = np.maximum(0, np.maximum(self.ya[i:j].min(0) - self.yb[k:m].max(0), self.yb[k:m].min(0) - self.ya[i:j].max(0)))
        if gap @ gap > self.eps2:
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.links[i:j, k:m] = self.a[i:j] @ self.b[k:m].T >= self.cosine
            return
        halves = lambda x, y: [(x, (x + y) // 2), ((x + y) // 2, y)] if y - x > LEAF else [(x, y)]
        for p in halves(i, j):
            for q in halves(k, m):
                self.run(*p, *q)


def blocks(vectors: DataFrame, turn, eps: float, block: int, kind: str) -> DataFrame:
    """Sorted runs of vectors: at (order), dim, n, lo, hi (box), ids, data."""
    keyed = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("key", pa.int64()), ("data", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs = columns(b, "vec_id", "v")
            for d in sorted({len(v) for v in vs}):
                pick = [i for i, v in enumerate(vs) if len(v) == d]
                raw = np.array([vs[i] for i in pick])  # in doubles
                key = grid_order(projected(unit(raw), turn), eps)
                yield batch(keyed, [ids[i] for i in pick], [d] * len(pick), key, [r.tobytes() for r in raw.astype(kind)])

    made = pa.schema([("at", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def one() -> pa.RecordBatch:
            nonlocal at, held
            d = held[0][1]
            x = np.frombuffer(b"".join(h[2] for h in held), kind).reshape(-1, d)
            y = projected(unit(x), turn)
            row = [at], [d], [len(held)], [y.min(0)], [y.max(0)], [np.array([h[0] for h in held], np.int64).tobytes()], [x.tobytes()]
            at, held = at + 1, []
            return batch(made, *row)

        for b in batches:
            for row in zip(*columns(b, "vec_id", "dim", "data"), strict=True):
                if held and (len(held) >= block or held[0][1] != row[1]):
                    yield one()
                held.append(row)
        if held:
            yield one()

    rows = vectors.select("vec_id", "v").mapInArrow(tidy(keys), "vec_id long, dim int, key long, data binary")
    n = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // block)))  # no more tasks than blocks
    ordered = rows.repartitionByRange(n, "dim", "key", "vec_id").sortWithinPartitions("dim", "key", "vec_id")
    return written(ordered.mapInArrow(tidy(cut), "at long, dim int, n int, lo array<double>, hi array<double>, ids binary, data binary"), "blocks")


def near(eps: float):
    """Whether the boxes of intervals a and b come within eps."""
    gap = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= (eps * (1 + 1e-9)) ** 2


def block_pairs(table: DataFrame, eps: float) -> DataFrame:
    """i, j: the pairs of blocks (i <= j) left by the recursion over intervals of FAN ** level blocks."""
    plain = table.select("at", "dim", "lo", "hi").withColumn("k", F.row_number().over(Window.orderBy("at")) - 1)
    plain = written(plain, "boxes")
    n = plain.count()
    height = 0
    while FAN**height < n:
        height += 1
    lo, hi = (F.array(*[f(F.col(c)[i]) for i in range(AXES)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")))
    level = lambda h: plain.groupBy("dim", F.floor(F.col("k") / FAN**h).alias("k")).agg(lo, hi).withColumn("up", F.floor(F.col("k") / FAN))
    top = level(height)
    pairs = top.alias("a").join(top.alias("b"), [F.col("a.dim") == F.col("b.dim"), F.col("a.k") == F.col("b.k")]).select(F.col("a.dim").alias("dim"), F.col("a.k").alias("i"), F.col("b.k").alias("j"))
    for h in range(height - 1, -1, -1):
        own = level(h)
        left = pairs.join(own.alias("a"), [F.col("i") == F.col("a.up"), pairs["dim"] == F.col("a.dim")]).drop("i")
        both = left.join(own.alias("b"), [F.col("j") == F.col("b.up"), F.col("a.dim") == F.col("b.dim"), F.col("a.k") <= F.col("b.k")])
        pairs = written(both.filter(near(eps)).select(F.col("a.dim").alias("dim"), F.col("a.k").alias("i"), F.col("b.k").alias("j")), f"level{h}")
    at = plain.select("k", "at")
    return pairs.join(at.select(F.col("k").alias("i"), F.col("at").alias("a_at")), "i").join(at.select(F.col("k").alias("j"), F.col("at").alias("b_at")), "j").select("a_at", "b_at")


def local_links(pairs: DataFrame, table: DataFrame, turn, cosine: float, eps: float, kind: str) -> DataFrame:
    """vec_id, n (links found here), root (a vector of the same local group)."""
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for r in range(b.num_rows):
                d = col["dim"][r].as_py()
                ids = [np.frombuffer(col[c][r].as_buffer(), np.int64) for c in ("a_ids", "b_ids")]
                x, y = (unit(np.frombuffer(col[c][r].as_buffer(), kind).reshape(-1, d)) for c in ("a_data", "b_data"))
                same = col["a_at"][r] == col["b_at"][r]
                j = Join(x, y, projected(x, turn), projected(y, turn), cosine, eps)
                j.run(0, len(x), 0, len(y))
                if same:
                    np.fill_diagonal(j.links, False)
                    full, names = j.links, ids[0]
                else:
                    p, q = np.flatnonzero(j.links.any(1)), np.flatnonzero(j.links.any(0))
                    part = j.links[np.ix_(p, q)]
                    full = np.zeros((len(p) + len(q),) * 2, dtype=bool)
                    full[: len(p), len(p) :] = part
                    full[len(p) :, : len(p)] = part.T
                    names = np.concatenate((ids[0][p], ids[1][q]))
                n = full.sum(1)
                root = names[local_groups(full)] if len(names) else names
                has = n > 0
                yield batch(schema, names[has], n[has], root[has])

    cols = lambda s: table.select(F.col("at").alias(f"{s}_at"), *([F.col("dim")] if s == "a" else []), F.col("ids").alias(f"{s}_ids"), F.col("data").alias(f"{s}_data"))
    both = pairs.join(cols("a"), "a_at").join(cols("b"), "b_at").select("a_at", "b_at", "dim", "a_ids", "b_ids", "a_data", "b_data")
    return written(both.mapInArrow(tidy(task), "vec_id long, n long, root long"), "links")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, *, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    eps = float(np.sqrt(2 - 2 * cosine))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # single-precision components travel as such and are compared as doubles
    every = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    every = written(every.withColumn("row", F.monotonically_increasing_id()), "vectors")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = every.filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0.0))
    fit = fit.select(F.col("row").alias("vec_id"), "v")
    turn = axes(fit)
    before = spark.conf.get(key)
    table = blocks(fit, turn, eps, block, kind)
    pairs = block_pairs(table, eps)
    spark.conf.set(key, "4")  # a row holds two blocks
    try:
        found = local_links(pairs, table, turn, cosine, eps, kind)
    finally:
        spark.conf.set(key, before)
    counts = found.groupBy(F.col("vec_id").alias("row")).agg(F.sum("n").alias("n_links"))
    labels = written(with_roots(components(found.filter("vec_id <> root").select("vec_id", "root").distinct())).withColumnRenamed("node", "row"), "labels")
    names = labels.join(every.select("row", "vec_id"), "row").groupBy("component").agg(F.min("vec_id").alias("component_id"), F.min("row").alias("first"))
    named = labels.join(few(written(names, "names")), "component").select("row", F.col("component_id").alias("least"), "first")
    out = every.select("row", "vec_id").join(counts, "row", "left").join(named, "row", "left")
    component = F.when(F.col("first").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    kept = F.when(component.isNull(), F.col("row") == F.coalesce("first", "row")).otherwise(F.coalesce(F.col("vec_id") == component, F.lit(False)))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS MATERIALIZED (SELECT k, vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
l AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM u a JOIN u b ON a.k <> b.k AND list_dot_product(a.v, b.v) >= 0.95 * a.n * b.n),
r AS (SELECT k AS a, k AS b FROM u UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT u.vec_id, coalesce(c.n, 0) AS n_links, m.id AS component_id, u.vec_id = m.id AS kept
FROM u JOIN (SELECT r.a, min(w.vec_id) AS id FROM r JOIN u w ON w.k = r.b GROUP BY r.a) m ON m.a = u.k LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) c ON c.x = u.k
"""
