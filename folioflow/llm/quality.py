"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes, padded with zeros to whole blocks, pass through learned filters of WIDTH bytes; each filter's response is
max-pooled over overlapping chunks of two neighbouring blocks that together cover the whole document; a small dense layer scores each
chunk; mean, minimum and maximum of the chunk scores make one logit. Filters, dense layer and combination are all learned by Adam.

Training takes a bounded sample of labelled rows: at most `sample_rows` of the training fold, lowest hash of doc_id first, none longer
than `sample_longest` characters. Scoring takes every text whole, block by block, so memory doesn't grow with a text's length beyond
its own bytes. A null or empty text is one block of zeros. Rows with a null label aren't learned from; without labels of two kinds the
score is the share of label 1 (0.5 without any). Repeated rows score alike, and a score that equals the threshold is kept; an empty
table gives an empty result. Columns other than doc_id and text are never read; keep_good() passes them through under any name, while
scored() adds `__score` and takes no frame that has such a column. A labelled text longer than `sample_longest` isn't learned from, but
is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, crc_mod, slices, small_batches, tidy

WIDTH, BLOCK = 4, 128
THRESHOLD = 0.3
#: Bounds of the training sample.
SAMPLE_ROWS, SAMPLE_LONGEST = 4000, 20_000


def padded(text: str | None) -> np.ndarray:
    """Bytes of whole blocks, and WIDTH - 1 zeros more for the last windows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return np.frombuffer(raw.ljust(size + WIDTH - 1, b"\0"), dtype=np.uint8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class ByteCnn:
    def __init__(self, filters: int = 24, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "taps": rng.normal(0, 0.3, (WIDTH, 256, filters)),
            "w1": rng.normal(0, (2 / filters) ** 0.5, (filters, hidden)),
            "b1": np.zeros(hidden),
            "w2": rng.normal(0, (2 / hidden) ** 0.5, hidden),
            "b2": np.zeros(1),
            "mix": np.array([1.0, 0.5, 0.5]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.prior: float | None = None

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Response tables of byte pairs: a window of four bytes is then two lookups."""
        t = self.p["taps"]
        return tuple((t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in (0, 2))

    def blocks(self, data: np.ndarray, tables, places: bool = False):
        """The maximum of each filter in each block, and where it is."""
        two = data[:-1].astype(np.int32) << 8 | data[1:]
        r = tables[0][two[: len(data) - 3]]
        r += tables[1][two[2:]]
        r = r.reshape(-1, BLOCK, r.shape[1])
        return (r.max(1), r.argmax(1)) if places else (r.max(1), None)

    def logit(self, pooled: np.ndarray) -> tuple[float, tuple]:
        """From block maxima to the document's logit."""
        p = self.p
        chunks = np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled
        h = chunks @ p["w1"] + p["b1"]
        z = np.maximum(h, 0) @ p["w2"] + p["b2"][0]
        three = np.array([z.mean(), z.min(), z.max()], dtype=np.float32)
        return float(three @ p["mix"]), (chunks, h, z, three)

    def score(self, text: str | None, tables) -> float:
        if self.prior is not None:
            return self.prior
        data = padded(text)
        step = 512 * BLOCK
        pooled = np.concatenate([self.blocks(data[i : i + step + WIDTH - 1], tables)[0] for i in range(0, len(data) - WIDTH + 1, step)])
        return float(sigmoid(self.logit(pooled)[0]))

    def gradient(self, data: np.ndarray, label: float, weight: float, tables, g: dict[str, np.ndarray]) -> None:
        p = self.p
        pooled, places = self.blocks(data, tables, True)
        logit, (chunks, h, z, three) = self.logit(pooled)
        d = np.float32((sigmoid(logit) - label) * weight)
        g["mix"] += d * three
        dz = np.full(len(z), d * p["mix"][0] / len(z), dtype=np.float32)
        dz[z.argmin()] += d * p["mix"][1]
        dz[z.argmax()] += d * p["mix"][2]
        g["b2"] += dz.sum()
        g["w2"] += np.maximum(h, 0).T @ dz
        dh = np.outer(dz, p["w2"]) * (h > 0)
        g["b1"] += dh.sum(0)
        g["w1"] += chunks.T @ dh
        dc = dh @ p["w1"].T
        dp = np.zeros_like(pooled)
        if len(pooled) > 1:
            left = pooled[:-1] >= pooled[1:]
            dp[:-1] += dc * left
            dp[1:] += dc * ~left
        else:
            dp += dc
        at = places + np.arange(len(pooled))[:, None] * BLOCK
        f = np.broadcast_to(np.arange(pooled.shape[1]), at.shape)
        for k in range(WIDTH):
            np.add.at(g["taps"][k], (data[at + k], f), dp)

    def fit(self, texts: list[str | None], labels: list[int], *, epochs: int = 10, group: int = 16, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        y = np.asarray(labels, dtype=np.float32)
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        data = [padded(t) for t in texts]
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(y) // group)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), group):
                tables = self.pairs()
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                for j in order[i : i + group]:
                    self.gradient(data[j], float(y[j]), float(weight[j]) / group, tables, g)
                step += 1
                lr = rate * (1 - 0.95 * step / steps)
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    x -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, rows: int, longest: int) -> tuple[list, list]:
    """Texts and labels of at most `rows` labelled documents for which `fold` holds, those of the lowest hash of doc_id.
    Of rows that repeat an id, the least text counts."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold).select("doc_id", F.col(label).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(rows)
    short = docs.select("doc_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) <= longest)
    got = short.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["__label"], r["text"] or ""))
    return [r["text"] for r in got], [r["__label"] for r in got]


def train(docs: DataFrame, labels: DataFrame, *, fold=None, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST, **options) -> ByteCnn:
    texts, y = labelled_sample(docs, labels, "quality", F.lit(True) if fold is None else fold, rows, longest)
    return ByteCnn().fit(texts, y, **options)


def scored(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """All columns of docs and `__score`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.pairs()
        for b in batches:
            for part in slices(b, "text"):
                got = [sent.value.score(t, tables) for t in columns(part, "text")[0]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, "__score"])

    return docs.mapInArrow(tidy(task), docs.select("*", F.lit(0.0).alias("__score")).schema)


def in_training():
    return crc_mod("doc_id", 5) != 0


def op3_quality_cnn(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs.select("doc_id", "text"), train(docs, labels, fold=in_training()))
    return found.select("doc_id", (~in_training()).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier, trained on the training fold of labels, doesn't reject; all their columns and no other."""
    names = docs.columns
    plain = docs.withColumnsRenamed({c: f"c{i}_" for i, c in enumerate(names) if c != "text"})
    kept = scored(plain, train(docs, labels, fold=in_training())).filter(F.col("__score") >= threshold)
    return kept.withColumnsRenamed({f"c{i}_": c for i, c in enumerate(names) if c != "text"}).select(*names)
