r"""N-gram Jaccard join in the metric space of shingle sets: exact areas, pivots, Voronoi regions joined recursively; exact.

1 - Jaccard is a metric. Between unrelated texts it is 1, so regions around a few pivots for the whole corpus would tell nothing apart
and every document would be a boundary document of every region. So the space is first cut, exactly, into areas in which distances
do tell. Sizes fall into annuli around the empty set, each with a window of larger documents that can still reach a smaller one; in an
annulus the shingle universe falls into so many parts that two sets within the radius must agree on one part that isn't empty. Sets that
agree on a part share a cell. Sets with too many empty parts for that argument share a cell, besides, for each shingle in the prefix
that two such sets must share. Linked sets differ in so few parts that they share a known number of cells; sets that share fewer with
all others together go.

In each cell the smallest set is the pivot. A set's distance to the pivot it shares most cells with is measured exactly, and within the
radius the two are linked. A cell whose sets are all in one component by now is done. The sets of the others fall into areas that no
open cell crosses. Inside an area the sets are joined by the method of regions.py: Voronoi regions around pivots, boundary sets
replicated by triangle-inequality windows, recursion. What leaves a task is a star for each local group and not its pairs, so a group of
thousands of near copies makes rows in proportion to its size. Equal sets are collapsed beforehand. No candidate, partner or cell is
dropped at any size.

Words: A-Z lower-cased, runs of [^\x20\x09-\x0D]. With fewer words than a shingle has, the whole sequence is one shingle. Sets are of
64-bit hashes. Columns of docs other than doc_id and text aren't read and may have any name. A very long text is one set like any other. Texts without words, null texts among them, have the empty set and link with nothing. A row with a
null id links as any other, but counts in no component's least id; rows that repeat an id share what their texts link to. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_bounds, pack, pack_counts, pack_sorted, unpack, unpack_sorted
from .common import batch, columns, discard, few, mix, release, slices, small_batches, sorted_unique, tidy, words, written
from .components import components, with_roots
from .regions import region_links

WORDS, PERCENT = 4, 85
#: Ratio between the bounds of size annuli.
RATIO = 1.6
#: Signatures a task holds before it sends them on; bytes of text for each bucket of signatures.
HELD, BUCKET_BYTES = 400_000, 12 << 20
#: Bits that signatures lose on the way: sets that agree on the rest only by chance are compared, not linked.
SHORT = np.uint64(16)
#: Places of repeated sets (8 bytes each) that are broadcast; beyond, the join shuffles.
BROADCAST_PLACES = 2_000_000
#: Sets of a cell up to which its pairs are counted one by one.
SMALL_CELL = 6
#: Sets of a cell in one row.
PIECE = 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Finds the text of a row without an id again.
TEXT_KEY = "case when doc_id is null then xxhash64(text) end as key"


class Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(tokens: list[bytes], hashes: Hashes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _STEP + h[i : i + len(out)]
    return sorted_unique(mix(out))


def fingerprint(s: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(np.append(mix(s + _STEP), mix(np.array([len(s)], np.uint64))).sum(dtype=np.uint64).view(np.int64))


class Cells:
    """The cells of a set, as 64-bit signatures."""

    def __init__(self, percent: int = PERCENT, ratio: float = RATIO):
        if not 1 <= percent < 100:
            raise ValueError("percent: 1 to 99")
        self.percent = percent
        #: The smallest size at which unequal sets can be linked: one shingle is linked to two at 50 %.
        self.first = 2 if percent > 50 else 1
        bounds = [self.first]
        while bounds[-1] < 1 << 40:
            bounds.append(int(np.ceil(bounds[-1] * ratio)))
        self.bounds = bounds
        t = percent
        self.most_apart = []
        for low in bounds[1:]:
            small = low - 1
            self.most_apart.append((small + 100 * small // t) * (100 - t) // (100 + t))
        self.parts = [d + 3 + d // 6 for d in self.most_apart]
        self.edges: dict[int, np.ndarray] = {}

    def of(self, s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each annulus or window the set is in: its cells, and the least number of them it shares with any set it is linked to."""
        n = len(s)
        if n < self.first:
            return []
        g = int(np.searchsorted(self.bounds, n, side="right")) - 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ _STEP))))
        found = [self._group(s, sums, g)]
        least = -(-self.percent * n // 100)
        while g and least < self.bounds[g]:  # a linked set can be in the annulus below, and with a low percentage further down
            g -= 1
            found.append(self._group(s, sums, g))
        return found

    def _group(self, s: np.ndarray, sums: np.ndarray, g: int) -> tuple[np.ndarray, int]:
        m = self.parts[g]
        if m not in self.edges:
            self.edges[m] = np.array([(j << 64) // m for j in range(1, m)], dtype=np.uint64)
        at = np.concatenate(([0], np.searchsorted(s, self.edges[m]), [len(s)]))
        full = at[1:] > at[:-1]
        value = (sums[at[1:]] - sums[at[:-1]])[full] + (np.flatnonzero(full).astype(np.uint64) + np.uint64(g << 32)) * _STEP
        out = mix(value)
        need = int(full.sum()) - self.most_apart[g]
        if need <= 0:
            prefix = len(s) - -(-self.percent * len(s) // 100) + 1
            out = np.concatenate((out, mix(s[:prefix] + np.uint64((g + 1) << 40))))
        return out, max(1, need)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def survey(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """A row per document (bucket null): its id, or the key of its text, its set's size, fingerprint (print) and the fewest cells it
    shares with any set it is linked to; and blobs of (signature, owner) by chunk and bucket. A chunk is what a task sends at once, its
    owners are the sets in it, and node is the place, chunk and owner, of a set where a task first met it. What a row of a bucket
    weighs doesn't depend on the number of buckets."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("sigs", pa.binary()), ("owners", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("need", pa.int32()), ("node", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells, seen = Hashes(), Cells(percent), set()
        chunk = TaskContext.get().partitionId() << 20
        held, owners, size, sets = [], [], 0, 0

        def send() -> pa.RecordBatch:
            sig = np.concatenate(held)
            owner = np.repeat(np.array(owners, np.uint32), [len(x) for x in held])
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], owner[order]
            at = bucket_bounds(sig, buckets)
            rows = [(b, pack_sorted(sig[i:j] >> SHORT), pack_counts(owner[i:j])) for b, (i, j) in enumerate(itertools.pairwise(at.tolist())) if j > i]
            nothing = [None] * len(rows)
            return batch(schema, [r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows], [r[2] for r in rows], *[nothing] * 6)

        for b in batches:
            for part in slices(b, "text"):
                ids, keys, texts = columns(part, "doc_id", "key", "text")
                sizes, prints, needs, nodes = [], [], [], []
                for t in texts:
                    s = shingles(words(t), hashes, k)
                    f = fingerprint(s)
                    sizes.append(len(s))
                    prints.append(f)
                    node = need = None
                    if len(s) >= cells.first and f not in seen:
                        seen.add(f)
                        node = chunk << 20 | sets
                        found = cells.of(s)
                        need = min(n for _, n in found)
                        for sigs, _ in found:
                            held.append(sigs)
                            owners.append(sets)
                            size += len(sigs)
                        sets += 1
                        if size >= HELD:
                            yield send()
                            chunk += 1
                            held, owners, size, sets = [], [], 0, 0
                    needs.append(need)
                    nodes.append(node)
                nothing = [None] * len(ids)
                yield batch(schema, *[nothing] * 4, ids, keys, sizes, prints, needs, nodes)
        if held:
            yield send()

    kind = "bucket int, chunk long, sigs binary, owners binary, doc_id long, key long, n long, print long, need int, node long"
    return written(docs.selectExpr("doc_id", TEXT_KEY, "text").mapInArrow(tidy(task), kind), "survey")


def first_places(survey: DataFrame, classes: DataFrame) -> DataFrame:
    """chunk, sigs, owners, bucket of the survey without what it says again of sets that another chunk holds, too."""
    kept = classes.select("print", F.col("node").alias("kept"))
    again = survey.filter(F.col("node").isNotNull()).select("print", "node").join(kept, "print").filter("node <> kept")
    again = written(again.select(F.shiftright("node", 20).alias("chunk"), F.col("node").bitwiseAND((1 << 20) - 1).cast("int").alias("owner")), "again")
    few = F.broadcast if again.count() <= BROADCAST_PLACES else lambda df: df
    gone = again.groupBy("chunk").agg(F.sort_array(F.collect_list("owner")).alias("gone"))  # a chunk's owners are bounded
    blobs = survey.filter(F.col("bucket").isNotNull()).select("bucket", "chunk", "sigs", "owners").join(few(gone), "chunk", "left")
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("sigs", pa.binary()), ("owners", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, chunk, sigs, owners, gone in zip(*columns(b, "bucket", "chunk", "sigs", "owners", "gone"), strict=True):
                if gone:
                    sig, owner = unpack_sorted(sigs), unpack(owners)
                    stays = np.isin(owner, np.array(gone), invert=True)
                    if not stays.any():
                        continue
                    sigs, owners = pack_sorted(sig[stays]), pack_counts(owner[stays])
                out.append((bucket, chunk, sigs, owners))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    return blobs.select("bucket", "chunk", "sigs", "owners", "gone").mapInArrow(tidy(task), "bucket int, chunk long, sigs binary, owners binary")


def shared_cells(blobs: DataFrame, needs: DataFrame, turns: int = 2) -> DataFrame:
    """cell, weight, node, pivot: the sets of every cell that holds two or more, of sets that share enough cells to be linked to any.
    Two linked sets of an annulus differ in so few parts that they agree on a number of cells; a set with fewer shared cells goes, and
    with it the cells it shared with one other. Each turn only drops what can't be linked, so their number doesn't matter."""
    schema = pa.schema([("cell", pa.int64()), ("piece", pa.int32()), ("nodes", pa.list_(pa.int64())), ("weight", pa.int64())])

    def of_bucket(table: pa.Table) -> pa.Table:
        sigs, nodes = [], []
        for s, o, c in zip(*(table.column(c).to_pylist() for c in ("sigs", "owners", "chunk")), strict=True):
            sigs.append(unpack_sorted(s))
            nodes.append(unpack(o).astype(np.int64) + (c << 20))
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        lengths = np.diff(np.append(first, len(sig)))
        keep = np.repeat(lengths > 1, lengths)
        node, lengths = node[keep], lengths[lengths > 1]
        del sigs, nodes, sig, order, new, keep
        if not len(lengths):
            return pa.Table.from_batches([], schema)
        # Cells with the same sets are one cell with a weight; long ones go in pieces, which are the same for the same sets.
        starts = np.cumsum(lengths) - lengths
        print_ = mix(np.add.reduceat(mix(node.view(np.uint64)), starts) + lengths.astype(np.uint64))
        _, at, weight = np.unique(print_, return_index=True, return_counts=True)
        pieces = -(-lengths[at] // PIECE)
        which = np.repeat(np.arange(len(at)), pieces)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = starts[at][which] + piece * PIECE
        high = np.minimum(low + PIECE, (starts + lengths)[at][which])
        offsets = np.concatenate(([0], np.cumsum(high - low))).astype(np.int32)
        take = np.repeat(low - offsets[:-1], high - low) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[take], pa.int64()))
        out = pa.Table.from_batches([batch(schema, _signed(print_[at][which]), piece, lists, weight[which])])
        release()
        return out

    found = blobs.groupBy("bucket").applyInArrow(of_bucket, "cell long, piece int, nodes array<long>, weight long")
    found = found.groupBy("cell", "piece").agg(F.any_value("nodes").alias("nodes"), F.sum("weight").alias("weight"))
    members = written(found.select("cell", "weight", F.explode("nodes").alias("node")), "cells")
    for _ in range(turns):
        counts = members.groupBy("node").agg(F.sum("weight").alias("n"))
        fit = counts.join(needs, "node").filter("n >= need").select("node")
        kept = written(members.select("cell", "weight", "node").join(fit, "node", "left_semi"), "kept")
        # A table of its own, so that adaptive execution can split a cell of thousands of sets in the join.
        live = written(kept.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1").drop("n"), "live")
        smaller = written(kept.join(live, "cell").select("cell", "weight", "node", "pivot"), "cells")
        discard(members, kept, live)
        members = smaller
    return members


def sets_of(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """node, size, members (sorted hashes): the set of each wanted (doc_id, key, print, node), once, from the text again; by key where
    there is no id. repeated: doc_id of several rows; a task sends a set once, and the sets of those ids are reduced to one."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("members", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = Hashes(), set()
        for b in batches:
            for part in slices(b, "text"):
                right = []
                for node, wants, text in zip(*columns(part, "node", "print", "text"), strict=True):
                    if node not in sent and fingerprint(s := shingles(words(text), hashes, k)) == wants:
                        sent.add(node)
                        right.append((node, len(s), s.tobytes()))
                if right:
                    yield batch(schema, *zip(*right, strict=True))

    texts = docs.select("doc_id", "text").join(few(wanted.filter("doc_id is not null").select("doc_id", "node", "print")), "doc_id").select("node", "print", "text")
    nameless = wanted.filter("doc_id is null").select("key", "node", "print")
    if not nameless.isEmpty():
        found = docs.filter("doc_id is null").selectExpr(TEXT_KEY, "text").join(few(nameless), "key")
        texts = texts.unionByName(found.groupBy("node", "print").agg(F.any_value("text").alias("text")))
    met = written(texts.mapInArrow(tidy(task), "node long, size long, members binary"), "sets")
    twice = written(wanted.join(repeated, "doc_id", "left_semi").select("node"), "twice")
    if twice.isEmpty():
        return met
    one = [F.any_value(c).alias(c) for c in ("size", "members")]
    by = few(twice)
    sets = written(met.join(by, "node", "left_anti").unionByName(met.join(by, "node", "left_semi").groupBy("node").agg(*one)), "sets")
    discard(met, twice)
    return sets


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """p, x, common, total: sizes of intersection and union of each pair of sets."""
    schema = pa.schema([("p", pa.int64()), ("x", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, x = columns(b, "p", "x")
            common, total = [], []
            a_col, b_col = (b.column(b.schema.get_field_index(c)) for c in ("a", "b"))
            for left, right in zip(a_col, b_col, strict=True):
                one, two = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                same = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                common.append(same)
                total.append(len(one) + len(two) - same)
            yield batch(schema, p, x, common, total)

    # Ids go to the sets where their number allows it, so that a set moves once at most.
    pairs = pairs.select("p", "x")
    left = sets.join(few(pairs.select(F.col("p").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("p"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("x"), F.col("members").alias("b"))
    both = right.join(few(pairs), "x").join(left, "p").select("p", "x", "a", "b")
    return both.mapInArrow(tidy(task), "p long, x long, common long, total long")


def links(members: DataFrame, needs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links enough to connect all sets that are connected. members: cell, weight, node, pivot."""
    sizes = sets.select("node", "size")
    shared = members.filter("node <> pivot").groupBy(F.col("pivot").alias("p"), F.col("node").alias("x")).agg(F.sum("weight").alias("count"))
    nearest = shared.groupBy("x").agg(F.max_by("p", F.struct("count", -F.col("p"))).alias("p"))
    one, two = sizes.select(F.col("node").alias("p"), F.col("size").alias("ps")), sizes.select(F.col("node").alias("x"), F.col("size").alias("xs"))
    fit = F.least("ps", "xs") * 100 >= F.greatest("ps", "xs") * percent
    nearest = written(nearest.join(one, "p").join(two, "x").filter(fit).select("p", "x"), "nearest")
    found = measured(nearest, sets).filter(F.col("common") * 100 >= F.col("total") * percent)
    stars = written(found.select(F.col("p").alias("u"), F.col("x").alias("v")), "stars")
    labels = with_roots(components(stars))

    table = members.select("cell", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = table.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    cells = written(cells.filter("lo <> hi").select("cell", "least", "n"), "mixed")
    opened = written(members.select("cell", "weight", "node").join(cells, "cell"), "opened")
    # Two sets of different components are linked only if they share enough open cells: for small cells that is counted pair by pair,
    # and what they could share of large ones is added. Large cells connect all their sets.
    large = opened.filter(F.col("n") > SMALL_CELL)
    small = opened.filter(F.col("n") <= SMALL_CELL).groupBy("cell").agg(F.array_sort(F.collect_list("node")).alias("s"), F.min("weight").alias("weight"))
    both = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    together = small.select("weight", F.inline(both)).groupBy("x", "y").agg(F.sum("weight").alias("shared"))
    most = large.groupBy("node").agg(F.sum("weight").alias("most"))
    least = opened.select("node").distinct().join(needs, "node").join(most, "node", "left").withColumn("most", F.coalesce("most", F.lit(0)))
    side = lambda c: least.select(F.col("node").alias(c), F.col("need").alias(f"{c}_need"), F.col("most").alias(f"{c}_most"))
    likely = together.join(side("x"), "x").join(side("y"), "y").filter(F.col("shared") + F.least("x_most", "y_most") >= F.greatest("x_need", "y_need"))
    cross = written(likely.select(F.col("y").alias("node"), F.col("x").alias("least")).unionByName(large.select("node", "least")).distinct(), "open")
    discard(opened, cells)
    if cross.isEmpty():
        return stars
    areas = with_roots(components(cross)).withColumnRenamed("component", "region")
    owners = stars.select(F.col("v").alias("node"), F.col("u").alias("owner"))
    areas = areas.join(sizes, "node").join(owners, "node", "left").withColumn("owner", F.coalesce("owner", "node"))
    for more in region_links(areas.select("region", "node", "size", "owner"), sets, percent):
        stars = stars.unionByName(more)
    return stars


def placed(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, print and chosen of every row: its set and the one set of its component that stays."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    seen = survey(docs, words, percent, buckets)
    info = written(seen.filter(F.col("bucket").isNull()).select("doc_id", "key", "n", "print", "need", "node"), "info")
    one = [F.min("doc_id").alias("first"), F.min("key").alias("key"), F.min("need").alias("need"), F.min("node").alias("node")]
    classes = written(info.filter("n > 0").groupBy("print").agg(*one), "classes")
    needs = classes.filter(F.col("node").isNotNull()).select("node", "need")
    members = shared_cells(first_places(seen, classes), needs)
    discard(seen)
    wanted = members.select("node").distinct().join(classes.filter(F.col("node").isNotNull()), "node").select(F.col("first").alias("doc_id"), "key", "print", "node")
    repeated = info.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    sets = sets_of(docs, written(wanted, "wanted"), repeated, words)
    roots = written(with_roots(components(links(members, needs, sets, percent))), "roots")
    discard(sets, members)
    named = roots.join(classes, "node")
    order = F.struct(F.col("first").isNull().alias("none"), "first", "print")
    least = named.groupBy("component").agg(F.min("first").alias("least"), F.min(order)["print"].alias("chosen"))
    found = named.join(least, "component").select("print", "least", "chosen")
    by_class = classes.join(found, "print", "left").select("print", F.coalesce("least", "first").alias("least"), F.coalesce("chosen", "print").alias("chosen"))
    by_class = written(by_class, "by_class")  # a table of its own, so that a class of many copies can be split in the join
    out = info.select("doc_id", "n", "print").join(by_class, "print", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "print", "chosen")


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return placed(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def with_nodes(docs: DataFrame, k: int) -> DataFrame:
    """All columns of docs and `__node`, the fingerprint of the set."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for part in slices(b, "text"):
                got = [fingerprint(shingles(words(t), hashes, k)) for t in columns(part, "text")[0]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.int64())], names=[*part.schema.names, "__node"])

    return docs.mapInArrow(tidy(task), docs.select("*", F.lit(0).cast("long").alias("__node")).schema)


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one of each group: of its set with the smallest id, or of one set if none has an id, a row with that
    id. Texts without words stay. Rows that repeat an id, or have none, are told apart by their sets."""
    rows = written(placed(docs, words, percent), "groups")
    stays = (F.col("print") == F.col("chosen")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = written(rows.filter((F.col("n_shingles") > 0) & ~stays).select("doc_id").distinct(), "gone")
    kept = docs.join(few(gone), "doc_id", "left_anti")
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    twice = written(counted.filter("(rows > 1 or doc_id is null) and n > 0").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    twice = few(twice)
    kept = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]), "left_anti")
    again = with_nodes(docs.join(twice, docs["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi"), words)
    empty = F.col("__node") == fingerprint(np.zeros(0, np.uint64))
    right = rows.filter((F.col("n_shingles") > 0) & stays).select(F.col("doc_id").alias("__id"), F.col("print").alias("__set")).distinct()
    chosen = again.filter(~empty).join(right, again["doc_id"].eqNullSafe(F.col("__id")) & (again["__node"] == F.col("__set")), "left_semi")
    parts = [kept, again.filter(empty), chosen.dropDuplicates(["doc_id", "__node"])]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.b, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = w.doc_id
"""
