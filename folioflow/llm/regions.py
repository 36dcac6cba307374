"""Links inside areas of the Jaccard join: Voronoi regions around pivots, joined recursively, with boundary sets in several regions.

An area is a group of sets that can only be linked among themselves. One with more than OWN_BLOCK shingles is parted twice over.

First by size, the distance from the empty set: a set's home is its annulus, one factor of the similarity wide, and it is a guest in the
annuli below that hold sets large enough to be linked to it. A linked pair meets in the annulus of the smaller one.

Then around pivots, again and again: the distance of each set to every pivot of its region is measured, and the set's home is the nearest pivot's region. It stands as a guest in
any other region in which a home set can be within the radius r of it. For a home set y of pivot q and a guest x of pivot p linked to it,
the triangle inequality gives d(x, q) <= d(x, p) + 2 r and |d(x, q) - d(y, q)| <= r, so x is a guest of q only if d(x, q) lies within both
windows, the second from the nearest to the farthest home set of q, a radius wider on either side. By induction over levels x is in
the last region in which y is at home, so joining home sets with all sets of each last region finds every link.

A region that pivots can't part at less than half of its work isn't parted: its sets, all about equally far apart, go into rings one
radius wide around their nearest pivot, rings into blocks of bounded size, and two blocks meet only if sizes, rings and the intervals of
their distances to every pivot of the region allow a link. Sets within the radius of their pivot are linked to it and need not meet.
A block, or a pair of blocks, is joined in one task by a product of incidence matrices, exactly. What leaves a task is a star for each
local group. No set, region or block is dropped at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, discard, few, sorted_unique, tidy, written
from .components import local_groups

#: Shingles and sets that a block, the unit that moves, holds about at most; sets of a tile, the unit of a product.
BLOCK_SHINGLES, BLOCK_SETS, TILE = 1_000_000, 4096, 768
#: Pairs a hash makes up to which they are counted one by one, and pairs counted at once.
RARE, PAIRS = 2000, 8_000_000
#: The shingles beyond which a region is parted: those of a few hundred sets.
OWN_BLOCK = 100_000
#: Pivots of a region: half drawn by the weight of what is linked to them, half evenly; levels of the recursion.
PIVOTS, LEVELS = 16, 8
#: A region is parted if its parts together need at most this share of its work.
GAIN = 0.5
#: Tolerance of windows over distances in floating point; it only admits more guests.
SLACK = 1e-9

STAR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of sorted sets. Hashes that many sets of both sides hold are counted by products of 0/1
    matrices, the others by their pairs."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (a, b)]
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(sorted_unique(all_a), sorted_unique(all_b), assume_unique=True)
    n, m = len(a), len(b)
    common = np.zeros(n * m, dtype=np.int64)
    if len(both):
        placed = []
        for side, lengths in ((all_a, sizes[0]), (all_b, sizes[1])):
            at = np.minimum(np.searchsorted(both, side), len(both) - 1)
            hit = both[at] == side
            col, row = at[hit], np.repeat(np.arange(len(lengths)), lengths)[hit]
            order = np.argsort(col, kind="stable")
            placed.append((row[order], col[order], np.bincount(col, minlength=len(both))))
        (row_a, col_a, in_a), (row_b, col_b, in_b) = placed
        rare = in_a * in_b <= RARE
        first_b = np.cumsum(in_b) - in_b
        one = rare[col_a]
        row, reps, first = row_a[one], in_b[col_a[one]], first_b[col_a[one]]
        ends = np.cumsum(reps)
        for start in range(0, len(row), PAIRS // RARE + 1):
            part = slice(start, start + PAIRS // RARE + 1)
            r, before = reps[part], ends[part] - reps[part]
            other = np.repeat(first[part] - before + before[0], r) + np.arange(r.sum())
            common += np.bincount(np.repeat(row[part], r) * m + row_b[other], minlength=n * m)
        place = np.cumsum(~rare) - 1
        kept = [(x[~rare[c]], place[c[~rare[c]]]) for x, c, _ in placed]
        for start in range(0, int((~rare).sum()), columns_at_once):
            dense = []
            for (x, c), k in zip(kept, (n, m), strict=True):
                i, j = np.searchsorted(c, (start, start + columns_at_once))
                hits = np.zeros((k, min(columns_at_once, int((~rare).sum()) - start)), dtype=np.float32)
                hits[x[i:j], c[i:j] - start] = 1
                dense.append(hits)
            common += (dense[0] @ dense[1].T).astype(np.int64).ravel()
    common = common.reshape(n, m)
    return common, sizes[0][:, None] + sizes[1][None, :] - common


def block_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b are linked. Tiles run along sizes, and those whose sizes lie too far apart are passed over."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    sides = []
    for side in (a, b):
        order = np.argsort([len(x) for x in side], kind="stable")
        sides.append([(at, [side[i] for i in at]) for at in np.array_split(order, -(-len(order) // TILE) or 1) if len(at)])
    for rows, x in sides[0]:
        for cols, y in sides[1]:
            if 100 * min(len(x[-1]), len(y[-1])) >= percent * max(len(x[0]), len(y[0])):
                common, total = intersections(x, y)
                out[np.ix_(rows, cols)] = 100 * common >= percent * total
    return out


def sets_in(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def star(near: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    root = names[local_groups(near)] if len(names) else names
    other = root != names
    return batch(STAR, names[other], root[other])


def pivots_of(table: DataFrame, level: int) -> DataFrame:
    """region, pivot: up to PIVOTS sets for each region, drawn among the sets its home sets are linked to or else stand for themselves.
    A draw is the least of exponentially distributed keys, so it takes one sum by owner and one row a region."""
    owners = table.filter("home").groupBy("region", "owner").agg(F.sum("size").alias("weight"))
    even = lambda i: (F.pmod(F.xxhash64(F.lit(f"{level}:{i}"), "owner"), F.lit(1 << 52)) + 1) / float(1 << 52)
    key = lambda i: -F.log(even(i)) / (F.col("weight") if i % 2 else F.lit(1.0))
    drawn = F.array_distinct(F.array(*[F.min(F.struct(key(i).alias("key"), "owner"))["owner"] for i in range(PIVOTS)]))
    return owners.groupBy("region").agg(drawn.alias("drawn")).select("region", F.explode("drawn").alias("pivot"))


SEEN = "region long, node long, size long, home boolean, owner long, pivot long, d double, nearest double, own boolean, linked boolean, ring int"


def measured_to_pivots(table: DataFrame, wide: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """A row for each set of a wide region and each of its pivots: the distance d, the nearest pivot's, whether this is that one, whether
    they are linked, and the ring. A region's sets are dealt to tasks of bounded size, each with all pivots of the region."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SEEN.split(", "))])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema)
        right = right.sort_by("pivot")
        names = right.column("pivot").to_numpy()
        common, total = intersections(sets_in(left.column("members")), sets_in(right.column("pivot_set")))
        d = (total - common) / total
        best = d.argmin(1)  # of equal ones the least pivot
        linked = 100 * common >= percent * total
        steps = -(-(total - common) * 100 // (total * (100 - percent))) - 1
        ring = np.where(linked, 0, np.maximum(steps, 1))
        n, m = d.shape
        take = pa.array(np.repeat(np.arange(n), m))
        kept = [left.column(c).combine_chunks().take(take) for c in ("region", "node", "size", "home", "owner")]
        own = np.zeros((n, m), dtype=bool)
        own[np.arange(n), best] = True
        rest = [np.tile(names, n), d.ravel(), np.repeat(d[np.arange(n), best], m), own.ravel(), linked.ravel(), ring.ravel().astype(np.int32)]
        return pa.Table.from_batches([batch(schema, *kept, *rest)])

    large = table.join(few(wide.select("region", "splits")), "region").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("splits")))
    pivots = written(pivots_of(large, level).join(few(wide.select("region", "splits")), "region"), "pivots")
    left = sets.select("node", "members").join(few(large.drop("splits")), "node")
    right = sets.select(F.col("node").alias("pivot"), F.col("members").alias("pivot_set")).join(few(pivots), "pivot")
    right = right.select("region", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"), "pivot", "pivot_set")
    keys = ["region", "salt"]
    left, right = (x.withColumn("salt", F.col("salt").cast("long")) for x in (left, right))
    return written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, SEEN), "seen")


def annuli(table: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Wide regions parted by size; the others as they are."""
    base = float(-np.log(percent / 100))
    by = few(wide.select("region"))
    size = F.log(F.col("size")) / base
    own, least = F.floor(size).cast("int"), F.floor(size - 1 - SLACK).cast("int")
    split = table.join(by, "region", "left_semi").withColumn("own", own).withColumn("ring", F.explode(F.sequence(least, own)))
    split = split.withColumn("home", F.col("home") & (F.col("own") == F.col("ring"))).withColumn("part", F.xxhash64("region", "ring"))
    homes = split.filter("home").select("part").distinct()
    split = split.join(homes, "part", "left_semi").select(F.col("part").alias("region"), "node", "size", "home", "owner")
    return table.join(by, "region", "left_anti").select(*split.columns).unionByName(split)


def wide_regions(table: DataFrame) -> DataFrame:
    """region, whole, homes, n and splits (tasks to deal its sets to) of the regions with more than OWN_BLOCK shingles."""
    size = F.col("size")
    whole = table.groupBy("region").agg(F.sum(size).alias("whole"), F.sum(F.when(F.col("home"), size).otherwise(0)).alias("homes"), F.count(F.lit(1)).alias("n"))
    splits = F.greatest(F.ceil(F.col("whole") / BLOCK_SHINGLES), F.ceil(F.col("n") / (2 * TILE)))
    return written(whole.filter(F.col("whole") > OWN_BLOCK).withColumn("splits", splits.cast("long")), "wide")


def parted(areas: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last regions (region, node, size, home, owner, ring, far; owner, ring and the distances to pivots only of regions that can't be
    parted), and links found on the way. areas: region, node, size, owner."""
    r = (100 - percent) / 100
    table = written(areas.select("region", "node", "size", F.lit(True).alias("home"), "owner"), "regions")
    last, stars = [], []
    alone = ["home", F.lit(None).cast("long").alias("owner"), F.lit(None).cast("int").alias("ring"), F.lit(None).cast("array<double>").alias("far")]
    size = F.col("size")
    wide = wide_regions(table)
    if not wide.isEmpty():
        table = written(annuli(table, wide, percent), "annuli")
    for level in range(LEVELS + 1):
        wide = wide_regions(table)
        if wide.isEmpty():
            last.append(table.select("region", "node", "size", *alone))
            break
        last.append(table.join(few(wide.select("region")), "region", "left_anti").select("region", "node", "size", *alone))
        seen = measured_to_pivots(table, wide, sets, percent, level)
        stars.append(seen.filter((F.col("ring") == 0) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("node").alias("v")))
        radii = written(seen.filter("own and home").groupBy("region", "pivot").agg(F.min("d").alias("least"), F.max("d").alias("most")), "radii")
        d, slack = F.col("d"), r + SLACK
        inside = (d <= F.col("nearest") + 2 * r + SLACK) & (d <= F.col("most") + slack) & (d >= F.col("least") - slack)
        moved = seen.join(few(radii), ["region", "pivot"]).filter(inside)
        moved = moved.select("region", F.xxhash64("region", "pivot").alias("part"), "node", "size", (F.col("home") & F.col("own")).alias("home"), "owner")
        parts = moved.groupBy("region", "part").agg(F.sum(size).cast("double").alias("w"), F.sum(F.when(F.col("home"), size).otherwise(0)).cast("double").alias("h"))
        cost = parts.groupBy("region").agg(F.sum(F.col("w") * F.col("h")).alias("cost")).join(wide, "region")
        gain = GAIN if level < LEVELS else -1.0
        good = written(cost.filter(F.col("cost") <= gain * F.col("whole").cast("double") * F.col("homes")).select("region"), "good")
        by = few(good)
        stuck = seen.join(by, "region", "left_anti").groupBy("region", "node", "size", "home")
        far = F.transform(F.array_sort(F.collect_list(F.struct("pivot", "d"))), lambda x: x["d"])
        stuck = stuck.agg(F.max(F.when(F.col("own"), F.col("pivot"))).alias("owner"), F.max(F.when(F.col("own"), F.col("ring"))).alias("ring"), far.alias("far"))
        last.append(stuck.select("region", "node", "size", "home", "owner", "ring", "far"))
        table = written(moved.join(by, "region", "left_semi").select(F.col("part").alias("region"), "node", "size", "home", "owner"), "regions")
    out = last[0]
    for x in last[1:]:
        out = out.unionByName(x)
    return written(out, "last"), stars


def apart(r: float) -> Column:
    """Whether the distances to some pivot hold two blocks apart."""
    gap = lambda s, t: F.zip_with(f"{s}.least", f"{t}.most", lambda x, y: x - y > r + SLACK)
    return F.coalesce(F.exists(gap("a", "b"), lambda x: x) | F.exists(gap("b", "a"), lambda x: x), F.lit(False))


def within_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """u, v: a star for each local group of linked sets of a block, of which one at least is at home."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nodes, homes, sets in zip(*columns(b, "nodes", "homes"), b.column(2), strict=True):
                every, at = sets_in(sets.values), np.flatnonzero(homes)
                near = block_links([every[i] for i in at], every, percent)
                full = np.zeros((len(every), len(every)), dtype=bool)
                full[at] = near
                full[:, at] |= near.T
                yield star(full, np.array(nodes, np.int64))

    return blocks.select("nodes", "homes", "sets").mapInArrow(tidy(task), "u long, v long")


def between_blocks(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """u, v: a star for each local group of linked sets of a pair of different blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a_nodes, b_nodes, *both in zip(*columns(b, "a_nodes", "b_nodes"), b.column(2), b.column(3), strict=True):
                near = block_links(*(sets_in(x.values) for x in both), percent)
                p, q = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                full = np.zeros((len(p) + len(q),) * 2, dtype=bool)
                full[: len(p), len(p) :] = near[np.ix_(p, q)]
                full[len(p) :, : len(p)] = near[np.ix_(p, q)].T
                yield star(full, np.concatenate((np.array(a_nodes, np.int64)[p], np.array(b_nodes, np.int64)[q])))

    side = lambda k, s: blocks.select(F.col("block").alias(k), F.col("nodes").alias(f"{s}_nodes"), F.col("sets").alias(f"{s}_sets"))
    # Only blocks that have a partner move.
    left = side("i", "a").join(few(pairs), "i")
    both = left.join(side("j", "b").join(few(pairs.select("j").distinct()), "j", "left_semi"), "j")
    return both.select("a_nodes", "b_nodes", "a_sets", "b_sets").mapInArrow(tidy(task), "u long, v long")


def region_links(areas: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of u, v that connect all sets of areas (region, node, size, owner) that are connected."""
    r = (100 - percent) / 100
    spots, stars = parted(areas, sets, percent)
    keys = ["region", "guests", "owner", "ring"]
    # Small regions are one block, guests and all; in what can't be parted, pivots with much around them have blocks of their own, by ring, and the others
    # share blocks.
    big = spots.filter("owner is not null").groupBy("region", "home", "owner").agg(F.sum("size").alias("w"))
    big = written(big.filter(F.col("w") > BLOCK_SHINGLES / 2).select("region", "home", "owner", F.lit(True).alias("big")), "big")
    spots = spots.join(few(big), ["region", "home", "owner"], "left").withColumn("guests", F.col("owner").isNotNull() & ~F.col("home")).withColumn("by", F.when(F.col("big").isNull(), F.coalesce("owner", "node")).otherwise(F.col("node")))
    spots = spots.select("node", "size", "region", "home", "guests", *[F.when(F.col("big"), F.col(c)).alias(c) for c in ("owner", "ring")], "by", "far")
    totals = spots.groupBy(*keys).agg(F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).alias("split"))
    other = totals.select(*[F.col(k).alias(f"t_{k}") for k in keys], "split")
    dealt = spots.join(other, [F.col("region") == F.col("t_region"), *[F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys[1:]]]).withColumn("salt", F.pmod(F.xxhash64("by"), F.col("split")))
    dealt = written(dealt.withColumn("block", F.xxhash64(*keys, "salt")).select("node", "home", "block", *keys, "size", "far"), "dealt")
    ends = [F.array(*[f(F.get("far", F.lit(k))) for k in range(PIVOTS)]).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    boxes = written(dealt.groupBy("block", *keys).agg(F.min("size").alias("lo"), F.max("size").alias("hi"), *ends), "boxes")
    blocks = sets.join(few(dealt.select("node", "home", "block")), "node").groupBy("block").agg(F.collect_list(F.struct("node", "home", "members")).alias("s"))
    blocks = written(blocks.select("block", F.col("s.node").alias("nodes"), F.col("s.home").alias("homes"), F.col("s.members").alias("sets")), "blocks")
    a, b = boxes.alias("a"), boxes.alias("b")
    ring = F.abs(F.col("a.ring") - F.col("b.ring"))
    idle = (F.col("a.owner") == F.col("b.owner")) & ((F.col("a.ring") + F.col("b.ring") == 0) | (ring >= 2))
    reach = F.least("a.hi", "b.hi") * 100 >= F.greatest("a.lo", "b.lo") * percent
    met = ~(F.col("a.guests") & F.col("b.guests")) & reach & ~F.coalesce(idle, F.lit(False)) & ~apart(r)
    pairs = a.join(b, [F.col("a.region") == F.col("b.region"), F.col("a.block") < F.col("b.block"), met])
    pairs = written(pairs.select(F.col("a.block").alias("i"), F.col("b.block").alias("j")), "pairs")
    spark = sets.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # a row holds two blocks
    try:
        done = boxes.filter("guests or owner is not null and ring = 0").select("block")
        found = [written(x, "joined") for x in (within_blocks(blocks.join(few(done), "block", "left_anti"), percent), between_blocks(pairs, blocks, percent))]
    finally:
        spark.conf.set(key, before)
    discard(blocks)
    return stars + found
