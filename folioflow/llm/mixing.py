"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies and one hash-seeded Bernoulli copy.

Native Spark SQL only. Sizes are summed per source with map-side partial sums, so a source with a third of all rows costs one row
per task; the rates table has one row per source. Nulls: a null text has size 0; a null source is a source of its own, last in order;
a null id hashes as the empty text. The draw u is seeded with id and text. Rows equal in id, source and text share it but not their fate:
they are numbered, and the i-th takes ceil(i rate - u) - ceil((i - 1) rate - u) copies, which for a row alone is floor(rate) and one more
if u is below the fraction, and for g equal rows adds up to g times the rate, rounded up or down. Numbers are given within each part of a
written table and continued from part to part, so that a group of equal rows with a third of the table is not one task's; which of some
equal rows has which number is left open, and other columns, if they differ, go with it. Columns of any other name pass through. Very
long texts are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate. The targets fill up like water: a source's target is its weight times one level, or `most`
    times its size where that is less. Sorted by the level at which a source is full, the level follows from running sums."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    full = Window.orderBy("full_at", F.asc_nulls_last("source"))
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    table = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("capped", F.col("full_at") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    )
    target = F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))
    return table.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)).select("source", "source_size", "target", "rate")


def uniform(doc_id: str, digest, seed: str):
    """A number in [0, 1) from the first 52 bits of an MD5 digest of id and text: the same on every run and engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), digest)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def text_digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def row_key(text_md5):
    """The same for rows equal in id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.md5(F.concat(part(F.col("doc_id").cast("string")), part(F.col("source").cast("string")), text_md5).cast("binary"))


def numbered(rows: DataFrame, key: str, part: str, number: str) -> DataFrame:
    """The rows of a written table with their numbers, from 1, among those of the same key; part: the piece of the table a row is in."""
    inside = F.row_number().over(Window.partitionBy(key, part).orderBy(key)).cast("long")
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias(number))
    per = per.select(F.col(key).alias("same_"), F.col(part).alias("part_"), F.coalesce(F.sum(number).over(before), F.lit(0)).alias("before_"))
    met = rows.withColumn(number, inside).join(few(written(per, "parts")), (F.col(key) == F.col("same_")) & (F.col(part) == F.col("part_")))
    return met.withColumn(number, F.col(number) + F.col("before_")).drop("same_", "part_", "before_")


def repeated(keys: DataFrame, key: str) -> DataFrame:
    """The keys that several rows share."""
    return written(keys.groupBy(key).agg(F.count(F.lit(1)).alias("rows_")).filter("rows_ > 1").select(F.col(key).alias("twice_")), "repeated")


def with_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with a number among those of the same key; rows alone with theirs don't move."""
    twice = repeated(rows.select(key), key)
    if twice.isEmpty():
        return rows.withColumn(number, F.lit(1).cast("long"))
    by = few(twice)
    again = written(rows.join(by, F.col(key) == F.col("twice_"), "left_semi").withColumn("part__", F.spark_partition_id()), "again")
    alone = rows.join(by, F.col(key) == F.col("twice_"), "left_anti").withColumn(number, F.lit(1).cast("long"))
    return alone.unionByName(numbered(again, key, "part__", number).drop("part__"))


def copies(rate, draw, number):
    """How often the mix takes the number-th of some equal rows."""
    return F.ceil(number * rate - draw) - F.ceil((number - 1) * rate - draw)


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of each row."""
    sizes = sized(docs.select("doc_id", "source", "text")).withColumn("digest", text_digest()).drop("text")
    sizes = written(sizes.withColumn("key_", row_key(F.col("digest"))), "sizes")
    r = rates(sizes, weights, most).withColumnRenamed("source", "of")
    joined = with_numbers(sizes, "key_", "number_").join(r, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    joined = joined.withColumn("copies", copies(F.col("rate"), uniform("doc_id", F.col("digest"), seed), F.col("number_")))
    return joined.drop("digest", "key_", "number_").withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it."""
    weights, most, seed = options.get("weights", WEIGHTS), options.get("most", MOST), options.get("seed", "mix")
    names = docs.columns
    sizes = written(sized(docs.select("source", "text")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    r = rates(sizes, weights, most).select(F.col("source").alias("of"), "rate")
    back = {f"c{i}_": c for i, c in enumerate(names) if c not in ("doc_id", "source", "text")}
    plain = docs.withColumnsRenamed({c: k for k, c in back.items()}).withColumn("key_", row_key(text_digest()))
    joined = with_numbers(plain, "key_", "number_").join(r, F.col("source").eqNullSafe(F.col("of")), "left")
    joined = joined.withColumn("copies_", copies(F.col("rate"), uniform("doc_id", text_digest(), seed), F.col("number_")))
    taken = joined.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.greatest("copies_", F.lit(1)).cast("int")))).filter("copy_ <= copies_")
    return taken.drop("of", "rate", "copy_", "copies_", "key_", "number_").withColumnsRenamed(back).select(*names)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS i, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
c AS (SELECT *, full_at <= level AS capped FROM l),
m AS (SELECT *, max(CASE WHEN NOT capped THEN level END) OVER () AS lvl FROM c),
t AS (SELECT source, source_size, CASE WHEN capped OR lvl IS NULL THEN cap ELSE least(weight * lvl, cap) END AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
j AS (SELECT d.doc_id, d.i, d.size, r.source_size, r.target, r.rate,
        CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST((ceil(i * rate - u) - ceil((i - 1) * rate - u)) * size AS BIGINT) AS taken FROM j
"""
