"""Rows that repeat: ids in many rows, equal rows, vectors without an id, against brute force and in bounded memory."""

import collections
import math

from pyspark.sql import functions as F

from folioflow.llm import embeddings, jaccard, mixing, token_store
from folioflow.llm.common import shared_dir

from .test_operators import docs_frame, prose


def test_jaccard_of_an_id_in_very_many_rows(spark):
    """One id and its near copy's in thousands of rows each make one set each: work grows with the rows, not with their powers."""
    w = prose(60)
    n = 20_000
    docs = spark.range(n).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, w).otherwise(w + " more").alias("text")).repartition(6)
    docs = docs.unionByName(spark.createDataFrame([(5, w + " other"), (6, "alone"), (1, "a text of its own")], "doc_id long, text string"))
    got = jaccard.jaccard_components(docs).groupBy("doc_id", "component_id").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, 0): n // 2, (1, 0): n // 2, (1, 1): 1, (5, 0): 1, (6, 6): 1}
    sets = []
    for r in jaccard.keep_one(docs.withColumn("source", F.lit("a"))).collect():
        sets.append((r["doc_id"], r["text"]))
    assert sorted(sets) == [(0, w), (1, "a text of its own"), (6, "alone")]


def test_equal_rows_are_drawn_apart(spark):
    data = [(None, "four words of text", "a")] * 1000 + [(i, "one two", "b") for i in range(400)] + [(3, "six " * 6, None)] * 50 + [(3, "six " * 6, "b")] * 3
    docs = docs_frame(spark, data).repartition(7)
    plan = mixing.plan(docs)
    got = plan.collect()
    assert len(got) == len(data)
    of = collections.defaultdict(list)
    for r in got:
        of[r["source"]].append(r)
    for rows in of.values():
        target = rows[0]["target"]
        assert abs(sum(r["taken"] for r in rows) - target) <= max(6 * 1, 0.15 * target)
    # a group of equal rows takes its rate times its number, rounded up or down, and its rows differ by one copy at most
    for source, n in (("a", 1000), (None, 50)):
        rows = of[source]
        total = sum(r["copies"] for r in rows)
        assert math.floor(n * rows[0]["rate"]) <= total <= math.ceil(n * rows[0]["rate"])
        assert max(r["copies"] for r in rows) - min(r["copies"] for r in rows) <= 1
    again = mixing.plan(docs_frame(spark, data[::-1]).repartition(3)).collect()
    key = lambda rows: collections.Counter((r["doc_id"], r["source"], r["taken"]) for r in rows)
    assert key(again) == key(got)
    taken = mixing.mix_sources(docs)
    assert taken.columns == docs.columns
    assert collections.Counter(r["source"] for r in taken.collect()) == {s: sum(r["copies"] for r in rows) for s, rows in of.items()}


def test_each_row_is_a_vector(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(None, a), (None, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, None), (4, None), (4, None)]
    out = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)).collect()
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    want = [(None, 2, 1, False), (None, 2, 1, False), (1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (None, 1, None, False), (None, 0, None, True), (4, 0, 4, True), (4, 0, 4, True)]
    assert got == collections.Counter(want)


def test_rows_of_one_id_fill_several_files(spark):
    """Equal rows without an id and rows that share one, each a third of a table."""
    data = [(None, "the same words")] * 400 + [(7, f"text {i}") for i in range(400)] + [(i, "x") for i in range(400)]
    path = shared_dir(spark) + "/t"
    token_store.write_store(spark.createDataFrame(data, "doc_id long, text string").repartition(5), path, partitions=8, shard_ids=200)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in data)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    each = [collections.Counter(i for s in token_store.shards(f["content"]) for i in s.doc_ids()) for f in files]
    assert sum(c[None] > 0 for c in each) > 1 and sum(c[7] > 0 for c in each) > 1 and max(sum(c.values()) for c in each) < 500
