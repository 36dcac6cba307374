"""Queries of the catalogue on tables of odd values, row by row against their SQL."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from folioflow.functions import text as X
from folioflow.operators import correct
from folioflow.sources import audio

duckdb = pytest.importorskip("duckdb")


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL, sorted."""
    db = duckdb.connect()
    for n, t in tables.items():
        pq.write_table(t, f"{folder}/{n}.parquet")
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    df = e.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want))


def talks(texts):
    n = range(len(texts))
    return pa.table({"conv_id": pa.array([i // 4 for i in n], pa.int64()), "turn": pa.array([i % 4 for i in n], pa.int64()), "role": ["user"] * len(texts), "text": texts})


@pytest.mark.parametrize("name", ["accept_suggestion", "speaker_resolution"])
def test_capitals_letter_by_letter(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, conversations=talks(["ßa und", "äßk so", "Straße", "ﬁn ŉa", "ᾳx", "", "aß", "öß e ẞ", "ǰ", "plain words"]))
    assert got == want


def test_levels_have_the_bits_of_their_sql():
    v = np.random.default_rng(3).normal(size=(200, 64)).astype(np.float32)
    from folioflow.plans.catalog_edits import _LEVEL

    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": list(range(200)), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    want = db.execute(f"WITH x AS (SELECT vec_id, list_transform(embedding, lambda s: CAST(s AS DOUBLE)) AS v FROM embeddings), {_LEVEL} SELECT list_transform(v, lambda s: s * factor) FROM y ORDER BY vec_id").fetchall()
    assert all((audio.normalize(x, 16000, audio.Loudness()) == np.array(w[0])).all() for x, w in zip(v, want, strict=True))


def test_halves_are_rounded_as_scaled_numbers(spark):
    z = [(2 * i + 1) / 2e6 for i in range(400_000, 400_500)] + [-0.5195015, 0.0, float("nan")]
    want = [r[0] for r in duckdb.execute("SELECT round(z, 6) FROM (SELECT unnest(?) AS z)", [z]).fetchall()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(X.rounded("z", 6)).collect()]
    assert repr(got) == repr(want)


def test_levels_of_small_negative_numbers(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(300, 64)).astype(np.float32)
    v[:, 0] = np.where(np.arange(300) % 2, -2e-7, 2e-7)
    v[:, 1] = -0.0
    got, want = both(spark, tmp_path, "levelled_samples", embeddings=pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    assert got == want and any("-0.0," in r for r in want)


def test_levels_by_the_logarithm_of_the_c_library():
    for x in np.random.default_rng(7).normal(size=(300, 64)):
        assert audio.gain_db(x, 16000, audio.Loudness())[2] == min(-18.0 - 20 * math.log10(math.sqrt(np.cumsum(x * x)[-1] / 64)), 30.0)


def test_look_alikes_of_repeated_keys(spark, tmp_path):
    texts = ["find Find ring\nThe ring find, mind", "the mind and the find", "mind find ring ring mind"] * 2
    docs = pa.table({"doc_id": pa.array([0, 1, 2] * 2, pa.int64()), "source": ["a"] * 6, "text": texts})
    got, want = both(spark, tmp_path, "confusion", documents=docs)
    assert got == want and got
    plan = e.queries()["confusion"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan  # tokens aren't put in order before it is known which of them have a fix


@pytest.mark.parametrize("name", ["ocr_suggestions", "correct_lines"])
def test_tokens_without_a_fix_stay_in_place(spark, tmp_path, name):
    texts = ["find Find ring\nThe ring find, mind", "the mind and the find, hand", "mind find ring ring mind fimd", "hand ring, and the rimg"] * 3
    docs = pa.table({"doc_id": pa.array(range(12), pa.int64()), "source": ["a", "b", None] * 4, "text": texts})
    pq.write_table(docs, f"{tmp_path}/documents.parquet")
    df = e.queries()[name](spark, str(tmp_path))
    assert df.count()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Before each shuffle of the words of all lines, a broadcast of bits takes out those that aren't sought; lines are compared by digest.
    assert plan.count("getbit") >= (1 if name == "ocr_suggestions" else 3) and "sha2(" in plan


def test_bits_leave_nothing_out(spark):
    rows = spark.range(5000).selectExpr("concat('p', id % 7) as project_id", "concat('Word', id) as token")
    words = spark.range(0, 5000, 3).selectExpr("concat('p', id % 7) as project_id", "concat('word', id) as word")
    got = {r["token"].lower() for r in correct.maybe_of(rows, words, ["project_id"]).collect()}
    want = {r["word"] for r in words.collect()}
    assert want <= got and len(got) < len(want) + 100


def test_a_line_changed_since_keeps_its_text(spark):
    now = spark.createDataFrame([("p", 0, 0, "a , b"), ("p", 0, 1, "c  d"), ("p", 0, 2, None)], "project_id string, chapter_pos int, line_pos int, text string")
    was = spark.createDataFrame([("p", 0, 0, "a , b"), ("p", 0, 1, "c , d"), ("p", 0, 2, "e , f")], now.schema)
    fixed, made = correct.apply_candidates(now, correct.candidates(was, spark.createDataFrame([("a", 1)], "word string, freq long"), correctors=correct.default_correctors()[:1]))
    assert [r["text"] for r in fixed.orderBy("line_pos").collect()] == ["a, b", "c  d", None]
    assert [r["status"] for r in made.orderBy("line_pos").collect()] == ["auto_applied", "pending", "pending"]
