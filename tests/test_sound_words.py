"""Loudness filters over blocks against sample by sample, nearest words against all pairs, first tokens of a line, fixes of changed lines."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import correct
from folioflow.sources import audio


def by_sample(x, b, a):
    out = np.empty_like(x)
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(x.tolist()):
        out[i] = y = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x2, x1, y2, y1 = x1, v, y1, y
    return out


@pytest.mark.parametrize("rate", [8000, 22050, 24000, 48000])
def test_filters_over_blocks(rate):
    rng = np.random.default_rng(rate)
    for n in (0, 1, audio.BLOCK - 1, audio.BLOCK, audio.BLOCK + 1, 5000):
        x = rng.normal(size=n)
        for b, a in (audio._shelf(rate), audio._high_pass(rate)):
            assert np.abs(audio.biquad(x, b, a) - by_sample(x, b, a)).max(initial=0) < 1e-9


def test_filters_are_fast():
    x = np.random.default_rng(1).normal(size=480_000)
    timed = lambda f: min((time.perf_counter(), f(x, *audio._shelf(24000)), time.perf_counter())[::2] for _ in range(3))
    (a, b), (c, d) = timed(audio.biquad), timed(by_sample)
    assert d - c > 5 * (b - a)


def test_measured_sounds(spark):
    tone = (0.1 * np.sin(2 * np.pi * 997 * np.arange(48000) / 48000)).tolist()
    df = spark.createDataFrame([(1, tone, "x"), (2, [0.5] * 10, None), (3, [], ""), (4, None, "")], "k int, samples array<double>, peak_name string")
    got = {r["k"]: r for r in audio.measured(df, 48000).collect()}
    assert abs(got[1]["lufs"] - (20 * np.log10(0.1) - 3.01)) < 0.1 and abs(got[1]["gain_db"] + 18 + got[1]["lufs"]) < 1e-9
    assert got[2]["lufs"] is None and abs(got[2]["gain_db"] - (-18 - 20 * np.log10(0.5))) < 1e-9
    assert (got[3]["peak"], got[3]["gain_db"], got[4]["peak"]) == (0.0, 0.0, 0.0) and got[1]["peak_name"] == "x"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def deleted(w, most):
    w = w[:most]
    once = {w[:i] + w[i + 1 :] for i in range(len(w))} | ({""} if not w else set())
    return {w} | once | {x[:i] + x[i + 1 :] for x in once for i in range(len(x))}


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_beginnings_share_a_deletion(a, b):
    if edits(a, b) <= 2:
        for most in (3, 7, correct.PREFIX):
            assert deleted(a, most) & deleted(b, most)


def test_nearest_words_equal_all_pairs(spark):
    rng = random.Random(2)
    known = {"".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 15]))): rng.randint(1, 4) for _ in range(250)} | {"x" * 300: 1, "übung": 2}
    asked = {"".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 5, 9, 12, 15]))) for _ in range(60)} | {"x" * 299 + "y", "ubung", "z" * 500}
    got = {r["word"]: r["suggestion"] for r in correct.spelling_corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, freq long")).collect()}
    want = {}
    for w in asked:
        near = [(edits(w, k), -f, [-ord(c) for c in k], k) for k, f in known.items() if abs(len(w) - len(k)) <= 2 and edits(w, k) <= 2]
        if near:
            least = min(n[0] for n in near)
            freq = min(n[1] for n in near if n[0] == least)
            want[w] = max(n[3] for n in near if n[:2] == (least, freq))
    assert got == want
    keys = spark.createDataFrame([("x" * 300,), ("abcdefghijklmnop",)], "word string").select(F.size(correct.deletions()).alias("n")).collect()
    assert max(r["n"] for r in keys) <= 1 + correct.PREFIX + correct.PREFIX * (correct.PREFIX - 1) // 2


def test_first_tokens_are_found_in_their_line(spark):
    lines = spark.createDataFrame([("p", 0, 0, "The cat the CAT a Cat"), ("p", 0, 1, ""), ("p", 0, 2, None), ("p", 0, 3, "cat")], "project_id string, chapter_pos int, line_pos int, text string")
    out = correct.first_tokens(lines, X.tokens)
    assert sorted((r["line_pos"], r["pos"], r["token"], r["word"]) for r in out.collect()) == [(0, 0, "The", "the"), (0, 1, "cat", "cat"), (0, 4, "a", "a"), (3, 0, "cat", "cat")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_fix_of_a_changed_line_waits(spark):
    ddl = "project_id string, chapter_pos int, line_pos int, text string"
    found = correct.candidates(spark.createDataFrame([("p", 0, 0, "a  b"), ("p", 0, 1, "c  d")], ddl), spark.createDataFrame([], "word string, freq long"))
    now = spark.createDataFrame([("p", 0, 0, "a  b"), ("p", 0, 1, "changed")], ddl)
    lines, made = correct.apply_candidates(now, found)
    assert {r["text"] for r in lines.collect()} == {"a b", "changed"}
    assert {r["original"]: r["status"] for r in made.collect()} == {"a  b": "auto_applied", "c  d": "pending"}
