"""Fill-in-middle, forced-boundary BPE and TSQR whitening against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import encoding, fim, forced_bpe, trees, whitening

RNG = random.Random(11)
ALPHABET = "ab cdEZ\n\t  .,'<PSM>0129é漢😀  \x1c"


def texts():
    made = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(150)]
    planned = [None, "", " ", "a", "no units?", "<P>held", "x<S", "<<P", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  x", "don't you'll we've I'm he'd they're 'tis ''s 's 'S '", "a  b   c\n\n d \n", "  ", "x \n", "  y", "漢字 ひらがな", "́á", "=" * 3000, "a" * 5000, "ab" * 2000, " " * 700 + "x", "word " * 20_000, "1234567 12'345", " x", "\x00\x7f", "ß  \x85z", "\U0001f468‍\U0001f469"]
    return planned + made + ["twice", "twice"]


def rows(spark, extra="string"):
    t = texts()
    data = [(None if i == 5 else i if i < len(t) - 1 else i - 1, x, "own", "own") for i, x in enumerate(t)]
    return spark.createDataFrame(data, "doc_id long, text string, output string, IDS string").repartition(3), data


def expected_fim(doc_id, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(u)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if r[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force_and_restores(spark):
    docs, data = rows(spark)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "IDS", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    want = sorted((str(i), t or "", *map(str, expected_fim(i, t))) for i, t, *_ in data)
    assert sorted((str(r["doc_id"]), r["text"] or "", *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))) for r in out) == want
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and all(r["IDS"] == "own" for r in out)


def test_fim_query_is_native(spark, tmp_path):
    docs, data = rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = fim.op11_fill_in_middle(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Pandas", plan)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) for r in out.collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted((str(i), *expected_fim(i, t)[:2], sha(expected_fim(i, t)[4]), sha(t or "")) for i, t, *_ in data)
    assert not fim.fill_in_middle(docs.limit(0)).collect()


def test_fim_refuses_marks_that_could_be_misread(spark):
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    docs, _ = rows(spark)
    out = fim.fill_in_middle(docs.filter("doc_id > 30"), sentinels=("", "", ""), rearranged=100, suffix_first=50)
    assert all(r["back"] == (r["text"] or "") for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"), ("", "", ""))).collect())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_path())


def test_bpe_equals_the_library(spark):
    docs, data = rows(spark)
    t = library()
    coded = forced_bpe.encode(docs)
    assert coded.columns == ["doc_id", "text", "output", "n_tokens", "ids"]
    out = forced_bpe.decode(coded).collect()
    assert len(out) == len(data)
    for r in out:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids), r["text"]
        assert r["n_tokens"] == len(ids) and r["decoded"] == t.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_bpe_of_many_scripts_and_marks():
    t, e = library(), forced_bpe.ForcedBpe(encoding.default_path())
    import pyarrow as pa

    rng = random.Random(3)
    points = [*range(32, 0x250), *range(0x370, 0x600), *range(0x900, 0xA00), *range(0x2000, 0x2100), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640), 0x558, 0x1C, 0x85, 0x3000, 0x16E4]
    made = ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    made += ["".join(rng.choice(["'s", "'", " ", "  ", "\n", "re", "'ll", "x", "1", "-", "'d", "S"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text, ids in zip(made, e.encode(pa.array(made)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_cuts_are_certain():
    """No token of the vocabulary holds a pair of bytes that is marked as a cut, and most borders of fragments are such pairs."""
    e = forced_bpe.ForcedBpe(encoding.default_path())
    for i in range(0, len(e.lengths), 7):
        b = e.all_bytes[e.starts[i] : e.starts[i] + e.lengths[i]]
        assert i in e.added.values() or not e.forced[b[:-1], b[1:]].any()
    data = b"The cat sat on the mat, and 12 dogs ran."
    cuts = set(e.fragments(data, np.array([0, len(data)])).tolist())
    certain = {i for i in range(1, len(data)) if e.forced[data[i - 1], data[i]]}
    assert certain <= cuts and len(certain) > len(cuts) / 2


def test_bpe_decodes_broken_ids_as_the_library_does(spark):
    t = library()
    lists = [[], [50256], [220, 50256, 220], [0xF0, 0xF0], [447, 222, 447], [99999, 64], list(range(0, 50257, 97))]
    frame = spark.createDataFrame([(i, struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(lists)] + [(99, None)], "k long, ids binary")
    got = {r["k"]: r["decoded"] for r in forced_bpe.decode(frame).collect()}
    assert got == {i: t.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {99: ""}


def test_bpe_refuses_other_tokenizers_and_takes_an_empty_table(spark, tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        forced_bpe.ForcedBpe(public_tokenizers.path("word_bpe_49k.json"))
    docs, _ = rows(spark)
    assert not forced_bpe.decode(forced_bpe.encode(docs.limit(0))).collect()


def test_bpe_query(spark, tmp_path):
    docs, data = rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    t, sha = library(), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in data:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode())))
    out = forced_bpe.op12_forced_boundary_bpe(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(want)


def brute_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviations = ((n * x - s) ** 2).sum(1)
    c = (n * x - s).astype(np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, deviations.tolist(), c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def vectors(spark, n=400, d=40):
    rng = np.random.default_rng(4)
    m = (rng.normal(size=(n, d)) * np.linspace(2, 0.1, d) + rng.normal(size=d)).astype(np.float32).tolist()
    data = [(i, v, i % 3, "own") for i, v in enumerate(m)] + [(7, m[7], 1, "own"), (None, m[9], 1, "own")]
    bad = [(1000, None), (1001, [None, *m[0][1:]]), (1002, [float("nan"), *m[0][1:]]), (1003, [float("inf"), *m[0][1:]]), (1004, m[0][:-1]), (1005, []), (1006, [1e30, *m[0][1:]])]
    frame = spark.createDataFrame(data + [(*b, 0, "own") for b in bad], "vec_id long, embedding array<float>, component int, n string")
    return frame.repartition(5), data


def test_whitening_equals_brute_force(spark, tmp_path):
    frame, data = vectors(spark)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op13_tsqr_whitening(spark, str(tmp_path)).collect()
    n, far, w, share = brute_whitening([v for _, v, *_ in data], 32)
    assert len(out) == 32 * len(data) and {r["n"] for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["deviation"]), [[] for _ in range(32)])[r["component"] - 1].append(r["whitened"])
        assert math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9) and 0 <= r["identity_error"] < 1e-9
    assert sorted(map(str, got)) == sorted({str((i, d)) for (i, *_), d in zip(data, far, strict=True)})
    sign = None
    for row, ((i, *_), d) in enumerate(zip(data, far, strict=True)):
        mine = np.array([g[0] for g in got[i, d]])
        assert len(got[i, d][0]) == (2 if i == 7 else 1)
        sign = np.sign(mine * w[row]) if sign is None else sign
        assert np.allclose(mine * sign, w[row], rtol=1e-7, atol=1e-9)


def test_whitening_merges_many_states(spark, monkeypatch):
    monkeypatch.setattr(whitening, "tree", lambda states, merge: trees.tree(states, merge, 2))
    frame, data = vectors(spark, 90, 6)
    rows = whitening.usable(frame.repartition(11), "vec_id", "embedding")
    n, total = whitening.sums(rows)
    c = whitening.Centre(n, total)
    r = whitening.r_factor(rows.filter(F.size("v") == 6), c)
    x = np.array([[math.floor(64 * np.float64(v)) + 1_000_000 for v in row[1]] for row in data], dtype=np.float64)
    assert n == len(x) and total == [int(v) for v in x.sum(0)]
    assert r.shape == (6, 6) and np.allclose(r.T @ r, (x - x.mean(0)).T @ (x - x.mean(0)))


def test_whitening_of_ill_conditioned_and_flat_tables(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert not whitening.whiten(flat).collect() and not whitening.whiten(flat.limit(1)).collect() and not whitening.whiten(flat.limit(0)).collect()
    line = spark.createDataFrame([(i, [float(i), 5.0, float(2 * i)]) for i in range(20)], "vec_id long, embedding array<double>")
    out = whitening.whiten(line).collect()
    assert len(out) == 20 and {r["component"] for r in out} == {1} and all(math.isclose(r["explained"], 1) for r in out)
    wide = spark.createDataFrame([(i, [1e9 * (i % 7), float(i % 5) / 64]) for i in range(35)], "vec_id long, embedding array<double>")
    both = whitening.whiten(wide).collect()
    assert {r["component"] for r in both} == {1, 2} and all(r["identity_error"] < 1e-4 for r in both)
    x = [[64 * 10**9 * (i % 7), i % 5] for i in range(35)]
    s = [sum(v[k] for v in x) for k in (0, 1)]
    assert {r["vec_id"]: int(r["deviation"]) for r in both} == {i: sum((35 * v[k] - s[k]) ** 2 for k in (0, 1)) for i, v in enumerate(x)}
