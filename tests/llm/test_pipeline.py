"""The pipeline against a brute-force version on a small corpus."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import decontaminate, encoding, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(14)
    rows = []
    for i in range(120):
        t = prose(rng.randint(20, 90))
        if i % 5 == 0:
            t = " ".join(w + "%%%" for w in t.split())
        if i % 7 == 0:
            t = f"{t} {item} {prose(3)}"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    rows += [(200 + i, rows[i][1] + " more" * (i % 2), "en", "s0", 0) for i in range(1, 12)]
    rows += [(300, None, "en", None, 0), (301, "", "en", "s1", 0), (302, rows[1][1], "en", "s1", 0)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item


def shingles(t):
    w = WORD.findall(t.lower()) if t else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def without_item(t, item):
    if not t:
        return t
    raw = t.encode()
    at = [m.span() for m in PLAIN.finditer(raw)]
    low = [raw[a:b].lower() for a, b in at]
    want = item.encode().split()
    grams = {tuple(want[i : i + 10]) for i in range(len(want) - 9)}
    hit = {k for i in range(len(low) - 9) if tuple(low[i : i + 10]) in grams for k in range(i, i + 10)}
    out, last = b"", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += raw[last : at[i][0]]
        last = at[i][1]
    return (out + raw[last:]).decode()


def mixed(rows):
    size = lambda t: len(WORD.findall(t)) if t else 0
    total = {}
    for _, t, _, s, _ in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, whole = {}, sum(total.values())
    while True:
        rest = [s for s in order if s not in target]
        left = whole - sum(target.values())
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) >= 3 * total[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            break
        target |= {s: 3 * total[s] for s in over}
    out = []
    for r in rows:
        rate = min(target[r[3]] / total[r[3]], 3.0) if total[r[3]] else 0.0
        u = int(hashlib.md5(f"mix:{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def test_pipeline(spark, corpus):
    d, rows, item = corpus
    labels = {i: int(i % 5 > 0) for i in range(120) if zlib.crc32(str(i).encode()) % 5}
    net = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), fold=quality.in_training())
    assert len(labels) > 60
    tables = net.pairs()
    good = [r for r in rows if net.score(r[1], tables) >= quality.THRESHOLD]
    assert len(rows) > len(good) > 60
    sets = [shingles(r[1]) for r in good]
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(good)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)), key=lambda k: good[k][0])
            root[b] = a
    single = [r for i, r in enumerate(good) if find(i) == i]
    assert len(single) < len(good)
    cleaned = [(i, without_item(t, item), g, s, n) for i, t, g, s, n in single]
    kept = sorted(mixed(cleaned), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    enc = encoding.encoder(encoding.default_path()).tokenizer
    want, start = [], 0
    for i, t, *_ in kept:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_stages_keep_the_columns(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "mixing sources", "token id output"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.filter("false"), d).count() == 0
    assert decontaminate.WINDOW == 10
