"""The ten operators against brute force on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, other columns."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import components, decontaminate, embeddings, encoding, jaccard, lm, mixing, quality, regions, token_counts, token_store, toxicity, warc
from folioflow.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs_frame(spark, rows):
    """doc_id, text, source and columns whose names clash with what operators compute."""
    return spark.createDataFrame([(i, t, "en", s, 0, 0.5, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, size string")


@functools.cache
def texts():
    base = prose(120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:60] + prose(60).split())
    return [None, "", "  \n\t ", "one", "one", "two words", base, base, near, far, base.upper(), prose(30_000), "é ü ñ 漢字 words", *[prose(RNG.randint(1, 80)) for _ in range(40)]]


def rows():
    return [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts())]


def test_mix_matches_targets_and_caps(spark):
    docs = docs_frame(spark, rows() + [(3, "one", "a")])
    got = mixing.plan(docs).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert math.isclose(sum(t for t, _ in targets.values()), total)
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values())
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    again = mixing.plan(docs).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix_sources(docs).columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixing.mix_sources(docs).select("doc_id").collect())
    expect = collections.Counter()
    for r in got:
        expect[r["doc_id"]] += r["copies"]
    assert copies == +expect


def test_mix_of_nothing(spark):
    empty = docs_frame(spark, [])
    assert mixing.plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    assert [r["taken"] for r in mixing.plan(docs_frame(spark, [(1, None, None), (None, "", "a")])).collect()] == [0, 0]


def test_warc_round_trip(spark):
    html = ["<p>same</p>", "<p>other</p>", None, "", "x" * 300_000, "<p>same</p>", "é\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "s") for i, h in enumerate(html)] + [(5, "http://h/5", "<p>same</p>", "s")], "page_id long, url string, html string, payload string")
    path = shared_dir(spark) + "/a"
    warc.write_archives(pages, path)
    got = sorted(warc.read_archives(spark, path, payload=True).collect(), key=lambda r: (r["page_id"], r["record_type"]))
    assert [r["page_id"] for r in got] == [0, 1, 2, 3, 4, 5, 5, 6]
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[0] == ("revisit", 5) and kinds[5] == ("response", None) and kinds[2] == ("revisit", 3)
    for r in got:
        raw = (html[r["page_id"]] or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.digest(raw)
        assert r["payload"] == (raw if r["record_type"] == "response" else None)


def test_warc_keeps_small_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string")
    path = shared_dir(spark) + "/a"
    warc.write_archives(pages, path, revisit_from=3)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_warc_dictionary_leads_and_records_stand_alone():
    import zstandard

    records = [warc.record(i, "u", prose(50).encode(), None, "1970-01-01T00:00:00Z") for i in range(200)]
    frames = list(warc.archive(iter(records), dictionary_size=4096, sample_bytes=20_000, level=3))
    assert int.from_bytes(frames[0][:4], "little") == warc.DICTIONARY_FRAME and len(frames) == 201
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
    assert d.decompress(frames[77]) == records[76]
    assert sum(map(len, frames[1:])) < sum(map(len, records)) / 2
    assert list(warc.read_archive(b"".join(f + warc.SEPARATOR.encode() for f in frames))) == records


def test_encoder_equals_the_library():
    e = encoding.encoder(encoding.default_path())
    odd = ["a  b", "a   b", " a", "a ", "a  ", "\n", "a\nb\n\nc\n\n\nd", "a \nb", "a\n b", "don't  stop!!", "x\ty\r\nz", "漢字 仮名 é", "<|endoftext|> x", " y", "1,2 ... %%%a", "", None]
    every = odd + texts() + [prose(500).replace(" ", "\n", 40)]
    want = e.tokenizer.encode_batch([t or "" for t in every], add_special_tokens=False)
    for _ in range(2):
        assert [x == np.array(w.ids, e.dtype).tobytes() for x, w in zip(e.many(every), want, strict=True)] == [True] * len(every)
    assert [e.count(t or "") for t in every] == [len(w.ids) for w in want]


def test_added_tokens_are_found_as_the_library_finds_them(spark):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    fresh = Tokenizer.from_file(encoding.default_path())
    n = lambda t: fresh.encode(t, add_special_tokens=False).ids
    assert n(f"a {end} b") == [64, 220, 50256, 275]
    every = [f"a {end} b", end, f" {end}", f"{end}{end} x", f"a{end}b", f"a\n{end}\nb", f"a  {end} ", f"{prose(90)} {end}{prose(90)}", "<|endoftext|", f"{end[:5]} {end[5:]}", prose(50)]
    e = encoding.encoder(encoding.default_path())
    for _ in range(2):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.many(every)] == [n(t) for t in every]
    assert [e.count(t) for t in every] == [len(n(t)) for t in every]
    long = f"{prose(60)} {end} {prose(60)}"
    at = long.index(end)
    data = [(0, long, [(at + 3, at + 5, "")]), (1, long.replace(end, "<|end|>"), [(at + 5, at + 5, "oftext")]), (2, long, [(0, at, "")]), (3, None, [(0, 0, end)])]
    df = spark.createDataFrame(data, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    for r in token_counts.edited_counts(df, texts=True).collect():
        assert (r["n_tokens_before"], r["n_tokens"]) == (len(n(data[r["doc_id"]][1] or "")), len(n(r["text"])))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 1000], list(range(0, 5000, 7)), [0] * 300 + [1 << 40]])
def test_elias_fano(values):
    ef, end = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(np.array(values, np.uint64)).to_bytes(), 0)
    assert ef.decode().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_token_store_round_trip(spark):
    data = rows() + [(6, "again", "a"), (None, "no id", None)]
    path = shared_dir(spark) + "/t"
    token_store.write_store(docs_frame(spark, data), path, shard_ids=500)
    got = token_store.read_store(spark, path, ids=True).orderBy("start").collect()
    e = encoding.encoder(encoding.default_path())
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shard = next(token_store.shards(token_store.pack([3, 9], [b"\1\0\2\0", b"\3\0"], 2) + b"\n"))
    assert shard.document(1).tolist() == [3] and shard.doc_ids() == [3, 9]


def test_token_store_of_nothing(spark):
    path = shared_dir(spark) + "/t"
    token_store.write_store(docs_frame(spark, []), path)
    assert token_store.read_store(spark, path).count() == 0


def contaminated(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = pattern.findall(lower(text))
    hit, names = set(), set()
    for name, t in items:
        w = pattern.findall(lower(t))
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_decontamination(spark, most):
    long_item = prose(25)
    items = [(1, long_item), (10, long_item), (2, "Just Three Words"), (3, None), (4, " .,! "), (5, prose(12)), (None, prose(11))]
    planted = [(100, f"{prose(5)} {long_item.upper().replace(' ', ', ')} {prose(5)}", "a"), (101, "just-three words", "a"), (102, " ".join(long_item.split()[:9]), None), (103, items[5][1] + " " + items[6][1], "b")]
    docs = docs_frame(spark, rows() + planted)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench, most_windows=most).collect()}
    named = [("" if i is None else str(i), t) for i, t in items]
    for i, t, _ in rows() + planted:
        n, hit, names = contaminated(t, named)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    cleaned = decontaminate.decontaminate(docs, bench, most_windows=most)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(after[i] == t for i, t, _ in rows() if not got[i]["contaminated"])
    assert long_item.split()[3] not in after[100].lower().split() or contaminated(after[100], named)[1] == 0
    left = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, remove="documents").collect()}
    assert left == {i for i, r in got.items() if not r["contaminated"]}


def test_decontamination_of_and_by_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = docs_frame(spark, rows())
    assert decontaminate.report(docs, bench).filter("contaminated").count() == 0
    assert decontaminate.report(docs_frame(spark, []), bench).count() == 0


def test_marks_take_the_place_of_columns_of_their_names(spark):
    bench = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "say one two three", 9, "x", "y")], "doc_id long, text string, n_words int, runs string, items string")
    for most in (10, 0):
        (got,) = decontaminate.marked(docs, bench, most_windows=most).collect()
        assert (got["n_words"], got["runs"], got["items"]) == (4, [1, 4], ["a"])
        assert decontaminate.decontaminate(docs, bench, most_windows=most).columns == docs.columns


def test_decontamination_of_rows_that_repeat_an_id(spark):
    bench = spark.createDataFrame([(i, f"common passage of five words {i % 2}") for i in range(40)], "item_id long, text string")
    data = [(1, "common passage of five words 0"), (1, "nothing"), (1, None), (None, "x common passage of five words 1 y"), (None, "x common passage of five words 1 y")] + [(7, "common passage of five words 1")] * 500
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for most in (10_000, 0):
        got = collections.Counter((r["doc_id"], r["n_words"], tuple(r["runs"]), len(r["items"])) for r in decontaminate.marked(docs, bench, most_windows=most).collect())
        assert got == {(1, 6, (0, 6), 20): 1, (1, 1, (), 0): 1, (1, 0, (), 0): 1, (None, 8, (1, 7), 20): 2, (7, 6, (0, 6), 20): 500}


def test_mixing_with_any_column_names_and_repeated_ids(spark):
    data = [(7, f"w{i} b c d", "a", i) for i in range(1000)] + [(None, f"v{i} b", "b", i) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, __rate int").withColumns({n: F.lit(n) for n in ("__of", "__copy", "rate", "of", "copy", "c0_")})
    got = mixing.mix_sources(docs)
    assert got.columns == docs.columns
    plan = mixing.plan(docs)
    for source in ("a", "b"):
        own = [r for r in plan.collect() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.1 * own[0]["target"]
        assert got.filter(F.col("source") == source).count() == sum(r["copies"] for r in own)


def test_files_go_by_partition_number(spark):
    names = ["x/part-100000-a.txt", "x/part-99999-b.txt", "x/part-00002-c.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "file string").orderBy(token_store.part_number("file")).collect()
    assert [r["file"] for r in rows] == names[::-1]


def closure(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingle_set(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent", "cap"), [(4, 85, None), (5, 80, None), (2, 60, None), (4, 85, 50)])
def test_jaccard_components(spark, monkeypatch, k, percent, cap):
    if cap:  # blocks and regions of their own even for these few
        monkeypatch.setattr(regions, "OWN_BLOCK", cap)
        monkeypatch.setattr(regions, "BLOCK_SHINGLES", 400)
        monkeypatch.setattr(regions, "BLOCK_SETS", 3)
        monkeypatch.setattr(regions, "TILE", 2)
    rng = random.Random(k * percent)
    data = [t for t in texts() if not t or len(t) < 100_000]
    for size in (3, 6, 7, 9, 14, 30, 90, 200):
        base = prose(size, rng).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 18))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            if rng.random() < 0.4:
                w = w[: max(1, len(w) - rng.randint(0, size // 6))]
            data.append(" ".join(w))
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs_frame(spark, [(i, t, "a") for i, t in enumerate(data)]), words=k, percent=percent).collect()}
    sets = [shingle_set(t, k) for t in data]
    links = [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = closure(len(data), links)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(data))] == [(len(s), c) for s, c in zip(sets, want, strict=True)]


@pytest.mark.parametrize(("own", "shingles", "apart"), [(600, 300, True), (40, 30, True), (600, 300, False), (10**9, 10**9, True)])
def test_region_links(spark, monkeypatch, own, shingles, apart):
    """One area of several clusters, chained by some sets, against brute force; apart: clusters that pivots can part."""
    for name, value in (("OWN_BLOCK", own), ("BLOCK_SHINGLES", shingles), ("BLOCK_SETS", 5), ("TILE", 3), ("PIVOTS", 6), ("LEVELS", 3), ("RARE", 4), ("PAIRS", 40)):
        monkeypatch.setattr(regions, name, value)
    rng = np.random.default_rng(own + apart)
    sets = []
    for cluster in range(12 if apart else 1):
        base = rng.choice(5000, 60, replace=False) + (5000 * cluster if apart else 0)
        for k in range(8 if apart else 90):
            keep = base[rng.random(60) < rng.choice([0.97, 0.9, 0.8])]
            sets.append(np.unique(np.append(keep, rng.integers(10**6, 10**7, rng.integers(0, 9)))).astype(np.uint64))
    sets += [np.unique(rng.integers(0, 60_000, n)).astype(np.uint64) for n in (1, 2, 5, 400)]
    percent = 80
    linked = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
    assert linked
    table = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, size long, members binary")
    areas = table.selectExpr("0L as region", "node", "size", "node as owner")
    last, _ = regions.parted(areas, table, percent)
    if own == 600:
        assert last.select("region").distinct().count() > 1 and (apart or last.filter("owner is not null").count() > 0)
    found = [(r["u"], r["v"]) for x in regions.region_links(areas, table, percent) for r in x.collect()]
    assert closure(len(sets), found) == closure(len(sets), linked)


def test_jaccard_of_very_long_texts(spark):
    w = [f"{VOCABULARY[i % len(VOCABULARY)]}{i}" for i in range(60_000)]
    data = [" ".join(w), " ".join(w[:57_000]), " ".join(w[:40_000]), None, "", " ".join(w[55_000:])]
    docs = docs_frame(spark, [(i, t, "a") for i, t in enumerate(data)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {0: (59_997, 0), 1: (56_997, 0), 2: (39_997, 2), 3: (0, 3), 4: (0, 4), 5: (4_997, 5)}


@pytest.mark.parametrize("percent", [34, 50, 60])
def test_jaccard_of_very_different_sizes(spark, percent):
    data = []
    for n in (1, 2, 3, 4, 6, 8, 11, 12, 19, 31, 50):  # parts of a text that are just large enough, and just too small
        least = -(-percent * n // 100)
        data += [" ".join(f"x{n}y{i}" for i in range(m)) for m in {n, least, least - 1} if m > 0]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs_frame(spark, [(i, t, "a") for i, t in enumerate(data)]), words=1, percent=percent).collect()}
    sets = [shingle_set(t, 1) for t in data]
    want = closure(len(data), [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])
    assert [got[i] for i in range(len(data))] == want


def test_texts_without_an_id_link_like_others(spark):
    w = [f"w{i}" for i in range(114)]
    a, between, b = (" ".join(w[i : i + 100]) for i in (0, 7, 14))  # a and b are linked only by way of the text between
    x = prose(60)
    data = [(1, a), (None, between), (None, between), (2, b), (None, x), (9, x + " more"), (None, x.upper()), (None, "nothing like it"), (None, None), (4, "alone")]
    got = jaccard.jaccard_components(docs_frame(spark, [(i, t, "a") for i, t in data])).collect()
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got)
    n = len(shingle_set(x, 4))
    assert found == sorted([(1, 97, 1), (0, 97, 1), (0, 97, 1), (2, 97, 1), (0, n, 9), (9, n + 1, 9), (0, n, 9), (0, 1, 0), (0, 0, 0), (4, 1, 4)])


def test_keep_one_of_each_group(spark):
    docs = docs_frame(spark, rows() + [(6, texts()[6], "a"), (None, "no id at all here", "a")])
    kept = jaccard.keep_one(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and ids.count(6) == 1 and 7 not in ids and None in ids and {0, 1, 2, 9} <= set(ids)
    assert jaccard.keep_one(docs_frame(spark, [])).count() == 0


def test_keep_one_tells_rows_of_an_id_apart(spark):
    w = prose(80)
    near = [f"{w} {x}" for x in ("aa", "bb", "cc")]
    data = [(1, near[0]), (2, near[1]), (2, "a text of its own"), (3, "first"), (3, "second"), (3, "second"), (3, None), (None, near[2]), (None, "lone one"), (None, "LONE one"), (None, ""), (7, near[0]), (7, "")]
    kept = jaccard.keep_one(docs_frame(spark, [(i, t, "a") for i, t in data]))
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect())
    assert got == sorted([(1, near[0]), (2, "a text of its own"), (3, "first"), (3, "second"), (3, ""), (0, "lone one"), (0, ""), (7, "")])
    lone = docs_frame(spark, [(1, near[0], "a"), (None, near[1], "a")])
    assert [r["text"] for r in jaccard.keep_one(lone).collect()] == [near[0]]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [list(map(float, centres[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.35))) for i in range(150)]
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], vectors[0], [x * 7 for x in vectors[1]]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, 0.95, block=block).collect()}
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for i, j in itertools.combinations(good, 2):
        a, b = np.array(vectors[i]), np.array(vectors[j])
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
            links.append((i, j))
    degree = collections.Counter(itertools.chain.from_iterable(links))
    want = closure(len(vectors), links)
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(len(vectors))] == [(degree[i], want[i], want[i] == i) for i in range(len(vectors))]


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("chunk", [300, 1_000_000])
def test_language_model(spark, chunk):
    data = rows() + [(7, "one two", "a"), (None, "no id", None)]
    got = lm.score(docs_frame(spark, data), chunk=chunk).collect()
    tok = lambda t: [*WORD.findall(lower(t)), None]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = collections.Counter(itertools.chain.from_iterable(tok(t) for i, t, _ in data if fold(i) != 2))
    n, v = sum(counts.values()), len(counts)
    key = lambda i, nt, base: (i is None, i or 0, nt, round(base, 6))
    want = sorted((*key(i, len(tok(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t))), sum(counts[w] > 0 for w in tok(t)), fold(i) == 2) for i, t, _ in data)
    assert sorted((*key(r["doc_id"], r["n_tokens"], r["base_score"]), r["n_known"], r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(1)
    sentences = [prose(6, rng) for _ in range(30)]
    data = [(i, " ".join(rng.choice(sentences) for _ in range(10)), "a") for i in range(200)]
    held = lm.score(docs_frame(spark, data)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.6
    cells = np.array([[3, 8, 80, 50], [3, 0, lm.NEVER, 10], [0, 5, lm.NEVER, 4]])
    assert np.allclose(lm.em(cells, 0.001).sum(1), 1)


def test_language_model_without_training(spark):
    assert lm.score(docs_frame(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(docs_frame(spark, [(only, "a b", "x")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"])


def labelled(spark, n=160):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        words = prose(rng.randint(30, 120), rng).split()
        if toxic:
            words[rng.randrange(len(words))] = "idiot"
        text = " ".join(w + "%%%" * bad for w in words)
        data.append((i, text, "a"))
        labels.append((i, int(not bad), int(toxic), "c"))
    data += [(1000, None, "a"), (1001, "", "b"), (1002, prose(20_000), "a"), (1, "repeated", "a")]
    return docs_frame(spark, data), spark.createDataFrame(labels + [(5000, None, None, "c")], "doc_id long, quality int, toxic int, score string")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out(spark, module, label):
    docs, labels = labelled(spark)
    model = module.train(docs, labels, fold=module.in_training(), **({"epochs": 6} if module is quality else {}))
    name = "__score" if module is quality else "score"
    got = module.scored(docs.select("doc_id", "text"), model).withColumnRenamed(name, "p")
    assert got.count() == docs.count() and got.filter("p is null or p < 0 or p > 1").count() == 0
    held = got.filter(~module.in_training()).join(labels, "doc_id").filter("doc_id < 1000 and doc_id <> 1")
    right = held.filter((F.col("p") >= module.THRESHOLD).cast("int") == F.col(label)).count()
    assert right >= 0.9 * held.count() > 0


def test_labelled_sample_takes_a_row_of_each_id(spark):
    docs = docs_frame(spark, [(i, f"text {i}", "a") for i in range(10)] + [(3, f"text {i}", "a") for i in range(30, 60)] + [(4, None, "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    texts, y = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10, 100)
    assert (texts, y) == ([f"text {i}" for i in range(10)], [i % 2 for i in range(10)])


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels(spark, module, label):
    docs, labels = labelled(spark, 10)
    for some in (labels.filter("false"), labels.filter(f"{label} = 1")):
        model = module.train(docs, some)
        assert module.scored(docs.select("doc_id", "text"), model).count() == docs.count()
    assert module.scored(docs.filter("false").select("doc_id", "text"), model).count() == 0


def test_quality_stage_keeps_columns_and_ignores_other_columns(spark):
    docs, labels = labelled(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_cnn_gradient_is_the_slope():
    net = quality.ByteCnn(filters=3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = quality.padded(prose(150, random.Random(4)))
    loss = lambda: -np.log(quality.sigmoid(net.logit(net.blocks(data, net.pairs())[0])[0]))
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradient(data, 1.0, 1.0, net.pairs(), g)
    for name, at in (("taps", (1, ord("g"), 2)), ("w1", (0, 1)), ("w2", (2,)), ("mix", (1,))):
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert math.isclose((up - down) / (2 * eps), g[name][at], rel_tol=0.05, abs_tol=1e-5)


def test_cnn_reads_the_whole_text():
    net = quality.ByteCnn()
    tables = net.pairs()
    text = prose(60_000)
    whole = net.logit(net.blocks(quality.padded(text), tables)[0])[0]
    assert math.isclose(quality.sigmoid(whole), net.score(text, tables), rel_tol=1e-5)


def test_toxic_sentences_are_located(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    text = "All is well here. You are an idiot my friend! Good bye."
    found = toxicity.locate(docs_frame(spark, [(1, text, "a"), (2, "All is well.", "a"), (3, None, "a")]), model).collect()
    assert [(r["doc_id"], r["sentence"].strip()) for r in found] == [(1, "You are an idiot my friend")]
    assert text[found[0]["start"] : found[0]["end"]] == found[0]["sentence"]


def test_toxicity_counts_many_small_weights():
    rng = random.Random(3)
    hints = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmn"][:40]

    def data(n):
        y = [i % 2 for i in range(n)]
        return [" ".join(w for w in hints if rng.random() < (0.5 if v else 0.25)) + " house river." for v in y], y

    model = toxicity.NoisyOr().fit(*data(600))
    held, y = data(400)
    assert sum((model.score(t) >= 0.5) == v for t, v in zip(held, y, strict=True)) > 0.85 * len(held)


def test_edit_counts_equal_full_counts(spark):
    edits = [[], None, [(0, 0, "New ")], [(3, 9, ""), (0, 1_000_000, ""), (0, 0, "again")], [(5, 2, " x "), (-4, 3, None), (None, 2, "y")], [(40, 80, " ".join(VOCABULARY) * 3)]]
    data = [(i, t, edits[i % len(edits)]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = {r["doc_id"]: r for r in token_counts.edited_counts(df, texts=True).collect()}
    e = encoding.encoder(encoding.default_path())
    n = lambda t: len(e.tokenizer.encode(t, add_special_tokens=False).ids)
    for i, t, todo in data:
        now = t or ""
        for a, b, new in todo or []:
            a = min(max(a or 0, 0), len(now))
            now = now[:a] + (new or "") + now[min(max(b or 0, a), len(now)) :]
        r = got[i]
        assert (r["text"], r["n_tokens_before"], r["n_tokens"], r["n_chars"]) == (now, n(t or ""), n(now), len(now))
    long = next(i for i, t in enumerate(texts()) if t and len(t) > 100_000)
    assert token_counts.edited_counts(df.filter(F.col("doc_id") == long).withColumn("edits", token_counts.sample_edits())).first()["chars_encoded"] < 6000


@pytest.mark.parametrize("seed", range(6))
def test_token_tree_under_random_edits(seed):
    rng = random.Random(seed)
    e = encoding.encoder(encoding.default_path())
    now = prose(rng.randint(0, 400), rng)
    tree = token_counts.TokenTree(now, e)
    for _ in range(30):
        a = rng.randrange(len(now) + 3)
        b = a + rng.choice([0, 0, 3, 30, 900])
        new = rng.choice(["", " ", "x", " hello world", "\n\n", "  ", "é" * 5, "word " * rng.randrange(300)])
        tree.edit(a, b, new)
        a, b = min(a, len(now)), min(b, len(now))
        now = now[:a] + new + now[max(a, b) :]
        assert tree.whole() == now and tree.n_tokens == len(e.tokenizer.encode(now, add_special_tokens=False).ids)
