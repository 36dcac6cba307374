"""Text functions, segmentation and correction on hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import correct, segment


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokenizers(spark):
    assert each(spark, X.tokens, ["well-known don't, cat.", "Room101 3rd"]) == [["well-known", "don't", "cat"], ["Room", "rd"]]
    assert each(spark, X.ocr_tokens, ["well-known don't"]) == [["well", "known", "don't"]]
    assert each(spark, X.spell_tokens, ["  well-knonw, O'brein --- (x)", "", "“Teh”"]) == [["well-knonw", "O'brein", "x"], [], ["Teh"]]


def test_whitespace_fix(spark):
    given = ["a  b", "word .", "He said , hello", "the  cat  sat", "a b word.", "!!! ??? ...", "   ", "", None]
    assert each(spark, X.whitespace_fix, given) == ["a b", "word.", "He said, hello", "the cat sat", None, None, None, None, None]


def test_file_names(spark):
    given = ['bad/name:with*reserved?"<>|chars', "  spaced   out  ", "Rësumé 章", "", "///", "a\x01b\x7f"]
    assert each(spark, X.sanitize_filename, given) == ["badnamewithreservedchars", "spaced out", "Rësumé 章", "audiobook", "audiobook", "ab"]
    from folioflow.sources.m4b import plain_name

    assert [plain_name(g) for g in given] == ["badnamewithreservedchars", "spaced out", "Rësumé 章", "audiobook", "audiobook", "ab"]


def test_escapes_and_small_functions(spark):
    assert each(spark, X.escape_ffmetadata, ["a=b;c#d\\e", "x\ny"]) == ["a\\=b\\;c\\#d\\\\e", "x\\\ny"]
    assert each(spark, X.coerce_category, [" Man ", "GIRL", "robot", None]) == ["man", "girl", "unknown", "unknown"]
    assert each(spark, lambda c: X.shortened(c, 4), ["abcd", "abcde"]) == ["abcd", "abc…"]
    assert each(spark, X.is_renderable, ["a", " 　\t", "", None]) == [True, False, False, False]
    assert each(spark, lambda c: X.review_status(c.cast("double")), ["0.75", "0.74"]) == ["approved", "needs_review"]
    assert each(spark, lambda c: X.pcm16(c.cast("double")), ["1.5", "-1.5", "0.5", "-0.00004"]) == [32767, -32768, 16383, -1]
    assert each(spark, lambda c: X.milliseconds(c.cast("double")), ["0.0005", "0.0015"]) == [0, 2]
    assert each(spark, X.checkable, ["NASA", "OK", "Room101", "teh", "Élan"]) == [False, False, False, True, True]
    assert each(spark, lambda c: X.named_few(F.split(c, ","), 2), ["a,b", "a,b,c"]) == ["a, b", "a, b …"]


def test_blockers_in_words(spark):
    row = spark.range(1).select(
        X.describe_blockers(F.lit(3), F.lit(1), F.array(F.lit("narrator"), F.lit("Bob"))).alias("a"),
        X.describe_blockers(F.lit(0), F.lit(0), F.array().cast("array<string>")).alias("b"),
        X.describe_blockers(F.lit(1), F.lit(2), F.array().cast("array<string>")).alias("c"),
    )
    assert tuple(row.first()) == ("3 attributions, 1 text suggestion, voices needed for: narrator, Bob", "review complete", "1 attribution, 2 text suggestions")


def test_cache_key_is_the_digest_of_its_parts(spark):
    import hashlib

    params = X.canonical_params({"b": {"z": 1, "a": "é"}, "a": 2})
    assert params == '{"a":2,"b":{"a":"é","z":1}}'
    df = spark.createDataFrame([("t", None, None), ("t", "c", 7)], "t string, c string, s int")
    got = [r[0] for r in df.select(X.cache_key("t", "c", F.lit(params), "s")).collect()]
    want = [f"t\0\0{params}", f"t\0c\0{params}\0seed\x007"]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


CASES = {
    "The hall was silent.": [("The hall was silent.", False)],
    'The narrator spoke. "Hello there," said Alice.': [("The narrator spoke.", False), ('"Hello there,"', True), ("said Alice.", False)],
    "“Hi,” said Bob.": [("“Hi,”", True), ("said Bob.", False)],
    '"Yes," she said. "No," he replied.': [('"Yes,"', True), ("she said.", False), ('"No,"', True), ("he replied.", False)],
    '"oops he said': [('"oops he said', False)],
    "oops” he said": [("oops” he said", False)],
    "Alice's dog ran. \"Hi,\" she said.": [("Alice's dog ran.", False), ('"Hi,"', True), ("she said.", False)],
    "": [],
    "   \t  ": [],
}


def test_quote_spans(spark):
    got = each(spark, X.quote_spans, list(CASES))
    assert [[(s["text"], s["is_quote"]) for s in g] for g in got] == list(CASES.values())


def cursor_spans(line):
    """Spans by a scan from left to right, written apart from the pattern."""
    if not line.strip():
        return []
    out, i, plain = [], 0, ""
    while i < len(line):
        c = line[i]
        if c in '"“':
            end = line.find('"' if c == '"' else "”", i + 1)
            if end < 0:
                return [(line.strip(), False)]
            out += [(plain.strip(), False), (line[i : end + 1], True)]
            plain, i = "", end + 1
        elif c == "”":
            return [(line.strip(), False)]
        else:
            plain, i = plain + c, i + 1
    return [s for s in [*out, (plain.strip(), False)] if s[0]]


def test_quote_spans_against_a_scan(spark):
    rng = random.Random(2)
    given = ["".join(rng.choice('ab .“”"') for _ in range(rng.randint(0, 14))) for _ in range(800)]
    got = each(spark, X.quote_spans, given)
    assert [[(s["text"], s["is_quote"]) for s in g] for g in got] == [cursor_spans(g) for g in given]


def lines(spark, texts):
    return spark.createDataFrame([("p", 0, i, t) for i, t in enumerate(texts)], "project_id string, chapter_pos int, line_pos int, text string")


def words(spark, *w):
    return spark.createDataFrame([(x, 1) for x in w], "word string, freq long")


def pairs(df):
    return sorted((r["original"], r["suggested"]) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "dictionary", "protected", "want"),
    [
        ("modem art", ["modern", "art"], [], [("modem", "modern")]),
        ("modem art", ["modern", "modem", "art"], [], []),
        ("modem art", ["modern", "art"], ["modem"], []),
        ("fil", ["fii"], [], []),
        ("falr", ["fair"], [], [("falr", "fair")]),
        ("arn ready", ["am", "ready"], [], [("arn", "am")]),
        ("Modem modem", ["modern"], [], [("Modem", "Modern")]),
    ],
)
def test_look_alikes(spark, text, dictionary, protected, want):
    keep = spark.createDataFrame([("p", w) for w in protected], "project_id string, word string")
    assert pairs(correct.confusion_candidates(lines(spark, [text]), words(spark, *dictionary).select("word"), keep)) == want


@pytest.mark.parametrize(
    ("text", "dictionary", "want"),
    [
        ("care-\nfully chosen", ["carefully"], [("care-\nfully", "carefully")]),
        ("care- fully chosen", ["carefully"], [("care- fully", "carefully")]),
        ("the- wind howled", ["the", "wind"], []),
        ("care-\nfully", [], []),
        ("care-\nfully", ["care", "fully", "carefully"], []),
    ],
)
def test_broken_words(spark, text, dictionary, want):
    assert pairs(correct.dehyphenation_candidates(lines(spark, [text]), words(spark, *dictionary).select("word"))) == want


def test_spelling(spark):
    known = words(spark, "the", "spoke", "narrator", "well", "known")
    got = pairs(correct.spelling_candidates(lines(spark, ["The narrarator spoke. NASA OK Room101 Narrarator", "zzzzzzz qqqqqq"]), known))
    assert got == [("narrarator", "narrator")]


def test_spelling_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    unknown = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(60)} - set(vocabulary))
    known = spark.createDataFrame([(w, i % 5) for i, w in enumerate(vocabulary)], "word string, freq long")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for u in unknown:
        best = max(((-distance(u, w), i % 5, w) for i, w in enumerate(vocabulary)), default=None)
        if best and -best[0] <= 2:
            want[u] = best[2]
    got = {r["word"]: r["suggestion"] for r in correct.spelling_corrections(spark.createDataFrame([(u,) for u in unknown], "word string"), known).collect()}
    assert got == want


def test_protected_words(spark):
    got = lambda texts, names: {r["word"] for r in correct.protected_words(lines(spark, texts), spark.createDataFrame([("p", n) for n in names], "project_id string, name string")).collect()}
    assert got(["Aelin drew her blade.", "Aelin smiled."], []) == {"aelin"}
    assert got(["nothing here"], ["Aelin Galathynius"]) == {"aelin", "galathynius"}
    assert got(["Zorblax saw Glimphor.", "Zorblax"], []) == {"zorblax"}


def test_correction_applies_automatic_fixes_only(spark):
    given = ["He  said , hello", "The narrarator spoke.", "The quiet hall was empty.", ""]
    book = lines(spark, given)
    known = words(spark, "the", "narrator", "spoke", "quiet", "hall", "was", "empty", "said", "hello")
    found = correct.candidates(book, known)
    fixed, made = correct.apply_candidates(book, found)
    assert [r["text"] for r in fixed.orderBy("line_pos").collect()] == ["He said, hello", *given[1:]]
    assert sorted((r["original"], r["suggested"], r["status"]) for r in made.collect()) == [("He  said , hello", "He said, hello", "auto_applied"), ("narrarator", "narrator", "pending")]
    left = correct.uncorrected(book, made)
    assert sorted(r["line_pos"] for r in left.collect()) == [2, 3]


def test_segments_of_lines(spark):
    book = lines(spark, ['"Hello," said Alice.', "Silence."])
    narr = spark.createDataFrame([("p", "n")], "project_id string, narrator_id string")
    got = [(r["text"], r["speaker_id"], r["confidence"], r["review_status"]) for r in segment.line_segments(book, narr).orderBy("line_pos", "seg_pos").collect()]
    assert got == [('"Hello,"', None, 0.0, "needs_review"), ("said Alice.", "n", 1.0, "approved"), ("Silence.", "n", 1.0, "approved")]
    ids = [r["segment_id"] for r in segment.line_segments(book, narr).collect()]
    assert len(set(ids)) == 3 and all(re.fullmatch("seg_[0-9a-f]{32}", i) for i in ids)
