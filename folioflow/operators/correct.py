"""Correction of OCR and spelling faults: candidates by dictionary joins, applied to lines.

Lines: any key columns (project_id, chapter_pos, line_pos) and text. A dictionary has one column, word, in lower case. Candidates have
the key columns, rank (order within a line), original, suggested, reason, confidence and auto. All correctors see the text as it came.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import make_id

KEY = ("project_id", "chapter_pos", "line_pos")
# Confidences, and look-alike letters in the order they are tried.
AUTO, JOIN, LOOKALIKE, SPELLING = 0.99, 0.5, 0.4, 0.7
CONFUSIONS = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("l", "i"), ("i", "l"))
#: l and i are only swapped in words of this length.
LONG_ENOUGH = 4
#: Letters of a word's beginning by which words of like spelling meet.
PREFIX = 10
#: Bits that tell which words are sought: a broadcast of 1,048,576 rows at most.
WORD_BITS = 1 << 26


def protected_words(lines: DataFrame, speakers: DataFrame | None = None, least: int = 2, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """by, word: words of speakers' names, and words that begin with a capital at least `least` times in a book."""
    found = lines.select(*by, F.explode(X.tokens("text")).alias("token")).filter(F.col("token").rlike(r"^\p{Lu}"))
    frequent = found.groupBy(*by, X.fold("token").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    if speakers is None:
        return frequent
    named = speakers.select(*by, F.explode(X.tokens("name")).alias("token")).select(*by, X.fold("token").alias("word"))
    return frequent.unionByName(named).distinct()


def first_tokens(lines: DataFrame, tokens, key=KEY) -> DataFrame:
    """key, pos, token, word: of each word of a line, in whatever case, its first token. Found within the line: its tokens sorted by word
    and place, the first of each word kept; nothing is shuffled."""
    each = lines.select(*key, F.transform(tokens("text"), lambda t, i: F.struct(X.fold(t).alias("word"), i.alias("pos"), t.alias("token"))).alias("all"))
    each = each.select(*key, F.array_sort("all").alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["word"] != x["word"]))
    return each.select(*key, F.inline(first)).select(*key, "pos", "token", "word")


def all_tokens(lines: DataFrame, tokens, key=KEY) -> DataFrame:
    """key, pos, token of all that stands in the lines."""
    return lines.select(*key, F.posexplode(tokens("text")).alias("pos", "token"))


def maybe_among(rows: DataFrame, mine: list[Column], words: DataFrame, theirs: list[Column]) -> DataFrame:
    """The rows whose values `mine` may be the values `theirs` of one of the words, and few others: a bit for the hash of each word goes
    out, however many words there are, and rows without one needn't be shuffled."""
    at = lambda values: F.xxhash64(*values).bitwiseAND(F.lit(WORD_BITS - 1))
    held = words.select(at(theirs).alias("at")).groupBy(F.shiftright("at", 6).alias("bit_row")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    bit = at(mine)
    return rows.join(F.broadcast(held), (F.shiftright(bit, 6) == F.col("bit_row")) & (F.getbit("bits", bit.bitwiseAND(F.lit(63))) == 1), "left_semi")


def maybe_of(each: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """The tokens whose word may be one of `words` (by, word)."""
    names = [F.col(x) for x in by]
    return maybe_among(each, [*names, X.fold("token")], words, [*names, F.col("word")])


def forms_of(each: DataFrame, by: list[str]) -> DataFrame:
    """by, token: each form once. What joins drop anyway, as forms of no project, is left out at once, so that all who read the forms ask
    for the same rows and Spark deals them out once for all."""
    there = reduce(Column.__and__, [F.col(x).isNotNull() for x in by], X.fold("token").isNotNull())
    return each.select(*by, "token").filter(there).distinct()


def fixed_tokens(each: DataFrame, words: DataFrame, by: list[str], suggested: Column, key=KEY) -> DataFrame:
    """first_tokens of the words alone that `words` (by, word, more) tells of, out of all_tokens, with what it suggests for a token, null
    where that is nothing. The words are sought in a hash of them, so that only what is found has to be put in order."""
    sought = words.withColumnsRenamed({x: f"sought_{x}" for x in (*by, "word")}).hint("shuffle_hash")
    same = reduce(Column.__and__, [F.col(x) == F.col(f"sought_{x}") for x in by], X.fold("token") == F.col("sought_word"))
    found = each.join(sought, same).select(*key, F.col("sought_word").alias("word"), F.struct("pos", "token", suggested.alias("suggested")).alias("m"))
    return found.groupBy(*key, "word").agg(F.min("m").alias("m")).select(*key, "m.*", "word").filter("suggested is not null")


def not_in(df: DataFrame, words: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return df.join(words, list(on), "left_anti")


def unprotected(df: DataFrame, protected: DataFrame | None) -> DataFrame:
    return df if protected is None else not_in(df, protected, tuple(x for x in protected.columns))


def whitespace_candidates(lines: DataFrame, key=KEY) -> DataFrame:
    fixed = X.whitespace_fix("text")
    return lines.filter(fixed.isNotNull()).select(*key, F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.col("text").alias("original"), fixed.alias("suggested"), F.lit("ocr-artifact").alias("reason"), F.lit(AUTO).alias("confidence"), F.lit(True).alias("auto"))


def dehyphenation_candidates(lines: DataFrame, dictionary: DataFrame, protected: DataFrame | None = None, key=KEY) -> DataFrame:
    """A word broken by a hyphen and a line break or blanks, where the whole is a word and not both halves are."""
    pattern = F.lit(r"(\p{L}+)-(?:\n| +)(\p{L}+)")
    parts = [F.regexp_extract_all("text", pattern, F.lit(i)) for i in range(3)]
    each = lines.select(*key, F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("original", "l", "r"), strict=True)])).alias("pos", "m")).select(*key, "pos", "m.*")
    each = each.withColumns({"suggested": F.concat("l", "r"), "word": X.fold(F.concat("l", "r"))})
    each = unprotected(each.join(dictionary, "word", "left_semi"), protected)
    # The dictionary is dealt out once for all three joins: its columns differ in name only.
    each = each.withColumns({"lf": X.fold("l"), "rf": X.fold("r")})
    each = each.join(dictionary.select(F.col("word").alias("lw")), F.col("lf") == F.col("lw"), "left")
    each = each.join(dictionary.select(F.col("word").alias("rw")), F.col("rf") == F.col("rw"), "left").filter("lw is null or rw is null")
    return each.select(*key, F.lit(1).alias("kind"), "pos", "original", "suggested", F.lit("ocr-artifact").alias("reason"), F.lit(JOIN).alias("confidence"), F.lit(False).alias("auto"))


def confusion_variants(token: str = "token"):
    """array<struct<rank, at, fixed>>: the token with each look-alike swapped at each place."""
    t = F.col(token)

    def swapped(rank: int, a: str, b: str):
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.lower(F.substr(t, i, F.lit(len(a)))) == a)
        made = F.transform(places, lambda i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), F.concat(F.substr(t, F.lit(1), i - 1), F.lit(b), F.substr(t, i + len(a))).alias("fixed")))
        return F.filter(made, lambda _: F.length(t) >= LONG_ENOUGH) if {a, b} == {"l", "i"} else made

    return F.concat(*[swapped(rank, a, b) for rank, (a, b) in enumerate(CONFUSIONS)])


def confusion_candidates(lines: DataFrame, dictionary: DataFrame, protected: DataFrame | None = None, key=KEY) -> DataFrame:
    """The first swap of a look-alike that makes an unknown word a known one."""
    each = all_tokens(lines, X.ocr_tokens, key)
    # Each form is looked up and tried once, however many lines hold it.
    by = [] if protected is None else [x for x in protected.columns if x != "word"]
    forms = forms_of(each, by).filter(F.length("token") >= 3).withColumn("word", X.fold("token"))
    unknown = unprotected(not_in(forms, dictionary, ("word",)), protected)
    tried = unknown.select(*by, F.col("token").alias("original"), F.explode(confusion_variants()).alias("v")).select(*by, "original", "v.*", X.fold("v.fixed").alias("word"))
    good = unprotected(tried.join(dictionary, "word", "left_semi"), protected)
    fixed = good.groupBy(*by, "original").agg(F.min_by("fixed", F.struct("rank", "at")).alias("suggested"))
    fixes = fixed.groupBy(*by, X.fold("original").alias("word")).agg(F.map_from_entries(F.collect_list(F.struct("original", "suggested"))).alias("fixes"))
    best = fixed_tokens(maybe_of(each, unknown, by), fixes, by, F.col("fixes")[F.col("token")], key).withColumnRenamed("token", "original")
    return best.select(*key, F.lit(2).alias("kind"), "pos", "original", "suggested", F.lit("ocr-artifact").alias("reason"), F.lit(LOOKALIKE).alias("confidence"), F.lit(False).alias("auto"))


def deletions(word: str = "word", most: int = PREFIX):
    """The beginning of a word, and it without each one and each two of its letters. Of two words within two edits, the beginnings share
    one of these: letters that an insertion pushed out of one are made up for by what was inserted. A word has a bounded number of
    them, however long it is."""
    w = F.substring(word, 1, most)
    n = F.length(w)
    drop = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    once = F.when(n > 0, drop(w)).otherwise(F.array(F.lit("")))
    twice = F.flatten(F.transform(once, drop))
    return F.array_distinct(F.concat(F.array(w), once, twice))


def spelling_corrections(unknown: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """word, suggestion: the nearest dictionary word within `most` edits, two at most; ties go to the more frequent, then the later in
    order. dictionary: word, freq. Words meet through shared deletions of their beginnings, an equi-join, and are then measured."""
    if most > 2:
        raise ValueError("words further apart than two edits need not share a deletion")
    left = unknown.select("word").distinct().select("word", F.explode(deletions()).alias("d"))
    right = dictionary.select(F.col("word").alias("other"), "freq", F.explode(deletions()).alias("d"))
    left = maybe_among(left, [F.col("d")], right, [F.col("d")])
    near = F.levenshtein("word", "other", most)
    both = left.join(right, "d").filter(F.abs(F.length("word") - F.length("other")) <= most).select("word", "other", "freq", near.alias("dist")).filter("dist >= 0")
    return both.groupBy("word").agg(F.max_by("other", F.struct(-F.col("dist"), F.col("freq"), F.col("other"))).alias("suggestion"))


def spelling_candidates(lines: DataFrame, dictionary: DataFrame, protected: DataFrame | None = None, key=KEY) -> DataFrame:
    """Unknown words with another spelling at hand. dictionary: word, freq."""
    each = all_tokens(lines, X.spell_tokens, key)
    by = [] if protected is None else [x for x in protected.columns if x != "word"]
    forms = forms_of(each, by).filter(X.checkable("token")).select(*by, X.fold("token").alias("word")).distinct()
    unknown = unprotected(not_in(forms, dictionary.select("word"), ("word",)), protected)
    fixed = unknown.join(spelling_corrections(unknown, dictionary), "word").filter("suggestion <> word")
    fixed = fixed_tokens(maybe_of(each, unknown, by), fixed, by, F.col("suggestion"), key).filter(X.checkable("token"))
    return fixed.select(*key, F.lit(3).alias("kind"), "pos", F.col("token").alias("original"), "suggested", F.lit("spellcheck").alias("reason"), F.lit(SPELLING).alias("confidence"), F.lit(False).alias("auto"))


#: What a corrector is: lines, dictionary (word, freq) and protected words in, candidates with kind and pos out.
Corrector = Callable[..., DataFrame]


def default_correctors() -> tuple[Corrector, ...]:
    """White space, broken words, look-alikes, spelling: in the order their candidates stand in a line."""
    words = lambda d: d.select("word")
    return (
        lambda lines, d, p, key: whitespace_candidates(lines, key),
        lambda lines, d, p, key: dehyphenation_candidates(lines, words(d), p, key),
        lambda lines, d, p, key: confusion_candidates(lines, words(d), p, key),
        lambda lines, d, p, key: spelling_candidates(lines, d, p, key),
    )


def candidates(lines: DataFrame, dictionary: DataFrame, protected: DataFrame | None = None, key=KEY, correctors: tuple[Corrector, ...] | None = None) -> DataFrame:
    """All candidates of all correctors, with rank. dictionary: word, freq. Every corrector sees the lines as they came."""
    found = [c(lines, dictionary, protected, key) for c in correctors or default_correctors()]
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy(*key).orderBy("kind", "pos", "original")
    return every.withColumn("rank", F.row_number().over(order) - 1).drop("kind", "pos")


def uncorrected(lines: DataFrame, suggestions: DataFrame, key=KEY) -> DataFrame:
    """Lines without a correction suggestion yet."""
    return lines.join(suggestions.filter(X.is_correction("reason")).select(*key).distinct(), list(key), "left_anti")


def apply_candidates(lines: DataFrame, found: DataFrame, key=KEY) -> tuple[DataFrame, DataFrame]:
    """The lines with automatic fixes in, and the suggestions: automatic ones applied (their original is the line before), others pending.
    A fix whose line has changed since isn't applied and waits for a person like the others."""
    fixes = found.filter("auto").select(*key, F.col("suggested").alias("fixed"), F.col("original").alias("was"))
    now = lines.join(fixes, list(key), "left")
    fixed = now.withColumn("text", F.when(F.col("was") == F.col("text"), F.col("fixed")).otherwise(F.col("text"))).select(*lines.columns)
    # Whether the text is still the one it was is told by its digest: whole lines aren't dealt out for that.
    digest = lambda x: F.unhex(F.sha2(x, 256))
    told = found.join(lines.select(*key, digest("text").alias("now")), list(key), "left")
    status = F.when(F.col("auto") & (digest("original") == F.col("now")), "auto_applied").otherwise("pending")
    made = told.select(*key, F.col("rank").alias("sug_pos"), make_id("sug", *key, "rank").alias("suggestion_id"), "original", "suggested", "reason", "confidence", status.alias("status"))
    return fixed, made
