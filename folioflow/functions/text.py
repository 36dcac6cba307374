"""Scalar functions on text, as Spark columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, CORRECTION_REASONS, RENDERED

# Fixed patterns of the three tokenizers: words, words for OCR checks, edges of spell-check tokens.
WORD = r"\p{L}+(?:[-'’]\p{L}+)*"
OCR_WORD = r"\p{L}+(?:'\p{L}+)*"
SPACELESS = r"(?U)\S+"
EDGES = r"(?U)^[^\w]+|[^\w]+$"
#: Text in straight or curly quotes, or what stands between.
QUOTED = '"[^"]*"|“[^”]*”'
SPAN = QUOTED + '|[^"“”]+'
STRIP = r"(?U)^\s+|\s+$"

APPROVE_FROM = 0.75


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), STRIP, "")


def fold(x: Column | str) -> Column:
    return F.lower(c(x))


#: Letters whose capital is several letters, and those among them that have one of their own as well.
_LONG = "".join(x for x in map(chr, range(0x10000)) if len(x.upper()) > 1)
_OWN = {x: x.title() for x in _LONG if len(x.title()) == 1 and x.title() != x} | {"ß": "ẞ"}


def upper(x: Column | str) -> Column:
    """Letter by letter, as SQL engines do it: ẞ for ß. Letters that have only several for a capital, as ligatures, stay as they are."""
    parts = F.regexp_extract_all(F.translate(c(x), "".join(_OWN), "".join(_OWN.values())), F.lit(f"[{_LONG}]+|[^{_LONG}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{_LONG}]"), p).otherwise(F.upper(p))), "")


def tokens(x: Column | str) -> Column:
    """Words of letters, with hyphens and apostrophes inside."""
    return F.regexp_extract_all(c(x), F.lit(WORD), F.lit(0))


def ocr_tokens(x: Column | str) -> Column:
    """Words of letters with straight apostrophes inside; a hyphen parts words."""
    return F.regexp_extract_all(c(x), F.lit(OCR_WORD), F.lit(0))


def spell_tokens(x: Column | str) -> Column:
    """What stands between white space, without marks at its ends."""
    return F.filter(F.transform(F.regexp_extract_all(c(x), F.lit(SPACELESS), F.lit(0)), lambda t: F.regexp_replace(t, EDGES, "")), lambda t: t != "")


def whitespace_fix(x: Column | str) -> Column:
    """The text with runs of blanks as one and none before a mark; null if that changes nothing or there is no word."""
    x = c(x)
    fixed = F.regexp_replace(F.regexp_replace(x, "[ \t]{2,}", " "), "[ \t]+([,.;:!?])", "$1")
    return F.when(x.rlike(r"(?U)\w") & (fixed != x), fixed)


def sanitize_filename(x: Column | str) -> Column:
    """A name that every file system takes; `audiobook` if nothing is left."""
    plain = F.regexp_replace(c(x), r'[/\\:*?"<>|\p{C}]', "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit("")), F.lit("audiobook"))


def escape_ffmetadata(x: Column | str) -> Column:
    return F.regexp_replace(c(x), r"([\\=;#\n])", r"\\$1")


def without_fragment(x: Column | str) -> Column:
    """A link's file: what stands before its first `#`."""
    return F.substring_index(c(x), "#", 1)


def coerce_category(x: Column | str) -> Column:
    """A provider's word for a voice category; anything else is unknown."""
    known = fold(strip(x))
    return F.when(known.isin(*CATEGORIES), known).otherwise(F.lit("unknown"))


def review_status(confidence: Column | str, threshold: float = APPROVE_FROM) -> Column:
    return F.when(c(confidence) >= threshold, "approved").otherwise("needs_review")


def is_renderable(x: Column | str) -> Column:
    return F.coalesce(c(x).rlike(r"(?U)\S"), F.lit(False))


def is_rendered(status: Column | str) -> Column:
    return F.coalesce(c(status).isin(*RENDERED), F.lit(False))


def is_correction(reason: Column | str) -> Column:
    return F.coalesce(c(reason).isin(*CORRECTION_REASONS), F.lit(False))


def all_caps(x: Column | str) -> Column:
    return (F.upper(c(x)) == c(x)) & (F.lower(c(x)) != c(x))


def checkable(x: Column | str) -> Column:
    """Whether the spelling of a token is worth a look: three characters, no digit, not all capitals."""
    return (F.length(c(x)) >= 3) & ~c(x).rlike(r"(?U)\d") & ~all_caps(x)


def is_balanced(x: Column | str) -> Column:
    """Whether every quote mark is part of a closed pair."""
    return ~F.regexp_replace(c(x), QUOTED, "").rlike('["“”]')


def quote_spans(x: Column | str) -> Column:
    """array<struct<text, is_quote>>: quotes with their marks and the narration between, stripped; a line with an open quote is one
    narration; a blank line has none."""
    x = c(x)
    bare = F.transform(F.regexp_extract_all(x, F.lit(SPAN), F.lit(0)), lambda s: F.struct(F.when(s.rlike('^["“]'), s).otherwise(strip(s)).alias("text"), s.rlike('^["“]').alias("is_quote")))
    whole = F.array(F.struct(strip(x).alias("text"), F.lit(False).alias("is_quote")))
    return F.when(~is_renderable(x), F.filter(whole, lambda s: F.lit(False))).when(is_balanced(x), F.filter(bare, lambda s: s["text"] != "")).otherwise(whole)


def canonical_params(params: Mapping[str, object]) -> str:
    """JSON with sorted keys at every level, no blanks, letters as they are: the same bytes for the same settings."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def render_params(params: Mapping[str, object], seed: int | None) -> dict[str, object]:
    return dict(params) if seed is None else {**params, "seed": seed}


def cache_key(text: Column | str, clip_id: Column | str, params: Column | str, seed: Column | str) -> Column:
    """SHA-256 of what a rendering depends on."""
    zero = F.lit("\0")
    tail = F.when(c(seed).isNotNull(), F.concat(zero, F.lit("seed"), zero, c(seed).cast("string"))).otherwise("")
    return F.sha2(F.concat(c(text), zero, F.coalesce(c(clip_id), F.lit("")), zero, c(params), tail).cast("binary"), 256)


def audio_path(key: Column | str) -> Column:
    return F.concat(F.lit("audio/"), c(key), F.lit(".wav"))


def shortened(x: Column | str, most: int) -> Column:
    """At most `most` characters, the last of them an ellipsis where something was cut."""
    return F.when(F.length(c(x)) > most, F.concat(F.substring(c(x), 1, most - 1), F.lit("…"))).otherwise(c(x))


def progress_text(x: Column | str) -> Column:
    return F.substring(c(x), 1, 40)


def pcm16(x: Column | str) -> Column:
    """A sample in [-1, 1] as a 16-bit integer, cut towards zero and held within range."""
    return F.least(F.greatest((c(x) * 32767).cast("int"), F.lit(-32768)), F.lit(32767))


def milliseconds(seconds: Column | str) -> Column:
    """Rounded half to even."""
    return F.bround(c(seconds) * 1000).cast("long")


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded as a scaled number, half away from zero, as SQL engines do it; round() takes the number's shortest decimal form instead, and
    loses the sign of a zero."""
    scale = float(10**digits)
    return F.signum(c(x)) * F.abs(F.round(c(x) * scale)) / scale


def plural(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, "s").otherwise("")))


def describe_blockers(attributions: Column, suggestions: Column, voices: Column) -> Column:
    """One line on what still blocks the review. voices: array of names."""
    need = F.when(F.size(voices) > 0, F.concat(F.lit("voices needed for: "), F.array_join(voices, ", ")))
    said = F.concat_ws(", ", plural(attributions, "attribution"), plural(suggestions, "text suggestion"), need)
    return F.when(said == "", "review complete").otherwise(said)


def named_few(names: Column, most: int = 5) -> Column:
    """The first few of a list, and a sign that there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, " …").otherwise(""))
