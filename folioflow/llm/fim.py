r"""Fill-in-middle transformation in native Spark SQL: no Python code runs on the data.

A text is cut into units (runs of A-Z and a-z, and every other code point alone) by regexp_extract_all. Two 8-digit groups of a SHA-256
of seed and id, read by conv, give two cuts among the units; slice and array_join build prefix, middle and suffix, which sentinels
arrange as prefix-suffix-middle (psm) or suffix-prefix-middle (spm). Two more groups choose the form. restore() parses the sentinels and
gives the text back exactly: a text that holds a sentinel stays plain, and no sentinel can arise across a border, because a sentinel's
first character stands nowhere else in a sentinel.

Each row is computed on its own: nothing is shuffled, and a hot source or a group of copies costs what its rows cost. Rows that repeat
an id are cut by the same draws, each in its own text. A null text is an empty one; a null id hashes as the empty text. An empty text, or
one that holds a sentinel, is plain. A very long text makes one array of its units within its task: memory grows with the longest text.
Columns of docs pass through, but for those called like an output, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are rearranged, and of 100 of these, those in suffix-prefix-middle order.
REARRANGED, SUFFIX_FIRST = 90, 20
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Three different marks, none inside another, whose first characters occur nowhere else in any of them."""
    first = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or not all(sentinels) or any(c in s[1:] for s in sentinels for c in first) or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError(f"sentinels could be misread in a text: {sentinels}")


def draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits, from 1, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output (the rearranged text)."""
    check_sentinels(sentinels)
    keep = [c for c in docs.columns if c.lower() not in OUTPUTS]
    if not {text, key} <= set(keep):
        raise ValueError(f"text and key must not be called as an output is: {OUTPUTS}")
    p, s, m = map(F.lit, sentinels)
    units, digest, cuts, parts = (free_name(docs.columns, f"fim_{c}") for c in ("units", "digest", "cuts", "parts"))
    whole = F.coalesce(F.col(text), F.lit(""))
    held = whole == ""
    for mark in (p, s, m):
        held = held | F.contains(whole, mark)
    form = F.when(held | (draw(F.col(digest), 3) % 100 >= rearranged), "plain").when(draw(F.col(digest), 4) % 100 < suffix_first, "spm").otherwise("psm")
    at = [draw(F.col(digest), k) % (F.col("n") + 1) for k in (1, 2)]
    joined = lambda start, size: F.array_join(F.slice(units, start.cast("int"), size.cast("int")), "")
    a, b = F.col(cuts)["a"], F.col(cuts)["b"]
    bent = F.col("form") != "plain"
    pre, mid, suf = (F.col(parts)[x] for x in "pms")
    order = F.when(F.col("form") == "spm", F.concat(s, suf, p, pre, m, mid)).when(F.col("form") == "psm", F.concat(p, pre, s, suf, m, mid)).otherwise(whole)
    out = docs.select(*keep, F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)).alias(units), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256).alias(digest))
    out = out.select(*keep, units, digest, F.size(units).cast("long").alias("n"), form.alias("form"))
    out = out.withColumn(cuts, F.when(bent, F.struct(F.least(*at).alias("a"), F.greatest(*at).alias("b"))))
    out = out.withColumn(parts, F.when(bent, F.struct(joined(F.lit(1), a).alias("p"), joined(a + 1, b - a).alias("m"), joined(b + 1, F.col("n") - b).alias("s"))))
    return out.select(*keep, "n", "form", F.length(pre).cast("long").alias("prefix_chars"), F.length(mid).cast("long").alias("middle_chars"), order.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() rearranged, from its output and form alone."""
    check_sentinels(sentinels)
    p, s, m = sentinels
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle, rest = after(output, m), before(output, m)
    psm = F.concat(after(before(rest, s), p), middle, after(rest, s))
    spm = F.concat(after(rest, p), middle, after(before(rest, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT) FOR k IN [1, 2, 3, 4]] AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
