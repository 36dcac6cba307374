"""The library's operators as queries over the driver's tables, each with the SQL that gives the same rows.

A document is a chapter, its lines the text between line breaks, its source the book. A conversation is a chapter whose turns are lines
spoken by their role. The tables hold hardly any OCR faults, quotes or odd names, so queries on those put them in by a plain replace()
that both sides share. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import actions, attribute, correct, gate, render, resolve, segment, timeline, views, voice
from ..sources import audio, epub

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- what the queries start from -------------------------------------------------------------------------------------------------

LINES_SQL = """lines AS (SELECT source AS project_id, CAST(doc_id AS INTEGER) AS chapter_pos, CAST(i - 1 AS INTEGER) AS line_pos, s[i] AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def lines(spark: SparkSession, d: str, change=lambda t: t) -> DataFrame:
    docs = table(spark, d, "documents")
    cut = docs.select(F.col("source").alias("project_id"), F.col("doc_id").cast("int").alias("chapter_pos"), F.posexplode(F.split("text", "\n", -1)).alias("line_pos", "text"))
    return cut.withColumn("text", change(F.col("text")))


def rep(t, a: str, b: str):
    return F.replace(t, F.lit(a), F.lit(b))


TOKEN_SQL = r"regexp_extract_all({0}, '\p{{L}}+(?:[-''’]\p{{L}}+)*')"
OCR_SQL = r"regexp_extract_all({0}, '\p{{L}}+(?:''\p{{L}}+)*')"
SPELL_SQL = r"list_filter(list_transform(regexp_extract_all({0}, '[^\s\p{{Z}}]+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+$', '', 'g')), lambda t: t <> '')"

#: Letters beyond ASCII in the tables' words, each for a sign that no word holds: DuckDB's levenshtein counts bytes, Spark's characters.
_WIDE = ("ßäçèéêíñóöü’", "0123456789AB")


def distance_sql(a: str, b: str) -> str:
    one = lambda x: f"translate({x}, '{_WIDE[0]}', '{_WIDE[1]}')"
    return f"levenshtein({one(a)}, {one(b)})"


DICT_SQL = f"dict AS (SELECT lower(t) AS word, count(*) AS freq FROM (SELECT unnest({TOKEN_SQL.format('text')}) AS t FROM documents) GROUP BY 1 HAVING count(*) >= 3)"


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words that occur three times: the tables have no dictionary of their own."""
    each = table(spark, d, "documents").select(F.explode(X.tokens("text")).alias("t"))
    return each.groupBy(F.lower("t").alias("word")).agg(F.count(F.lit(1)).alias("freq")).filter("freq >= 3")


SEG_SQL = """segments AS (SELECT CAST(conv_id % 7 AS VARCHAR) AS project_id, CAST(conv_id AS INTEGER) AS chapter_pos, CAST(turn AS INTEGER) AS line_pos, 0 AS seg_pos,
    'g' || conv_id || '-' || turn AS segment_id, text, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS speaker_id, 'character' AS role, (turn % 10) / 10.0 AS confidence,
    CASE WHEN turn % 3 = 2 THEN 'needs_review' ELSE 'approved' END AS review_status, CASE WHEN turn % 4 = 3 THEN NULL ELSE 'k' || (conv_id % 50) END AS audio_cache_key,
    CASE WHEN turn % 6 = 5 THEN 'failed' WHEN turn % 2 = 1 THEN 'approved' ELSE 'completed' END AS audio_status, CASE WHEN turn % 8 = 1 THEN CAST(turn AS INTEGER) END AS audio_seed FROM conversations)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, d, "conversations").select(
        (conv % 7).cast("string").alias("project_id"), conv.cast("int").alias("chapter_pos"), turn.cast("int").alias("line_pos"), F.lit(0).alias("seg_pos"),
        F.concat(F.lit("g"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("segment_id"), "text", F.when(turn % 5 != 4, F.col("role")).alias("speaker_id"), F.lit("character").alias("role"), ((turn % 10) / 10.0).alias("confidence"),
        F.when(turn % 3 == 2, "needs_review").otherwise("approved").alias("review_status"), F.when(turn % 4 != 3, F.concat(F.lit("k"), (conv % 50).cast("string"))).alias("audio_cache_key"),
        F.when(turn % 6 == 5, "failed").when(turn % 2 == 1, "approved").otherwise("completed").alias("audio_status"), F.when(turn % 8 == 1, turn.cast("int")).alias("audio_seed"),
    )


#: A cast for each project: a narrator in all but the last, one speaker per role, one of them with a usable clip.
SPEAKER_ROWS = [("narrator", "narrator", "narrator", "clip0", "unknown"), ("user", "User", "character", "clip1", "woman"), ("assistant", "Assistant", "character", None, "man"), ("system", "System", "character", "clip9", "unknown")]
CLIP_ROWS = [("clip0", "/clips/n.wav", "narrator"), ("clip1", "/clips/u.wav", "user"), ("clip2", "/clips/gone.wav", "gone")]
FILES = ["/clips/n.wav", "/clips/u.wav"]


def _values(rows) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


CAST_SQL = f"""projects AS (SELECT CAST(p AS VARCHAR) AS project_id FROM range(0, 7) t(p)),
speakers AS (SELECT project_id, CAST(pos AS INTEGER) AS speaker_pos, speaker_id, name, role, voice_clip_id, category FROM projects,
  (VALUES {_values([(i, *r) for i, r in enumerate(SPEAKER_ROWS)])}) v(pos, speaker_id, name, role, voice_clip_id, category) WHERE NOT (project_id = '6' AND role = 'narrator')),
clips AS (SELECT project_id, voice_clip_id, source_path, label FROM projects, (VALUES {_values(CLIP_ROWS)}) v(voice_clip_id, source_path, label)),
files AS (SELECT * FROM (VALUES {_values([(f,) for f in FILES])}) v(path)),
narr AS (SELECT project_id, speaker_id AS narrator_id, name AS narrator_name FROM speakers WHERE role = 'narrator'),
eff AS (SELECT s.*, coalesce(s.speaker_id, n.narrator_id) AS effective_id FROM segments s LEFT JOIN narr n USING (project_id)),
paths AS (SELECT s.project_id, s.speaker_id, f.path AS clip_path FROM speakers s LEFT JOIN clips c ON s.project_id = c.project_id AND s.voice_clip_id = c.voice_clip_id LEFT JOIN files f ON c.source_path = f.path),
ref AS (SELECT project_id, effective_id AS speaker_id, min(row(chapter_pos, line_pos, seg_pos)) AS first FROM eff WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') AND effective_id IS NOT NULL GROUP BY ALL),
bare AS (SELECT r.* FROM ref r ANTI JOIN (SELECT * FROM paths WHERE clip_path IS NOT NULL) p USING (project_id, speaker_id))"""


def projects(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.col("id").cast("string").alias("project_id"))


def cast(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = projects(spark)
    who = spark.createDataFrame([(i, *r) for i, r in enumerate(SPEAKER_ROWS)], "speaker_pos int, speaker_id string, name string, role string, voice_clip_id string, category string")
    has = spark.createDataFrame([(i, *r) for i, r in enumerate(CLIP_ROWS)], "clip_pos int, voice_clip_id string, source_path string, label string")
    speakers = p.join(F.broadcast(who), ~((F.col("project_id") == "6") & (F.col("role") == "narrator"))).select("project_id", *who.columns)
    clips = p.join(F.broadcast(has), F.lit(True)).select("project_id", *has.columns)
    return speakers, clips, spark.createDataFrame([(f,) for f in FILES], "path string")


# --- text --------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT * FROM lines")
def parse_lines(spark, d):
    """Documents as parsed chapters of their sources, with the lines that book_tables makes of them."""
    docs = table(spark, d, "documents")
    books = docs.select(F.col("source").alias("project_id"), F.col("doc_id").cast("int").alias("chapter_pos"), F.lit("t").alias("chapter_title"), F.split("text", "\n", -1).alias("lines"))
    return epub.book_tables(books)[1].select("project_id", "chapter_pos", "line_pos", "text")


@query(f"SELECT doc_id, {TOKEN_SQL.format('text')} AS tokens FROM documents")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {OCR_SQL.format('text')} AS tokens FROM documents")
def ocr_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.ocr_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {SPELL_SQL.format('text')} AS tokens FROM documents")
def spell_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.spell_tokens("text").alias("tokens"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT project_id, unnest({TOKEN_SQL.format('text')}) AS t FROM lines)
SELECT project_id, lower(t) AS word FROM t WHERE regexp_matches(t, '^\\p{{Lu}}') GROUP BY 1, 2 HAVING count(*) >= 2""")
def protected_set(spark, d):
    return correct.protected_words(lines(spark, d))


@query(f"""WITH {LINES_SQL}, b AS (SELECT project_id, chapter_pos, line_pos, replace(text, ', ', ' ,  ') AS text FROM lines),
f AS (SELECT *, regexp_replace(regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([,.;:!?])', '\\1', 'g') AS suggested FROM b)
SELECT project_id, chapter_pos, line_pos, text AS original, suggested FROM f WHERE suggested <> text AND regexp_matches(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')""")
def whitespace_fix(spark, d):
    return correct.whitespace_candidates(lines(spark, d, lambda t: rep(t, ", ", " ,  "))).select(*correct.KEY, "original", "suggested")


@query(f"""WITH {LINES_SQL}, {DICT_SQL}, b AS (SELECT project_id, chapter_pos, line_pos, replace(text, 'tion', 'ti- on') AS text FROM lines),
m AS (SELECT project_id, chapter_pos, line_pos, unnest(regexp_extract_all(text, '\\p{{L}}+-(?:\\n| +)\\p{{L}}+')) AS original FROM b),
p AS (SELECT *, regexp_extract(original, '^(\\p{{L}}+)-', 1) AS l, regexp_extract(original, '(\\p{{L}}+)$', 1) AS r FROM m)
SELECT project_id, chapter_pos, line_pos, original, l || r AS suggested FROM p WHERE lower(l || r) IN (SELECT word FROM dict) AND NOT (lower(l) IN (SELECT word FROM dict) AND lower(r) IN (SELECT word FROM dict))""")
def dehyphenation(spark, d):
    return correct.dehyphenation_candidates(lines(spark, d, lambda t: rep(t, "tion", "ti- on")), dictionary(spark, d).select("word")).select(*correct.KEY, "original", "suggested")


_PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(correct.CONFUSIONS))


@query(f"""WITH {LINES_SQL}, {DICT_SQL}, b AS (SELECT project_id, chapter_pos, line_pos, replace(replace(text, 'nd', 'ncl'), 'in', 'ln') AS text FROM lines),
x AS (SELECT project_id, chapter_pos, line_pos, {OCR_SQL.format('text')} AS ts FROM b),
t AS (SELECT project_id, chapter_pos, line_pos, i AS pos, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM x)),
f AS (SELECT project_id, chapter_pos, line_pos, lower(token) AS word, arg_min(token, pos) AS token FROM t GROUP BY ALL),
u AS (SELECT * FROM f WHERE length(token) >= 3 AND word NOT IN (SELECT word FROM dict)),
c AS (SELECT u.*, rank, i, substr(token, 1, CAST(i - 1 AS BIGINT)) || b || substr(token, CAST(i + length(a) AS BIGINT)) AS fixed
      FROM (SELECT u.*, unnest(range(1, length(token) + 1)) AS i FROM u) u, (VALUES {_PAIRS}) p(rank, a, b)
      WHERE lower(substr(token, CAST(i AS BIGINT), length(a))) = a AND (length(token) >= 4 OR a NOT IN ('l', 'i')))
SELECT project_id, chapter_pos, line_pos, token AS original, arg_min(fixed, rank * 100000 + i) AS suggested FROM c WHERE lower(fixed) IN (SELECT word FROM dict) GROUP BY project_id, chapter_pos, line_pos, token""")
def confusion(spark, d):
    broken = lines(spark, d, lambda t: rep(rep(t, "nd", "ncl"), "in", "ln"))
    return correct.confusion_candidates(broken, dictionary(spark, d).select("word")).select(*correct.KEY, "original", "suggested")


@query(f"""WITH {DICT_SQL}, w AS (SELECT DISTINCT lower(t) AS word FROM (SELECT unnest({TOKEN_SQL.format('text')}) AS t FROM conversations)),
u AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM dict)),
n AS (SELECT u.word, g.word AS other, {distance_sql('u.word', 'g.word')} AS dist, freq FROM u JOIN dict g ON abs(length(u.word) - length(g.word)) <= 2 AND {distance_sql('u.word', 'g.word')} <= 2),
r AS (SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, other DESC) AS k FROM n)
SELECT word, other AS suggestion FROM r WHERE k = 1""")
def spell_correct(spark, d):
    words = table(spark, d, "conversations").select(F.explode(X.tokens("text")).alias("t")).select(F.lower("t").alias("word")).distinct()
    known = dictionary(spark, d)
    return correct.spelling_corrections(words.filter(F.length("word") >= 3).join(known, "word", "left_anti"), known)


@query(f"""WITH {LINES_SQL}, {DICT_SQL}, x AS (SELECT project_id, chapter_pos, line_pos, {SPELL_SQL.format('text')} AS ts FROM lines),
t AS (SELECT project_id, chapter_pos, line_pos, i AS pos, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM x)),
f AS (SELECT project_id, chapter_pos, line_pos, lower(token) AS word, arg_min(token, pos) AS token FROM t GROUP BY ALL)
SELECT project_id, chapter_pos, line_pos, token FROM f WHERE length(token) >= 3 AND NOT regexp_matches(token, '[0-9]') AND NOT (upper(token) = token AND lower(token) <> token) AND word NOT IN (SELECT word FROM dict)""")
def spell_candidates(spark, d):
    each = correct.first_tokens(lines(spark, d), X.spell_tokens).filter(X.checkable("token"))
    return correct.not_in(each, dictionary(spark, d).select("word"), ("word",)).select(*correct.KEY, "token")


@query()
def correct_lines(spark, d):
    """All correctors at once, and their fixes applied; ranks depend on a fold of case that SQL engines differ in."""
    broken = lines(spark, d, lambda t: rep(t, ", ", " ,  "))
    found = correct.candidates(broken, dictionary(spark, d), correct.protected_words(broken))
    return correct.apply_candidates(broken, found)[1]


_SPAN = """q AS (SELECT project_id, chapter_pos, line_pos, replace(replace(text, ', ', ', "'), '. ', '." ') AS text FROM lines),
b AS (SELECT *, NOT regexp_matches(regexp_replace(text, '"[^"]*"|“[^”]*”', '', 'g'), '["“”]') AS ok, regexp_matches(text, '[^\\s\\p{Z}]') AS said FROM q),
a AS (SELECT project_id, chapter_pos, line_pos, CASE WHEN NOT said THEN [] WHEN ok THEN regexp_extract_all(text, '"[^"]*"|“[^”]*”|[^"“”]+') ELSE [text] END AS raw, ok FROM b),
s AS (SELECT project_id, chapter_pos, line_pos, list_filter(list_transform(raw, lambda x: {'text': CASE WHEN ok AND regexp_matches(x, '^["“]') THEN x ELSE regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END, 'is_quote': ok AND regexp_matches(x, '^["“]')}), lambda y: y.text <> '') AS s FROM a),
spans AS (SELECT project_id, chapter_pos, line_pos, CAST(i - 1 AS INTEGER) AS seg_pos, s[i].text AS text, s[i].is_quote AS is_quote FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s))"""


def quoted(spark, d) -> DataFrame:
    return lines(spark, d, lambda t: rep(rep(t, ", ", ', "'), ". ", '." '))


@query(f"WITH {LINES_SQL}, {_SPAN} SELECT * FROM spans")
def quote_spans(spark, d):
    return segment.spans(quoted(spark, d))


@query(f"WITH {LINES_SQL}, {_SPAN} SELECT project_id, count(*) AS n_lines, count(*) FILTER (ok) AS n_balanced FROM b GROUP BY 1")
def balanced_lines(spark, d):
    return quoted(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(X.is_balanced("text")).alias("n_balanced"))


@query(f"""WITH {LINES_SQL}, {_SPAN} SELECT project_id, chapter_pos, line_pos, seg_pos, text, CASE WHEN NOT is_quote THEN 'n-' || project_id END AS speaker_id, CASE WHEN is_quote THEN 0.0 ELSE 1.0 END AS confidence,
CASE WHEN is_quote THEN 'needs_review' ELSE 'approved' END AS review_status FROM spans""")
def line_segments(spark, d):
    q = quoted(spark, d)
    narr = q.select("project_id").distinct().withColumn("narrator_id", F.concat(F.lit("n-"), "project_id"))
    return segment.line_segments(q, narr).select(*segment.KEY, "seg_pos", "text", "speaker_id", "confidence", "review_status")


@query(f"WITH {LINES_SQL} SELECT project_id, chapter_pos, line_pos, CAST(floor((row_number() OVER (PARTITION BY project_id, chapter_pos ORDER BY line_pos) - 1) / 60) AS INTEGER) AS \"window\" FROM lines")
def attribution_windows(spark, d):
    return attribute.windows(lines(spark, d)).select(*correct.KEY, "window")


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(url, ''), '[/\\\\:*?"<>|\\p{C}]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')), ''), 'audiobook') || '.m4b' AS file_name FROM pages""")
def sanitize_filename(spark, d):
    return table(spark, d, "pages").select("page_id", timeline.output_name(F.coalesce("url", F.lit(""))).alias("file_name"))


@query(r"SELECT page_id, regexp_replace(url, '([\\=;#\n])', '\\\1', 'g') AS escaped, CASE WHEN length(url) > 30 THEN substr(url, 1, 29) || '…' ELSE url END AS short, split_part(url, '#', 1) AS plain FROM pages")
def escape_ffmetadata(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_ffmetadata("url").alias("escaped"), X.shortened("url", 30).alias("short"), X.without_fragment("url").alias("plain"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Label ' || doc_id WHEN doc_id % 3 = 1 AND trim(split_part(text, chr(10), 1)) <> '' THEN trim(split_part(text, chr(10), 1)) ELSE 'Chapter ' || (doc_id + 1) END AS title FROM documents")
def chapter_title_fallback(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", epub.chapter_title(F.when(i % 3 == 0, F.concat(F.lit("Label "), i.cast("string"))), F.when(i % 3 == 1, F.element_at(F.split("text", "\n", -1), 1)), F.lit(" "), i + 1).alias("title"))


@query()
def page_lines(spark, d):
    return epub.page_lines(table(spark, d, "pages").select("page_id", "html")).select("page_id", "heading", F.posexplode_outer("lines").alias("line_pos", "text"))


# --- speakers and voices ------------------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT CAST(conv_id % 7 AS VARCHAR) AS project_id, conv_id * 100000 + turn AS pos, CASE WHEN turn % 6 = 0 THEN NULL ELSE upper(substr(text, 1, 2)) || lower(substr(text, 3, 1)) END AS name FROM conversations),
{SEG_SQL}, {CAST_SQL}, n AS (SELECT project_id, lower(name) AS folded, arg_min(name, pos) AS name, min(pos) AS first FROM m WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM speakers) GROUP BY 1, 2)
SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY first, folded) - 1 + (SELECT max(speaker_pos) + 1 FROM speakers s WHERE s.project_id = n.project_id) AS speaker_pos FROM n""")
def speaker_resolution(spark, d):
    turn = F.col("turn")
    name = F.when(turn % 6 != 0, F.concat(X.upper(F.substring("text", 1, 2)), F.lower(F.substring("text", 3, 1))))
    m = table(spark, d, "conversations").select((F.col("conv_id") % 7).cast("string").alias("project_id"), (F.col("conv_id") * 100000 + turn).alias("pos"), name.alias("name"))
    speakers, _, _ = cast(spark)
    _, every = resolve.resolve_names(m, speakers)
    return every.join(speakers, ["project_id", "speaker_id"], "left_anti").select("project_id", "name", F.col("speaker_pos").cast("long").alias("speaker_pos"))


@query(f"WITH {SEG_SQL}, {CAST_SQL} SELECT project_id, speaker_id, first[1] AS chapter_pos, first[2] AS line_pos, row_number() OVER (PARTITION BY project_id ORDER BY first) AS place FROM ref".replace("first[1]", "struct_extract_at(first, 1)").replace("first[2]", "struct_extract_at(first, 2)"))
def first_seen_speakers(spark, d):
    speakers, _, _ = cast(spark)
    from pyspark.sql import Window

    seen = resolve.referenced(segments(spark, d), speakers)
    return seen.select("project_id", "speaker_id", "first.chapter_pos", "first.line_pos", F.row_number().over(Window.partitionBy("project_id").orderBy("first")).cast("long").alias("place"))


@query(f"""WITH {SEG_SQL}, {CAST_SQL} SELECT e.segment_id, effective_id, CASE WHEN e.speaker_id IS NULL THEN coalesce(n.narrator_name, 'narrator') || ' (auto)' ELSE coalesce(s.name, '<unknown>') END AS speaker_display
FROM eff e LEFT JOIN narr n USING (project_id) LEFT JOIN speakers s ON s.project_id = e.project_id AND s.speaker_id = e.speaker_id""")
def effective_speakers(spark, d):
    speakers, _, _ = cast(spark)
    return resolve.display(resolve.effective(segments(spark, d), speakers), speakers).select("segment_id", "effective_id", "speaker_display")


_SAMPLE = f"{SEG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, speaker_id ORDER BY chapter_pos, line_pos) AS k FROM segments WHERE speaker_id IS NOT NULL AND regexp_matches(text, '[^\\s\\p{{Z}}]'))"


@query(f"WITH {_SAMPLE} SELECT project_id, speaker_id, list(trim(text) ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY ALL")
def speaker_samples(spark, d):
    return attribute.speaker_samples(segments(spark, d))


@query(f"""WITH {_SAMPLE}, {CAST_SQL}, x AS (SELECT project_id, speaker_id, string_agg(trim(text), ' ' ORDER BY k) AS said FROM r WHERE k <= 3 GROUP BY ALL)
SELECT project_id, 'Classify each speaker''s voice category. Speakers:' || chr(10) || string_agg('[' || speaker_id || '] ' || name || CASE WHEN coalesce(said, '') = '' THEN ' — (no sample lines)' ELSE ' — sample lines: ' || said END, chr(10) ORDER BY speaker_pos) || chr(10) || 'Return one entry per speaker_id.' AS prompt
FROM speakers LEFT JOIN x USING (project_id, speaker_id) WHERE role = 'character' AND category = 'unknown' GROUP BY project_id""")
def classify_prompts(spark, d):
    speakers, _, _ = cast(spark)
    return attribute.classify_prompts(speakers, attribute.speaker_samples(segments(spark, d))).select("project_id", "prompt")


@query(f"""WITH {SEG_SQL}, w AS (SELECT project_id, segment_id FROM segments WHERE review_status = 'needs_review'),
r AS (SELECT project_id, segment_id, role AS who, confidence, line_pos FROM (SELECT *, speaker_id AS r FROM segments) WHERE line_pos % 2 = 0)
SELECT w.project_id, w.segment_id, r.who AS name, coalesce(r.confidence, 0.0) AS confidence, coalesce(CASE WHEN r.confidence >= 0.75 THEN 'approved' ELSE 'needs_review' END, 'needs_review') AS status, r.segment_id IS NOT NULL AS answered
FROM w LEFT JOIN r ON w.project_id = r.project_id AND w.segment_id = r.segment_id""")
def candidate_defaulting(spark, d):
    s = segments(spark, d)
    results = s.filter("line_pos % 2 = 0").select("project_id", "segment_id", F.col("role").alias("speaker"), "confidence", F.col("line_pos").alias("seq"))
    out = attribute.with_defaults(s.filter("review_status = 'needs_review'").select("project_id", "segment_id"), results)
    return out.withColumn("status", X.review_status("confidence"))


@query(f"""WITH {SEG_SQL}, t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY project_id, chapter_pos ORDER BY line_pos) - 1) / 60) AS INTEGER) AS w FROM segments),
x AS (SELECT project_id, chapter_pos, w, row_number() OVER (PARTITION BY project_id, chapter_pos, w ORDER BY line_pos) AS k, CASE WHEN review_status = 'needs_review' THEN '[SEG ' || segment_id || '] ' || text ELSE text END AS tagged, CASE WHEN review_status = 'needs_review' THEN segment_id END AS seg, line_pos FROM t)
SELECT project_id, chapter_pos, w AS "window", 'Attribute each marked quote to its speaker. Lines:' || chr(10) || string_agg('L' || k || ': ' || tagged, chr(10) ORDER BY k) || chr(10) || 'Return one entry per SEG id.' AS context,
list(seg ORDER BY line_pos) FILTER (seg IS NOT NULL) AS candidates FROM x GROUP BY ALL HAVING count(seg) > 0""")
def attribution_contexts(spark, d):
    s = segments(spark, d)
    return attribute.contexts(s, s.select(*segment.KEY, "text"))


_VOICES = """lost AS (SELECT DISTINCT s.project_id FROM segments s ANTI JOIN narr USING (project_id) WHERE s.speaker_id IS NULL AND regexp_matches(text, '[^\\s\\p{Z}]')),
voices AS (SELECT project_id, name, min(first) AS first FROM (SELECT b.project_id, coalesce(s.name, b.speaker_id) AS name, b.first FROM bare b LEFT JOIN speakers s USING (project_id, speaker_id)
  UNION ALL SELECT project_id, 'narrator', row(2147483647, 2147483647, 2147483647) FROM lost) GROUP BY 1, 2)"""


@query(f"WITH {SEG_SQL}, {CAST_SQL}, {_VOICES} SELECT project_id, name FROM voices")
def unresolved_voices(spark, d):
    return voice.unresolved_voices(segments(spark, d), *cast(spark)).select("project_id", "name")


@query(f"WITH {SEG_SQL}, {CAST_SQL} SELECT s.project_id, s.speaker_id, s.name FROM bare JOIN speakers s USING (project_id, speaker_id)")
def unresolved_speakers(spark, d):
    return voice.unresolved_speakers(segments(spark, d), *cast(spark)).select("project_id", "speaker_id", "name")


@query(f"""WITH {SEG_SQL}, {CAST_SQL} SELECT s.project_id, s.speaker_pos, s.speaker_id, s.name, s.role, s.category, c.label AS clip_label, c.source_path AS clip_path, r.speaker_id IS NOT NULL AS is_referenced, b.speaker_id IS NOT NULL AS needs_voice, c.source_path IS NOT NULL AND f.path IS NULL AS clip_file_missing
FROM speakers s LEFT JOIN clips c ON c.project_id = s.project_id AND c.voice_clip_id = s.voice_clip_id LEFT JOIN files f ON f.path = c.source_path LEFT JOIN ref r ON r.project_id = s.project_id AND r.speaker_id = s.speaker_id LEFT JOIN bare b ON b.project_id = s.project_id AND b.speaker_id = s.speaker_id""")
def voice_rows(spark, d):
    return voice.voice_rows(segments(spark, d), *cast(spark))


OVERRIDES, DEFAULTS = {"man": "/clips/m.wav", "woman": ""}, {"woman": "/clips/w.wav", "girl": "/clips/g.wav"}


@query(f"""WITH {SEG_SQL}, {CAST_SQL}, t AS (SELECT s.project_id, s.category, s.name, CASE s.category WHEN 'man' THEN '/clips/m.wav' WHEN 'woman' THEN '/clips/w.wav' WHEN 'girl' THEN '/clips/g.wav' END AS clip_path FROM bare JOIN speakers s USING (project_id, speaker_id))
SELECT project_id, category, clip_path, count(*) AS n FROM t GROUP BY ALL""")
def bulk_voice_plan(spark, d):
    plan = voice.bulk_plan(voice.unresolved_speakers(segments(spark, d), *cast(spark)), OVERRIDES, DEFAULTS)
    return plan.groupBy("project_id", "category", "clip_path").agg(F.count(F.lit(1)).alias("n"))


# --- review, rendering, timeline ----------------------------------------------------------------------------------------------------

_SUGGEST = """suggestions AS (SELECT CAST(doc_id % 7 AS VARCHAR) AS project_id, CAST(doc_id AS INTEGER) AS chapter_pos, 0 AS line_pos, 0 AS sug_pos, 's' || doc_id AS suggestion_id, CASE WHEN quality = 0 THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS status FROM labels)"""


def suggestions(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select((i % 7).cast("string").alias("project_id"), i.cast("int").alias("chapter_pos"), F.lit(0).alias("line_pos"), F.lit(0).alias("sug_pos"), F.concat(F.lit("s"), i.cast("string")).alias("suggestion_id"), F.when(F.col("quality") == 0, "pending").when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("status"))


_BLOCK = f"""{SEG_SQL}, {CAST_SQL}, {_VOICES}, {_SUGGEST}, a AS (SELECT project_id, list(segment_id ORDER BY chapter_pos, line_pos, seg_pos) AS x FROM segments WHERE review_status = 'needs_review' GROUP BY 1),
g AS (SELECT project_id, list(suggestion_id ORDER BY chapter_pos) AS x FROM suggestions WHERE status = 'pending' GROUP BY 1), v AS (SELECT project_id, list(name ORDER BY first, name) AS x FROM voices GROUP BY 1),
blockers AS (SELECT p.project_id, coalesce(a.x, []) AS needs_attribution, coalesce(g.x, []) AS pending_suggestions, coalesce(v.x, []) AS unassigned_voices FROM projects p LEFT JOIN a USING (project_id) LEFT JOIN g USING (project_id) LEFT JOIN v USING (project_id))"""


def blocked(spark, d) -> DataFrame:
    speakers, clips, files = cast(spark)
    return gate.project_blockers(segments(spark, d), suggestions(spark, d), speakers, clips, files, projects(spark))


@query(f"WITH {_BLOCK} SELECT * FROM blockers")
def review_blockers(spark, d):
    return blocked(spark, d)


@query(f"""WITH {_BLOCK}, n AS (SELECT project_id, CAST(len(needs_attribution) AS INTEGER) AS n_attributions, CAST(len(pending_suggestions) AS INTEGER) AS n_suggestions, CAST(len(unassigned_voices) AS INTEGER) AS n_voices, unassigned_voices FROM blockers)
SELECT project_id, n_attributions, n_suggestions, n_voices, n_attributions + n_suggestions + n_voices = 0 AS complete, coalesce(nullif(concat_ws(', ', CASE WHEN n_attributions > 0 THEN n_attributions || ' attribution' || CASE WHEN n_attributions <> 1 THEN 's' ELSE '' END END,
CASE WHEN n_suggestions > 0 THEN n_suggestions || ' text suggestion' || CASE WHEN n_suggestions <> 1 THEN 's' ELSE '' END END, CASE WHEN n_voices > 0 THEN 'voices needed for: ' || array_to_string(unassigned_voices, ', ') END), ''), 'review complete') AS summary FROM n""")
def gate_summary(spark, d):
    speakers, clips, files = cast(spark)
    return gate.review_state(segments(spark, d), suggestions(spark, d), speakers, clips, files, projects(spark))


PARAMS = X.canonical_params({"seed": 7, "exaggeration": 0.5})
_KEYS = f"""{SEG_SQL}, {CAST_SQL}, keyed AS (SELECT e.*, sha256(text || chr(0) || coalesce(s.voice_clip_id, '') || chr(0) || '{PARAMS}' || CASE WHEN audio_seed IS NOT NULL THEN chr(0) || 'seed' || chr(0) || audio_seed ELSE '' END) AS key
FROM eff e LEFT JOIN speakers s ON s.project_id = e.project_id AND s.speaker_id = e.effective_id)"""


def params(spark) -> DataFrame:
    return projects(spark).withColumn("params", F.lit(PARAMS))


@query(f"WITH {_KEYS} SELECT segment_id, effective_id, key FROM keyed")
def cache_keys(spark, d):
    return render.with_keys(segments(spark, d), cast(spark)[0], params(spark)).select("segment_id", "effective_id", "key")


def stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Segments whose even lines hold the key they ought to have, and the files there are: those of lines not divisible by three."""
    s = segments(spark, d)
    keyed = render.with_keys(s, cast(spark)[0], params(spark)).withColumn("audio_cache_key", F.when(F.col("line_pos") % 2 == 0, F.col("key")).otherwise(F.col("audio_cache_key")))
    return keyed.select(*s.columns), keyed.filter("line_pos % 3 <> 0").select(F.col("key").alias("cache_key")).distinct()


_WORK = f"""{_KEYS}, st AS (SELECT * EXCLUDE (audio_cache_key, key), CASE WHEN line_pos % 2 = 0 THEN key ELSE audio_cache_key END AS audio_cache_key, key FROM keyed), af AS (SELECT DISTINCT key AS cache_key FROM keyed WHERE line_pos % 3 <> 0),
work AS (SELECT * FROM st WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') AND NOT coalesce(audio_cache_key = key AND audio_status IN ('completed', 'approved') AND audio_cache_key IN (SELECT cache_key FROM af), false))"""


@query(f"WITH {_WORK} SELECT segment_id, key FROM work")
def render_worklist(spark, d):
    s, files = stored(spark, d)
    return render.worklist(s, cast(spark)[0], params(spark), files).select("segment_id", "key")


@query(f"WITH {_WORK} SELECT w.key, min(w.text) AS text, min(p.clip_path) AS clip_path FROM work w JOIN paths p ON p.project_id = w.project_id AND p.speaker_id = w.effective_id WHERE clip_path IS NOT NULL GROUP BY w.key")
def key_dedup(spark, d):
    s, files = stored(spark, d)
    speakers, clips, there = cast(spark)
    return render.distinct_work(render.worklist(s, speakers, params(spark), files), voice.clip_paths(speakers, clips, there)).select("key", "text", "clip_path")


@query(f"WITH {_WORK} SELECT segment_id FROM st WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') AND NOT (audio_cache_key IS NOT NULL AND audio_status IN ('completed', 'approved') AND audio_cache_key IN (SELECT cache_key FROM af))")
def unrendered(spark, d):
    s, files = stored(spark, d)
    return render.unrendered(s, files).select("segment_id")


CHAPTERS_SQL = """chapters AS (SELECT project_id, chapter_pos, 'Talk = ' || chapter_pos AS title FROM segments GROUP BY 1, 2 UNION ALL SELECT project_id, 1000000000, 'The end; #' FROM segments GROUP BY 1),
timed AS (SELECT *, length(text) * 0.064 AS duration FROM segments)"""


def chapters(spark, d) -> DataFrame:
    s = segments(spark, d)
    last = s.select("project_id").distinct().select("project_id", F.lit(1000000000).alias("chapter_pos"), F.lit("The end; #").alias("title"))
    return s.select("project_id", "chapter_pos").distinct().withColumn("title", F.concat(F.lit("Talk = "), F.col("chapter_pos").cast("string"))).unionByName(last)


def timed(spark, d) -> DataFrame:
    return segments(spark, d).withColumn("duration", F.length("text") * 0.064)


_TIME = f"""{SEG_SQL}, {CHAPTERS_SQL}, l AS (SELECT project_id, chapter_pos, sum(duration) + (count(DISTINCT line_pos) - 1) * 0.4 AS length FROM timed WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') GROUP BY 1, 2),
c AS (SELECT c.*, coalesce(l.length, 0) AS length, l.length IS NOT NULL AS spoken FROM chapters c LEFT JOIN l USING (project_id, chapter_pos)),
h AS (SELECT *, max(CAST(spoken AS INTEGER)) OVER (PARTITION BY project_id ORDER BY chapter_pos) > 0 AS heard, lead(chapter_pos) OVER (PARTITION BY project_id ORDER BY chapter_pos) IS NULL AS last FROM c),
marks AS (SELECT project_id, chapter_pos, title, coalesce(sum(length + CASE WHEN heard AND NOT last THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY project_id ORDER BY chapter_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_s, length FROM h)"""


def markers(spark, d) -> DataFrame:
    return timeline.chapter_markers(timeline.chapter_lengths(chapters(spark, d), timed(spark, d)))


@query(f"WITH {_TIME} SELECT project_id, chapter_pos, CAST(round(start_s, 4) AS DOUBLE) AS start_s, CAST(round(start_s + length, 4) AS DOUBLE) AS end_s FROM marks")
def chapter_timeline(spark, d):
    return markers(spark, d).select("project_id", "chapter_pos", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


_ESC = r"regexp_replace({0}, '([\\=;#\n])', '\\\1', 'g')"


@query(f"""WITH {_TIME} SELECT project_id, ';FFMETADATA1' || chr(10) || 'title=Book ' || project_id || chr(10) || 'artist=A\\;B' || chr(10) || 'album=Book ' || project_id || chr(10) ||
string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(round_even(round(start_s, 4) * 1000, 0) AS BIGINT) || chr(10) || 'END=' || CAST(round_even(round(start_s + length, 4) * 1000, 0) AS BIGINT) || chr(10) || 'title=' || {_ESC.format('title')}, chr(10) ORDER BY chapter_pos) || chr(10) AS metadata FROM marks GROUP BY project_id""")
def ffmetadata(spark, d):
    books = projects(spark).withColumns({"title": F.concat(F.lit("Book "), "project_id"), "author": F.lit("A;B")})
    m = markers(spark, d).withColumns({"start_s": F.round("start_s", 4), "end_s": F.round("end_s", 4)})
    return timeline.ffmetadata(m, books.join(m.select("project_id").distinct(), "project_id"))


@query(f"""WITH {SEG_SQL}, said AS (SELECT *, row_number() OVER (PARTITION BY project_id, chapter_pos ORDER BY line_pos) AS n FROM segments WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')), {CHAPTERS_SQL.split("),", 1)[0]}),
p AS (SELECT project_id, chapter_pos, line_pos, 1 AS part, '/a/it''s ' || segment_id || '.wav' AS path FROM said UNION ALL SELECT project_id, chapter_pos, line_pos, 0, '/a/silence_0400ms.wav' FROM said WHERE n > 1
  UNION ALL SELECT c.project_id, c.chapter_pos, 2147483647, 2, '/a/silence_1000ms.wav' FROM chapters c JOIN (SELECT project_id, min(chapter_pos) AS f FROM said GROUP BY 1) x USING (project_id) WHERE c.chapter_pos >= f AND c.chapter_pos < 1000000000)
SELECT project_id, string_agg('file ''' || replace(path, '''', '''\\''''') || '''', chr(10) ORDER BY chapter_pos, line_pos, part) || chr(10) AS listing FROM p GROUP BY 1""")
def concat_manifest(spark, d):
    s = segments(spark, d).withColumns({"path": F.concat(F.lit("/a/it's "), "segment_id", F.lit(".wav")), "line_silence": F.lit("/a/silence_0400ms.wav"), "chapter_silence": F.lit("/a/silence_1000ms.wav")})
    return timeline.concat_list(timeline.playlist(s, chapters(spark, d)))


@query(f"""WITH {SEG_SQL}, {CAST_SQL} SELECT project_id, count(*) AS total, count(*) FILTER (review_status = 'needs_review') AS needs_review, count(*) FILTER (audio_status = 'approved') AS approved,
count(*) FILTER (audio_status IN ('completed', 'approved')) AS rendered, CASE WHEN count(*) FILTER (audio_status = 'failed') > 0 AND count(*) FILTER (audio_status IN ('completed', 'approved')) = 0 THEN 'failed' ELSE 'completed' END AS status FROM segments GROUP BY 1""")
def segment_counts(spark, d):
    s = segments(spark, d)
    rows = s.withColumns({"is_open": F.col("review_status") == "needs_review", "is_approved": F.col("audio_status") == "approved", "is_done": X.is_rendered("audio_status"), "any": F.lit(True)})
    return views.counts(rows, total="any", needs_review="is_open", approved="is_approved", rendered="is_done").join(render.outcome(s).select("project_id", "status"), "project_id")


def placed(spark, d) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, d)
    return s.select("project_id", "chapter_pos").distinct().select("project_id", "chapter_pos", (F.col("chapter_pos") + 1).alias("order"), F.concat(F.lit("Talk "), F.col("chapter_pos").cast("string")).alias("title")), s.select("project_id", "chapter_pos", "line_pos", F.col("line_pos").alias("order"), "text", F.col("segment_id").alias("line_id"))


@query(f"""WITH {SEG_SQL}, {CAST_SQL} SELECT e.segment_id, e.chapter_pos + 1 AS chapter_index, 'Talk ' || e.chapter_pos AS chapter_title, e.line_pos AS line_order, CASE WHEN e.speaker_id IS NULL THEN coalesce(n.narrator_name, 'narrator') || ' (auto)' ELSE coalesce(s.name, '<unknown>') END AS speaker_display,
review_status = 'needs_review' AS needs_review, e.speaker_id IS NULL AS is_narrator_fallback FROM eff e LEFT JOIN narr n USING (project_id) LEFT JOIN speakers s ON s.project_id = e.project_id AND s.speaker_id = e.speaker_id""")
def segment_rows(spark, d):
    return views.segment_rows(segments(spark, d), cast(spark)[0], *placed(spark, d)).select("segment_id", "chapter_index", "chapter_title", "line_order", "speaker_display", "needs_review", "is_narrator_fallback")


@query(f"""WITH {_WORK} SELECT segment_id, audio_status = 'approved' AS is_approved, audio_status = 'failed' AS is_failed, audio_status IN ('completed', 'approved') AS is_rendered, audio_cache_key IN (SELECT cache_key FROM af) IS TRUE AS is_playable,
CASE WHEN audio_cache_key IN (SELECT cache_key FROM af) THEN 'audio/' || audio_cache_key || '.wav' END AS wav_path FROM st WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')""")
def audio_rows(spark, d):
    s, files = stored(spark, d)
    return views.audio_rows(s.filter(X.is_renderable("text")), cast(spark)[0], *placed(spark, d), files).select("segment_id", "is_approved", "is_failed", "is_rendered", "is_playable", "wav_path")


@query(f"""WITH {SEG_SQL}, f AS (SELECT *, CASE WHEN review_status = 'needs_review' THEN segment_id END AS hit FROM segments)
SELECT segment_id, coalesce(first(hit IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY chapter_pos, line_pos, seg_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), first(hit IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY chapter_pos, line_pos, seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_flagged,
coalesce(last(hit IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY chapter_pos, line_pos, seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last(hit IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY chapter_pos, line_pos, seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_flagged FROM f""")
def next_flagged(spark, d):
    s = segments(spark, d).withColumn("flag", F.col("review_status") == "needs_review")
    return views.flagged_neighbours(s, "flag", "segment_id", ("chapter_pos", "line_pos", "seg_pos")).select("segment_id", "next_flagged", "prev_flagged")


_STAGE = """pr AS (SELECT user_id, max(event_id) % 7 AS done FROM events GROUP BY 1), st AS (SELECT * FROM (VALUES (0, 'parse'), (1, 'correct'), (2, 'attribute'), (3, 'review'), (4, 'synthesize'), (5, 'assemble')) v(stage_pos, stage))"""


def progress(spark, d) -> DataFrame:
    done = F.col("done")
    names = F.array(*map(F.lit, gate.STAGES))
    p = table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") % 7).alias("done"))
    return p.select(F.col("user_id").cast("string").alias("project_id"), F.map_from_arrays(F.slice(names, 1, done.cast("int")), F.array_repeat(F.lit("completed"), done.cast("int"))).alias("stage_status"))


@query(f"WITH {_STAGE} SELECT CAST(user_id AS VARCHAR) AS project_id, stage, CASE WHEN stage_pos < done THEN 'completed' ELSE 'pending' END AS status, stage_pos = done AS is_next FROM pr, st")
def stage_progress(spark, d):
    return gate.stage_rows(progress(spark, d)).select("project_id", "stage", "status", "is_next")


@query(f"WITH {_STAGE} SELECT CAST(user_id AS VARCHAR) AS project_id, (SELECT stage FROM st WHERE stage_pos = done) AS next_stage FROM pr")
def next_stage(spark, d):
    return gate.next_stage(progress(spark, d))


# --- actions ----------------------------------------------------------------------------------------------------------------------------


def offered(spark, d) -> DataFrame:
    """A suggestion for each turn: its second word in capitals."""
    s = segments(spark, d)
    word = F.element_at(F.split("text", " ", -1), 1)
    return s.select(*segment.KEY, F.lit(0).alias("sug_pos"), F.col("segment_id").alias("suggestion_id"), word.alias("original"), F.concat(X.upper(word), F.lit("!")).alias("suggested"), F.lit("spellcheck").alias("reason"), F.lit(0.7).alias("confidence"), F.lit("pending").alias("status"))


@query(f"""WITH {SEG_SQL}, o AS (SELECT *, split_part(text, ' ', 1) AS original, line_pos % 2 = 0 AS hit FROM segments)
SELECT segment_id, CASE WHEN hit AND original <> '' THEN upper(original) || '!' || substr(text, length(original) + 1) ELSE text END AS text, CASE WHEN hit AND original <> '' THEN NULL ELSE audio_cache_key END AS audio_cache_key, CASE WHEN hit AND original <> '' THEN 'pending' ELSE audio_status END AS audio_status FROM o""")
def accept_suggestion(spark, d):
    s, o = segments(spark, d), offered(spark, d)
    chosen = o.filter("line_pos % 2 = 0").select("suggestion_id")
    return actions.accept_suggestions(o, s.select(*segment.KEY, "text"), s, chosen)[2].select("segment_id", "text", "audio_cache_key", "audio_status")


@query(f"""WITH {SEG_SQL} SELECT project_id, chapter_pos, line_pos, seg_pos, text, review_status, speaker_id FROM (SELECT project_id, chapter_pos, line_pos, seg_pos, text, review_status, speaker_id FROM segments WHERE line_pos % 2 = 1
UNION ALL SELECT project_id, chapter_pos, line_pos, 0, 'She said:', 'approved', CASE WHEN project_id <> '6' THEN 'narrator' END FROM segments WHERE line_pos % 2 = 0
UNION ALL SELECT project_id, chapter_pos, line_pos, 1, '"No."', 'needs_review', NULL FROM segments WHERE line_pos % 2 = 0)""")
def edit_line(spark, d):
    s = segments(spark, d)
    ln = s.select(*segment.KEY, F.col("segment_id").alias("line_id"), "text")
    edits = ln.filter("line_pos % 2 = 0").select("line_id", F.lit('She said: "No."').alias("new_text"))
    return actions.edit_lines(ln, s, edits, resolve.narrators(cast(spark)[0]))[1].select(*segment.KEY, "seg_pos", "text", "review_status", "speaker_id")


@query(f"WITH {SEG_SQL} SELECT segment_id, 'approved' AS review_status FROM segments")
def auto_accept(spark, d):
    return actions.auto_accept(segments(spark, d), offered(spark, d))[0].select("segment_id", "review_status")


@query(f"WITH {SEG_SQL} SELECT segment_id, CASE WHEN line_pos % 3 = 0 THEN 42 ELSE audio_seed END AS audio_seed, CASE WHEN line_pos % 3 = 0 THEN NULL ELSE audio_cache_key END AS audio_cache_key, CASE WHEN line_pos % 3 = 0 THEN 'pending' ELSE audio_status END AS audio_status FROM segments")
def reroll(spark, d):
    s = segments(spark, d)
    return actions.reroll_audio(s, s.filter("line_pos % 3 = 0").select("segment_id"), 42).select("segment_id", "audio_seed", "audio_cache_key", "audio_status")


# --- sound --------------------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda s: CAST(s AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, list_max(list_transform(v, lambda s: abs(s))) AS peak, sqrt(list_dot_product(v, v) / len(v)) AS rms FROM x)
SELECT vec_id, round(peak, 6) AS peak, round(CASE WHEN peak <= 0.0001 THEN 0.0 ELSE least(-18.0 - 20 * log10(rms), 30.0) END, 6) AS gain_db FROM m""")
def loudness_gain(spark, d):
    """Vectors as sounds too short for gating: their RMS tells."""
    made = audio.measured(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples")), 16000)
    return made.select("vec_id", X.rounded("peak", 6).alias("peak"), X.rounded("gain_db", 6).alias("gain_db"))


def _filter_sql(name: str, of: str, b: list[float], a: list[float]) -> str:
    """A second-order filter sample by sample, all sounds side by side."""
    n = [f"CAST('{float(v)!r}' AS DOUBLE)" for v in (*b, *a[1:])]
    return f"""{name} AS (SELECT sound, i, x AS x1, CAST(0 AS DOUBLE) AS x2, {n[0]} * x AS y1, CAST(0 AS DOUBLE) AS y2 FROM {of} WHERE i = 0
UNION ALL SELECT s.sound, s.i, s.x, f.x1, {n[0]} * s.x + {n[1]} * f.x1 + {n[2]} * f.x2 - {n[3]} * f.y1 - {n[4]} * f.y2, f.y1 FROM {name} f JOIN {of} s ON s.sound = f.sound AND s.i = f.i + 1)"""


#: Sounds of 100 vectors at 8000 Hz: 0.8 s, five blocks of gating. Every tenth vector is all but silent, so that gates have work to do.
_SOUND_RATE, _SOUND_VECTORS = 8000, 100


@query(f"""WITH RECURSIVE v AS (SELECT vec_id // {_SOUND_VECTORS} AS sound, vec_id, CASE WHEN vec_id % {_SOUND_VECTORS} >= 60 THEN 0.001 ELSE 1.0 END AS f, embedding FROM embeddings),
u AS (SELECT sound, vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS k, f FROM v),
s AS MATERIALIZED (SELECT sound, row_number() OVER (PARTITION BY sound ORDER BY vec_id, k) - 1 AS i, CAST(e AS DOUBLE) * f AS x FROM u),
{_filter_sql("f1", "s", *audio._shelf(_SOUND_RATE))}, t AS MATERIALIZED (SELECT sound, i, y1 AS x FROM f1), {_filter_sql("f2", "t", *audio._high_pass(_SOUND_RATE))},
n AS (SELECT sound, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM s GROUP BY 1),
k AS (SELECT sound, n, unnest(range(0, n - 3200 + 1, 800)) AS start FROM n WHERE n >= 3200),
p AS (SELECT k.sound, k.start, avg(f2.y1 * f2.y1) AS p FROM k JOIN f2 ON f2.sound = k.sound AND f2.i >= k.start AND f2.i < k.start + 3200 GROUP BY ALL),
g AS (SELECT sound, p FROM p WHERE -0.691 + 10 * log10(p) > -70), m AS (SELECT sound, -0.691 + 10 * log10(avg(p)) - 10 AS gate FROM g GROUP BY 1),
l AS (SELECT sound, -0.691 + 10 * log10(avg(p)) AS lufs FROM g JOIN m USING (sound) WHERE -0.691 + 10 * log10(p) > gate GROUP BY 1)
SELECT sound, round(peak, 6) AS peak, round(lufs, 6) AS lufs, round(CASE WHEN peak <= 0.0001 THEN 0 ELSE least(-18 - coalesce(lufs, 20 * log10(rms)), 30) END, 6) AS gain_db FROM n LEFT JOIN l USING (sound)""")
def gated_loudness(spark, d):
    at = F.col("vec_id")
    v = table(spark, d, "embeddings").select(F.floor(at / _SOUND_VECTORS).alias("sound"), "vec_id", F.transform("embedding", lambda s: s.cast("double") * F.when(at % _SOUND_VECTORS >= 60, 0.001).otherwise(1.0)).alias("e"))
    sounds = v.groupBy("sound").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("parts")).select("sound", F.flatten("parts.e").alias("samples"))
    return audio.measured(sounds, _SOUND_RATE).select("sound", *[F.round(c, 6).alias(c) for c in ("peak", "lufs", "gain_db")])


@query("SELECT vec_id, list_transform(embedding, lambda s: CAST(greatest(least(trunc(CAST(s AS DOUBLE) * 32767), 32767), -32768) AS INTEGER)) AS pcm FROM embeddings")
def pcm_samples(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda s: X.pcm16(s.cast("double"))).alias("pcm"))


# --- more of the tables ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES_SQL} SELECT project_id || '/' || chapter_pos AS project_id FROM lines GROUP BY 1 HAVING count(*) FILTER (length(text) > 40) = 0""")
def silent_books(spark, d):
    """Each document as a book whose lines count from 41 characters on: the books without a line."""
    long_ = lines(spark, d).select(F.concat("project_id", F.lit("/"), F.col("chapter_pos").cast("string")).alias("project_id"), F.when(F.length("text") > 40, F.array("text")).alias("lines"))
    return epub.silent_books(long_)


@query("""SELECT CAST(conv_id AS VARCHAR) AS project_id, coalesce(nullif(max(CASE WHEN turn = 0 THEN trim(substr(text, 1, conv_id % 4)) END), ''), 'Title ' || conv_id) AS title, 'Nobody' AS author FROM conversations GROUP BY conv_id""")
def merged_metadata(spark, d):
    talk = table(spark, d, "conversations")
    old = talk.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("project_id"), F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("title"), F.lit("Nobody").alias("author"))
    new = talk.filter("turn = 0").select(F.col("conv_id").cast("string").alias("project_id"), F.trim(F.expr("substring(text, 1, cast(conv_id % 4 as int))")).alias("title"), F.lit("").alias("author"))
    return epub.merged_metadata(old, new)


_RUNS = """runs AS (SELECT CAST(event_id AS VARCHAR) AS project_id, ['parse', 'correct', 'attribute', 'review', 'synthesize', 'assemble'][1 + event_id % 6] AS stage, ['completed', 'needs_review', 'stopped', 'failed', 'completed'][1 + event_id % 5] AS status, event_type AS message FROM events)"""


@query(f"""WITH {_RUNS} SELECT project_id, CASE WHEN status = 'completed' AND stage <> 'assemble' THEN 'stopped' ELSE status END AS kind,
CASE status WHEN 'completed' THEN CASE WHEN stage <> 'assemble' THEN 'stopped after ' || stage ELSE 'complete' END WHEN 'needs_review' THEN '2 attributions' WHEN 'stopped' THEN 'stopped' ELSE 'failed: ' || message END AS summary FROM runs""")
def run_outcomes(spark, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % by + 1).cast("int"))
    runs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("project_id"), pick(gate.STAGES, 6).alias("stage"), pick(("completed", "needs_review", "stopped", "failed", "completed"), 5).alias("status"), F.col("event_type").alias("message"))
    return gate.outcome(runs, runs.select("project_id", F.lit("2 attributions").alias("summary")), until="parse")


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('man', 'woman', 'boy', 'girl', 'unknown') THEN lower(trim(event_type)) ELSE 'unknown' END AS category, CASE WHEN value >= 0.75 THEN 'approved' ELSE 'needs_review' END AS status FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Man ' WHEN 1 THEN 'GIRL' ELSE event_type END AS event_type, value FROM events)")
def coerced_categories(spark, d):
    i = F.col("event_id")
    word = F.when(i % 4 == 0, " Man ").when(i % 4 == 1, "GIRL").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", X.coerce_category(word).alias("category"), X.review_status("value").alias("status"))


@query(f"""WITH {SEG_SQL}, o AS (SELECT *, split_part(text, ' ', 1) AS original FROM segments)
SELECT segment_id AS suggestion_id, 'Talk ' || chapter_pos AS chapter_title, line_pos AS line_order, text AS line_text, original, true AS is_pending FROM o""")
def suggestion_rows(spark, d):
    return views.suggestion_rows(offered(spark, d), *placed(spark, d)).select("suggestion_id", "chapter_title", "line_order", "line_text", "original", "is_pending")


@query("SELECT DISTINCT printf('silence_%04dms_%dhz_%dch_%db.wav', CAST(l_linenumber AS INTEGER) * 100, 8000 + l_linenumber, 1, 2) AS file_name FROM lineitem")
def silence_files(spark, d):
    n = F.col("l_linenumber").cast("int")
    return table(spark, d, "lineitem").select(n.alias("l_linenumber")).distinct().select(timeline.silence_name(n / 10, n + 8000, F.lit(1), F.lit(2)).alias("file_name"))
