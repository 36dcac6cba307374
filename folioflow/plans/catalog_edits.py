"""More queries of the catalogue: reviewers' actions, repeated ids, whole corrections, stored projects, provider answers and sound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import actions, attribute, correct, render, resolve, segment, voice
from ..schema import STORED
from ..sources import audio, workspace
from .catalog import _WORK, DICT_SQL, LINES_SQL, OCR_SQL, PARAMS, SEG_SQL, SPELL_SQL, TOKEN_SQL, _PAIRS, cast, chapters, dictionary, distance_sql, lines, offered, params, projects, query, rep, segments, stored, table

KEY = ", ".join(correct.KEY)


# --- a larger cast: customers speak, suppliers are clips, nations are projects --------------------------------------------------------

PEOPLE_SQL = """people AS (SELECT CAST(c_nationkey AS VARCHAR) AS project_id, CAST(c_custkey AS INTEGER) AS speaker_pos, 'c' || {0} AS speaker_id, c_name AS name, CASE WHEN c_custkey % 10 = 3 THEN 'narrator' ELSE 'character' END AS role,
  'v' || c_custkey % 3 AS voice_clip_id, 'unknown' AS category FROM customer),
reels AS (SELECT CAST(s_nationkey AS VARCHAR) AS project_id, CAST(s_suppkey AS INTEGER) AS clip_pos, 'v' || s_suppkey % 2 AS voice_clip_id, '/clips/' || s_suppkey || '.wav' AS source_path, s_name AS label FROM supplier),
there AS (SELECT source_path AS path FROM reels WHERE clip_pos % 3 <> 0)"""
ONCE, AGAIN = PEOPLE_SQL.format("c_custkey"), PEOPLE_SQL.format("c_custkey % 20")


def people(spark, d, repeated: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """speakers, clips, files; with `repeated`, ids that stand in several rows of a project."""
    i, s = F.col("c_custkey"), F.col("s_suppkey")
    who = table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("project_id"), i.cast("int").alias("speaker_pos"), F.concat(F.lit("c"), (i % 20 if repeated else i).cast("string")).alias("speaker_id"), F.col("c_name").alias("name"),
        F.when(i % 10 == 3, "narrator").otherwise("character").alias("role"), F.concat(F.lit("v"), (i % 3).cast("string")).alias("voice_clip_id"), F.lit("unknown").alias("category"),
    )
    reels = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("project_id"), s.cast("int").alias("clip_pos"), F.concat(F.lit("v"), (s % 2).cast("string")).alias("voice_clip_id"), F.concat(F.lit("/clips/"), s.cast("string"), F.lit(".wav")).alias("source_path"), F.col("s_name").alias("label"))
    return who, reels, reels.filter("clip_pos % 3 <> 0").select(F.col("source_path").alias("path"))


_CLIPS = f"""{AGAIN}, one AS (SELECT project_id, speaker_id, arg_max(voice_clip_id, speaker_pos) AS v FROM people GROUP BY 1, 2), reel AS (SELECT project_id, voice_clip_id AS v, arg_max(source_path, clip_pos) AS p FROM reels GROUP BY 1, 2),
clip AS (SELECT one.project_id, one.speaker_id, there.path AS clip_path FROM one LEFT JOIN reel ON reel.project_id = one.project_id AND reel.v = one.v LEFT JOIN there ON there.path = reel.p)"""


@query(f"WITH {_CLIPS} SELECT * FROM clip")
def clips_of_repeated_ids(spark, d):
    return voice.clip_paths(*people(spark, d, True))


@query(f"WITH {_CLIPS} SELECT project_id, speaker_id, clip_path IS NOT NULL AS has_voice FROM clip")
def speakers_with_voice(spark, d):
    return voice.has_voice(*people(spark, d, True))


@query(f"""WITH {SEG_SQL}, {AGAIN}, one AS (SELECT project_id, speaker_id, arg_min(voice_clip_id, speaker_pos) AS v FROM people GROUP BY 1, 2), s AS (SELECT * EXCLUDE (speaker_id), 'c' || (chapter_pos + line_pos) % 20 AS speaker_id FROM segments)
SELECT segment_id, s.speaker_id AS effective_id, sha256(text || chr(0) || coalesce(v, '') || chr(0) || '{PARAMS}' || CASE WHEN audio_seed IS NOT NULL THEN chr(0) || 'seed' || chr(0) || audio_seed ELSE '' END) AS key
FROM s LEFT JOIN one ON one.project_id = s.project_id AND one.speaker_id = s.speaker_id""")
def keys_of_repeated_ids(spark, d):
    s = segments(spark, d).withColumn("speaker_id", F.concat(F.lit("c"), ((F.col("chapter_pos") + F.col("line_pos")) % 20).cast("string")))
    return render.with_keys(s, people(spark, d, True)[0], params(spark)).select("segment_id", "effective_id", "key")


@query(f"""WITH {ONCE}, p AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS project_id FROM nation UNION ALL SELECT 'empty'), who AS (SELECT * FROM people WHERE role <> 'narrator' OR TRY_CAST(project_id AS INTEGER) % 2 = 0),
bare AS (SELECT p.project_id, (SELECT max(speaker_pos) + 1 FROM who w WHERE w.project_id = p.project_id) AS n FROM p WHERE project_id NOT IN (SELECT project_id FROM who WHERE role = 'narrator'))
SELECT project_id, speaker_pos, speaker_id, name, role FROM who UNION ALL SELECT project_id, CAST(coalesce(n, 0) AS INTEGER), 'spk_' || substr(sha256(project_id || chr(31) || 'narrator'), 1, 32), 'narrator', 'narrator' FROM bare""")
def ensured_narrators(spark, d):
    who = people(spark, d)[0].filter("role <> 'narrator' or try_cast(project_id as int) % 2 = 0")
    p = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("project_id")).unionByName(spark.range(1).select(F.lit("empty").alias("project_id")))
    return resolve.with_narrators(who, p).select("project_id", "speaker_pos", "speaker_id", "name", "role")


@query(f"""WITH {ONCE} SELECT project_id, speaker_pos, speaker_id FROM people WHERE speaker_pos % 2 = 0 AND project_id = '3' AND lower(name) = lower((SELECT min(name) FROM people WHERE project_id = '3' AND speaker_pos % 2 = 0))""")
def speaker_by_name(spark, d):
    who = people(spark, d)[0].filter("speaker_pos % 2 = 0")
    name = who.filter("project_id = '3'").agg(F.min("name")).first()[0] or ""
    return resolve.find_speaker(who, name.upper(), "3").select("project_id", "speaker_pos", "speaker_id")


# --- actions --------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SEG_SQL} SELECT segment_id AS suggestion_id, CASE WHEN line_pos % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM segments")
def reject_suggestion(spark, d):
    o = offered(spark, d)
    return actions.reject_suggestions(o, o.filter("line_pos % 3 = 0").select("suggestion_id")).select("suggestion_id", "status")


@query(f"WITH {SEG_SQL} SELECT segment_id, CASE line_pos % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE review_status END AS review_status FROM segments")
def review_attribution(spark, d):
    s = segments(spark, d)
    approved = actions.review_attributions(s, s.filter("line_pos % 3 = 0").select("segment_id"), "approved")
    return actions.review_attributions(approved, s.filter("line_pos % 3 = 1").select("segment_id"), "rejected").select("segment_id", "review_status")


@query(f"""WITH {SEG_SQL} SELECT segment_id, CASE line_pos % 4 WHEN 0 THEN 'user' WHEN 1 THEN NULL ELSE speaker_id END AS speaker_id, CASE WHEN line_pos % 4 = 1 THEN 'narrator' ELSE role END AS role, CASE WHEN line_pos % 4 < 2 THEN 'approved' ELSE review_status END AS review_status FROM segments""")
def set_segment_speaker(spark, d):
    s, who = segments(spark, d), cast(spark)[0]
    given = actions.set_speaker(s, who, s.filter("line_pos % 4 = 0").select("segment_id"), "user")
    return actions.set_speaker(given, who, s.filter("line_pos % 4 = 1").select("segment_id"), None).select("segment_id", "speaker_id", "role", "review_status")


@query(f"""WITH {SEG_SQL}, h AS (SELECT *, project_id = '3' AND line_pos % 2 = 0 AS hit FROM segments) SELECT segment_id, CASE WHEN hit THEN 'spk_' || substr(sha256('3' || chr(31) || 'a stranger'), 1, 32) ELSE speaker_id END AS speaker_id,
CASE WHEN hit THEN 'approved' ELSE review_status END AS review_status FROM h""")
def reassign_to_new_speaker(spark, d):
    s = segments(spark, d)
    chosen = s.filter("project_id = '3' and line_pos % 2 = 0").select("segment_id")
    return actions.reassign_to_new_speaker(s, cast(spark)[0], chosen, "3", "A Stranger")[0].select("segment_id", "speaker_id", "review_status")


@query(f"""WITH {ONCE}, f AS (SELECT min(path) AS path FROM there), n AS (SELECT coalesce(max(clip_pos), -1) + 1 AS pos FROM reels WHERE project_id = '3')
SELECT project_id, clip_pos, voice_clip_id, source_path, label FROM reels UNION ALL SELECT '3', CAST(pos AS INTEGER), 'clip_' || substr(sha256('3' || chr(31) || path || chr(31) || pos), 1, 32), path, split_part(path, '/', -1) FROM f, n""")
def register_clip(spark, d):
    _, reels, files = people(spark, d)
    return actions.register_clip(reels, files, "3", files.agg(F.min("path")).first()[0])[0]


@query(f"""WITH {ONCE}, m AS (SELECT project_id, min(voice_clip_id) AS m FROM reels GROUP BY 1)
SELECT project_id, speaker_id, CASE WHEN speaker_pos % 4 = 0 THEN coalesce(m, voice_clip_id) ELSE voice_clip_id END AS voice_clip_id FROM people LEFT JOIN m USING (project_id)""")
def assign_voices(spark, d):
    who, reels, _ = people(spark, d)
    pairs = who.filter("speaker_pos % 4 = 0").select("project_id", "speaker_id").join(reels.groupBy("project_id").agg(F.min("voice_clip_id").alias("clip_id")), "project_id")
    return actions.assign_voices(who, reels.dropDuplicates(["project_id", "voice_clip_id"]), pairs).select("project_id", "speaker_id", "voice_clip_id")


@query(f"WITH {ONCE} SELECT project_id, speaker_id, CASE WHEN speaker_pos % 5 <> 0 THEN voice_clip_id END AS voice_clip_id FROM people")
def unassign_voice(spark, d):
    who = people(spark, d)[0]
    return actions.unassign_voice(who, who.filter("speaker_pos % 5 = 0").select("speaker_id")).select("project_id", "speaker_id", "voice_clip_id")


@query(f"WITH {ONCE} SELECT project_id, speaker_id, CASE WHEN speaker_pos % 5 = 0 THEN 'girl' ELSE category END AS category FROM people")
def set_category(spark, d):
    who = people(spark, d)[0]
    return actions.set_category(who, who.filter("speaker_pos % 5 = 0").select("speaker_id"), " Girl ").select("project_id", "speaker_id", "category")


@query(f"WITH {SEG_SQL} SELECT segment_id, CASE WHEN line_pos % 3 = 0 THEN 'approved' ELSE audio_status END AS audio_status FROM segments")
def approve_audio(spark, d):
    s = segments(spark, d)
    return actions.approve_audio(s, s.filter("line_pos % 3 = 0").select("segment_id")).select("segment_id", "audio_status")


@query(f"WITH {SEG_SQL} SELECT segment_id, CASE WHEN line_pos % 3 <> 0 THEN audio_cache_key END AS audio_cache_key, CASE WHEN line_pos % 3 = 0 THEN 'failed' ELSE audio_status END AS audio_status FROM segments")
def fail_audio(spark, d):
    s = segments(spark, d)
    return actions.fail_audio(s, s.filter("line_pos % 3 = 0").select("segment_id")).select("segment_id", "audio_cache_key", "audio_status")


# --- correction -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT {KEY} FROM lines WHERE chapter_pos % 9 NOT IN (0, 3)")
def lines_to_correct(spark, d):
    ls = lines(spark, d)
    i = F.col("chapter_pos") % 9
    told = ls.filter("chapter_pos % 3 = 0").select(*correct.KEY, F.when(i == 0, "spellcheck").when(i == 3, "ocr-artifact").otherwise("by hand").alias("reason"))
    return correct.uncorrected(ls, told).select(*correct.KEY)


@query(f"WITH {LINES_SQL} SELECT {KEY} FROM lines WHERE chapter_pos % 2 = 1")
def lines_to_attribute(spark, d):
    ls = lines(spark, d)
    return segment.unattributed(ls, ls.filter("chapter_pos % 2 = 0")).select(*correct.KEY)


@query(f"""WITH {LINES_SQL}, t AS (SELECT project_id, unnest({TOKEN_SQL.format('text')}) AS t FROM lines), n AS (SELECT project_id, unnest({TOKEN_SQL.format("'Old-Timer ' || project_id")}) AS t FROM (SELECT DISTINCT project_id FROM lines))
SELECT project_id, lower(t) AS word FROM t WHERE regexp_matches(t, '^\\p{{Lu}}') GROUP BY 1, 2 HAVING count(*) >= 2 UNION SELECT project_id, lower(t) FROM n""")
def protected_with_names(spark, d):
    ls = lines(spark, d)
    return correct.protected_words(ls, ls.select("project_id").distinct().withColumn("name", F.concat(F.lit("Old-Timer "), "project_id")))


_OCR = f"""{LINES_SQL}, {DICT_SQL}, b AS (SELECT {KEY}, replace(replace(replace(text, ', ', ' ,  '), 'tion', 'ti- on'), 'nd', 'ncl') AS text FROM lines),
prot AS (SELECT project_id, lower(t) AS word FROM (SELECT project_id, unnest({TOKEN_SQL.format('text')}) AS t FROM b) WHERE regexp_matches(t, '^\\p{{Lu}}') GROUP BY 1, 2 HAVING count(*) >= 2),
blanks AS (SELECT *, regexp_replace(regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([,.;:!?])', '\\1', 'g') AS suggested FROM b),
k0 AS (SELECT {KEY}, 0 AS kind, 0 AS pos, text AS original, suggested FROM blanks WHERE suggested <> text AND regexp_matches(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')),
hs AS (SELECT {KEY}, regexp_extract_all(text, '\\p{{L}}+-(?:\\n| +)\\p{{L}}+') AS ms FROM b),
h AS (SELECT {KEY}, i - 1 AS pos, ms[i] AS original, regexp_extract(ms[i], '^(\\p{{L}}+)-', 1) AS l, regexp_extract(ms[i], '(\\p{{L}}+)$', 1) AS r FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hs)),
k1 AS (SELECT {KEY}, 1 AS kind, pos, original, l || r AS suggested FROM h WHERE lower(l || r) IN (SELECT word FROM dict) AND NOT (lower(l) IN (SELECT word FROM dict) AND lower(r) IN (SELECT word FROM dict)) AND (project_id, lower(l || r)) NOT IN (SELECT (project_id, word) FROM prot)),
os AS (SELECT {KEY}, {OCR_SQL.format('text')} AS ts FROM b), ot AS (SELECT {KEY}, i - 1 AS pos, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM os)),
ow AS (SELECT {KEY}, lower(token) AS word, arg_min(token, pos) AS token, min(pos) AS pos FROM ot GROUP BY ALL),
ou AS (SELECT * FROM ow WHERE length(token) >= 3 AND word NOT IN (SELECT word FROM dict) AND (project_id, word) NOT IN (SELECT (project_id, word) FROM prot)),
oc AS (SELECT ou.*, rank, i, substr(token, 1, CAST(i - 1 AS BIGINT)) || y || substr(token, CAST(i + length(x) AS BIGINT)) AS fixed FROM (SELECT *, unnest(range(1, length(token) + 1)) AS i FROM ou) ou, (VALUES {_PAIRS}) p(rank, x, y)
  WHERE lower(substr(token, CAST(i AS BIGINT), length(x))) = x AND (length(token) >= 4 OR x NOT IN ('l', 'i'))),
k2 AS (SELECT {KEY}, 2 AS kind, pos, token AS original, arg_min(fixed, rank * 100000 + i) AS suggested FROM oc WHERE lower(fixed) IN (SELECT word FROM dict) AND (project_id, lower(fixed)) NOT IN (SELECT (project_id, word) FROM prot) GROUP BY {KEY}, pos, token),
k AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)"""


def ocr_applied(spark, d) -> tuple[DataFrame, DataFrame]:
    broken = lines(spark, d, lambda t: rep(rep(rep(t, ", ", " ,  "), "tion", "ti- on"), "nd", "ncl"))
    found = correct.candidates(broken, dictionary(spark, d), correct.protected_words(broken), correctors=correct.default_correctors()[:3])
    return correct.apply_candidates(broken, found)


@query(f"""WITH {_OCR} SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY kind, pos, original) - 1 AS sug_pos, original, suggested, 'ocr-artifact' AS reason, CAST(CASE kind WHEN 0 THEN 0.99 WHEN 1 THEN 0.5 ELSE 0.4 END AS DOUBLE) AS confidence,
CASE kind WHEN 0 THEN 'auto_applied' ELSE 'pending' END AS status FROM k""")
def ocr_suggestions(spark, d):
    return ocr_applied(spark, d)[1].select(*correct.KEY, F.col("sug_pos").cast("long").alias("sug_pos"), "original", "suggested", "reason", "confidence", "status")


@query(f"WITH {_OCR} SELECT {KEY}, coalesce(k0.suggested, b.text) AS text FROM b LEFT JOIN k0 USING ({KEY})")
def ocr_fixed_lines(spark, d):
    return ocr_applied(spark, d)[0]


#: The tokens to be checked, and from x, lines with their tokens ts, the nearest words r of unprotected unknown words u.
_SPELL_LAST = (SPELL_SQL.format("text"), f"""t AS (SELECT {KEY}, i - 1 AS pos, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM x)),
f AS (SELECT {KEY}, lower(token) AS word, arg_min(token, pos) AS token, min(pos) AS pos FROM t GROUP BY ALL),
u AS (SELECT * FROM f WHERE length(token) >= 3 AND NOT regexp_matches(token, '[0-9]') AND NOT (upper(token) = token AND lower(token) <> token) AND word NOT IN (SELECT word FROM dict) AND (project_id, word) NOT IN (SELECT (project_id, word) FROM prot)), w AS (SELECT DISTINCT word FROM u),
n AS (SELECT w.word, g.word AS other, {distance_sql('w.word', 'g.word')} AS dist, freq FROM w JOIN dict g ON abs(length(w.word) - length(g.word)) <= 2 AND {distance_sql('w.word', 'g.word')} <= 2),
r AS (SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, other DESC) AS k FROM n)""")


@query(f"""WITH {SEG_SQL}, {DICT_SQL}, prot AS (SELECT '' AS project_id, '' AS word), x AS (SELECT {KEY}, {_SPELL_LAST[0]} AS ts FROM segments), {_SPELL_LAST[1]}
SELECT {KEY}, token AS original, other AS suggested FROM u JOIN r USING (word) WHERE k = 1 AND other <> word""")
def spelling_suggestions(spark, d):
    said = segments(spark, d).select(*correct.KEY, "text")
    return correct.spelling_candidates(said, dictionary(spark, d)).select(*correct.KEY, "original", "suggested")


# --- rendering, stored projects ---------------------------------------------------------------------------------------------------------


def _speech():
    def say(text: str, clip: str, settings) -> bytes:
        if len(text) % 5 == 0:
            raise ValueError("not this one")
        return audio.encode(np.zeros(8), 8000)

    return say


@query(f"""WITH {_WORK}, j AS (SELECT w.segment_id, p.clip_path IS NOT NULL AND length(w.text) % 5 <> 0 AS ok FROM work w LEFT JOIN paths p ON p.project_id = w.project_id AND p.speaker_id = w.effective_id)
SELECT st.segment_id, CASE WHEN j.segment_id IS NULL THEN audio_cache_key WHEN ok THEN key END AS audio_cache_key, CASE WHEN j.segment_id IS NULL THEN audio_status WHEN ok THEN 'completed' ELSE 'failed' END AS audio_status FROM st LEFT JOIN j ON j.segment_id = st.segment_id""")
def synthesized(spark, d):
    s, files = stored(spark, d)
    return render.synthesize(s, *cast(spark), params(spark), files, _speech)[0].select("segment_id", "audio_cache_key", "audio_status")


@query(f"""WITH {_WORK}, m AS (SELECT project_id, list('Talk = ' || chapter_pos || ' / seg ' || segment_id ORDER BY chapter_pos, line_pos, seg_pos) AS l FROM st
WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') AND NOT (audio_cache_key IS NOT NULL AND audio_status IN ('completed', 'approved') AND audio_cache_key IN (SELECT cache_key FROM af)) GROUP BY 1)
SELECT project_id, array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ' …' ELSE '' END AS said FROM m""")
def unrendered_names(spark, d):
    s, files = stored(spark, d)
    return render.unrendered_names(render.unrendered(s, files), chapters(spark, d))


@query(f"""WITH {SEG_SQL} SELECT project_id, dense_rank() OVER (PARTITION BY project_id ORDER BY chapter_pos) - 1 AS chapter_pos, row_number() OVER (PARTITION BY project_id, chapter_pos ORDER BY line_pos) - 1 AS line_pos,
segment_id, text, speaker_id, CAST(confidence AS DOUBLE) AS confidence, review_status, audio_cache_key, audio_status, audio_seed FROM segments""")
def stored_projects(spark, d):
    """Every project written as its nested document and read back."""
    s = segments(spark, d)
    who, clips, _ = cast(spark)
    none = F.lit(None).cast("string")
    t = {
        "projects": projects(spark).select("project_id", F.lit("p").alias("name"), F.lit("/w").alias("workspace_dir"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("/e").alias("source_ebook_path"), none.alias("cover_image_path"), F.create_map().cast("map<string,string>").alias("stage_status"), F.lit(PARAMS).alias("tts_params")),
        "chapters": chapters(spark, d).withColumns({"chapter_id": F.concat(F.lit("c"), F.col("chapter_pos").cast("string")), "order": F.col("chapter_pos").cast("int")}),
        "lines": s.select(*correct.KEY, F.concat(F.lit("l"), "segment_id").alias("line_id"), F.col("line_pos").alias("order"), "text"), "segments": s, "suggestions": offered(spark, d), "speakers": who, "voice_clips": clips,
    }
    doc = workspace.documents(t).select(F.from_json("json", STORED, {"mode": "FAILFAST"}).alias("d"), F.get_json_object("json", "$.tts_params").alias("params"))
    back = workspace.split(doc.select("d.*", "params"))["segments"]
    return back.select("project_id", F.col("chapter_pos").cast("long").alias("chapter_pos"), F.col("line_pos").cast("long").alias("line_pos"), "segment_id", "text", "speaker_id", "confidence", "review_status", "audio_cache_key", "audio_status", "audio_seed")


# --- answers and sound --------------------------------------------------------------------------------------------------------------------


def each_row(df: DataFrame, f: Callable[[dict], list[dict]], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """The rows that f makes of each row; lists of numbers come as arrays."""
    schema = pa.schema(fields)

    def values(column) -> list:
        return audio.views(column) if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) else column.to_pylist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*map(values, b.columns), strict=True)
            yield pa.RecordBatch.from_pylist([x for r in rows for x in f(dict(zip(b.schema.names, r, strict=True)))], schema)

    return df.mapInArrow(task, ddl)


def _answers(spark, d, entry, name: str) -> DataFrame:
    """conv_id, answer, wanted: of each talk what a provider might say of its turns."""
    s = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("g"), "turn").alias("id"), "role")
    return s.groupBy("conv_id").agg(F.array_sort(F.collect_list("id")).alias("wanted"), F.to_json(F.struct(F.collect_list(entry).alias(name))).alias("answer"))


@query("""SELECT conv_id, 'g' || turn AS id, CASE WHEN turn % 4 = 2 THEN role END AS speaker, CASE WHEN turn % 2 = 0 THEN turn / 10.0 ELSE 0.0 END AS confidence, turn % 2 = 0 AS answered FROM conversations""")
def parsed_attributions(spark, d):
    turn = F.col("turn")
    entry = F.when(turn % 2 == 0, F.struct(F.col("id").alias("segment_id"), F.when(turn % 4 == 0, "The Narrator").otherwise(F.col("role")).alias("speaker"), (turn / 10.0).alias("confidence")))
    answers = _answers(spark, d, entry, "attributions").withColumnRenamed("wanted", "candidates")
    return attribute.read_attributions(answers).select("conv_id", F.col("segment_id").alias("id"), "speaker", "confidence", "answered")


@query("SELECT conv_id, 'g' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'man' ELSE 'unknown' END AS category, CAST(CASE WHEN turn % 3 = 2 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM conversations")
def parsed_categories(spark, d):
    turn = F.col("turn")
    entry = F.when(turn % 3 != 2, F.struct(F.col("id").alias("speaker_id"), F.when(turn % 3 == 0, " Man ").otherwise("alien").alias("category"), F.lit(0.5).alias("confidence")))
    return attribute.read_categories(_answers(spark, d, entry, "classifications")).select("conv_id", F.col("speaker_id").alias("id"), "category", "confidence")


_PCM = "list_transform({0}, lambda s: trunc(greatest(least(s, 1.0), -1.0) * 32767))"
_LEVEL = """m AS (SELECT *, list_max(list_transform(v, lambda s: abs(s))) AS peak, sqrt(list_dot_product(v, v) / len(v)) AS rms FROM x),
g AS (SELECT *, CASE WHEN peak <= 0.0001 THEN 1.0 ELSE pow(10.0, least(-18.0 - 20 * log10(rms), 30.0) / 20) END AS f FROM m),
y AS (SELECT *, CASE WHEN peak > 0.0001 AND peak * f > pow(10.0, -0.05) THEN pow(10.0, -0.05) / peak ELSE f END AS factor FROM g)"""


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


@query(f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda s: CAST(s AS DOUBLE)) AS v FROM embeddings), {_LEVEL} SELECT vec_id, list_transform(v, lambda s: round(s * factor, 6)) AS samples FROM y""")
def levelled_samples(spark, d):
    read = lambda r: [{"vec_id": r["vec_id"], "samples": audio.normalize(r["embedding"], 16000, audio.Loudness())}]
    made = each_row(_vectors(spark, d), read, [("vec_id", pa.int64()), ("samples", pa.list_(pa.float64()))], "vec_id long, samples array<double>")
    return made.select("vec_id", F.transform("samples", lambda s: X.rounded(s, 6)).alias("samples"))


@query(f"""WITH x AS (SELECT vec_id, {_PCM.format('list_transform(embedding, lambda q: CAST(q AS DOUBLE))')} AS pcm FROM embeddings) SELECT vec_id, list_transform(pcm, lambda s: CAST(s AS BIGINT)) AS pcm, len(pcm) / 8000.0 AS seconds FROM x""")
def wav_round_trip(spark, d):
    def read(r):
        wav = audio.encode(r["embedding"], 8000)
        return [{"vec_id": r["vec_id"], "pcm": (audio.decode(wav)[0] * 32768).astype(np.int64), "seconds": audio.duration(wav)}]

    return each_row(_vectors(spark, d), read, [("vec_id", pa.int64()), ("pcm", pa.list_(pa.int64())), ("seconds", pa.float64())], "vec_id long, pcm array<long>, seconds double")


@query(f"""WITH x AS (SELECT vec_id, list_transform({_PCM.format('list_transform(embedding, lambda q: CAST(q AS DOUBLE))')}, lambda p: p / 32768) AS v FROM embeddings), {_LEVEL},
z AS (SELECT vec_id, {_PCM.format('list_transform(v, lambda q: q * factor)')} AS pcm FROM y) SELECT vec_id, list_transform(pcm, lambda s: CAST(s AS BIGINT)) AS pcm FROM z""")
def levelled_wav(spark, d):
    read = lambda r: [{"vec_id": r["vec_id"], "pcm": (audio.decode(audio.normalize_wav(audio.encode(r["embedding"], 8000), audio.Loudness()))[0] * 32768).astype(np.int64)}]
    return each_row(_vectors(spark, d), read, [("vec_id", pa.int64()), ("pcm", pa.list_(pa.int64()))], "vec_id long, pcm array<long>")


@query("""SELECT DISTINCT printf('silence_%04dms_%dhz_%dch_%db.wav', CAST(l_linenumber AS INTEGER) * 100, 8000 + l_linenumber, 2, 2) AS file_name, CAST(round_even((8000 + l_linenumber) * (l_linenumber / 10.0), 0) AS BIGINT) AS frames FROM lineitem""")
def silence_frames(spark, d):
    def read(r):
        name, wav = audio.silence(r["n"] / 10, 8000 + r["n"], 2, 2)
        return [{"file_name": name, "frames": audio.header(wav)[3]}]

    n = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("n")).distinct()
    return each_row(n, read, [("file_name", pa.string()), ("frames", pa.int64())], "file_name string, frames long")
