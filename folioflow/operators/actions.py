"""What a reviewer does, as rewrites of tables, with what each change makes stale.

An action returns the changed tables. `stale` names the stages whose completion it takes back: REVIEW, SYNTHESIZE and ASSEMBLE.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PreconditionError
from ..functions import text as X
from ..schema import make_id
from .segment import line_segments, spans

REVIEW, AUDIO = ("review",), ("synthesize", "assemble")
LINE = ("project_id", "chapter_pos", "line_pos")


def stale(projects: DataFrame, which: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Projects without the status of these stages where `which` (project_id) names them."""
    hit = which.select("project_id").distinct().withColumn("hit", F.lit(True))
    kept = F.map_filter("stage_status", lambda k, _: ~k.isin(*stages))
    return projects.join(hit, "project_id", "left").withColumn("stage_status", F.when(F.col("hit"), kept).otherwise(F.col("stage_status"))).select(*projects.columns)


def _update(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def _chosen(ids: DataFrame | list[str], column: str, df: DataFrame) -> DataFrame:
    """df with __hit: whether its id is among the chosen. An id that no row has is refused: of a list at once, of a table when the result
    is computed, in the same pass."""
    if isinstance(ids, list):
        there = {r[0] for r in df.filter(F.col(column).isin(*ids)).select(column).distinct().collect()} if ids else set()
        if lost := sorted(set(ids) - there):
            raise ValueError(f"no {column} {lost[0]!r}")
        return df.withColumn("__hit", F.col(column).isin(*ids) if ids else F.lit(False))
    asked = ids.select(F.col(column).alias("__asked")).distinct()
    both = df.withColumn("__row", F.lit(True)).join(asked, F.col(column) == F.col("__asked"), "full_outer")
    lost = F.raise_error(F.concat(F.lit(f"no {column} '"), F.coalesce("__asked", F.lit("")), F.lit("'"))).cast("boolean")
    return both.filter(F.when(F.col("__row"), True).otherwise(lost)).withColumn("__hit", F.col("__asked").isNotNull()).drop("__row", "__asked")


def missing(ids: DataFrame, column: str, df: DataFrame) -> DataFrame:
    """The ids, each once, that no row of df has."""
    return ids.select(column).distinct().join(df.select(column), column, "left_anti")


def require(df: DataFrame, column: str, value: str) -> None:
    if df.filter(F.col(column) == value).isEmpty():
        raise ValueError(f"no {column} {value!r}")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def accept_suggestions(suggestions: DataFrame, lines: DataFrame, segments: DataFrame, ids) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """suggestions, lines, segments, and the projects whose audio is stale. In order of sug_pos, each accepted suggestion replaces the
    first occurrence of its original in its line and in the first segment there that holds it; that segment loses its rendering."""
    picked = _chosen(ids, "suggestion_id", suggestions)
    todo = picked.filter("__hit").groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("sug_pos", "original", "suggested"))).alias("todo"))
    told = _update(picked, F.col("__hit"), status=F.lit("approved")).select(*suggestions.columns)

    swap = lambda acc, s: replace_first(acc, s["original"], s["suggested"])
    fixed = lines.join(todo, list(LINE), "left").withColumn("text", F.when(F.col("todo").isNull(), F.col("text")).otherwise(F.aggregate("todo", F.col("text"), swap))).select(*lines.columns)

    # The segments of a line in one array: each suggestion goes to the first element that holds its original.
    touched = segments.join(todo, list(LINE))
    grouped = touched.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("seg_pos", "text"))).alias("s"), F.first("todo").alias("todo"))

    def in_first(acc, s):
        at = F.array_position(F.transform(acc, lambda g: (F.instr(g["text"], s["original"]) > 0) & (F.length(s["original"]) > 0)), F.lit(True))
        return F.transform(acc, lambda g, i: F.when(i + 1 == at, F.struct(g["seg_pos"].alias("seg_pos"), replace_first(g["text"], s["original"], s["suggested"]).alias("text"))).otherwise(g))

    after = grouped.select(*LINE, F.inline(F.aggregate("todo", F.col("s"), in_first))).withColumnRenamed("text", "new_text")
    out = segments.join(after, [*LINE, "seg_pos"], "left").withColumn("changed", F.coalesce(F.col("new_text") != F.col("text"), F.lit(False)))
    changed = out.filter("changed").select("project_id").distinct()
    out = _update(out, F.col("changed"), text=F.col("new_text"), audio_cache_key=F.lit(None), audio_status=F.lit("pending")).select(*segments.columns)
    return told, fixed, out, changed


def reject_suggestions(suggestions: DataFrame, ids) -> DataFrame:
    return _update(_chosen(ids, "suggestion_id", suggestions), F.col("__hit"), status=F.lit("rejected")).select(*suggestions.columns)


def edit_lines(lines: DataFrame, segments: DataFrame, edits: DataFrame, narrators: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines, segments, and the projects where something changed. edits: line_id, new_text. A text that cuts into the same spans as the
    segments there are changes nothing; any other replaces the line and its segments."""
    asked = lines.join(edits, "line_id").select(*LINE, "line_id", F.col("new_text").alias("text"))
    want = spans(asked).groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("seg_pos", "text"))).alias("w")).select(*LINE, F.col("w.text").alias("want"))
    have = segments.join(asked.select(*LINE), list(LINE)).groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("seg_pos", "text"))).alias("h")).select(*LINE, F.col("h.text").alias("have"))
    none = F.array().cast("array<string>")
    new = asked.join(want, list(LINE), "left").join(have, list(LINE), "left").filter(F.coalesce("want", none) != F.coalesce("have", none)).select(*LINE, "text")
    fixed = lines.join(new.withColumnRenamed("text", "new_text"), list(LINE), "left").withColumn("text", F.coalesce("new_text", "text")).select(*lines.columns)
    made = line_segments(new, narrators).select(*[F.col(c).cast(segments.schema[c].dataType) for c in segments.columns])
    return fixed, segments.join(new.select(*LINE), list(LINE), "left_anti").unionByName(made), new.select("project_id").distinct()


def review_attributions(segments: DataFrame, ids, status: str) -> DataFrame:
    """status: approved or rejected; neither blocks the review."""
    return _update(_chosen(ids, "segment_id", segments), F.col("__hit"), review_status=F.lit(status)).select(*segments.columns)


def set_speaker(segments: DataFrame, speakers: DataFrame, ids, speaker_id: str | None) -> DataFrame:
    """Gives segments to a speaker, or to no one (the narrator speaks), and approves that."""
    role = "narrator"
    if speaker_id is not None:
        row = speakers.filter(F.col("speaker_id") == speaker_id).select("role").first()
        if row is None:
            raise ValueError(f"no speaker {speaker_id!r}")
        role = row["role"]
    return _update(_chosen(ids, "segment_id", segments), F.col("__hit"), speaker_id=F.lit(speaker_id), role=F.lit(role), review_status=F.lit("approved")).select(*segments.columns)


def create_character(speakers: DataFrame, project_id: str, name: str) -> tuple[DataFrame, str]:
    """The speakers with one more character, and its id; a name that is taken, in any case, gives that speaker."""
    same = speakers.filter((F.col("project_id") == project_id) & (X.fold("name") == name.lower())).orderBy("speaker_pos").select("speaker_id").first()
    if same:
        return speakers, same["speaker_id"]
    at = speakers.filter(F.col("project_id") == project_id).agg(F.max("speaker_pos")).first()[0]
    row = speakers.sparkSession.range(1).select(F.lit(project_id).alias("project_id"), F.lit((-1 if at is None else at) + 1).cast("int").alias("speaker_pos"), make_id("spk", F.lit(project_id), F.lit(name.lower())).alias("speaker_id"), F.lit(name).alias("name"), F.lit("character").alias("role"), F.lit(None).cast("string").alias("voice_clip_id"), F.lit("unknown").alias("category"))
    return speakers.unionByName(row), row.first()["speaker_id"]


def reassign_to_new_speaker(segments: DataFrame, speakers: DataFrame, ids, project_id: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Segments given to the character of that name, and the speakers, with that character if the name was new."""
    every, speaker_id = create_character(speakers, project_id, name)
    chosen = _chosen(ids, "segment_id", segments)
    given = _update(chosen, F.col("__hit"), speaker_id=F.lit(speaker_id), role=F.lit("character"), review_status=F.lit("approved"))
    return given.select(*segments.columns), every


def register_clip(clips: DataFrame, files: DataFrame, project_id: str, path: str, label: str | None = None) -> tuple[DataFrame, str]:
    """The clips with one more; the file has to be there. files: path."""
    require(files, "path", path)
    at = clips.filter(F.col("project_id") == project_id).agg(F.max("clip_pos")).first()[0]
    pos = (-1 if at is None else at) + 1
    row = clips.sparkSession.range(1).select(F.lit(project_id).alias("project_id"), F.lit(pos).cast("int").alias("clip_pos"), make_id("clip", F.lit(project_id), F.lit(path), F.lit(str(pos))).alias("voice_clip_id"), F.lit(path).alias("source_path"), F.lit(label or path.rsplit("/", 1)[-1]).alias("label"))
    return clips.unionByName(row), row.first()["voice_clip_id"]


def assign_voices(speakers: DataFrame, clips: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: project_id, speaker_id, clip_id. Every pair has to name a speaker and a clip there is."""
    bad = pairs.join(speakers, ["project_id", "speaker_id"], "left_anti").unionByName(pairs.join(clips.select("project_id", F.col("voice_clip_id").alias("clip_id")), ["project_id", "clip_id"], "left_anti").select(*pairs.columns))
    if not bad.isEmpty():
        raise ValueError(f"no such speaker or clip: {bad.first().asDict()}")
    return speakers.join(pairs.select("project_id", "speaker_id", F.col("clip_id").alias("given")), ["project_id", "speaker_id"], "left").withColumn("voice_clip_id", F.coalesce("given", "voice_clip_id")).select(*speakers.columns)


def unassign_voice(speakers: DataFrame, ids) -> DataFrame:
    return _update(_chosen(ids, "speaker_id", speakers), F.col("__hit"), voice_clip_id=F.lit(None)).select(*speakers.columns)


def set_category(speakers: DataFrame, ids, category: str) -> DataFrame:
    return _update(_chosen(ids, "speaker_id", speakers), F.col("__hit"), category=X.coerce_category(F.lit(category))).select(*speakers.columns)


def approve_audio(segments: DataFrame, ids) -> DataFrame:
    return _update(_chosen(ids, "segment_id", segments), F.col("__hit"), audio_status=F.lit("approved")).select(*segments.columns)


def new_seed(current: int | None) -> int:
    """A seed in [1, 2**31 - 1) other than the current one. Drawn on the driver: a plan that is retried must not draw again."""
    while (seed := 1 + secrets.randbelow((1 << 31) - 2)) == current:
        pass
    return seed


def reroll_audio(segments: DataFrame, ids, seed: int) -> DataFrame:
    return _update(_chosen(ids, "segment_id", segments), F.col("__hit"), audio_seed=F.lit(seed), audio_cache_key=F.lit(None), audio_status=F.lit("pending")).select(*segments.columns)


def fail_audio(segments: DataFrame, ids) -> DataFrame:
    return _update(_chosen(ids, "segment_id", segments), F.col("__hit"), audio_cache_key=F.lit(None), audio_status=F.lit("failed")).select(*segments.columns)


def auto_accept(segments: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything in review settled without a reviewer: attributions approved, suggestions rejected."""
    return _update(segments, F.col("review_status") == "needs_review", review_status=F.lit("approved")), _update(suggestions, F.col("status") == "pending", status=F.lit("rejected"))


def renumbered(df: DataFrame, pos: str, by: tuple[str, ...]) -> DataFrame:
    """Positions without gaps."""
    return df.withColumn(pos, (F.row_number().over(Window.partitionBy(*by).orderBy(pos)) - 1).cast("int"))


def require_no_rows(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise PreconditionError(message)
