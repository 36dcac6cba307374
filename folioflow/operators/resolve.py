"""Speakers: who a segment's effective speaker is, and which speaker a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import make_id

NARRATOR_NAMES = ("narrator", "the narrator")


def narrators(speakers: DataFrame) -> DataFrame:
    """project_id, narrator_id, narrator_name: of each project the first speaker whose role is narrator."""
    first = speakers.filter("role = 'narrator'").groupBy("project_id").agg(F.min_by(F.struct("speaker_id", "name"), "speaker_pos").alias("s"))
    return first.select("project_id", F.col("s.speaker_id").alias("narrator_id"), F.col("s.name").alias("narrator_name"))


def with_narrators(speakers: DataFrame, projects: DataFrame) -> DataFrame:
    """The speakers, and a narrator for each project that has none, after its other speakers."""
    last = speakers.groupBy("project_id").agg((F.max("speaker_pos") + 1).alias("next"))
    bare = projects.select("project_id").distinct().join(narrators(speakers), "project_id", "left_anti").join(last, "project_id", "left")
    made = bare.select("project_id", F.coalesce("next", F.lit(0)).cast("int").alias("speaker_pos"), make_id("spk", "project_id", F.lit("narrator")).alias("speaker_id"), F.lit("narrator").alias("name"), F.lit("narrator").alias("role"), F.lit(None).cast("string").alias("voice_clip_id"), F.lit("unknown").alias("category"))
    return speakers.unionByName(made)


def unique_last(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row per key, the one with the largest pos: as an index built in order, where the last write wins."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), pos).alias("r")).select(*key, "r.*").select(*df.columns)


def unique_first(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row per key, the one with the smallest pos: as a search from the front."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), pos).alias("r")).select(*key, "r.*").select(*df.columns)


def effective(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with effective_id: their speaker, or without one the narrator, or null without a narrator."""
    return segments.join(narrators(speakers).select("project_id", "narrator_id"), "project_id", "left").withColumn("effective_id", F.coalesce("speaker_id", "narrator_id")).drop("narrator_id")


def referenced(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """project_id, speaker_id, first: effective speakers of segments with something to say, with their first place in reading order."""
    said = effective(segments.filter(X.is_renderable("text")), speakers).filter("effective_id is not null")
    return said.groupBy("project_id", F.col("effective_id").alias("speaker_id")).agg(F.min(F.struct("chapter_pos", "line_pos", "seg_pos")).alias("first"))


def narrator_alias(name: Column | str) -> Column:
    """Null for a name that means the narrator."""
    return F.when(~X.fold(name).isin(*NARRATOR_NAMES), X.c(name))


def resolve_names(mentions: DataFrame, speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions: project_id, pos, name (null: the narrator). Returns them with speaker_id and role, and the speakers with a new character
    for each name that none has, in order of first mention. Names are compared in lower case, the first speaker of a name is meant."""
    known = speakers.select("project_id", X.fold("name").alias("folded"), "speaker_pos", "speaker_id", "role")
    known = unique_first(known, ["project_id", "folded"], "speaker_pos")
    named = mentions.withColumn("folded", X.fold("name"))
    new = named.filter("name is not null").join(known, ["project_id", "folded"], "left_anti").groupBy("project_id", "folded").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("first"))
    start = speakers.groupBy("project_id").agg((F.max("speaker_pos") + 1).alias("start"))
    order = Window.partitionBy("project_id").orderBy("first", "folded")
    new = new.join(start, "project_id", "left").withColumn("speaker_pos", (F.coalesce("start", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    made = new.select("project_id", "speaker_pos", make_id("spk", "project_id", "folded").alias("speaker_id"), "name", F.lit("character").alias("role"), F.lit(None).cast("string").alias("voice_clip_id"), F.lit("unknown").alias("category"))
    every = speakers.unionByName(made)
    index = known.unionByName(made.select("project_id", X.fold("name").alias("folded"), "speaker_pos", "speaker_id", "role"))
    told = named.join(index.select("project_id", "folded", F.col("speaker_id").alias("by_name"), F.col("role").alias("name_role")), ["project_id", "folded"], "left")
    told = told.join(narrators(speakers).select("project_id", "narrator_id"), "project_id", "left")
    none = F.col("name").isNull()
    return told.select(*mentions.columns, F.when(none, F.col("narrator_id")).otherwise(F.col("by_name")).alias("speaker_id"), F.when(none, "narrator").otherwise(F.col("name_role")).alias("role")), every


def find_speaker(speakers: DataFrame, token: str, project_id: str | None = None) -> DataFrame:
    """The speaker a user means by a number (place in the list) or a name in any case; no row if there is none. Without a project, that
    of each project."""
    if project_id is not None:
        speakers = speakers.filter(F.col("project_id") == project_id)
    if token.lstrip("-").isdigit():
        return speakers.filter(F.col("speaker_pos") == int(token))
    hits = speakers.filter(X.fold("name") == token.lower())
    return unique_first(hits.withColumn("__n", X.fold("name")), ["project_id", "__n"], "speaker_pos").drop("__n")


def display(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with speaker_display: the name, `<narrator> (auto)` for one without a speaker, `<unknown>` for an unknown id."""
    by_id = unique_last(speakers.select("project_id", "speaker_id", "speaker_pos", F.col("name").alias("speaker_name")), ["project_id", "speaker_id"], "speaker_pos").drop("speaker_pos")
    out = segments.join(by_id, ["project_id", "speaker_id"], "left").join(narrators(speakers).select("project_id", "narrator_name"), "project_id", "left")
    auto = F.concat(F.coalesce("narrator_name", F.lit("narrator")), F.lit(" (auto)"))
    return out.withColumn("speaker_display", F.when(F.col("speaker_id").isNull(), auto).otherwise(F.coalesce("speaker_name", F.lit("<unknown>")))).drop("speaker_name", "narrator_name")
