"""Voices: which clip a speaker has, who still needs one, and filling in by category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PreconditionError
from ..functions import text as X
from ..schema import make_id
from .resolve import narrators, referenced, unique_last


def clip_paths(speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, speaker_id, clip_path: of each speaker the path of its clip, null if it has none, the clip is unknown or the file is
    missing. files: path, of the files there are. Of rows that repeat an id the last counts."""
    by_id = unique_last(clips, ["project_id", "voice_clip_id"], "clip_pos").select("project_id", "voice_clip_id", "source_path")
    one = unique_last(speakers, ["project_id", "speaker_id"], "speaker_pos").join(by_id, ["project_id", "voice_clip_id"], "left")
    there = files.select(F.col("path").alias("source_path"), F.lit(True).alias("exists")).distinct()
    return one.join(there, "source_path", "left").select("project_id", "speaker_id", F.when(F.col("exists"), F.col("source_path")).alias("clip_path"))


def has_voice(speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    return clip_paths(speakers, clips, files).select("project_id", "speaker_id", F.col("clip_path").isNotNull().alias("has_voice"))


def _first_unvoiced(segments: DataFrame, speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    used = referenced(segments, speakers)
    return used.join(clip_paths(speakers, clips, files).filter("clip_path is not null").select("project_id", "speaker_id"), ["project_id", "speaker_id"], "left_anti")


def unresolved_speakers(segments: DataFrame, speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """Speakers that say something and have no usable clip, with first (their place); ids without a speaker don't count."""
    bare = _first_unvoiced(segments, speakers, clips, files)
    return unique_last(speakers, ["project_id", "speaker_id"], "speaker_pos").join(bare, ["project_id", "speaker_id"])


def unresolved_voices(segments: DataFrame, speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, name, first: names that need a voice, once each. An id without a speaker stands for itself; `narrator` is there where
    segments without a speaker meet a project without a narrator."""
    bare = _first_unvoiced(segments, speakers, clips, files)
    names = unique_last(speakers, ["project_id", "speaker_id"], "speaker_pos").select("project_id", "speaker_id", "name")
    named = bare.join(names, ["project_id", "speaker_id"], "left").select("project_id", F.coalesce("name", "speaker_id").alias("name"), "first")
    lost = needs_narrator(segments, speakers).select("project_id", F.lit("narrator").alias("name"), "first")
    return named.unionByName(lost).groupBy("project_id", "name").agg(F.min("first").alias("first"))


def needs_narrator(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """project_id, first: projects without a narrator where something is said by no one; after all others in order."""
    silent = segments.filter(X.is_renderable("text") & F.col("speaker_id").isNull()).select("project_id").distinct()
    end = F.lit((1 << 31) - 1)
    return silent.join(narrators(speakers), "project_id", "left_anti").select("project_id", F.struct(end.alias("chapter_pos"), end.alias("line_pos"), end.alias("seg_pos")).alias("first"))


def voice_rows(segments: DataFrame, speakers: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """A row per speaker, as the list for assigning voices shows it."""
    by_id = unique_last(clips, ["project_id", "voice_clip_id"], "clip_pos").select("project_id", "voice_clip_id", F.col("label").alias("clip_label"), F.col("source_path").alias("clip_source"))
    there = files.select(F.col("path").alias("clip_source"), F.lit(True).alias("exists")).distinct()
    used = referenced(segments, speakers).select("project_id", "speaker_id", F.lit(True).alias("used"))
    need = unresolved_speakers(segments, speakers, clips, files).select("project_id", "speaker_id", F.lit(True).alias("need"))
    out = speakers.join(by_id, ["project_id", "voice_clip_id"], "left").join(there, "clip_source", "left").join(used, ["project_id", "speaker_id"], "left").join(need, ["project_id", "speaker_id"], "left")
    no = F.lit(False)
    return out.select("project_id", "speaker_pos", "speaker_id", "name", "role", "category", "clip_label", F.col("clip_source").alias("clip_path"), F.coalesce("used", no).alias("is_referenced"), F.coalesce("need", no).alias("needs_voice"), (F.col("clip_source").isNotNull() & F.col("exists").isNull()).alias("clip_file_missing"))


def category_clip(category, overrides: Mapping[str, str | None], defaults: Mapping[str, str]):
    """The clip of a category: what the user says, else the category's default, else what the user says for all, else the default for
    all; null if none is set. An empty path counts as none."""
    pick = lambda table: F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in table.items() if v and k != "default"], F.lit(None).cast("string"))
    return F.coalesce(pick(overrides), pick(defaults), F.lit(overrides.get("default") or None).cast("string"), F.lit(defaults.get("default") or None).cast("string"))


def bulk_plan(unresolved: DataFrame, overrides: Mapping[str, str | None], defaults: Mapping[str, str]) -> DataFrame:
    """The speakers without a voice, each with clip_path by its category; null where no clip covers it."""
    return unresolved.withColumn("clip_path", category_clip(F.col("category"), overrides, defaults))


def uncovered(plan: DataFrame) -> DataFrame:
    """project_id, category, names (in order of first place) of the speakers no clip covers, by project and category."""
    rows = plan.filter("clip_path is null").groupBy("project_id", "category").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("s"))
    return rows.select("project_id", "category", F.col("s.name").alias("names")).orderBy("project_id", "category")


def apply_bulk(plan: DataFrame, speakers: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speakers and clips with the plan carried out, one clip per distinct path, and counts by category. All or nothing: a plan that
    leaves someone out is refused."""
    if not plan.filter("clip_path is null").isEmpty():
        raise PreconditionError("no clip covers: " + ", ".join(r["category"] for r in uncovered(plan).select("category").distinct().orderBy("category").collect()))
    start = clips.groupBy("project_id").agg((F.max("clip_pos") + 1).alias("start"))
    firsts = plan.groupBy("project_id", "clip_path").agg(F.min(F.struct("first", "category")).alias("f"))
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("f"))
    new = firsts.withColumn("n", order).join(start, "project_id", "left")
    new = new.select("project_id", (F.coalesce("start", F.lit(0)) + F.col("n") - 1).cast("int").alias("clip_pos"), make_id("clip", "project_id", "clip_path").alias("voice_clip_id"), F.col("clip_path").alias("source_path"), F.concat(F.col("f.category"), F.lit(" (default)")).alias("label"))
    given = plan.select("project_id", "speaker_id", make_id("clip", "project_id", "clip_path").alias("given"))
    told = speakers.join(given, ["project_id", "speaker_id"], "left").withColumn("voice_clip_id", F.coalesce("given", "voice_clip_id")).select(*speakers.columns)
    return told, clips.unionByName(new), plan.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("assigned"))
