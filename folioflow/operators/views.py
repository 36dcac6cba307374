"""Flat tables for review, in reading order, with their counts and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CATEGORIES
from .resolve import display, narrators


def _titled(df: DataFrame, chapters: DataFrame, lines: DataFrame) -> DataFrame:
    titles = chapters.select("project_id", "chapter_pos", F.col("order").alias("chapter_index"), F.col("title").alias("chapter_title"))
    orders = lines.select("project_id", "chapter_pos", "line_pos", F.col("order").alias("line_order"), F.col("text").alias("line_text"), "line_id")
    return df.join(titles, ["project_id", "chapter_pos"]).join(orders, ["project_id", "chapter_pos", "line_pos"])


def segment_rows(segments: DataFrame, speakers: DataFrame, chapters: DataFrame, lines: DataFrame) -> DataFrame:
    rows = _titled(display(segments, speakers), chapters, lines)
    return rows.select("project_id", "chapter_pos", "line_pos", "seg_pos", "segment_id", "chapter_index", "chapter_title", "line_order", "text", "speaker_display", "role", "confidence", "review_status", (F.col("review_status") == "needs_review").alias("needs_review"), F.col("speaker_id").isNull().alias("is_narrator_fallback"))


def suggestion_rows(suggestions: DataFrame, chapters: DataFrame, lines: DataFrame) -> DataFrame:
    rows = _titled(suggestions, chapters, lines)
    return rows.select("project_id", "chapter_pos", "line_pos", "sug_pos", "suggestion_id", "line_id", "chapter_index", "chapter_title", "line_order", "line_text", "original", "suggested", "reason", "confidence", "status", (F.col("status") == "pending").alias("is_pending"))


def audio_rows(segments: DataFrame, speakers: DataFrame, chapters: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """files: cache_key."""
    there = files.select(F.col("cache_key").alias("audio_cache_key"), F.lit(True).alias("there")).distinct()
    rows = _titled(display(segments, speakers), chapters, lines).join(there, "audio_cache_key", "left")
    said = X.is_renderable("text")
    playable = said & F.coalesce("there", F.lit(False))
    return rows.select("project_id", "chapter_pos", "line_pos", "seg_pos", "segment_id", "chapter_index", "chapter_title", "line_order", "text", "speaker_display", "audio_status", (F.col("audio_status") == "approved").alias("is_approved"), (F.col("audio_status") == "failed").alias("is_failed"), (said & X.is_rendered("audio_status")).alias("is_rendered"), playable.alias("is_playable"), F.when(playable, X.audio_path("audio_cache_key")).alias("wav_path"))


def counts(rows: DataFrame, **flags: str) -> DataFrame:
    """project_id and, under each given name, how many rows have the flag."""
    return rows.groupBy("project_id").agg(*[F.count_if(F.col(c)).alias(n) for n, c in flags.items()])


def only(rows: DataFrame, flag: Column | str, on: bool = True) -> DataFrame:
    """The rows with the flag, if the filter is on."""
    return rows.filter(flag) if on else rows


def speaker_options(speakers: DataFrame) -> DataFrame:
    """project_id, position, speaker_id, name, role: the narrator, then the characters in order; other narrators are left out."""
    first = narrators(speakers).select("project_id", F.col("narrator_id").alias("speaker_id"), F.lit(1).alias("is_first"))
    rows = speakers.join(first, ["project_id", "speaker_id"], "left").filter("role = 'character' or is_first = 1")
    order = Window.partitionBy("project_id").orderBy(F.coalesce("is_first", F.lit(0)).desc(), "speaker_pos")
    return rows.select("project_id", (F.row_number().over(order) - 1).alias("position"), "speaker_id", "name", "role")


def category_options(spark) -> DataFrame:
    return spark.createDataFrame([(i, c, c.capitalize()) for i, c in enumerate(CATEGORIES)], "position int, value string, display string")


def category_choices(speakers: DataFrame) -> DataFrame:
    """project_id, speaker_id, position, value, display, chosen: what each speaker can be given; chosen: what it has."""
    all_ = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("value"), F.lit(c.capitalize()).alias("display")) for i, c in enumerate(CATEGORIES)])
    return speakers.select("project_id", "speaker_id", "category", F.inline(all_)).select("project_id", "speaker_id", "position", "value", "display", (F.col("value") == F.col("category")).alias("chosen"))


def flagged_neighbours(rows: DataFrame, flag: str, id_: str, order: tuple[str, ...], by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """rows with next_flagged and prev_flagged: the nearest flagged row after and before, going round at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    hit = F.when(F.col(flag), F.col(id_))
    every = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Looking back from the end, as a frame that shrinks is computed anew for each row and one that grows isn't.
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.coalesce(F.last(hit, True).over(back), F.first(hit, True).over(every))
    prev = F.coalesce(F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.last(hit, True).over(every))
    return rows.withColumn("next_flagged", nxt).withColumn("prev_flagged", prev)


def reselect(rows: DataFrame, order: tuple[str, ...], old: tuple) -> DataFrame:
    """Of each project the row at or after an old place, else the first."""
    place = F.struct(*order)
    was = F.struct(*[F.lit(v).alias(c) for v, c in zip(old, order, strict=True)])
    w = Window.partitionBy("project_id").orderBy((place >= was).desc(), *order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def has_any(df: DataFrame, condition: Column | str = "true") -> bool:
    return not df.filter(condition).limit(1).isEmpty()
