"""Quotes and narration of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import make_id

KEY = ("project_id", "chapter_pos", "line_pos")


#: What cuts a line: its text in, array<struct<text, is_quote>> out. functions.text.quote_spans is the default.
Segmenter = Callable[[Column], Column]


def spans(lines: DataFrame, key=KEY, segmenter: Segmenter = X.quote_spans) -> DataFrame:
    """key, seg_pos, text, is_quote."""
    return lines.select(*key, F.posexplode(segmenter(F.col("text"))).alias("seg_pos", "s")).select(*key, "seg_pos", "s.*")


def unattributed(lines: DataFrame, segments: DataFrame, key=KEY) -> DataFrame:
    return lines.join(segments.select(*key).distinct(), list(key), "left_anti")


def line_segments(lines: DataFrame, narrators: DataFrame, key=KEY, segmenter: Segmenter = X.quote_spans) -> DataFrame:
    """Segments of lines: narration is the narrator's and approved, a quote has no speaker yet and needs review.
    narrators: project_id, narrator_id."""
    cut = spans(lines, key, segmenter).join(narrators, "project_id", "left")
    quote = F.col("is_quote")
    return cut.select(
        *key, "seg_pos", make_id("seg", *key, "seg_pos", "text").alias("segment_id"), "text",
        F.when(~quote, F.col("narrator_id")).alias("speaker_id"), F.lit("narrator").alias("role"), F.when(quote, 0.0).otherwise(1.0).alias("confidence"),
        F.when(quote, "needs_review").otherwise("approved").alias("review_status"), F.lit(None).cast("string").alias("audio_cache_key"), F.lit("pending").alias("audio_status"), F.lit(None).cast("int").alias("audio_seed"),
    )
