"""Tables of a corpus of books, keyed by project and reading position, and the values their enumerations may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import MigrationError, SerializationError

#: Version of the stored form.
VERSION = 3

# Fixed values of the data model.
ROLES = ("narrator", "character")
CATEGORIES = ("man", "woman", "boy", "girl", "unknown")
STAGES = ("parse", "correct", "attribute", "review", "synthesize", "assemble")
STATUSES = ("pending", "auto_applied", "approved", "rejected", "needs_review", "completed", "stopped", "failed")
RENDERED = ("completed", "approved")
HALTING = ("stopped", "needs_review", "failed")
CORRECTION_REASONS = ("ocr-artifact", "spellcheck")


PROJECTS = "project_id string, schema_version int, name string, workspace_dir string, title string, author string, source_ebook_path string, cover_image_path string, stage_status map<string,string>, tts_params string"
CHAPTERS = "project_id string, chapter_pos int, chapter_id string, `order` int, title string"
LINES = "project_id string, chapter_pos int, line_pos int, line_id string, `order` int, text string"
SEGMENTS = "project_id string, chapter_pos int, line_pos int, seg_pos int, segment_id string, text string, speaker_id string, role string, confidence double, review_status string, audio_cache_key string, audio_status string, audio_seed int"
SUGGESTIONS = "project_id string, chapter_pos int, line_pos int, sug_pos int, suggestion_id string, original string, suggested string, reason string, confidence double, status string"
SPEAKERS = "project_id string, speaker_pos int, speaker_id string, name string, role string, voice_clip_id string, category string"
VOICE_CLIPS = "project_id string, clip_pos int, voice_clip_id string, source_path string, label string"
#: What sources.audio.read_audio gives.
AUDIO_FILES = "cache_key string, path string, sample_rate int, channels int, sample_width int, frames long"
AUDIO = "cache_key string, path string, wav binary"
#: How the last run of each stage ended for a project.
STAGE_RESULTS = "project_id string, stage string, status string, message string"
TABLES = {"projects": PROJECTS, "chapters": CHAPTERS, "lines": LINES, "segments": SEGMENTS, "suggestions": SUGGESTIONS, "speakers": SPEAKERS, "voice_clips": VOICE_CLIPS, "audio": AUDIO, "stage_results": STAGE_RESULTS}

#: Reading order within a project.
READING = ("chapter_pos", "line_pos", "seg_pos")

# The nested stored form. Versions 1 and 2 lack the fields that migrate() fills.
_SEGMENT = "struct<id:string,text:string,speaker_id:string,role:string,confidence:double,review_status:string,audio_cache_key:string,audio_status:string,audio_seed:int>"
_SUGGESTION = "struct<id:string,original:string,suggested:string,reason:string,confidence:double,status:string>"
_LINE = f"struct<id:string,chapter_id:string,order:int,text:string,segments:array<{_SEGMENT}>,suggestions:array<{_SUGGESTION}>>"
_CHAPTER = f"struct<id:string,order:int,title:string,lines:array<{_LINE}>>"
_BOOK = f"struct<title:string,author:string,source_ebook_path:string,cover_image_path:string,chapters:array<{_CHAPTER}>>"
_SPEAKER = "struct<id:string,name:string,role:string,voice_clip_id:string,category:string>"
STORED = f"schema_version int, id string, name string, workspace_dir string, book {_BOOK}, speakers array<{_SPEAKER}>, voice_clips array<struct<id:string,source_path:string,label:string>>, stage_status map<string,string>, tts_params string"


def make_id(prefix: str, *keys: Column | str) -> Column:
    """A stable id from where a row stands: retries and reruns give the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]), 256), 1, 32))


def require_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The frame; running it fails where the column holds none of the allowed values. Stored enumerations aren't coerced."""
    ok = F.col(column).isNull() | F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} can't be "), F.col(column))).cast("string")))


def check_version(version: object) -> int:
    """The version, if it can be read."""
    if not isinstance(version, int) or isinstance(version, bool):
        raise SerializationError(f"schema_version can't be {version!r}")
    if not 1 <= version <= VERSION:
        raise MigrationError(f"version {version} can't be brought to {VERSION}")
    return version
