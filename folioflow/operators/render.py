"""Content-addressed rendering: keys, what is left to do, and the work itself, once per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PreconditionError, SpeechProviderError
from ..functions import text as X
from .resolve import effective, unique_first
from .voice import clip_paths

#: text, clip path, parameters (with the seed) -> WAV bytes.
Speech = Callable[[str, str, Mapping[str, object]], bytes]


def with_keys(segments: DataFrame, speakers: DataFrame, params: DataFrame) -> DataFrame:
    """Segments with effective_id and key: the key they ought to have now. params: project_id, params (canonical JSON)."""
    clip = unique_first(speakers, ["project_id", "speaker_id"], "speaker_pos").select("project_id", F.col("speaker_id").alias("effective_id"), "voice_clip_id")
    out = effective(segments, speakers).join(clip, ["project_id", "effective_id"], "left").join(params, "project_id", "left")
    return out.withColumn("key", X.cache_key("text", "voice_clip_id", "params", "audio_seed")).drop("voice_clip_id")


def is_current(files_col: str = "there"):
    return (F.col("audio_cache_key") == F.col("key")) & X.is_rendered("audio_status") & F.coalesce(F.col(files_col), F.lit(False))


def worklist(segments: DataFrame, speakers: DataFrame, params: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with something to say whose rendering isn't current: the stored key differs, the status isn't rendered, or the file is
    missing. files: cache_key."""
    there = files.select(F.col("cache_key").alias("audio_cache_key"), F.lit(True).alias("there")).distinct()
    keyed = with_keys(segments.filter(X.is_renderable("text")), speakers, params).join(there, "audio_cache_key", "left")
    return keyed.filter(~F.coalesce(is_current(), F.lit(False))).drop("there")


def unrendered(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with something to say that can't be assembled yet; the stored key is trusted."""
    said = segments.filter(X.is_renderable("text"))
    there = files.select(F.col("cache_key").alias("audio_cache_key"), F.lit(True).alias("there")).distinct()
    ok = F.col("audio_cache_key").isNotNull() & X.is_rendered("audio_status") & F.coalesce("there", F.lit(False))
    return said.join(there, "audio_cache_key", "left").filter(~ok).drop("there").select(*segments.columns)


def unrendered_names(missing: DataFrame, chapters: DataFrame) -> DataFrame:
    """project_id, said: the first five of what is missing, by chapter title and segment id."""
    told = missing.join(chapters.select("project_id", "chapter_pos", "title"), ["project_id", "chapter_pos"], "left")
    rows = told.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", "line_pos", "seg_pos", F.concat("title", F.lit(" / seg "), "segment_id").alias("name")))).alias("s"))
    return rows.select("project_id", X.named_few(F.col("s.name")).alias("said"))


def distinct_work(work: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per key: key, text, clip_path, params, audio_seed. Equal text, clip and settings are rendered once."""
    voiced = work.join(paths.withColumnRenamed("speaker_id", "effective_id"), ["project_id", "effective_id"], "left").filter("clip_path is not null")
    return voiced.groupBy("key").agg(F.min(F.struct("text", "clip_path", "params", "audio_seed")).alias("w")).select("key", "w.*")


def rendered(work: DataFrame, speech: Callable[[], Speech], loudness: Callable[[bytes, dict], bytes] | None = None, counter=None) -> DataFrame:
    """key, wav, error: each row's sound. counter: an accumulator of the rows done. `speech` makes the provider once per task; what it raises becomes the row's error. The loudness
    step gets the row's own settings; one that fails leaves the sound as it came."""
    schema = pa.schema([("key", pa.string()), ("wav", pa.binary()), ("error", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        say = speech()
        for b in batches:
            out = []
            for r in b.to_pylist():
                settings = json.loads(r["params"] or "{}")
                params = X.render_params(settings, r["audio_seed"])
                try:
                    wav, error = say(r["text"], r["clip_path"], params), None
                except Exception as e:  # a provider may raise anything; one segment's failure is its own
                    wav, error = None, f"{type(e).__name__}: {e}"
                if wav is not None and loudness:
                    try:
                        wav = loudness(wav, settings)
                    except (ValueError, ArithmeticError):
                        pass
                out.append((r["key"], wav, error))
                if counter is not None:
                    counter.add(1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return work.select("key", "text", "clip_path", "params", "audio_seed").mapInArrow(task, "key string, wav binary, error string")


def stamped(segments: DataFrame, work: DataFrame, results: DataFrame) -> DataFrame:
    """All segments with key and status as the work left them: completed, or failed without a key. Others stay as they were."""
    done = work.select("project_id", "segment_id", "key").join(results.select("key", F.col("error").isNull().alias("ok")), "key", "left")
    done = done.select("project_id", "segment_id", F.when(F.col("ok"), F.col("key")).alias("new_key"), F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(True).alias("worked"))
    out = segments.join(done, ["project_id", "segment_id"], "left")
    worked = F.coalesce("worked", F.lit(False))
    return out.withColumn("audio_cache_key", F.when(worked, F.col("new_key")).otherwise(F.col("audio_cache_key"))).withColumn("audio_status", F.when(worked & F.col("ok"), "completed").when(worked, "failed").otherwise(F.col("audio_status"))).select(*segments.columns)


def synthesize(segments: DataFrame, speakers: DataFrame, clips: DataFrame, clip_files: DataFrame, params: DataFrame, audio: DataFrame, speech: Callable[[], Speech], loudness=None) -> tuple[DataFrame, DataFrame]:
    """The segments after rendering, and key, wav, error of what was rendered. audio: cache_key of the files there are."""
    work = worklist(segments, speakers, params, audio)
    results = rendered(distinct_work(work, clip_paths(speakers, clips, clip_files)), speech, loudness)
    return stamped(segments, work, results), results


def render_segment(segments: DataFrame, segment_id: str, speakers: DataFrame, clips: DataFrame, clip_files: DataFrame, params: DataFrame, speech: Callable[[], Speech], loudness=None) -> tuple[DataFrame, bytes]:
    """One segment rendered now, current or not: the segments with its stamp, and the sound. A missing voice or a provider's error is
    raised, and then nothing is stamped."""
    one = with_keys(segments.filter((F.col("segment_id") == segment_id) & X.is_renderable("text")), speakers, params)
    work = distinct_work(one, clip_paths(speakers, clips, clip_files))
    row = rendered(work, speech, loudness).first()
    if row is None:
        raise PreconditionError(f"segment {segment_id!r} has nothing to say or no voice")
    if row["error"]:
        raise SpeechProviderError(row["error"])
    result = segments.sparkSession.createDataFrame([(row["key"], None)], "key string, error string")
    return stamped(segments, one, result), bytes(row["wav"])


def outcome(segments: DataFrame) -> DataFrame:
    """project_id, total, done, failed, status: completed unless everything that was tried failed."""
    s = X.is_rendered("audio_status")
    f = F.coalesce(F.col("audio_status") == "failed", F.lit(False))
    said = X.is_renderable("text")
    rows = segments.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(said & s).alias("done"), F.count_if(said & f).alias("failed"))
    return rows.withColumn("status", F.when((F.col("failed") > 0) & (F.col("done") == 0), "failed").otherwise("completed"))
