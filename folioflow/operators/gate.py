"""What still blocks a review, and how far a project has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import STAGES
from .voice import unresolved_voices


def blockers(segments: DataFrame, suggestions: DataFrame, voices: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, needs_attribution, pending_suggestions, unassigned_voices: ids and names in reading order. voices: of unresolved_voices."""
    ids = lambda df, pos, name: df.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", "line_pos", pos, name))).alias("s")).select("project_id", F.col(f"s.{name}").alias(name))
    a = ids(segments.filter("review_status = 'needs_review'"), "seg_pos", "segment_id").withColumnRenamed("segment_id", "needs_attribution")
    s = ids(suggestions.filter("status = 'pending'"), "sug_pos", "suggestion_id").withColumnRenamed("suggestion_id", "pending_suggestions")
    v = voices.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("s")).select("project_id", F.col("s.name").alias("unassigned_voices"))
    none = F.array().cast("array<string>")
    out = projects.select("project_id").join(a, "project_id", "left").join(s, "project_id", "left").join(v, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, none).alias(c) for c in ("needs_attribution", "pending_suggestions", "unassigned_voices")])


def project_blockers(segments, suggestions, speakers, clips, files, projects) -> DataFrame:
    return blockers(segments, suggestions, unresolved_voices(segments, speakers, clips, files), projects)


def open_counts(segments: DataFrame, suggestions: DataFrame, voices: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, n_attributions, n_suggestions, unassigned_voices (names in reading order): what blocks a review, counted where it is
    and not gathered. voices: of unresolved_voices."""
    n = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    v = voices.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("s")).select("project_id", F.col("s.name").alias("unassigned_voices"))
    out = projects.select("project_id").join(n(segments.filter("review_status = 'needs_review'"), "n_attributions"), "project_id", "left")
    out = out.join(n(suggestions.filter("status = 'pending'"), "n_suggestions"), "project_id", "left").join(v, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_attributions", "n_suggestions")], F.coalesce("unassigned_voices", F.array().cast("array<string>")).alias("unassigned_voices"))


def review_state(segments, suggestions, speakers, clips, files, projects) -> DataFrame:
    """As summary(), from counts."""
    c = open_counts(segments, suggestions, unresolved_voices(segments, speakers, clips, files), projects)
    a, s, v = F.col("n_attributions"), F.col("n_suggestions"), F.size("unassigned_voices")
    return c.select("project_id", a, s, v.alias("n_voices"), (a + s + v == 0).alias("complete"), X.describe_blockers(a, s, F.col("unassigned_voices")).alias("summary"))


def summary(blocked: DataFrame) -> DataFrame:
    """project_id, n_attributions, n_suggestions, n_voices, complete, summary."""
    a, s, v = F.size("needs_attribution"), F.size("pending_suggestions"), F.size("unassigned_voices")
    return blocked.select("project_id", a.alias("n_attributions"), s.alias("n_suggestions"), v.alias("n_voices"), (a + s + v == 0).alias("complete"), X.describe_blockers(a, s, F.col("unassigned_voices")).alias("summary"))


def stages(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STAGES)), "stage_pos int, stage string")


def stage_rows(projects: DataFrame) -> DataFrame:
    """project_id, stage_pos, stage, status, is_complete, is_next: each stage of each project. stage_status: map of stage to status."""
    named = F.array(*[F.struct(F.lit(i).alias("stage_pos"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    rows = projects.select("project_id", "stage_status", F.inline(named)).withColumn("status", F.coalesce(F.element_at("stage_status", F.col("stage")), F.lit("pending"))).drop("stage_status")
    rows = rows.withColumn("is_complete", F.col("status") == "completed")
    first = rows.filter(~F.col("is_complete")).groupBy("project_id").agg(F.min("stage_pos").alias("next_pos"))
    return rows.join(first, "project_id", "left").withColumn("is_next", F.coalesce(F.col("stage_pos") == F.col("next_pos"), F.lit(False))).drop("next_pos")


def next_stage(projects: DataFrame) -> DataFrame:
    """project_id, next_stage: the first stage that isn't complete; null if all are."""
    todo = stage_rows(projects).groupBy("project_id").agg(F.min_by(F.when(~F.col("is_complete"), F.col("stage")), F.when(~F.col("is_complete"), F.col("stage_pos"))).alias("next_stage"))
    return todo


def due(projects: DataFrame, stage: str) -> DataFrame:
    """project_id of the projects whose state permits the stage: it isn't complete there, and all before it are."""
    done = lambda name: F.coalesce(F.element_at("stage_status", F.lit(name)) == "completed", F.lit(False))
    ready = ~done(stage)
    for name in STAGES[: STAGES.index(stage)]:
        ready = ready & done(name)
    return projects.filter(ready).select("project_id")


def marked(projects: DataFrame, stage: str, results: DataFrame) -> DataFrame:
    """Projects with the stage marked as completed where it was; where it failed, was stopped or needs a review it has no mark. results:
    project_id, status; projects without a result stay as they are."""
    told = results.select("project_id", F.col("status").alias("told"))
    others = F.map_filter(F.coalesce("stage_status", F.create_map().cast("map<string,string>")), lambda k, _: k != stage)
    mark = F.when(F.col("told").isNull(), F.col("stage_status")).when(F.col("told") == "completed", F.map_concat(others, F.create_map(F.lit(stage), F.lit("completed")))).otherwise(others)
    return projects.join(told, "project_id", "left").withColumn("stage_status", mark).select(*projects.columns)


def counted(results: DataFrame) -> DataFrame:
    """stage, status, projects, message (of the first project): how many projects ended how."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = results.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("projects"), F.min_by("message", "project_id").alias("message"))
    return rows.orderBy(order, "status")


def outcome(results: DataFrame, summaries: DataFrame, until: str | None = None) -> DataFrame:
    """project_id, kind, summary of how a run ended. results: project_id, stage, status, message."""
    out = results.join(summaries.select("project_id", F.col("summary").alias("blocked")), "project_id", "left")
    early = F.lit(until is not None) & (F.col("stage") != STAGES[-1])
    done = F.col("status") == "completed"
    kind = F.when(done & early, "stopped").when(done, "completed").when(F.col("status") == "needs_review", "needs_review").when(F.col("status") == "stopped", "stopped").otherwise("failed")
    said = F.when(done & early, F.concat(F.lit("stopped after "), "stage")).when(done, "complete").when(F.col("status") == "needs_review", F.col("blocked")).when(F.col("status") == "stopped", "stopped").otherwise(F.concat(F.lit("failed: "), F.coalesce("message", F.lit(""))))
    return out.select("project_id", kind.alias("kind"), said.alias("summary"))
