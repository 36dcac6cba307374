"""When each chapter of an audiobook begins and ends, and the text files an assembler takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed pauses in seconds: between lines, between segments of a line, between chapters.
LINE_GAP, SEGMENT_GAP, CHAPTER_GAP = 0.4, 0.0, 1.0


def chapter_lengths(chapters: DataFrame, segments: DataFrame, line_gap: float = LINE_GAP, segment_gap: float = SEGMENT_GAP) -> DataFrame:
    """project_id, chapter_pos, title, length, spoken: seconds of sound and pauses in each chapter. segments: with duration."""
    said = segments.filter(X.is_renderable("text")).groupBy("project_id", "chapter_pos").agg(F.sum("duration").alias("sound"), F.count(F.lit(1)).alias("n"), F.countDistinct("line_pos").alias("lines"))
    length = F.col("sound") + (F.col("lines") - 1) * line_gap + (F.col("n") - F.col("lines")) * segment_gap
    out = chapters.select("project_id", "chapter_pos", "title").join(said, ["project_id", "chapter_pos"], "left")
    return out.select("project_id", "chapter_pos", "title", F.coalesce(length, F.lit(0.0)).alias("length"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("spoken"))


def chapter_markers(lengths: DataFrame, chapter_gap: float = CHAPTER_GAP) -> DataFrame:
    """project_id, chapter_pos, title, start_s, end_s. The pause after a chapter belongs to neither; there is none after the last
    chapter and none before any sound. One window per project, over its chapters."""
    book = Window.partitionBy("project_id").orderBy("chapter_pos")
    heard = F.max(F.col("spoken").cast("int")).over(book.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0
    last = F.lead("chapter_pos").over(book).isNull()
    step = lengths.withColumn("step", F.col("length") + F.when(heard & ~last, chapter_gap).otherwise(0.0))
    start = F.coalesce(F.sum("step").over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return step.withColumn("start_s", start).select("project_id", "chapter_pos", "title", "start_s", (F.col("start_s") + F.col("length")).alias("end_s"))


def ffmetadata(markers: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, metadata: the file of titles and chapters."""
    block = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), X.milliseconds("start_s").cast("string"), F.lit("\nEND="), X.milliseconds("end_s").cast("string"), F.lit("\ntitle="), X.escape_ffmetadata("title"))
    blocks = markers.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", block.alias("b")))).alias("bs"))
    title, author = X.escape_ffmetadata("title"), X.escape_ffmetadata("author")
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nartist="), author, F.lit("\nalbum="), title)
    rows = projects.select("project_id", head.alias("head")).join(blocks, "project_id", "left")
    return rows.select("project_id", F.concat("head", F.coalesce(F.concat(F.lit("\n"), F.array_join("bs.b", "\n")), F.lit("")), F.lit("\n")).alias("metadata"))


def playlist(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """project_id, chapter_pos, line_pos, seg_pos, part, path: what is played in order, pauses among them (part 0: a pause before the
    segment, 1: the segment, 2: the pause after its chapter). segments: with path, line_silence, chapter_silence (their files)."""
    said = segments.filter(X.is_renderable("text"))
    line = Window.partitionBy("project_id", "chapter_pos").orderBy("line_pos", "seg_pos")
    last = chapters.groupBy("project_id").agg(F.max("chapter_pos").alias("last_chapter"))
    marked = said.withColumn("n", F.row_number().over(line)).withColumn("was", F.lag("line_pos").over(line)).withColumn("is_last", F.lead("line_pos").over(line).isNull())
    key = ["project_id", "chapter_pos", "line_pos", "seg_pos"]
    sounds = marked.select(*key, F.lit(1).alias("part"), "path")
    between = marked.filter("n > 1 and was <> line_pos").select(*key, F.lit(0).alias("part"), F.col("line_silence").alias("path"))
    # Every chapter after the first sound has a pause after it, silent chapters too, but for the last chapter.
    first = said.groupBy("project_id").agg(F.min("chapter_pos").alias("first_spoken"), F.min("chapter_silence").alias("path"))
    end = F.lit((1 << 31) - 1)
    after = chapters.select("project_id", "chapter_pos").join(first, "project_id").join(last, "project_id").filter("chapter_pos >= first_spoken and chapter_pos < last_chapter")
    after = after.select("project_id", "chapter_pos", end.alias("line_pos"), end.alias("seg_pos"), F.lit(2).alias("part"), "path")
    return sounds.unionByName(between).unionByName(after)


def concat_list(played: DataFrame) -> DataFrame:
    """project_id, listing: the file that names, in order, what is played."""
    entry = F.concat(F.lit("file '"), F.replace(F.col("path"), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    rows = played.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", "line_pos", "seg_pos", "part", entry.alias("e")))).alias("es"))
    return rows.select("project_id", F.concat(F.array_join("es.e", "\n"), F.lit("\n")).alias("listing"))


def silence_name(seconds, rate, channels, width):
    """The file name of a pause in a format."""
    return F.format_string("silence_%04dms_%dhz_%dch_%db.wav", F.bround(seconds * 1000).cast("int"), rate, channels, width)


def output_name(title):
    return F.concat(X.sanitize_filename(title), F.lit(".m4b"))
