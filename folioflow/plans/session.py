"""A corpus of books as a set of stored tables, and the six stages that bring it from books to audiobooks.

A stage takes the projects whose state permits it: all stages before are complete there and it isn't. It plans its work on all of them at
once and commits what it changed, how it ended for each project, and its mark, in one manifest. A project that fails, or needs a
review, or was stopped, has no mark and waits; the others go on to the next stage. Rerun, a stage goes on where it was: lines that are
attributed and sounds that are rendered aren't asked for again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import FolioError, PreconditionError, StoppedError
from ..functions import text as X
from ..operators import actions, attribute, correct, gate, render, resolve, segment, timeline, voice
from ..schema import STAGES, TABLES, VERSION
from ..sources import epub, m4b
from ..sources.audio import Loudness, normalize_wav
from ..sources.store import Manifest, Store
from .progress import Watch

#: Segments that one task renders: what a stop, or a lost executor, can cost at most. Tasks of one run at most.
A_TASK, MOST_TASKS = 16, 100_000
#: Books read by their paths; more are read from the folder that holds all of them.
MOST_PATHS = 200


@dataclass
class Providers:
    """What a run needs from outside: makers of a language and a speech provider, a dictionary (word, freq), and the files there are."""

    language: Callable[[], attribute.LanguageProvider] | None = None
    speech: Callable[[], render.Speech] | None = None
    dictionary: DataFrame | None = None
    clip_files: DataFrame | None = None
    encoder: m4b.Encoder = m4b.ffmpeg
    segmenter: segment.Segmenter = X.quote_spans
    filesystems: m4b.FileSystems = m4b.open_filesystem


@dataclass
class Result:
    """How a stage, or the last stage of each project of a run, ended. projects: project_id, stage, status, message."""

    stage: str
    projects: DataFrame

    @cached_property
    def counts(self) -> list:
        return gate.counted(self.projects).collect()

    @property
    def status(self) -> str:
        """The worst there is among the projects."""
        found = {r["status"] for r in self.counts}
        return next((s for s in ("failed", "stopped", "needs_review") if s in found), "completed")

    @property
    def message(self) -> str:
        return "; ".join(f"{r['projects']} {r['status']} at {r['stage']}" + f" ({r['message']})" * bool(r["message"]) for r in self.counts)


@dataclass
class Changes:
    """What a stage wants to commit: tables that take the place of theirs, rows that are added, and project_id, status, message."""

    results: DataFrame
    replace: dict[str, DataFrame] = field(default_factory=dict)
    append: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Corpus:
    spark: SparkSession
    path: str
    providers: Providers = field(default_factory=Providers)
    config: Config = field(default_factory=Config)
    watch: Watch = field(default_factory=Watch)
    _kept: list[str] = field(default_factory=list, init=False, repr=False)

    # --- storage ---

    @cached_property
    def store(self) -> Store:
        return Store(self.spark, self.path, TABLES)

    def tables(self, at: Manifest | None = None) -> dict[str, DataFrame]:
        """The tables as the last manifest, or a given one, has them; the next save starts from it."""
        self._base = at or self.store.current()
        return {n: self.store.table(self._base, n) for n in TABLES}

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def kept(self, df: DataFrame) -> DataFrame:
        """Rows that must not be computed twice, as a provider's answers, which may differ when asked for again: written before anything
        reads them."""
        return self.kept_all([df])

    def kept_all(self, frames: Iterable[DataFrame]) -> DataFrame:
        """The rows of several frames, of one schema, written one frame after the other. What made one can be forgotten before the next."""
        path = self._new_path()
        for df in frames:
            df.write.mode("append").parquet(path)
            schema = df.schema
        return self.spark.read.schema(schema).parquet(path)

    def _new_path(self) -> str:
        self._kept.append(f"{self.path}/answers/{uuid.uuid4().hex}")
        return self._kept[-1]

    def forget(self) -> None:
        """Removes what was kept; after a commit nothing reads it."""
        for path in self._kept:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self._kept.clear()

    def save(self, append: Mapping[str, DataFrame] | None = None, **replace: DataFrame) -> Manifest:
        """Commits tables made from the last tables(). Refused if another writer has replaced one of them meanwhile."""
        self._base = self.store.commit(getattr(self, "_base", None) or self.store.current(), replace, append)
        return self._base

    def create(self, ebooks: str) -> None:
        """A project for each book below a folder that has none yet. Nothing is read but names: a book is parsed by its first stage."""
        t = self.tables()
        with epub.packed(self.spark):
            named = self.kept_all(epub.book_files(self.spark, p) for p in epub.parts(self.spark, ebooks))
        books = named.join(t["projects"].select("project_id"), "project_id", "left_anti")
        params = X.canonical_params(self.config.project_params())
        name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
        none = F.lit(None).cast("string")
        made = books.select("project_id", F.lit(VERSION).alias("schema_version"), name.alias("name"), F.lit(self.path).alias("workspace_dir"), name.alias("title"), none.alias("author"), F.col("path").alias("source_ebook_path"), none.alias("cover_image_path"), F.create_map().cast("map<string,string>").alias("stage_status"), F.lit(params).alias("tts_params"))
        try:
            self.save(append={"projects": made})
        finally:
            self.forget()

    # --- stages ---

    def _books(self, todo: DataFrame) -> Iterator[DataFrame]:
        """The parsed books of projects. A few are read by their paths, more from the folder above all of them, a part of it at a time."""
        paths = [r[0] for r in todo.select("source_ebook_path").limit(MOST_PATHS + 1).collect()]
        if len(paths) <= MOST_PATHS:
            yield epub.read_books(self.spark, paths, strict=False)
            return
        ends = todo.agg(F.min("source_ebook_path").alias("a"), F.max("source_ebook_path").alias("b")).first()
        same = next((i for i, (x, y) in enumerate(zip(ends["a"], ends["b"], strict=False)) if x != y), len(ends["a"]))
        for part in epub.parts(self.spark, ends["a"][:same].rsplit("/", 1)[0]):
            # Only the projects whose books may lie there are looked through: all paths below a folder lie between it and it with the
            # character after the slash, files at themselves.
            own = todo if isinstance(part, str) else todo.filter(F.col("source_ebook_path").between(min(part), max(f"{p}0" for p in part)))
            yield epub.read_books(self.spark, part, strict=False).join(own.select("project_id"), "project_id", "left_semi")

    def _parse(self, t: dict[str, DataFrame], todo: DataFrame) -> Changes:
        open_ = t["projects"].join(todo, "project_id", "left_semi").join(t["chapters"].select("project_id").distinct(), "project_id", "left_anti")
        open_ = self.kept(open_.select("project_id", "source_ebook_path"))
        with epub.packed(self.spark):
            books = self.kept_all(self._books(open_))  # parsed once; all that follows reads what was found
        told = epub.book_results(books, open_.select("project_id"))
        good = books.join(told.filter("status = 'completed'"), "project_id", "left_semi")
        chapters, lines = epub.book_tables(good)
        results = told.unionByName(all_of(todo.join(open_, "project_id", "left_anti"), "completed", ""))
        return Changes(results, {"projects": epub.merged_metadata(t["projects"], good)}, {"chapters": chapters, "lines": lines})

    def _correct(self, t: dict[str, DataFrame], todo: DataFrame) -> Changes:
        if self.providers.dictionary is None:
            return Changes(all_of(todo, "completed", "no dictionary, nothing corrected"))
        own = t["lines"].join(todo, "project_id", "left_semi")
        protected = correct.protected_words(own, t["speakers"].join(todo, "project_id", "left_semi"))
        found = correct.candidates(correct.uncorrected(own, t["suggestions"]), self.providers.dictionary, protected)
        lines, made = correct.apply_candidates(t["lines"], self.kept(found))
        return Changes(all_of(todo, "completed", "lines corrected"), {"lines": lines}, {"suggestions": made})

    def _attribute(self, t: dict[str, DataFrame], todo: DataFrame) -> Changes:
        speakers = resolve.with_narrators(t["speakers"], t["projects"].join(todo, "project_id", "left_semi"))
        narrators = resolve.narrators(speakers).select("project_id", "narrator_id")
        lines = segment.unattributed(t["lines"].join(todo, "project_id", "left_semi"), t["segments"])
        new = segment.line_segments(lines, narrators, segmenter=self.providers.segmenter)
        if new.isEmpty():
            return Changes(all_of(todo, "completed", ""))
        if self.providers.language is None or not self.providers.language().is_available():
            open_ = lines.select("project_id").distinct()
            return Changes(all_of(todo.join(open_, "project_id", "left_anti"), "completed", "").unionByName(all_of(open_, "failed", "no language provider")))
        answers = self.kept(attribute.attribute_books(attribute.contexts(new, lines), speakers, self.providers.language))
        broken = answers.filter("error is not null").groupBy("project_id").agg(F.min(F.struct("chapter_pos", "window")).alias("end"), F.min("error").alias("message"))
        # What a book was asked before its provider failed stays.
        reached = attribute.windows(lines).join(broken, "project_id", "left").filter(F.col("end").isNull() | (F.struct("chapter_pos", "window") < F.col("end")))
        new = new.join(reached.select(*segment.KEY), list(segment.KEY), "left_semi")
        wanted = new.filter("review_status = 'needs_review'").select("project_id", "segment_id")
        said = attribute.told(answers)
        told = attribute.with_defaults(wanted, said.filter("answered"))
        order = said.select("project_id", "segment_id", F.col("seq").alias("pos"))
        named, every = resolve.resolve_names(told.join(order, ["project_id", "segment_id"], "left"), speakers)
        made = attribute.apply_attributions(new, named)
        every = self.kept(attribute.classify_speakers(every, t["segments"].unionByName(made.select(*t["segments"].columns)), self.providers.language))
        fine = todo.join(broken, "project_id", "left_anti")
        results = all_of(fine, "completed", "quotes attributed").unionByName(broken.select("project_id", F.lit("failed").alias("status"), "message"))
        return Changes(results, {"speakers": every}, {"segments": made})

    def blockers(self, t: dict[str, DataFrame] | None = None) -> DataFrame:
        t = t or self.tables()
        return gate.project_blockers(t["segments"], t["suggestions"], t["speakers"], t["voice_clips"], self.clip_files(), t["projects"])

    def review_state(self, t: dict[str, DataFrame] | None = None) -> DataFrame:
        """How many blockers of each kind a project has, and in a line."""
        t = t or self.tables()
        return gate.review_state(t["segments"], t["suggestions"], t["speakers"], t["voice_clips"], self.clip_files(), t["projects"])

    def clip_files(self) -> DataFrame:
        return self.providers.clip_files if self.providers.clip_files is not None else self.spark.createDataFrame([], "path string")

    def _review(self, t: dict[str, DataFrame], todo: DataFrame) -> Changes:
        told = self.review_state(t).join(todo, "project_id", "left_semi")
        return Changes(told.select("project_id", F.when(F.col("complete"), "completed").otherwise("needs_review").alias("status"), F.when(F.col("complete"), "review complete").otherwise(F.col("summary")).alias("message")))

    def _synthesize(self, t: dict[str, DataFrame], todo: DataFrame) -> Changes:
        if self.providers.speech is None:
            return Changes(all_of(todo, "failed", "no speech provider"))
        missing = voice.unresolved_voices(t["segments"].join(todo, "project_id", "left_semi"), t["speakers"], t["voice_clips"], self.clip_files())
        names = F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"])
        unvoiced = missing.groupBy("project_id").agg(F.concat(F.lit("assign voices first: "), X.named_few(names)).alias("message"))
        unvoiced = self.kept(unvoiced.select("project_id", F.lit("failed").alias("status"), "message"))
        voiced = todo.join(unvoiced, "project_id", "left_anti")
        own = t["segments"].join(voiced, "project_id", "left_semi")
        params = t["projects"].select("project_id", F.col("tts_params").alias("params"))
        work = self.kept(render.worklist(own, t["speakers"], params, t["audio"].select("cache_key")))
        results, stopped = self._rendered(render.distinct_work(work, voice.clip_paths(t["speakers"], t["voice_clips"], self.clip_files())))
        made = results.filter("error is null").select(F.col("key").alias("cache_key"), X.audio_path("key").alias("path"), "wav")
        told = work.join(results.select("key").distinct(), "key", "left_semi") if stopped else work
        segments = render.stamped(t["segments"], told, results)
        ends = render.outcome(segments.join(voiced, "project_id", "left_semi"))
        open_ = work.join(results.select("key"), "key", "left_anti").select("project_id").distinct().withColumn("open", F.lit(stopped))
        ends = voiced.join(ends, "project_id", "left").join(open_, "project_id", "left")
        status = F.when(F.col("open"), "stopped").otherwise(F.coalesce("status", F.lit("completed")))
        message = F.when(F.col("open"), "stopped").when(F.col("status") == "failed", "all segments failed to synthesize").otherwise("segments synthesized")
        return Changes(unvoiced.unionByName(ends.select("project_id", status.alias("status"), message.alias("message"))), {"segments": segments}, {"audio": made})

    def _rendered(self, work: DataFrame) -> tuple[DataFrame, bool]:
        """key, wav, error of the work done, and whether it was stopped. A task's sounds are in place when it ends, whatever becomes of
        the others."""

        def loud(wav: bytes, settings: dict) -> bytes:
            s = Loudness.from_params(settings)
            return normalize_wav(wav, s) if s else wav

        work = self.kept(work)
        n = work.count()
        tasks = max(1, min(-(-n // A_TASK), MOST_TASKS))
        rows = render.rendered(work.repartition(tasks), self.providers.speech, loud, self.watch.counter(self.spark, n))
        path = self._new_path()
        write = rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        stopped = False
        try:
            self.watch.run(self.spark, "synthesize", lambda: write.parquet(path))
        except StoppedError:
            stopped = True
            self.spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)  # there may be no file at all
        return self.spark.read.schema(rows.schema).parquet(path), stopped

    def _assemble(self, t: dict[str, DataFrame], todo: DataFrame, folder: str | None = None) -> Changes:
        missing = render.unrendered(t["segments"].join(todo, "project_id", "left_semi"), t["audio"].select("cache_key"))
        said = render.unrendered_names(missing, t["chapters"]).select("project_id", F.lit("failed").alias("status"), F.concat(F.lit("not rendered: "), "said").alias("message"))
        said = self.kept(said)
        books = todo.join(said, "project_id", "left_anti")
        folder = folder or f"{self.path}/output"
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "16")  # a row may hold a sound of some megabytes
        try:
            listed = self.manifests(t).join(books, "project_id", "left_semi")
            made = self.kept(m4b.assemble_books(listed, folder, self.providers.encoder, self.sounds(t).join(books, "project_id", "left_semi"), self.providers.filesystems))
        finally:
            self.spark.conf.set(key, before)
        made = self.kept(m4b.publish(made, self.providers.filesystems))
        m4b.clear_staging(folder, self.providers.filesystems)
        told = books.join(made, "project_id", "left")
        ok = F.col("output").isNotNull()
        return Changes(said.unionByName(told.select("project_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(ok, "audiobook written").otherwise(F.coalesce("error", F.lit("there is nothing to play"))).alias("message"))))

    def sounds(self, t: dict[str, DataFrame]) -> DataFrame:
        """project_id, path, wav of what each book plays."""
        used = t["segments"].select("project_id", F.col("audio_cache_key").alias("cache_key")).distinct()
        return used.join(t["audio"].select("cache_key", "path", "wav"), "cache_key").select("project_id", "path", "wav")

    def manifests(self, t: dict[str, DataFrame]) -> DataFrame:
        """project_id, title, author, listing, metadata, cover_image_path of each book."""
        sounds = t["audio"].select(F.col("cache_key").alias("audio_cache_key"), "path", "wav")
        durations = wav_durations(sounds)
        s = t["segments"].join(durations, "audio_cache_key", "left")
        s = s.withColumns({"line_silence": timeline.silence_name(F.lit(timeline.LINE_GAP), F.col("rate"), F.col("channels"), F.col("width")), "chapter_silence": timeline.silence_name(F.lit(timeline.CHAPTER_GAP), F.col("rate"), F.col("channels"), F.col("width"))})
        listing = timeline.concat_list(timeline.playlist(s, t["chapters"]))
        marks = timeline.chapter_markers(timeline.chapter_lengths(t["chapters"], s))
        return t["projects"].select("project_id", "title", "author", "cover_image_path").join(timeline.ffmetadata(marks, t["projects"]), "project_id").join(listing, "project_id")

    # --- running ---

    def stage(self, name: str, only: DataFrame | None = None, **options) -> Result:
        """One stage for the projects `only` (project_id), all by default, in whatever state they are."""
        t = self.tables()
        base = self._base
        wanted = (t["projects"] if only is None else only).select("project_id").distinct()
        todo = self.kept(wanted)

        def work() -> None:
            changes = getattr(self, f"_{name}")(t, todo, **options)
            self._commit(base, t, name, changes)

        try:
            if name == "synthesize":  # watches its own jobs, and commits what was done before a stop
                work()
            else:
                self.watch.run(self.spark, name, work)
        except FolioError as e:
            told = all_of(todo, "stopped" if isinstance(e, StoppedError) else "failed", str(e))
            self._commit(base, t, name, Changes(told))
        finally:
            self.forget()
        return Result(name, self.tables()["stage_results"].filter(F.col("stage") == name).join(wanted, "project_id", "left_semi"))

    def _commit(self, base: Manifest, t: dict[str, DataFrame], name: str, changes: Changes) -> None:
        results = self.kept(changes.results.select("project_id", F.lit(name).alias("stage"), "status", "message"))
        others = t["stage_results"].join(results.select("project_id", "stage"), ["project_id", "stage"], "left_anti")
        replace = {"projects": t["projects"], **changes.replace}
        replace["projects"] = gate.marked(replace["projects"], name, results)
        replace["stage_results"] = others.unionByName(results)
        self._base = self.store.commit(base, replace, changes.append)

    def parse(self, only: DataFrame | None = None) -> Result:
        return self.stage("parse", only)

    def correct(self, only: DataFrame | None = None) -> Result:
        return self.stage("correct", only)

    def attribute(self, only: DataFrame | None = None) -> Result:
        return self.stage("attribute", only)

    def review(self, only: DataFrame | None = None) -> Result:
        return self.stage("review", only)

    def synthesize(self, only: DataFrame | None = None) -> Result:
        return self.stage("synthesize", only)

    def assemble(self, folder: str | None = None, only: DataFrame | None = None) -> Result:
        return self.stage("assemble", only, folder=folder)

    def run(self, until: str | None = None) -> Result:
        """All stages in order, or those up to `until`, each for the projects whose state permits it by then. The result has the last stage
        that each project was in; projects with nothing left to do aren't in it."""
        last: DataFrame | None = None
        for name in STAGES:
            due = gate.due(self.tables()["projects"], name)
            if not due.isEmpty():
                told = self.stage(name, due).projects
                last = told if last is None else last.join(told, "project_id", "left_anti").unionByName(told)
            if name == until or self.watch.asked.is_set():
                break
        return Result(until or STAGES[-1], last if last is not None else self.empty("stage_results"))

    def expire(self, keep: int = 5, older_than_s: float = 86_400) -> list[str]:
        """Drops old versions, and what stages have kept for themselves, after as long as a stage may run."""
        return self.store.expire(keep, older_than_s)

    def auto_accept(self) -> None:
        t = self.tables()
        segments, suggestions = actions.auto_accept(t["segments"], t["suggestions"])
        self.save(segments=segments, suggestions=suggestions)

    def assign_rest(self, overrides: dict[str, str | None] | None = None) -> DataFrame:
        """A clip by category for every speaker that needs one; counts by category. Refused if one isn't covered."""
        t = self.tables()
        plan = voice.bulk_plan(voice.unresolved_speakers(t["segments"], t["speakers"], t["voice_clips"], self.clip_files()), overrides or {}, self.config.voice_defaults).persist()
        try:
            if plan.isEmpty():
                raise PreconditionError("every speaker has a voice")
            # A row for each category, with some of the names of one project.
            bare = voice.uncovered(plan).groupBy("category").agg(X.named_few(F.min("names")).alias("names")).orderBy("category").collect()
            if bare:
                said = "; ".join(f"{r['category']} (speakers: {r['names']})" for r in bare)
                options = [f"--{r['category']}" for r in bare if r["category"] != "unknown"]
                raise PreconditionError(f"no clip for categories: {said}; pass {' / '.join([*options, '--default'])}")
            speakers, clips, counts = voice.apply_bulk(plan, t["speakers"], t["voice_clips"])
            counts = counts.groupBy("category").agg(F.sum("assigned").alias("assigned")).orderBy("category")
            counts = self.spark.createDataFrame(counts.collect(), counts.schema)
            self.save(speakers=speakers, voice_clips=clips, projects=actions.stale(t["projects"], plan.select("project_id"), actions.AUDIO))
        finally:
            plan.unpersist()
        return counts


def all_of(projects: DataFrame, status: str, message: str) -> DataFrame:
    return projects.select("project_id", F.lit(status).alias("status"), F.lit(message).alias("message"))


def wav_durations(sounds: DataFrame) -> DataFrame:
    """audio_cache_key, path, duration, rate, channels, width."""
    import pyarrow as pa

    from ..sources.audio import header

    schema = pa.schema([("audio_cache_key", pa.string()), ("path", pa.string()), ("duration", pa.float64()), ("rate", pa.int32()), ("channels", pa.int32()), ("width", pa.int32())])

    def task(batches):
        for b in batches:
            rows = []
            for key, path, wav in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rate, channels, width, frames = header(wav.as_py(), path)
                rows.append((key, path, frames / rate, rate, channels, width))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return sounds.select("audio_cache_key", "path", "wav").mapInArrow(task, "audio_cache_key string, path string, duration double, rate int, channels int, width int")
