"""Attribution of quotes to speakers by an external language provider: windows, prompts, answers, defaults.

Windows of a book run one after another, since each names the speakers that the ones before found; books run in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LanguageProviderError
from ..functions import text as X
from .resolve import NARRATOR_NAMES

#: Lines of one request, and sample lines of one speaker. Fixed values.
WINDOW_LINES, SAMPLES = 60, 3


@dataclass(frozen=True)
class Attribution:
    segment_id: str
    speaker: str | None
    confidence: float = 0.0
    rationale: str = ""


@dataclass(frozen=True)
class Profile:
    speaker_id: str
    name: str
    samples: Sequence[str] = field(default=())


class LanguageProvider:
    """What a provider of language answers has to do. Answers are plain text in the agreed JSON."""

    name = "none"

    def is_available(self) -> bool:
        return True

    def attribute(self, context: str, candidates: Sequence[str], known: Sequence[str]) -> str:
        raise NotImplementedError

    def classify(self, profiles: Sequence[Profile]) -> str:
        return json.dumps({"speakers": [{"speaker_id": p.speaker_id, "category": "unknown", "confidence": 0.0} for p in profiles]})


def windows(lines: DataFrame, size: int = WINDOW_LINES, key: tuple[str, ...] = ("project_id", "chapter_pos")) -> DataFrame:
    """Lines with window: consecutive groups of `size` of the lines there are, in each chapter."""
    order = Window.partitionBy(*key).orderBy("line_pos")
    return lines.withColumn("window", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def tagged_lines(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """key, tagged: lines with `[SEG id] ` before each quote, by place: spans follow one another in the text."""
    key = ["project_id", "chapter_pos", "line_pos"]
    quotes = segments.filter("review_status = 'needs_review'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seg_pos", "segment_id", "text"))).alias("q"))
    start = F.struct(F.lit("").alias("done"), F.col("text").alias("rest"))

    def put(acc, q):
        at = F.instr(acc["rest"], q["text"])
        head = F.substr(acc["rest"], F.lit(1), at - 1)
        return F.when(at == 0, acc).otherwise(F.struct(F.concat(acc["done"], head, F.lit("[SEG "), q["segment_id"], F.lit("] "), q["text"]).alias("done"), F.substr(acc["rest"], at + F.length(q["text"])).alias("rest")))

    joined = lines.select(*key, "text").join(quotes, key, "left")
    told = F.aggregate("q", start, put, lambda acc: F.concat(acc["done"], acc["rest"]))
    return joined.select(*key, F.when(F.col("q").isNull(), F.col("text")).otherwise(told).alias("tagged"))


def contexts(segments: DataFrame, lines: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """project_id, chapter_pos, window, context, candidates: a request for each window that has quotes."""
    key = ["project_id", "chapter_pos", "line_pos"]
    placed = windows(lines, size)
    told = tagged_lines(segments, lines).join(placed.select(*key, "window"), key)
    w = ["project_id", "chapter_pos", "window"]
    texts = told.groupBy(*w).agg(F.array_sort(F.collect_list(F.struct("line_pos", "tagged"))).alias("t"))
    numbered = F.transform("t", lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), x["tagged"]))
    body = F.concat(F.lit("Attribute each marked quote to its speaker. Lines:\n"), F.array_join(numbered, "\n"), F.lit("\nReturn one entry per SEG id."))
    ids = segments.filter("review_status = 'needs_review'").join(placed.select(*key, "window"), key).groupBy(*w).agg(F.array_sort(F.collect_list(F.struct("line_pos", "seg_pos", "segment_id"))).alias("c"))
    return texts.join(ids, w).select(*w, body.alias("context"), F.col("c.segment_id").alias("candidates"))


def parse_attributions(answer: str, candidates: Sequence[str]) -> list[Attribution]:
    """One attribution per candidate, in order: of answers to the same id the last, of none the narrator at 0.0. Answers to ids nobody
    asked for are dropped. A confidence that is no number counts as 0.0; anything else out of form is malformed."""
    try:
        entries = json.loads(answer)["attributions"]
        if not isinstance(entries, list):
            raise TypeError("no list")
        got = {str(e["segment_id"]): e for e in entries}
    except (ValueError, KeyError, TypeError) as e:
        raise LanguageProviderError(f"answer out of form: {e}", malformed=True) from e
    out = []
    for c in candidates:
        e = got.get(c)
        if e is None:
            out.append(Attribution(c, None, 0.0, "missing"))
            continue
        who = e.get("speaker")
        name = None if who is None or str(who).casefold() in NARRATOR_NAMES else str(who)
        out.append(Attribution(c, name, number(e.get("confidence")), str(e.get("rationale", ""))))
    return out


#: The agreed forms of answers. Numbers are read as text, so that one out of form doesn't spoil its entry.
ATTRIBUTIONS = "attributions array<struct<segment_id:string,speaker:string,confidence:string,rationale:string>>"
CLASSIFICATIONS = "classifications array<struct<speaker_id:string,category:string,confidence:string>>"


def _entries(form: str, key: str) -> Column:
    """The entries of the column `answer`; null where it isn't in the agreed form: no object, no list, an entry without its id."""
    found = F.from_json("answer", form)[form.split(" ")[0]]
    return F.when(F.ltrim("answer").startswith("{") & F.forall(found, lambda e: e[key].isNotNull()), found)


def _confidence(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def read_attributions(answers: DataFrame) -> DataFrame:
    """answers (answer and candidates, and any other columns, kept) by candidate: at (its place), segment_id, speaker, confidence, answered,
    malformed. As parse_attributions, on the JVM: of answers to the same id the last counts, of none the narrator at 0.0; a null answer
    is none at all."""
    kept = [c for c in answers.columns if c not in ("answer", "candidates")]
    read = answers.select(*kept, "answer", "candidates", _entries(ATTRIBUTIONS, "segment_id").alias("entries"))
    each = read.select(*kept, "answer", "entries", F.posexplode("candidates").alias("at", "segment_id"))
    own = F.filter("entries", lambda e: e["segment_id"] == F.col("segment_id"))
    each = each.withColumn("own", F.try_element_at(own, F.lit(-1)))
    name = F.when(X.fold("own.speaker").isin(*NARRATOR_NAMES), None).otherwise(F.col("own.speaker"))
    return each.select(*kept, "at", "segment_id", name.alias("speaker"), _confidence(F.col("own.confidence")).alias("confidence"), F.col("own").isNotNull().alias("answered"), (F.col("answer").isNotNull() & F.col("entries").isNull()).alias("malformed"))


def read_categories(answers: DataFrame) -> DataFrame:
    """answers (answer and wanted, and any other columns, kept) by wanted speaker: speaker_id, category, confidence; unknown at 0.0 where a
    well-formed answer says nothing usable. Malformed answers have no rows."""
    kept = [c for c in answers.columns if c not in ("answer", "wanted")]
    read = answers.select(*kept, "wanted", _entries(CLASSIFICATIONS, "speaker_id").alias("entries")).filter("entries is not null")
    each = read.select(*kept, "entries", F.explode("wanted").alias("speaker_id"))
    each = each.withColumn("own", F.try_element_at(F.filter("entries", lambda e: e["speaker_id"] == F.col("speaker_id")), F.lit(-1)))
    return each.select(*kept, "speaker_id", X.coerce_category("own.category").alias("category"), _confidence(F.col("own.confidence")).alias("confidence"))


def number(x: object) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0


def ask_raw(provider: LanguageProvider, context: str, candidates: Sequence[str], known: Sequence[str]) -> tuple[str, list[Attribution]] | None:
    """The provider's answer and what it says; asked once more if malformed or about none of the candidates; null if that doesn't help."""
    for _ in range(2):
        try:
            raw = provider.attribute(context, candidates, known)
            found = parse_attributions(raw, candidates)
        except LanguageProviderError as e:
            if e.malformed:
                continue
            raise
        if any(a.rationale != "missing" for a in found):
            return raw, found
    return None


def ask(provider: LanguageProvider, context: str, candidates: Sequence[str], known: Sequence[str]) -> list[Attribution] | None:
    """The provider's attributions, if it has any."""
    found = ask_raw(provider, context, candidates, known)
    return found[1] if found else None


def attribute_books(requests: DataFrame, speakers: DataFrame, provider: Callable[[], LanguageProvider]) -> DataFrame:
    """project_id, chapter_pos, window, candidates, answer, error of every request; told() reads the answers. A book's windows are asked
    in order in one task and each knows the characters of those before. Where the provider fails, the row has the error, and the book's
    later windows aren't asked; other books go on."""
    names = speakers.filter("role = 'character'").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("speaker_pos", "name"))).alias("s")).select("project_id", F.col("s.name").alias("known"))
    book = requests.join(names, "project_id", "left")
    schema = pa.schema([("project_id", pa.string()), ("chapter_pos", pa.int32()), ("window", pa.int32()), ("candidates", pa.list_(pa.string())), ("answer", pa.string()), ("error", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        project, known, seen, failed = None, [], set(), False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["project_id"] != project or project is None:
                    project, known, failed = r["project_id"], list(r["known"] or []), False
                    seen = {n.casefold() for n in known}
                if failed:
                    continue
                answer, error = None, None
                try:
                    own = own or provider()
                    if got := ask_raw(own, r["context"], r["candidates"], known):
                        answer = got[0]
                        for c in got[1]:
                            if c.speaker and c.speaker.casefold() not in seen:
                                seen.add(c.speaker.casefold())
                                known.append(c.speaker)
                except Exception as e:  # a provider may raise anything; one book's failure is its own
                    failed, error = True, f"{type(e).__name__}: {e}"
                out.append((project, r["chapter_pos"], r["window"], r["candidates"], answer, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ordered = book.repartition("project_id").sortWithinPartitions("project_id", "chapter_pos", "window")
    asked = ordered.select("project_id", "chapter_pos", "window", "context", "candidates", "known")
    return asked.mapInArrow(task, "project_id string, chapter_pos int, window int, candidates array<string>, answer string, error string")


def told(answers: DataFrame) -> DataFrame:
    """project_id, seq (order in the book), segment_id, speaker, confidence, answered of what attribute_books was answered."""
    each = read_attributions(answers.filter("error is null").select("project_id", "chapter_pos", "window", "candidates", "answer"))
    seq = F.col("chapter_pos").cast("long") * (1 << 40) + F.col("window").cast("long") * (1 << 16) + F.col("at")
    return each.select("project_id", seq.alias("seq"), "segment_id", "speaker", "confidence", "answered")


def with_defaults(requested: DataFrame, results: DataFrame) -> DataFrame:
    """requested (project_id, segment_id) with name, confidence, answered: the last result of each id, else no name at 0.0."""
    last = results.groupBy("project_id", "segment_id").agg(F.max_by(F.struct("speaker", "confidence"), "seq").alias("r")).select("project_id", "segment_id", F.col("r.speaker").alias("name"), F.col("r.confidence").alias("confidence"), F.lit(True).alias("answered"))
    out = requested.join(last, ["project_id", "segment_id"], "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("answered", F.coalesce("answered", F.lit(False)))


def apply_attributions(segments: DataFrame, told: DataFrame, threshold: float = X.APPROVE_FROM) -> DataFrame:
    """Segments with what the provider said. told: project_id, segment_id, speaker_id, role, confidence, answered."""
    new = told.select("project_id", "segment_id", F.when(F.col("answered"), F.col("speaker_id")).alias("n_speaker"), F.when(F.col("answered"), F.col("role")).otherwise("narrator").alias("n_role"), F.when(F.col("answered"), F.col("confidence")).otherwise(0.0).alias("n_conf"), F.when(F.col("answered"), X.review_status("confidence", threshold)).otherwise("needs_review").alias("n_status"), F.lit(True).alias("n"))
    out = segments.join(new, ["project_id", "segment_id"], "left")
    pick = lambda a, b: F.when(F.col("n"), F.col(a)).otherwise(F.col(b))
    return out.withColumns({"speaker_id": pick("n_speaker", "speaker_id"), "role": pick("n_role", "role"), "confidence": pick("n_conf", "confidence"), "review_status": pick("n_status", "review_status")}).select(*segments.columns)


def speaker_samples(segments: DataFrame, most: int = SAMPLES) -> DataFrame:
    """project_id, speaker_id, samples: the first few things each character says, in reading order."""
    said = segments.filter(X.is_renderable("text") & (F.col("role") == "character") & F.col("speaker_id").isNotNull())
    order = Window.partitionBy("project_id", "speaker_id").orderBy("chapter_pos", "line_pos", "seg_pos")
    few = said.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return few.groupBy("project_id", "speaker_id").agg(F.array_sort(F.collect_list(F.struct("n", X.strip("text").alias("t")))).alias("s")).select("project_id", "speaker_id", F.col("s.t").alias("samples"))


def classify_prompts(speakers: DataFrame, samples: DataFrame) -> DataFrame:
    """project_id, prompt, wanted: one request per project about its characters of unknown category."""
    todo = speakers.filter("role = 'character' and category = 'unknown'").join(samples, ["project_id", "speaker_id"], "left")
    said = X.strip(F.array_join(F.coalesce("samples", F.array().cast("array<string>")), " "))
    note = F.when(said == "", F.lit(" — (no sample lines)")).otherwise(F.concat(F.lit(" — sample lines: "), said))
    row = F.concat(F.lit("["), "speaker_id", F.lit("] "), "name", note)
    rows = todo.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("speaker_pos", "speaker_id", "name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), row.alias("row")))).alias("p"))
    body = F.concat(F.lit("Classify each speaker's voice category. Speakers:\n"), F.array_join("p.row", "\n"), F.lit("\nReturn one entry per speaker_id."))
    return rows.select("project_id", body.alias("prompt"), F.col("p.speaker_id").alias("wanted"), F.col("p.name").alias("names"), F.col("p.samples").alias("samples"))


def classify_speakers(speakers: DataFrame, segments: DataFrame, provider: Callable[[], LanguageProvider]) -> DataFrame:
    """Speakers with a category for the characters that had none. What the provider gets wrong changes nothing."""
    schema = pa.schema([("project_id", pa.string()), ("wanted", pa.list_(pa.string())), ("answer", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = provider()
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    out.append((r["project_id"], r["wanted"], own.classify([Profile(i, n, s) for i, n, s in zip(r["wanted"], r["names"], r["samples"], strict=True)])))
                except LanguageProviderError:
                    continue
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    answers = classify_prompts(speakers, speaker_samples(segments)).mapInArrow(task, "project_id string, wanted array<string>, answer string")
    return classified(speakers, read_categories(answers))


def classified(speakers: DataFrame, told: DataFrame) -> DataFrame:
    """Speakers with the categories that were told (project_id, speaker_id, category)."""
    new = told.select("project_id", "speaker_id", F.col("category").alias("told"))
    return speakers.join(new, ["project_id", "speaker_id"], "left").withColumn("category", F.coalesce("told", "category")).select(*speakers.columns)
