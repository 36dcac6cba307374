"""Queries of the catalogue on whole books: EPUBs made of the documents and parsed, stored versions, states of projects, settings, answers
that were kept, and audiobooks put together and shipped."""

from __future__ import annotations

import html
import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import actions, attribute, correct, gate, render, views, voice
from ..schema import CATEGORIES, SEGMENTS, STAGES
from ..sources import audio, book_source, epub, m4b, store, workspace
from .catalog import PARAMS, SEG_SQL, cast, params, query, segments, table
from .catalog import DICT_SQL, LINES_SQL, dictionary, rep
from .catalog_edits import _OCR, _SPELL_LAST, AGAIN, KEY, ONCE, _speech, each_row, people
from .session import Corpus

# --- EPUBs: a book for each document, its lines dealt to two chapters -----------------------------------------------------------------

_PAGE = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>{}</body></html>'


def epub_bytes(doc_id: int, text: str | None) -> bytes:
    """A book of one of eight makes: labels in a navigation document (0) or an NCX (1), a heading (2), a title on the item (3), none of
    these (4), no archive at all (5), nothing in the spine (6), a part out of the spine's line and one without a file (7)."""
    kind = doc_id % 8
    if kind == 5:
        return b"not an archive"
    lines = (text or "").split("\n")
    parts = [lines[0::2], lines[1::2]]
    head = f"<h2>Heading {doc_id}</h2>" if kind == 2 else ""
    bodies = [head + "".join(f"<p>{html.escape(x)}</p>" for x in p) for p in parts]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, data: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
        put("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="in/p.opf"/></rootfiles></container>')
        title = f' title="Item {doc_id}"' if kind == 3 else ""
        items = "".join(f'<item id="c{i}" href="c%20{i}.xhtml" media-type="application/xhtml+xml"{title}/>' for i in (0, 1))
        spine = ["c0", "c1"]
        if kind == 0:
            items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
            spine.insert(1, "nav")
            links = [("c%200.xhtml#top", f"First {doc_id}"), ("c%200.xhtml", "Again"), ("c%201.xhtml", f" Second  {doc_id} ")]
            put("in/nav.xhtml", _PAGE.format('<nav epub:type="toc"><ol>' + "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in links) + "</ol></nav>"))
        if kind == 1:
            items += '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
            point = lambda h, t, more="": f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{h}"/>{more}</navPoint>'
            put("in/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>' + point("c%200.xhtml#a", f"First {doc_id}", point("c%201.xhtml", f"Second {doc_id}")) + point("c%200.xhtml", "Again") + "</navMap></ncx>")
        refs = "".join(f'<itemref idref="{s}"/>' for s in spine)
        if kind == 6:
            refs = ""
        if kind == 7:
            items += '<item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="p.png" media-type="image/png"/>'
            refs = '<itemref idref="c0" linear="no"/><itemref idref="gone"/><itemref idref="pic"/><itemref idref="nobody"/><itemref idref="c1"/>'
        meta = f"<dc:title>Book {doc_id}</dc:title><dc:title>Other</dc:title>" if doc_id % 3 else ""
        meta += "<dc:creator> Some One </dc:creator>" if doc_id % 2 else ""
        put("in/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, body in enumerate(bodies):
            put(f"in/c {i}.xhtml", _PAGE.format(body))
    return out.getvalue()


def epubs(spark, d) -> DataFrame:
    """path, content."""
    make = lambda r: [{"path": f"/books/{r['doc_id']}.epub", "content": epub_bytes(r["doc_id"], r["text"])}]
    return each_row(table(spark, d, "documents").select("doc_id", "text"), make, [("path", pa.string()), ("content", pa.binary())], "path string, content binary")


#: One row for each chapter, or for a book without any.
_EPUBS = r"""d AS (SELECT doc_id, doc_id % 8 AS kind, string_split(coalesce(text, ''), chr(10)) AS ls, '/books/' || doc_id || '.epub' AS path FROM documents),
p AS (SELECT *, unnest([0, 1]) AS part FROM d WHERE kind NOT IN (5, 6)),
l AS (SELECT doc_id, kind, path, part, list_filter(list_transform([ls[i] FOR i IN range(1 + part, len(ls) + 1, 2)], lambda s: trim(regexp_replace(s, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', ' ', 'g'))), lambda s: s <> '') AS own FROM p WHERE NOT (kind = 7 AND part = 0)),
t AS (SELECT doc_id, path, kind, CAST(CASE WHEN kind = 7 THEN 0 ELSE part END AS INTEGER) AS chapter_pos,
  CASE WHEN kind IN (0, 1) THEN ['First ', 'Second '][part + 1] || doc_id WHEN kind = 2 THEN 'Heading ' || doc_id WHEN kind = 3 THEN 'Item ' || doc_id ELSE 'Chapter ' || CASE WHEN kind = 7 THEN 1 ELSE part + 1 END END AS chapter_title,
  CASE WHEN kind = 2 THEN list_prepend('Heading ' || doc_id, own) ELSE own END AS lines FROM l),
b AS (SELECT d.path, d.doc_id, chapter_pos, chapter_title, lines, CASE WHEN d.kind <> 5 AND d.doc_id % 3 <> 0 THEN 'Book ' || d.doc_id ELSE CAST(d.doc_id AS VARCHAR) END AS title,
  CASE WHEN d.kind = 5 THEN NULL WHEN d.doc_id % 2 = 1 THEN 'Some One' ELSE 'Unknown' END AS author, d.kind = 5 AS broken FROM d LEFT JOIN t ON t.doc_id = d.doc_id),
i AS (SELECT *, 'prj_' || substr(sha256(path), 1, 32) AS project_id FROM b)"""


@query(f"WITH {_EPUBS} SELECT path, chapter_pos, chapter_title, lines, title, author, broken FROM b")
def parsed_epubs(spark, d):
    """Every book with its chapters, titles by all ways there are to find one, and the broken ones."""
    return epub.parsed_books(epubs(spark, d), strict=False).select("path", "chapter_pos", "chapter_title", "lines", "title", "author", F.col("error").isNotNull().alias("broken"))


def write_out(spark, d, folder: str) -> None:
    """The books put below a folder, up to a thousand in each of its own; made and written one by one, so that a task holds one of them."""

    def put(batches):
        fs, top = m4b.open_filesystem(folder)
        there = set()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = f"{top}/{doc_id // 1000}"
                if at not in there:
                    fs.create_dir(at)
                    there.add(at)
                with fs.open_output_stream(f"{at}/{doc_id}.epub") as f:
                    f.write(epub_bytes(doc_id, text.as_py()))
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    table(spark, d, "documents").select("doc_id", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()


@query(f"WITH {_EPUBS} SELECT parse_filename(path) AS file, chapter_pos, chapter_title, lines, title, author, broken FROM b")
def books_by_format(spark, d):
    """The same books written below a folder and read back by the data source, in partitions of a bounded size."""
    folder = store.scratch(spark)
    write_out(spark, d, folder)
    book_source.register(spark)
    read = spark.read.format("books").option("partitionBytes", 200_000).load(folder)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "chapter_pos", "chapter_title", "lines", "title", "author", F.col("error").isNotNull().alias("broken"))


def parsed(spark, d) -> DataFrame:
    return epub.parsed_books(epubs(spark, d), strict=False).withColumn("project_id", epub.make_id("prj", "path"))


@query(f"""WITH {_EPUBS}, c AS (SELECT project_id, chapter_pos, unnest(lines) AS text, unnest(range(len(lines))) AS k FROM i WHERE chapter_pos IS NOT NULL)
SELECT project_id, chapter_pos, CAST(k AS INTEGER) AS line_pos, 'ln_' || substr(sha256(concat_ws(chr(31), project_id, chapter_pos, k)), 1, 32) AS line_id, CAST(k AS INTEGER) AS "order", text FROM c""")
def book_lines(spark, d):
    return epub.book_tables(parsed(spark, d))[1]


@query(f"""WITH {_EPUBS} SELECT project_id, chapter_pos, 'ch_' || substr(sha256(concat_ws(chr(31), project_id, chapter_pos)), 1, 32) AS chapter_id, chapter_pos + 1 AS "order", chapter_title AS title FROM i WHERE chapter_pos IS NOT NULL""")
def book_chapters(spark, d):
    return epub.book_tables(parsed(spark, d))[0]


@query(f"""WITH {_EPUBS} SELECT project_id, CASE WHEN sum(coalesce(len(lines), 0)) > 0 THEN 'completed' ELSE 'failed' END AS status,
CASE WHEN sum(coalesce(len(lines), 0)) > 0 THEN 'book parsed' WHEN bool_or(broken) THEN 'broken' ELSE 'the book has no text' END AS message FROM i GROUP BY 1
UNION ALL SELECT 'lost-' || page_id, 'failed', 'the book''s file is missing' FROM pages""")
def parse_results(spark, d):
    """How parsing ended for every project, those among them whose files are gone."""
    books = parsed(spark, d)
    lost = table(spark, d, "pages").select(F.concat(F.lit("lost-"), F.col("page_id").cast("string")).alias("project_id"))
    told = epub.book_results(books, books.select("project_id").distinct().unionByName(lost))
    return told.withColumn("message", F.when(F.col("message").contains("not a zip file"), "broken").otherwise(F.col("message")))


# --- a corpus from its files on ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_EPUBS}, n AS (SELECT CAST(doc_id AS VARCHAR) AS name, any_value(title) AS title, any_value(author) AS author, count(chapter_pos) AS chapters, sum(coalesce(len(lines), 0)) AS lines FROM i GROUP BY 1)
SELECT name, CASE WHEN lines > 0 THEN 'correct' ELSE 'parse' END AS stage, CASE WHEN lines > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN lines > 0 THEN title ELSE name END AS title, CASE WHEN lines > 0 THEN author END AS author,
CASE WHEN lines > 0 THEN chapters ELSE 0 END AS chapters, CAST(CASE WHEN lines > 0 THEN lines ELSE 0 END AS BIGINT) AS lines FROM n""")
def corpus_run(spark, d):
    """The books' files made projects and run up to correction: where each project is, and what is stored of it."""
    top = store.scratch(spark)
    write_out(spark, d, f"{top}/in")
    corpus = Corpus(spark, f"{top}/ws")
    corpus.create(f"{top}/in")
    ends = corpus.run("correct").projects
    t = corpus.tables()
    n = lambda table, name: t[table].groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    out = t["projects"].join(ends, "project_id").join(n("chapters", "chapters"), "project_id", "left").join(n("lines", "lines"), "project_id", "left")
    return out.select("name", "stage", "status", "title", "author", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chapters", "lines")])


@query(f"""WITH {SEG_SQL}, one AS (SELECT min(segment_id) AS id FROM segments WHERE speaker_id = 'user' AND length(text) % 5 <> 0)
SELECT segment_id, CASE WHEN id IS NOT NULL THEN 'completed' ELSE audio_status END AS audio_status, CASE WHEN id IS NOT NULL THEN audio_cache_key <> sha256(text || chr(0) || 'clip1' || chr(0) || '{PARAMS}' || CASE WHEN audio_seed IS NOT NULL THEN chr(0) || 'seed' || chr(0) || audio_seed ELSE '' END) ELSE false END AS changed
FROM segments LEFT JOIN one ON id = segment_id""")
def rendered_one(spark, d):
    """One segment rendered on request; the others stay as they are."""
    s = segments(spark, d)
    chosen = s.filter("speaker_id = 'user' and length(text) % 5 <> 0").agg(F.min("segment_id")).first()[0]
    made, _ = render.render_segment(s, chosen, *cast(spark), params(spark), _speech)
    old = s.select("segment_id", F.col("audio_cache_key").alias("old"))
    changed = F.when(F.col("segment_id") == chosen, F.col("audio_cache_key") != F.col("old")).otherwise(F.lit(False))
    return made.join(old, "segment_id").select("segment_id", "audio_status", changed.alias("changed"))


# --- all correctors at once -----------------------------------------------------------------------------------------------------------------

_ALL = _OCR.replace(LINES_SQL, f"{SEG_SQL}, lines AS (SELECT {KEY}, text FROM segments)") + ", x AS (SELECT " + KEY + ", {0} AS ts FROM b), ".format(_SPELL_LAST[0]) + _SPELL_LAST[1]


@query(f"""WITH {_ALL}, every AS (SELECT {KEY}, kind, pos, original, suggested FROM k UNION ALL SELECT {KEY}, 3, pos, token, other FROM u JOIN r USING (word) WHERE k = 1 AND other <> word)
SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY kind, pos, original) - 1 AS sug_pos, original, suggested, CASE kind WHEN 3 THEN 'spellcheck' ELSE 'ocr-artifact' END AS reason,
CAST([0.99, 0.5, 0.4, 0.7][kind + 1] AS DOUBLE) AS confidence, CASE kind WHEN 0 THEN 'auto_applied' ELSE 'pending' END AS status FROM every""")
def corrected_talks(spark, d):
    """What the four default correctors find in turns of talk with faults put in."""
    said = segments(spark, d).select(*correct.KEY, rep(rep(rep(F.col("text"), ", ", " ,  "), "tion", "ti- on"), "nd", "ncl").alias("text"))
    made = correct.apply_candidates(said, correct.candidates(said, dictionary(spark, d), correct.protected_words(said)))[1]
    return made.select(*correct.KEY, F.col("sug_pos").cast("long").alias("sug_pos"), "original", "suggested", "reason", "confidence", "status")


# --- stored projects of all versions, and versions of a store ----------------------------------------------------------------------------


def stored_documents(spark, d) -> DataFrame:
    """value: a project for each conversation, as the first, second or third version of the stored form has it."""
    t = table(spark, d, "conversations")
    c, i = F.col("conv_id"), F.col("turn")
    version = c % 3 + 1
    text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    common = {"id": F.concat(F.lit("g"), i.cast("string")), "text": F.col("text"), "speaker_id": F.lit("s"), "role": F.lit("character"), "confidence": F.lit(0.5), "review_status": F.lit("approved"), "audio_cache_key": F.lit(None).cast("string"), "audio_status": F.lit("pending")}
    old = text(F.struct(*[v.alias(k) for k, v in common.items()]))
    new = text(F.struct(*[v.alias(k) for k, v in (common | {"audio_seed": i.cast("int")}).items()]))
    segment = F.when(version < 3, old).otherwise(new)
    line = F.concat(F.lit('{"id":"l'), i.cast("string"), F.lit('","chapter_id":"c","order":'), i.cast("string"), F.lit(',"text":'), F.regexp_extract(text(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1), F.lit(',"segments":['), segment, F.lit('],"suggestions":[]}'))
    book = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("j")))), lambda x: x["j"]), ",").alias("lines"))
    category = F.when(c % 3 + 1 >= 2, F.concat(F.lit(',"category":"'), F.element_at(F.array(*map(F.lit, CATEGORIES)), (c % 5 + 1).cast("int")), F.lit('"'))).otherwise("")
    return book.select(F.concat(
        F.lit('{"schema_version":'), version.cast("string"), F.lit(',"id":"p'), c.cast("string"), F.lit('","name":"n","workspace_dir":"/w","book":{"title":"T","author":"A","source_ebook_path":"/b","cover_image_path":null,"chapters":[{"id":"c","order":1,"title":"One","lines":['), F.col("lines"),
        F.lit(']}]},"speakers":[{"id":"s","name":"S","role":"character","voice_clip_id":null'), category, F.lit('}],"voice_clips":[],"stage_status":{"parse":"completed"},"tts_params":{"seed":'), c.cast("string"), F.lit("}}"),
    ).alias("value"))


@query("""SELECT 'p' || conv_id AS project_id, 3 AS schema_version, '{"seed":' || conv_id || '}' AS tts_params, CASE WHEN conv_id % 3 + 1 >= 2 THEN ['man', 'woman', 'boy', 'girl', 'unknown'][conv_id % 5 + 1] ELSE 'unknown' END AS category,
CAST(turn AS INTEGER) AS line_order, text, 'g' || turn AS segment_id, CASE WHEN conv_id % 3 = 2 THEN CAST(turn AS INTEGER) END AS audio_seed FROM conversations""")
def migrated_projects(spark, d):
    """Documents of all versions brought to the present one, in bulk."""
    t = workspace.project_tables(stored_documents(spark, d))
    who = t["speakers"].select("project_id", "category")
    lines = t["lines"].select("project_id", "line_pos", F.col("order").alias("line_order"))
    rows = t["segments"].join(lines, ["project_id", "line_pos"]).join(who, "project_id").join(t["projects"].select("project_id", "schema_version", "tts_params"), "project_id")
    return rows.select("project_id", "schema_version", "tts_params", "category", "line_order", "text", "segment_id", "audio_seed")


@query(f"WITH {SEG_SQL} SELECT segment_id, chapter_pos, text, 'even' AS part FROM segments WHERE chapter_pos % 2 = 0 UNION ALL SELECT segment_id, chapter_pos, text, 'odd' FROM segments WHERE chapter_pos % 2 = 1 UNION ALL SELECT 'first', -1, NULL, CAST(count(*) AS VARCHAR) FROM segments WHERE chapter_pos % 2 = 0")
def stored_versions(spark, d):
    """Segments committed in two parts, with a table of another writer in between; the last version, and how many rows the first has."""
    s = store.Store(spark, store.scratch(spark), {"segments": SEGMENTS, "notes": "note string"})
    rows = segments(spark, d)
    first = s.commit(s.current(), {"segments": rows.filter("chapter_pos % 2 = 0")})
    s.commit(s.current(), {"notes": spark.createDataFrame([("x",)], "note string")})
    last = s.commit(first, append={"segments": rows.filter("chapter_pos % 2 = 1")})
    now = s.table(last, "segments").select("segment_id", "chapter_pos", "text", F.when(F.col("chapter_pos") % 2 == 0, "even").otherwise("odd").alias("part"))
    then = s.table(first, "segments").agg(F.lit("first").alias("segment_id"), F.lit(-1).alias("chapter_pos"), F.lit(None).cast("string").alias("text"), F.count(F.lit(1)).cast("string").alias("part"))
    return now.unionByName(then)


# --- states of projects --------------------------------------------------------------------------------------------------------------------

#: A project for each event; stage k is complete where bit k of its number mod 64 is set, and has a mark of another kind where it isn't.
_STATES = f"""states AS (SELECT CAST(event_id AS VARCHAR) AS project_id, event_id % 64 AS bits, [{', '.join(f"(event_id % 64) // {1 << k} % 2 = 1" for k in range(6))}] AS done FROM events)"""


def states(spark, d) -> DataFrame:
    bits = F.col("event_id") % 64
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.when(F.floor(bits / (1 << k)) % 2 == 1, "completed").otherwise("needs_review").alias("value")) for k, s in enumerate(STAGES)])
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("project_id"), F.map_from_entries(entries).alias("stage_status"))


@query(f"WITH {_STATES} " + " UNION ALL ".join(f"SELECT project_id, '{s}' AS stage FROM states WHERE NOT done[{k + 1}]" + "".join(f" AND done[{j + 1}]" for j in range(k)) for k, s in enumerate(STAGES)))
def due_projects(spark, d):
    """Which projects each stage is planned on."""
    every = [gate.due(states(spark, d), s).withColumn("stage", F.lit(s)) for s in STAGES]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


@query(f"""WITH {_STATES} SELECT project_id, CASE WHEN CAST(project_id AS BIGINT) % 3 = 0 THEN 'completed' WHEN CAST(project_id AS BIGINT) % 3 = 1 THEN NULL WHEN done[4] THEN 'completed' ELSE 'needs_review' END AS review, CASE WHEN done[1] THEN 'completed' ELSE 'needs_review' END AS parse FROM states""")
def marked_projects(spark, d):
    """The marks after a review that a third of the projects passed and a third didn't; the others weren't in it."""
    s = states(spark, d)
    i = F.col("project_id").cast("long") % 3
    results = s.filter(i < 2).select("project_id", F.when(i == 0, "completed").otherwise("needs_review").alias("status"))
    after = gate.marked(s, "review", results)
    return after.select("project_id", F.element_at("stage_status", "review").alias("review"), F.element_at("stage_status", "parse").alias("parse"))


@query("""WITH r AS (SELECT CAST(event_id AS VARCHAR) AS project_id, ['parse', 'review', 'assemble'][event_id % 3 + 1] AS stage, ['completed', 'failed'][event_id % 2 + 1] AS status, event_type || event_id AS message FROM events)
SELECT stage, status, count(*) AS projects, arg_min(message, project_id) AS message FROM r GROUP BY 1, 2""")
def counted_results(spark, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % by + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("project_id"), pick(("parse", "review", "assemble"), 3).alias("stage"), pick(("completed", "failed"), 2).alias("status"), F.concat("event_type", F.col("event_id").cast("string")).alias("message"))
    return gate.counted(rows)


# --- speakers, settings, answers -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {ONCE}, n AS (SELECT project_id, arg_min(speaker_id, speaker_pos) AS s FROM people WHERE role = 'narrator' GROUP BY 1)
SELECT p.project_id, row_number() OVER (PARTITION BY p.project_id ORDER BY p.speaker_id IS NOT DISTINCT FROM n.s DESC, speaker_pos) - 1 AS position, speaker_id, name, role
FROM people p LEFT JOIN n ON n.project_id = p.project_id WHERE role = 'character' OR p.speaker_id IS NOT DISTINCT FROM n.s""")
def speaker_options(spark, d):
    return views.speaker_options(people(spark, d)[0]).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {ONCE}, o AS (SELECT unnest({list(CATEGORIES)!r}) AS value, unnest(range({len(CATEGORIES)})) AS position) SELECT project_id, speaker_id, position, value, upper(value[1]) || value[2:] AS display, value = ['man', 'woman', 'boy', 'girl', 'unknown'][speaker_pos % 5 + 1] AS chosen FROM people, o")
def category_options(spark, d):
    """The categories that each speaker can be given, and the one it has."""
    who = people(spark, d)[0].withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("speaker_pos") % 5 + 1).cast("int")))
    return views.category_choices(who).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {ONCE} SELECT project_id, speaker_id, CASE WHEN speaker_pos % 4 = 0 THEN 'unknown' WHEN speaker_pos % 4 = 1 THEN 'unknown' WHEN speaker_pos % 4 = 2 THEN 'girl' ELSE 'unknown' END AS category FROM people""")
def classified_speakers(spark, d):
    """Speakers with the categories of kept answers: none, malformed, one that is known, one that isn't."""
    who = people(spark, d)[0]
    i = F.col("speaker_pos") % 4
    entry = F.to_json(F.struct(F.array(F.struct("speaker_id", F.when(i == 2, " Girl").otherwise("robot").alias("category"), F.lit("0.5").alias("confidence"))).alias("classifications")))
    answers = who.filter(i > 0).select("project_id", F.array("speaker_id").alias("wanted"), F.when(i == 1, F.lit('{"classifications": [{}]}')).otherwise(entry).alias("answer"))
    return attribute.classified(who, attribute.read_categories(answers)).select("project_id", "speaker_id", "category")


@query(f"""WITH {AGAIN} SELECT project_id, category, list(name ORDER BY speaker_pos) AS names FROM (SELECT project_id, name, speaker_pos, ['man', 'woman', 'boy', 'girl', 'unknown'][speaker_pos % 5 + 1] AS category FROM people)
WHERE category IN ('boy', 'unknown') GROUP BY 1, 2""")
def uncovered_categories(spark, d):
    """Whom no clip covers when there are clips for three categories alone."""
    who = people(spark, d, True)[0].withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("speaker_pos") % 5 + 1).cast("int")))
    return voice.uncovered(voice.bulk_plan(who.withColumn("first", F.col("speaker_pos")), {"man": "/m.wav", "girl": ""}, {"woman": "/w.wav", "girl": "/g.wav"}))


@query("""SELECT c_custkey, '{"a":{"x":[' || c_custkey || ',true,null],"é":"' || c_mktsegment || '"},"b":"' || c_name || '","c":' || CASE WHEN c_custkey % 2 = 0 THEN 'false' ELSE '1.5' END || CASE WHEN c_custkey % 3 = 0 THEN ',"seed":' || c_custkey || '' WHEN c_custkey % 3 = 1 THEN ',"seed":7' ELSE '' END || '}' AS params FROM customer""")
def canonical_settings(spark, d):
    """Settings of a project, with or without a seed of their own and one of the segment's, as the text that keys are made of."""

    def read(r):
        given = {"c": False if r["c_custkey"] % 2 == 0 else 1.5, "b": r["c_name"], "a": {"é": r["c_mktsegment"], "x": [r["c_custkey"], True, None]}}
        if r["c_custkey"] % 3 == 1:
            given["seed"] = 7
        return [{"c_custkey": r["c_custkey"], "params": X.canonical_params(X.render_params(given, r["c_custkey"] if r["c_custkey"] % 3 == 0 else None))}]

    return each_row(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), read, [("c_custkey", pa.int64()), ("params", pa.string())], "c_custkey long, params string")


@query("""SELECT c_custkey, c_custkey % 4 <> 1 AS enabled, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE -18.0 END AS target, CASE WHEN c_custkey % 5 = 0 THEN '/' || c_name END AS woman FROM customer""")
def configured_projects(spark, d):
    """What projects keep of the settings of their environment, read back as a stage reads it."""

    def read(r):
        i = r["c_custkey"]
        env = {"FOLIOFLOW_LOUDNESS": " Off " if i % 4 == 1 else "yes", "FOLIOFLOW_LOUDNESS_TARGET": str(i) if i % 3 == 0 else "loud", "FOLIOFLOW_VOICE_WOMAN": f"/{r['c_name']}" if i % 5 == 0 else ""}
        config = Config.from_env(env)
        kept = audio.Loudness.from_params(json.loads(X.canonical_params(config.project_params())))
        return [{"c_custkey": i, "enabled": kept.enabled, "target": kept.target_lufs, "woman": config.voice_defaults.get("woman")}]

    return each_row(table(spark, d, "customer").select("c_custkey", "c_name"), read, [("c_custkey", pa.int64()), ("enabled", pa.bool_()), ("target", pa.float64()), ("woman", pa.string())], "c_custkey long, enabled boolean, target double, woman string")


class _Stubborn(attribute.LanguageProvider):
    """Malformed for a number of times, then right."""

    def __init__(self, bad: int):
        self.bad = bad

    def attribute(self, context, candidates, known):
        self.bad -= 1
        if self.bad >= 0:
            return "{"
        return json.dumps({"attributions": [{"segment_id": candidates[0], "speaker": "Ann"}]})


@query("SELECT event_id, event_id % 3 < 2 AS answered, CASE WHEN event_id % 3 < 2 THEN 'Ann' END AS speaker FROM events")
def asked_again(spark, d):
    """A malformed answer is asked for once more, and no more."""

    def read(r):
        found = attribute.ask(_Stubborn(r["event_id"] % 3), "", ["a"], [])
        return [{"event_id": r["event_id"], "answered": found is not None, "speaker": found[0].speaker if found else None}]

    return each_row(table(spark, d, "events").select("event_id"), read, [("event_id", pa.int64()), ("answered", pa.bool_()), ("speaker", pa.string())], "event_id long, answered boolean, speaker string")


@query(f"WITH {SEG_SQL} SELECT 'g' || conv_id || '-' || (turn + 1) AS segment_id FROM conversations EXCEPT SELECT segment_id FROM segments")
def missing_ids(spark, d):
    """The ids asked for that no segment has."""
    asked = table(spark, d, "conversations").select(F.concat(F.lit("g"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string")).alias("segment_id"))
    return actions.missing(asked, "segment_id", segments(spark, d))


@query(f"WITH {SEG_SQL} SELECT segment_id FROM segments WHERE review_status = 'needs_review' AND audio_status = 'failed'")
def filtered_view(spark, d):
    """The rows that a view shows with both of its filters on, and a third off."""
    rows = views.only(segments(spark, d), "review_status = 'needs_review'")
    return views.only(views.only(rows, "audio_status = 'failed'"), "false", on=False).select("segment_id")


# --- audiobooks --------------------------------------------------------------------------------------------------------------------------


def _numbers(listing: str, metadata: str, output: str, cover: str | None) -> None:
    """Stands in for an encoder: the metadata, and the sounds' samples in order."""
    with open(listing, encoding="utf-8") as names, open(metadata, encoding="utf-8") as told, open(output, "w", encoding="utf-8") as out:
        out.write(told.read())
        for name in names:
            with open(name.removeprefix("file '").rstrip("\n").removesuffix("'"), "rb") as f:
                samples, rate = audio.decode(f.read())
            out.write(f"{rate}:" + ",".join(str(int(v)) for v in samples * 32768) + "\n")


@query("""WITH v AS (SELECT vec_id, vec_id // 50 AS book, list_transform(embedding, lambda s: CAST(greatest(least(trunc(CAST(s AS DOUBLE) * 32767), 32767), -32768) AS INTEGER)) AS pcm FROM embeddings),
s AS (SELECT book, string_agg('8000:' || array_to_string(pcm, ',') || chr(10) || '8000:0,0,0,0,0,0,0,0' || chr(10), '' ORDER BY vec_id) AS sounds FROM v GROUP BY 1)
SELECT 'b' || book AS project_id, CASE WHEN book % 4 <> 3 THEN 'b' || book || '/Title ' || book || '.m4b' END AS file, CASE WHEN book % 4 <> 3 THEN sha256('meta ' || book || sounds) END AS sha256, CASE WHEN book % 4 = 3 THEN 'there is nothing to play' END AS error FROM s""")
def shipped_audiobooks(spark, d):
    """Books of 50 sounds each, a pause after each sound, put together, staged, published and read back; every fourth has an empty list."""
    i = F.col("vec_id")
    book = F.floor(i / 50)
    name = F.concat(F.lit("b"), book.cast("string"))
    v = table(spark, d, "embeddings").select(i, book.alias("book"), name.alias("project_id"), F.concat(F.lit("audio/"), i.cast("string"), F.lit(".wav")).alias("path"), "embedding")
    sounds = each_row(v.select("project_id", "path", "embedding"), lambda r: [{"project_id": r["project_id"], "path": r["path"], "wav": audio.encode(r["embedding"], 8000)}], [("project_id", pa.string()), ("path", pa.string()), ("wav", pa.binary())], "project_id string, path string, wav binary")
    entry = F.concat(F.lit("file '"), F.col("path"), F.lit("'\nfile 'silence_0001ms_8000hz_1ch_2b.wav'\n"))
    books = v.groupBy("book", "project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", entry.alias("e")))), lambda x: x["e"]), "").alias("all"))
    books = books.select("project_id", F.concat(F.lit("Title "), F.col("book").cast("string")).alias("title"), F.when(F.col("book") % 4 == 3, "").otherwise(F.col("all")).alias("listing"), F.concat(F.lit("meta "), F.col("book").cast("string")).alias("metadata"), F.lit(None).cast("string").alias("cover_image_path"))
    top = store.scratch(spark)
    m4b.assemble_books(books, f"{top}/books", _numbers, sounds).write.parquet(f"{top}/staged")
    m4b.publish(spark.read.parquet(f"{top}/staged")).write.parquet(f"{top}/published")
    done = spark.read.parquet(f"{top}/published")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.m4b").option("recursiveFileLookup", "true").load(f"{top}/books")
    files = files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return done.select("project_id", "error", F.regexp_extract("output", "([^/]+/[^/]+)$", 1).alias("file")).join(files, "file", "left").select("project_id", "file", "sha256", "error")
