"""Sources, providers, review and rendering of small books, end to end with stand-in providers."""

import io
import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.errors import AssemblyError, ConfigError, EbookParseError, LanguageProviderError, MigrationError, PreconditionError, SerializationError, SpeechProviderError, WorkspaceError
from folioflow.operators import actions, attribute, gate, render, resolve, timeline, views, voice
from folioflow.plans import cli, providers
from folioflow.plans.session import Corpus, Providers
from folioflow.schema import SEGMENTS, SPEAKERS, SUGGESTIONS, VERSION, VOICE_CLIPS, check_version
from folioflow.sources import audio, epub, m4b, workspace
from folioflow.sources.html import document_lines
from folioflow.streaming import ingest

PAGE = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>{}</body></html>'


def book(chapters, title="A Book", author="An Author", nav=None, skip=()):
    """An EPUB as bytes. chapters: (href, html)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, (h, _) in enumerate(chapters))
        refs = "".join(f'<itemref idref="c{i}"{" linear=\"no\"" if i in skip else ""}/>' for i in range(len(chapters)))
        if nav:
            items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
            refs += '<itemref idref="nav"/>'
            links = "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in nav)
            z.writestr("OEBPS/nav.xhtml", PAGE.format(f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        meta = (f"<dc:title>{title}</dc:title>" if title else "") + (f"<dc:creator>{author}</dc:creator>" if author else "")
        z.writestr("OEBPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for h, html in chapters:
            z.writestr(f"OEBPS/{h}", PAGE.format(html))
    return out.getvalue()


SAMPLE = [("1.xhtml", '<h1>Chapter One</h1><p>The narrator set the scene.</p><p>"Hello there," said Alice.</p><p>"And hello to you," Bob replied.</p>'), ("2.xhtml", '<h1>Chapter Two</h1><p>"Are we there yet?" Alice asked.</p>')]


def test_html_lines():
    assert document_lines("<p>The fact is<a epub:type='noteref' href='#n'>1</a> well known indeed.</p><aside epub:type='footnote'><p>Note.</p></aside>")[1] == ["The fact is well known indeed."]
    assert document_lines("<blockquote><p>Quoted.</p></blockquote>")[1] == ["Quoted."]
    assert document_lines("<p><b>Hel</b>lo&nbsp;&amp;<br/>x</p><p> </p><p><img src='i'/></p>")[1] == ["Hel lo & x"]
    assert document_lines("<h2> Big \n title </h2><div>own<div>inner</div></div>") == ("Big title", ["Big title", "inner"])
    assert document_lines("<p>one<p>two</p>")[1] == ["two"] and document_lines("<p>one<p>two</p>", True)[1] == ["one", "two"]
    assert document_lines("<head><title>t</title><style>p{}</style></head><body><script>var t='<p>no</p>'</script><li>item</li></body>")[1] == ["item"]
    assert document_lines(None) == (None, [])


def test_epub_chapters():
    b = epub.parse_epub(book(SAMPLE, nav=[("1.xhtml#x", "First"), ("1.xhtml", "Again"), ("", "No")]))
    assert (b.title, b.author) == ("A Book", "An Author")
    assert [c.title for c in b.chapters] == ["First", "Chapter Two"]
    assert b.chapters[0].lines == ["Chapter One", "The narrator set the scene.", '"Hello there," said Alice.', '"And hello to you," Bob replied.']
    skipped = epub.parse_epub(book([*SAMPLE, ("3.xhtml", "<p><img/></p>")], title=None, author=None, skip=(0,)), "stem")
    assert (skipped.title, skipped.author) == ("stem", "Unknown") and [(c.title, c.lines) for c in skipped.chapters][1] == ("Chapter 2", [])


@pytest.mark.parametrize("data", [b"", b"no zip", book([])[:-30]])
def test_broken_epubs(data):
    with pytest.raises(EbookParseError):
        epub.parse_epub(data)
    with pytest.raises(EbookParseError):
        epub.parser_for("book.pdf")


def test_read_books(spark, tmp_path):
    (tmp_path / "a.EPUB").write_bytes(book(SAMPLE))
    (tmp_path / "b.epub").write_bytes(b"broken")
    (tmp_path / "c.epub").write_bytes(book([("1.xhtml", "<p><img/></p>")]))
    (tmp_path / "d.txt").write_bytes(b"text")
    books = epub.read_books(spark, str(tmp_path), strict=False)
    assert books.filter("error is not null").count() == 1
    chapters, lines = epub.book_tables(books)
    assert chapters.count() == 3 and lines.count() == 6 and {r["order"] for r in chapters.collect()} == {1, 2}
    assert epub.silent_books(books.filter("error is null")).count() == 1
    with pytest.raises(Exception, match="EbookParseError"):
        epub.read_books(spark, str(tmp_path)).collect()


def test_sound_files():
    samples = np.array([0.0, 0.5, -1.0, 1.5])
    wav = audio.encode(samples, 22050)
    back, rate = audio.decode(wav)
    assert rate == 22050 and np.allclose(back, np.trunc(np.clip(samples, -1, 1) * 32767) / 32768)
    assert audio.duration(audio.encode(np.zeros(11025), 22050)) == 0.5
    name, quiet = audio.silence(0.4, 22050, 1, 2)
    assert name == "silence_0400ms_22050hz_1ch_2b.wav" and audio.header(quiet) == (22050, 1, 2, 8820)
    with pytest.raises(AssemblyError):
        audio.duration(b"nothing")
    with pytest.raises(ValueError, match="mono"):
        audio.decode(audio.container(b"\0" * 8, 8000, 2, 2))


def test_loudness():
    s = audio.Loudness()
    assert len(audio.normalize(np.zeros(0), 8000, s)) == 0 and not audio.normalize(np.zeros(10), 8000, s).any()
    loud = audio.normalize(np.full(800, 0.9), 8000, s)
    assert abs(20 * np.log10(np.sqrt(np.mean(loud**2))) + 18) < 0.01
    quiet = audio.normalize(np.full(800, 1.1e-4), 8000, s)
    assert abs(20 * np.log10(quiet[0] / 1.1e-4) - 30) < 1e-9
    peaky = audio.normalize(np.array([0.02] * 800 + [0.95] * 8), 8000, s)
    assert abs(np.abs(peaky).max() - 10 ** (-1 / 20)) < 1e-9
    tone = 0.1 * np.sin(2 * np.pi * 997 * np.arange(48000) / 48000)
    assert abs(audio.integrated_loudness(tone, 48000) - (20 * np.log10(0.1) - 3.01)) < 0.1
    assert audio.Loudness.from_params({}) is None and audio.Loudness.from_params({"loudness": {"enabled": 0}}).enabled is False
    stereo = audio.container(b"\1" * 80, 8000, 2, 2)
    assert audio.normalize_wav(stereo, s) == stereo


def test_config():
    c = Config.from_env({"FOLIOFLOW_LOUDNESS": "No", "FOLIOFLOW_LOUDNESS_PEAK": "x", "FOLIOFLOW_LOUDNESS_TARGET": "-20", "FOLIOFLOW_VOICE_MAN": "/m.wav", "FOLIOFLOW_VOICE_GIRL": ""})
    assert (c.loudness_enabled, c.loudness_peak_dbfs, c.loudness_target_lufs, c.voice_defaults) == (False, -1.0, -20.0, {"man": "/m.wav"})
    assert c.project_params()["loudness"]["enabled"] is False


STORED = {
    "schema_version": 1,
    "id": "p1",
    "name": "n",
    "workspace_dir": "/w",
    "book": {"title": "T", "author": "A", "source_ebook_path": "/b.epub", "cover_image_path": None, "chapters": [{"id": "c", "order": 1, "title": "One", "lines": [{"id": "l", "chapter_id": "c", "order": 0, "text": "Hi", "segments": [{"id": "s", "text": "Hi", "speaker_id": None, "role": "narrator", "confidence": 1.0, "review_status": "approved", "audio_cache_key": None, "audio_status": "pending"}], "suggestions": []}]}]},
    "speakers": [{"id": "n", "name": "narrator", "role": "narrator", "voice_clip_id": None}],
    "voice_clips": [],
    "stage_status": {"parse": "completed"},
    "tts_params": {"seed": 7, "loudness": {"enabled": True}},
}


def test_stored_projects(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(STORED, indent=1))
    t = workspace.read_projects(spark, str(tmp_path))
    again = json.loads(workspace.documents(t).first()["json"])
    want = workspace.migrate(json.loads(json.dumps(STORED)))
    assert again == want and again["schema_version"] == VERSION and again["speakers"][0]["category"] == "unknown"
    assert json.loads(t["projects"].first()["tts_params"]) == STORED["tts_params"]
    for change in ({"schema_version": 99}, {"speakers": [{**STORED["speakers"][0], "role": "villain"}]}):
        (tmp_path / "p.json").write_text(json.dumps({**STORED, **change}))
        with pytest.raises(Exception, match="can't be"):
            t = workspace.read_projects(spark, str(tmp_path))
            [t[n].collect() for n in ("projects", "speakers")]
    with pytest.raises(MigrationError):
        check_version(VERSION + 1)
    with pytest.raises(SerializationError):
        workspace.migrate({})


def test_local_files(tmp_path):
    path = str(tmp_path / "x" / "p.json")
    workspace.write_local(STORED, path)
    assert workspace.read_local(path)["schema_version"] == VERSION and os.listdir(tmp_path / "x") == ["p.json"]
    with pytest.raises(WorkspaceError):
        workspace.read_local(str(tmp_path / "none.json"))


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def cast(spark):
    return frame(spark, SPEAKERS, [("p", 0, "n", "narrator", "narrator", "v0", "unknown"), ("p", 1, "a", "Alice", "character", "v1", "woman"), ("p", 2, "b", "Bob", "character", None, "man")])


def clips(spark):
    return frame(spark, VOICE_CLIPS, [("p", 0, "v0", "/n.wav", "n"), ("p", 1, "v1", "/a.wav", "a")])


def files(spark, *paths):
    return spark.createDataFrame([(x,) for x in paths], "path string")


def seg(i, text, speaker, status="approved", role="character", key=None, audio_status="pending", line=None, chapter=0):
    return ("p", chapter, i if line is None else line, 0 if line is None else i, f"s{i}", text, speaker, role, 0.9, status, key, audio_status, None)


def sample_segments(spark):
    return frame(spark, SEGMENTS, [seg(0, '"Hello,"', "a"), seg(1, "said Alice.", "n", role="narrator"), seg(2, '"Hi,"', "b", "needs_review"), seg(3, "  ", "ghost"), seg(4, "Who?", None), seg(5, "Boo.", "ghost")])


def test_voices_and_gate(spark):
    s, who, has = sample_segments(spark), cast(spark), clips(spark)
    there = files(spark, "/n.wav", "/a.wav")
    names = [r["name"] for r in voice.unresolved_voices(s, who, has, there).orderBy("first").collect()]
    assert names == ["Bob", "ghost"]
    assert [r["name"] for r in voice.unresolved_speakers(s, who, has, there).collect()] == ["Bob"]
    assert [r["name"] for r in voice.unresolved_voices(s, who, has, files(spark, "/a.wav")).orderBy("first").collect()] == ["narrator", "Bob", "ghost"]
    assert "narrator" in {r["name"] for r in voice.unresolved_voices(s, who.filter("role <> 'narrator'"), has, there).collect()}
    sug = frame(spark, SUGGESTIONS, [("p", 0, 0, 0, "x1", "Allice", "Alice", "spellcheck", 0.7, "auto_applied"), ("p", 0, 1, 0, "x2", "Bbo", "Bob", "spellcheck", 0.7, "pending")])
    b = gate.project_blockers(s, sug, who, has, there, who.select("project_id").distinct())
    assert b.first().asDict() == {"project_id": "p", "needs_attribution": ["s2"], "pending_suggestions": ["x2"], "unassigned_voices": ["Bob", "ghost"]}
    rows = {r["name"]: r for r in voice.voice_rows(s, who, has, files(spark, "/n.wav")).collect()}
    assert rows["Alice"]["needs_voice"] and rows["Alice"]["clip_file_missing"] and not rows["narrator"]["needs_voice"]


def test_bulk_voices(spark):
    s, who, has = sample_segments(spark), cast(spark), clips(spark)
    open_ = voice.unresolved_speakers(s, who, has, files(spark, "/n.wav"))
    plan = voice.bulk_plan(open_, {"man": "/m.wav"}, {"default": "/d.wav"})
    told, made, counts = voice.apply_bulk(plan, who, has)
    assert {(r["category"], r["assigned"]) for r in counts.collect()} == {("man", 1), ("woman", 1)}
    assert made.count() == 4 and {r["label"] for r in made.collect()} >= {"man (default)", "woman (default)"}
    assert told.filter("voice_clip_id is null").count() == 0
    with pytest.raises(Exception, match="woman"):
        voice.apply_bulk(voice.bulk_plan(open_, {"man": "/m.wav"}, {}), who, has)


def test_names_resolve_to_speakers(spark):
    mentions = spark.createDataFrame([("p", 0, None), ("p", 1, "ALICE"), ("p", 2, "Carol"), ("p", 3, "carol"), ("p", 4, "Narrator"), ("p", 5, "Dave")], "project_id string, pos long, name string")
    told, every = resolve.resolve_names(mentions, cast(spark))
    by = {r["pos"]: (r["speaker_id"], r["role"]) for r in told.collect()}
    assert by[0] == by[4] == ("n", "narrator") and by[1] == ("a", "character") and by[2] == by[3] != by[5]
    assert [(r["name"], r["speaker_pos"]) for r in every.filter("speaker_pos > 2").orderBy("speaker_pos").collect()] == [("Carol", 3), ("Dave", 4)]
    assert resolve.find_speaker(every, "cAROL").count() == 1 == resolve.find_speaker(every, "2").count() and resolve.find_speaker(every, "99").count() == 0
    bare = resolve.with_narrators(cast(spark).filter("role <> 'narrator'"), cast(spark).select("project_id").distinct())
    assert bare.filter("role = 'narrator'").first()["speaker_pos"] == 3


def test_views(spark):
    s, who = sample_segments(spark), cast(spark)
    shown = {r["segment_id"]: r["speaker_display"] for r in resolve.display(s, who).collect()}
    assert (shown["s0"], shown["s4"], shown["s5"]) == ("Alice", "narrator (auto)", "<unknown>")
    flagged = views.flagged_neighbours(s.withColumn("f", F.col("segment_id").isin("s1", "s4")), "f", "segment_id", ("line_pos",))
    assert {r["segment_id"]: (r["next_flagged"], r["prev_flagged"]) for r in flagged.collect()} == {"s0": ("s1", "s4"), "s1": ("s4", "s4"), "s2": ("s4", "s1"), "s3": ("s4", "s1"), "s4": ("s1", "s1"), "s5": ("s1", "s4")}
    assert views.reselect(s, ("chapter_pos", "line_pos"), (0, 3)).first()["segment_id"] == "s3" and views.reselect(s, ("chapter_pos", "line_pos"), (9, 9)).first()["segment_id"] == "s0"
    assert [r["display"] for r in views.category_options(spark).collect()][:2] == ["Man", "Woman"] and views.has_any(s, "review_status = 'needs_review'")


def test_timeline(spark):
    chapters = spark.createDataFrame([("p", 0, "One"), ("p", 1, "Two"), ("p", 2, "Empty")], "project_id string, chapter_pos int, title string")
    rows = [("p", 0, 0, 0, "The hall was silent.", 0.2), ("p", 0, 1, 0, '"Hello,"', 0.1), ("p", 0, 1, 1, "said Alice softly.", 0.3), ("p", 0, 2, 0, "  ", 9.0), ("p", 1, 0, 0, '"We meet again,"', 0.15), ("p", 1, 0, 1, "said Alice again.", 0.25)]
    s = spark.createDataFrame(rows, "project_id string, chapter_pos int, line_pos int, seg_pos int, text string, duration double")
    marks = timeline.chapter_markers(timeline.chapter_lengths(chapters, s)).orderBy("chapter_pos")
    assert [(round(r["start_s"], 6), round(r["end_s"], 6)) for r in marks.collect()] == [(0.0, 1.0), (2.0, 2.4), (3.4, 3.4)]
    s = s.withColumns({"path": F.concat(F.lit("/x/"), F.col("line_pos").cast("string"), F.lit("'.wav")), "line_silence": F.lit("L"), "chapter_silence": F.lit("C")})
    listing = timeline.concat_list(timeline.playlist(s, chapters)).first()["listing"].splitlines()
    assert listing[0] == "file '/x/0'\\''.wav'" and [x[6:-1][0] for x in listing] == ["/", "L", "/", "/", "C", "/", "/", "C"]
    books = spark.createDataFrame([("p", "T;", "A")], "project_id string, title string, author string")
    text = timeline.ffmetadata(marks, books).first()["metadata"]
    assert text.startswith(";FFMETADATA1\ntitle=T\\;\nartist=A\nalbum=T\\;\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1000\ntitle=One\n") and text.endswith("START=3400\nEND=3400\ntitle=Empty\n")


def test_rendering_is_incremental(spark):
    s = frame(spark, SEGMENTS, [seg(0, "same", "a"), seg(1, "same", "a"), seg(2, "other", "b"), seg(3, " ", "a"), seg(4, "bad", "a")])
    who, has, there = cast(spark), clips(spark), files(spark, "/n.wav", "/a.wav")
    params = spark.createDataFrame([("p", "{}")], "project_id string, params string")

    def speech():
        def say(text, clip, params):
            if text == "bad":
                raise RuntimeError("no")
            return audio.encode(np.full(100, 0.5), 8000)

        return say

    none = spark.createDataFrame([], "cache_key string")
    out, made = render.synthesize(s, who, has, there, params, none, speech)
    rows = {r["segment_id"]: (r["audio_status"], r["audio_cache_key"] is not None) for r in out.collect()}
    assert rows == {"s0": ("completed", True), "s1": ("completed", True), "s2": ("failed", False), "s3": ("pending", False), "s4": ("failed", False)}
    assert made.filter("error is null").count() == 1 and made.count() == 2
    keys = made.filter("error is null").select(F.col("key").alias("cache_key"))
    assert {r["segment_id"] for r in render.worklist(out, who, params, keys).collect()} == {"s2", "s4"}
    assert {r["segment_id"] for r in render.unrendered(out, keys).collect()} == {"s2", "s4"}
    changed = spark.createDataFrame([("p", '{"seed":1}')], "project_id string, params string")
    assert render.worklist(out, who, changed, keys).count() == 4
    one, wav = render.render_segment(s, "s1", who, has, there, params, speech)
    assert len(wav) > 200 and {r["segment_id"] for r in one.filter("audio_status = 'completed'").collect()} == {"s1"}
    for bad, error in (("s4", SpeechProviderError), ("s2", PreconditionError), ("s3", PreconditionError)):
        with pytest.raises(error):
            render.render_segment(s, bad, who, has, there, params, speech)
    again = actions.reroll_audio(out, ["s0"], 5)
    assert {r["segment_id"] for r in render.worklist(again, who, params, keys).collect()} == {"s0", "s2", "s4"}


def test_actions(spark):
    s = frame(spark, SEGMENTS, [seg(0, '"Teh end," said Teh.', None, line=0, key="k", audio_status="completed"), seg(1, "Teh", "a", line=0, key="k", audio_status="completed")])
    ln = spark.createDataFrame([("p", 0, 0, "l0", '"Teh end," said Teh. Teh')], "project_id string, chapter_pos int, line_pos int, line_id string, text string")
    sug = frame(spark, SUGGESTIONS, [("p", 0, 0, 0, "x", "Teh", "The", "spellcheck", 0.7, "pending"), ("p", 0, 0, 1, "y", "Teh", "The", "spellcheck", 0.7, "pending")])
    told, lines, out, changed = actions.accept_suggestions(sug, ln, s, ["x"])
    assert lines.first()["text"] == '"The end," said Teh. Teh'
    assert [(r["text"], r["audio_cache_key"], r["audio_status"]) for r in out.orderBy("seg_pos").collect()] == [('"The end," said Teh.', None, "pending"), ("Teh", "k", "completed")]
    assert changed.count() == 1 and [r["status"] for r in told.orderBy("sug_pos").collect()] == ["approved", "pending"]
    _, both, _, _ = actions.accept_suggestions(sug, ln, s, ["x", "y"])
    assert both.first()["text"] == '"The end," said The. Teh'
    assert actions.reject_suggestions(sug, ["y"]).filter("status = 'rejected'").count() == 1
    edits = spark.createDataFrame([("l0", 'New. "Quote."')], "line_id string, new_text string")
    narr = resolve.narrators(cast(spark))
    _, made, touched = actions.edit_lines(ln, s, edits, narr)
    assert [r["text"] for r in made.orderBy("seg_pos").collect()] == ["New.", '"Quote."'] and touched.count() == 1
    with pytest.raises(ValueError, match="no speaker"):
        actions.set_speaker(s, cast(spark), ["s0"], "zz")
    given = actions.set_speaker(s, cast(spark), ["s0"], "b").orderBy("seg_pos").first()
    assert (given["speaker_id"], given["role"], given["review_status"]) == ("b", "character", "approved")
    more, new = actions.create_character(cast(spark), "p", "Carol")
    assert more.count() == 4 and actions.create_character(more, "p", "cArOl")[1] == new
    with pytest.raises(ValueError, match="path"):
        actions.register_clip(clips(spark), files(spark, "/x.wav"), "p", "/none.wav")
    for change in (lambda ids: actions.reject_suggestions(sug, ids), lambda ids: actions.accept_suggestions(sug, ln, s, ids)):
        with pytest.raises(ValueError, match="suggestion_id"):
            change(["x", "nobody's"])
    with pytest.raises(Exception, match="no segment_id 's9'"):
        actions.approve_audio(s, spark.createDataFrame([("s0",), ("s9",)], "segment_id string")).collect()
    with pytest.raises(Exception, match="no segment_id 's9'"):
        actions.approve_audio(s, spark.createDataFrame([("s0",), ("s9",)], "segment_id string")).select("text").count()
    moved, who = actions.reassign_to_new_speaker(s, cast(spark), ["s0"], "p", "Dora")
    dora = who.filter("name = 'Dora'").first()
    assert moved.orderBy("seg_pos").first()["speaker_id"] == dora["speaker_id"] and dora["role"] == "character" and who.count() == 4
    assert resolve.find_speaker(who, "dORA", "p").count() == 1 and resolve.find_speaker(who, "dora", "q").count() == 0
    has, clip = actions.register_clip(clips(spark), files(spark, "/x.wav"), "p", "/x.wav")
    pair = spark.createDataFrame([("p", "b", clip)], "project_id string, speaker_id string, clip_id string")
    voiced = actions.assign_voices(cast(spark), has, pair)
    assert voiced.filter("voice_clip_id is null").count() == 0 and actions.unassign_voice(voiced, ["b"]).filter("voice_clip_id is null").count() == 1
    assert actions.new_seed(5) != 5 and actions.set_category(cast(spark), ["b"], "BOY").filter("category = 'boy'").count() == 1
    projects = spark.createDataFrame([("p", {"review": "completed", "parse": "completed"})], "project_id string, stage_status map<string,string>")
    assert actions.stale(projects, changed, actions.REVIEW).first()["stage_status"] == {"parse": "completed"}


def test_first_output(spark, tmp_path):
    assert m4b.first_output(spark, str(tmp_path / "none")) is None
    for name in ("b.m4b", "a.m4b", "0.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert m4b.first_output(spark, str(tmp_path)).endswith("/a.m4b")


class Scripted(attribute.LanguageProvider):
    """Answers by the words around a quote."""

    def __init__(self, bad=0):
        self.bad = bad

    def attribute(self, context, candidates, known):
        if self.bad:
            self.bad -= 1
            return "no JSON"
        who = {'"Hello there,"': ("Alice", 0.9), '"And hello to you,"': ("Bob", 0.5), '"Are we there yet?"': ("Alice", 0.9)}
        return json.dumps({"attributions": [{"segment_id": c, "speaker": n, "confidence": p} for c in candidates for q, (n, p) in who.items() if f"[SEG {c}] {q}" in context]})

    def classify(self, profiles):
        return json.dumps({"classifications": [{"speaker_id": p.speaker_id, "category": "woman" if p.name == "Alice" else "??", "confidence": 0.9} for p in profiles]})


def test_provider_answers():
    ask = lambda raw: attribute.parse_attributions(json.dumps(raw), ["a", "b"])
    got = ask({"attributions": [{"segment_id": "b", "speaker": "The Narrator", "confidence": "x"}, {"segment_id": "zz", "speaker": "Q"}, {"segment_id": "b", "speaker": "Bob", "confidence": 0.5}]})
    assert got == [attribute.Attribution("a", None, 0.0, "missing"), attribute.Attribution("b", "Bob", 0.5, "")]
    for bad in ({}, {"attributions": 3}, {"attributions": [{"speaker": "x"}]}):
        with pytest.raises(LanguageProviderError) as e:
            ask(bad)
        assert e.value.malformed
    assert attribute.ask(Scripted(bad=1), '[SEG a] "Hello there,"', ["a"], [])[0].speaker == "Alice"
    assert attribute.ask(Scripted(bad=2), "", ["a"], []) is None


def test_windows_and_contexts(spark):
    lines = spark.createDataFrame([("p", 0, i, f'"Q{i}" he said.') for i in range(65)], "project_id string, chapter_pos int, line_pos int, text string")
    from folioflow.operators import segment

    s = segment.line_segments(lines, spark.createDataFrame([("p", "n")], "project_id string, narrator_id string"))
    got = attribute.contexts(s, lines).orderBy("window").collect()
    assert [len(r["candidates"]) for r in got] == [60, 5]
    first = got[1]["context"].splitlines()
    assert first[1] == f'L1: [SEG {got[1]["candidates"][0]}] "Q60" he said.' and first[-1] == "Return one entry per SEG id."
    twice = spark.createDataFrame([("p", 0, 0, '"No." he said. "No." she repeated.')], lines.schema)
    s = segment.line_segments(twice, spark.createDataFrame([("p", "n")], "project_id string, narrator_id string"))
    ids = [r["segment_id"] for r in s.filter("review_status = 'needs_review'").orderBy("seg_pos").collect()]
    assert attribute.tagged_lines(s, twice).first()["tagged"] == f'[SEG {ids[0]}] "No." he said. [SEG {ids[1]}] "No." she repeated.'


def encode_file(listing, metadata, output, cover):
    with open(listing) as a, open(metadata) as b, open(output, "w") as out:
        names = [x.removeprefix("file '").rstrip().removesuffix("'") for x in a]
        for x in names:
            if os.path.isabs(x):  # of a book, every sound has to be there
                with open(x, "rb") as f:
                    assert audio.duration(f.read()) > 0
        a.seek(0)
        out.write(a.read() + b.read())


def picture():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return m4b.MAGIC[0] + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_audiobook_file(tmp_path):
    out = m4b.assemble("file 'x'\n", ";FFMETADATA1\n", str(tmp_path), None, encode_file)
    assert open(out).read().startswith("file 'x'")
    os.remove(out)
    with pytest.raises(AssemblyError):
        m4b.assemble(" ", "", str(tmp_path), None, encode_file)
    with pytest.raises(AssemblyError):
        m4b.assemble("x", "", str(tmp_path), None, lambda *a: None)

    def choosy(listing, metadata, output, cover):
        if cover:
            raise AssemblyError("can't read the cover")
        encode_file(listing, metadata, output, cover)

    assert os.path.isfile(m4b.assemble("file 'x'\n", "", str(tmp_path), "c.png", choosy))


def test_covers(tmp_path):
    good = picture()
    for name, data, fine in (("a.png", good, True), ("b.png", good[:-20], False), ("c.png", good[:40] + b"?" + good[41:], False), ("d.png", m4b.MAGIC[0], False), ("e.jpg", m4b.MAGIC[1] + b"body\xff\xd9", True), ("f.jpeg", m4b.MAGIC[1] + b"body", False), ("g.gif", b"GIF89a", False), ("h.png", b"", False)):
        (tmp_path / name).write_bytes(data)
        found = m4b.cover_file(f"file:{tmp_path}/{name}", str(tmp_path / "in"[:0]), m4b.open_filesystem)
        assert (found is not None) == fine, name
    assert m4b.cover_file(None, str(tmp_path), m4b.open_filesystem) is None and m4b.cover_file(f"{tmp_path}/none.png", str(tmp_path), m4b.open_filesystem) is None


def shelf(uri):
    """A file system of another scheme: shelf:/x is kept below a folder."""
    import pyarrow.fs

    top, path = uri.removeprefix("shelf:").split("//", 1)
    return pyarrow.fs.SubTreeFileSystem(top, pyarrow.fs.LocalFileSystem()), path.rstrip("/")


def test_books_of_equal_titles_and_folders(spark, tmp_path):
    books = spark.createDataFrame([(p, "Same", "file 'audio/k.wav'\nfile 'silence_0500ms_8000hz_1ch_2b.wav'\n" if p != "r" else "", ";FFMETADATA1\n", None) for p in ("p", "q", "r")], "project_id string, title string, listing string, metadata string, cover_image_path string")
    sounds = spark.createDataFrame([(p, "audio/k.wav", audio.encode(np.full(80, 0.1), 8000)) for p in ("p", "q", "s")], "project_id string, path string, wav binary")
    for folder, systems, top in ((f"file://{tmp_path}/o", m4b.open_filesystem, tmp_path / "o"), (f"shelf:{tmp_path}/t//books", shelf, tmp_path / "t" / "books")):
        top.parent.mkdir(exist_ok=True)
        staged = m4b.assemble_books(books, folder, encode_file, sounds, systems)
        staged.write.parquet(f"{tmp_path}/staged-{top.name}")
        assert not list(top.glob("*/*.m4b"))  # a run that ends here leaves no book
        staged = spark.read.parquet(f"{tmp_path}/staged-{top.name}")
        for _ in range(2):  # as a repeated task would
            rows = {r["project_id"]: r for r in m4b.publish(staged, systems).collect()}
            assert {p: r["output"] for p, r in rows.items()} == {"p": f"{folder}/p/Same.m4b", "q": f"{folder}/q/Same.m4b", "r": None} and rows["r"]["error"] == "there is nothing to play"
        m4b.clear_staging(folder, systems)
        assert sorted(str(x.relative_to(top)) for x in top.rglob("*") if x.is_file()) == ["p/Same.m4b", "q/Same.m4b"]
    with pytest.raises(PreconditionError):
        m4b.assemble_books(books, "nowhere://b/o", encode_file, sounds)


def speak():
    return lambda text, clip, params: audio.encode(np.full(400 + len(text), 0.4), 8000)


def test_a_book_from_epub_to_audiobook(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(book(SAMPLE))
    known = spark.createDataFrame([("the", 5), ("narrator", 5)], "word string, freq long")
    there = files(spark, "/w.wav", "/d.wav")
    p = Providers(Scripted, speak, known.filter("false"), there, encode_file)
    ws = f"file://{tmp_path}/ws"
    call = lambda *a: cli.main([*a, "--workspace", ws], p, spark)
    assert call("new", f"{tmp_path}/in") == cli.OK
    assert call("run", "--until", "attribute") == cli.OK
    corpus = Corpus(spark, ws, p)
    t = corpus.tables()
    assert {(r["name"], r["category"]) for r in t["speakers"].collect()} == {("narrator", "unknown"), ("Alice", "woman"), ("Bob", "unknown")}
    assert t["segments"].filter("review_status = 'needs_review'").count() == 1
    assert call("run") == cli.REVIEW
    assert call("assign-voice", "--rest") == cli.PRECONDITION or call("status") == cli.OK
    corpus.config.voice_defaults = {"woman": "/w.wav", "default": "/d.wav"}
    assert {r["category"]: r["assigned"] for r in corpus.assign_rest().collect()} == {"woman": 1, "unknown": 2}
    assert call("run", "--auto-accept") == cli.OK
    assert [p.name for p in (tmp_path / "ws" / "output").glob("*/*")] == ["A Book.m4b"] and not os.path.exists("file:")
    t = corpus.tables()
    assert t["segments"].filter("audio_status = 'completed'").count() == t["segments"].count() >= t["audio"].count() > 0
    r = corpus.assemble(f"{tmp_path}/out")
    assert r.status == "completed", r.message
    (path,) = (tmp_path / "out").glob("*/A Book.m4b")
    made = path.read_text()
    assert "silence_" in made
    assert made.count("[CHAPTER]") == 2 and "title=Chapter Two" in made
    assert call("speakers") == cli.OK and "Alice (woman): woman (default)" in capsys.readouterr().out


def test_providers_by_name():
    providers.register_language("Scripted", lambda c: Scripted())
    assert isinstance(providers.language(Config(), "scripted", needed=True)(), Scripted)
    with pytest.raises(ConfigError, match="no speech provider"):
        providers.speech(Config())


def test_stages_and_outcomes(spark):
    done = spark.createDataFrame([("p", {"parse": "completed", "correct": "completed"}), ("q", {s: "completed" for s in gate.STAGES})], "project_id string, stage_status map<string,string>")
    assert {r["project_id"]: r["next_stage"] for r in gate.next_stage(done).collect()} == {"p": "attribute", "q": None}
    assert [r["stage"] for r in gate.stage_rows(done).filter("is_next").collect()] == ["attribute"]
    results = spark.createDataFrame([("a", "assemble", "completed", ""), ("b", "review", "needs_review", ""), ("c", "parse", "failed", "bad"), ("d", "parse", "stopped", "")], "project_id string, stage string, status string, message string")
    said = spark.createDataFrame([("b", "1 attribution")], "project_id string, summary string")
    assert {r["project_id"]: (r["kind"], r["summary"]) for r in gate.outcome(results, said).collect()} == {"a": ("completed", "complete"), "b": ("needs_review", "1 attribution"), "c": ("failed", "failed: bad"), "d": ("stopped", "stopped")}


def test_stream_of_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two\ntwo")
    q = ingest.ingest(ingest.line_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("line_pos", "text").orderBy("line_pos").collect() == [(0, "One two"), (1, "two")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
