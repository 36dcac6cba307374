"""Versions of tables, stages by project, stopping and going on, the command line with named providers."""

import collections
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.errors import LanguageProviderError, StoppedError, WorkspaceError
from folioflow.operators import gate, render, segment
from folioflow.plans import cli, providers, session
from folioflow.plans.progress import Watch
from folioflow.plans.session import Corpus, Providers
from folioflow.schema import PROJECTS, SEGMENTS, SPEAKERS, STAGES, VOICE_CLIPS
from folioflow.sources import audio, store

from .test_books import SAMPLE, Scripted, book, encode_file, files, speak

SCHEMAS = {"a": "k int, v string", "b": "k int"}


def test_a_commit_writes_what_changed(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", SCHEMAS)
    rows = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], SCHEMAS["a"])
    empty = s.current()
    assert empty.version == -1 and s.table(empty, "a").count() == 0
    one = s.commit(empty, {"a": rows(1), "b": rows(1).select("k")})
    two = s.commit(one, append={"a": rows(2, 3)})
    assert two.tables["b"] == one.tables["b"] and two.tables["a"][0] == one.tables["a"][0] and len(two.tables["a"]) == 2
    assert sorted(r["k"] for r in s.table(two, "a").collect()) == [1, 2, 3] and s.table(one, "a").count() == 1
    assert len(os.listdir(tmp_path / "s" / "tables" / "b")) == 1


def test_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    s = store.Store(spark, f"file://{tmp_path}/s", SCHEMAS)
    m = s.current()
    for i in range(4):
        m = s.commit(m, append={"b": spark.createDataFrame([(i,)], SCHEMAS["b"])})
    assert len(m.tables["b"]) == 2 and sorted(r["k"] for r in s.table(m, "b").collect()) == [0, 1, 2, 3]


def test_two_writers(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/s", SCHEMAS)
    rows = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], SCHEMAS["a"])
    base = s.commit(s.current(), {"a": rows(1), "b": rows(1).select("k")})
    s.commit(base, {"a": rows(2)})
    with pytest.raises(WorkspaceError, match="another writer has changed a"):
        s.commit(base, {"a": rows(3)})
    assert [r["k"] for r in s.table(s.current(), "a").collect()] == [2]
    last = s.commit(base, {"b": rows(9).select("k")}, {"a": rows(4)})  # other tables, and rows added: on top of the first writer's
    assert sorted(r["k"] for r in s.table(last, "a").collect()) == [2, 4] and s.table(last, "b").first()["k"] == 9
    # many at once: each comes through once
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(s.commit(last, append={"b": rows(i).select("k")}).version)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == list(range(last.version + 1, last.version + 5))
    assert sorted(r["k"] for r in s.table(s.current(), "b").collect()) == [0, 1, 2, 3, 9]


def test_expiry(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", SCHEMAS)
    m = s.current()
    for i in range(4):
        m = s.commit(m, {"a": spark.createDataFrame([(i, "x")], SCHEMAS["a"])} | ({} if i else {"b": spark.createDataFrame([(7,)], SCHEMAS["b"])}))
    assert s.expire(keep=2) == []  # too young to be told from a writer's at work
    assert s.versions() == [2, 3] and len(s.expire(keep=2, older_than_s=-5)) == 2
    assert s.table(s.current(), "a").first()["k"] == 3 and s.table(s.current(), "b").first()["k"] == 7 and s.table(s.read(2), "a").first()["k"] == 2


def test_due_and_marked(spark):
    done = lambda *x: dict.fromkeys(x, "completed")
    rows = [("new", {}), ("parsed", done("parse")), ("blocked", done(*STAGES[:3]) | {"review": "needs_review"}), ("all", done(*STAGES)), ("none", None), ("gap", done("parse", "attribute"))]
    p = spark.createDataFrame([(i, m) for i, m in rows], "project_id string, stage_status map<string,string>")
    found = {s: {r[0] for r in gate.due(p, s).collect()} for s in STAGES}
    assert found == {"parse": {"new", "none"}, "correct": {"parsed", "gap"}, "attribute": set(), "review": {"blocked"}, "synthesize": set(), "assemble": set()}
    told = spark.createDataFrame([("new", "completed"), ("none", "failed"), ("all", "failed")], "project_id string, status string")
    after = {r["project_id"]: r["stage_status"] for r in gate.marked(p, "parse", told).collect()}
    assert after["new"] == done("parse") and after["none"] == {} and after["all"] == done(*STAGES[1:]) and after["parsed"] == done("parse")


class Failing(Scripted):
    """Answers for one book, and breaks down at another's second chapter."""

    def attribute(self, context, candidates, known):
        if "Broken here" in context:
            raise LanguageProviderError("unreachable")
        return super().attribute(context, candidates, known)


def test_projects_go_their_own_ways(spark, tmp_path, capsys):
    """A book without errors reaches the end; one without text, a broken one, one whose provider fails and one that needs a review stop
    where they are, and go on later without doing again what was done."""
    (tmp_path / "in").mkdir()
    fine = [("1.xhtml", '<h1>One</h1><p>"Hello there," said Alice.</p>')]
    broken = [*fine, ("2.xhtml", '<h1>Two</h1><p>"Broken here," said Alice.</p>')]
    for name, data in {"fine": book(fine, "Fine"), "open": book(SAMPLE, "Open"), "silent": book([("1.xhtml", "<p><img/></p>")], "Silent"), "spineless": book([], "Bare"), "corrupt": b"no zip", "cut[1]*": book(broken, "Cut")}.items():
        (tmp_path / "in" / f"{name}.epub").write_bytes(data)
    there = files(spark, "/w.wav", "/d.wav")
    p = Providers(Failing, speak, None, there, encode_file)
    corpus = Corpus(spark, f"file://{tmp_path}/ws", p)
    corpus.create(f"{tmp_path}/in")
    corpus.create(f"{tmp_path}/in")
    assert corpus.tables()["projects"].count() == 6
    corpus.config.voice_defaults = {"default": "/d.wav"}
    corpus.run("attribute")
    corpus.assign_rest()
    r = corpus.run()
    name = {row["project_id"]: row["name"] for row in corpus.tables()["projects"].collect()}
    ends = {name[row["project_id"]]: (row["stage"], row["status"]) for row in r.projects.collect()}
    assert ends == {"fine": ("assemble", "completed"), "open": ("review", "needs_review"), "silent": ("parse", "failed"), "spineless": ("parse", "failed"), "corrupt": ("parse", "failed"), "cut[1]*": ("attribute", "failed")}
    said = {name[row["project_id"]]: row["message"] for row in corpus.tables()["stage_results"].filter("status <> 'completed'").collect()}
    assert said["silent"] == said["spineless"] == "the book has no text" and "unreachable" in said["cut[1]*"] and "zip" in said["corrupt"].lower()
    assert r.status == "failed" and "3 failed at parse" in r.message
    assert [x.name for x in (tmp_path / "ws" / "output").glob("*/*")] == ["Fine.m4b"]
    titles = {row["name"]: row["title"] for row in corpus.tables()["projects"].collect()}
    assert titles["fine"] == "Fine" and titles["corrupt"] == "corrupt"
    cut = [k for k, v in name.items() if v == "cut[1]*"][0]
    kept = corpus.tables()["segments"].filter(F.col("project_id") == cut)
    assert {row["chapter_pos"] for row in kept.collect()} == {0}  # what was answered before the failure
    # the provider is back, the corrupt file is mended: all but the silent ones go on
    corpus.providers.language = Scripted
    (tmp_path / "in" / "corrupt.epub").write_bytes(book(fine, "Mended"))
    corpus.run("attribute")
    corpus.auto_accept()
    if not corpus.blockers().filter("size(unassigned_voices) > 0").isEmpty():
        corpus.assign_rest()
    r = corpus.run()
    ends = {name[row["project_id"]]: (row["stage"], row["status"]) for row in r.projects.collect()}
    assert ends == {"open": ("assemble", "completed"), "corrupt": ("assemble", "completed"), "cut[1]*": ("assemble", "completed"), "silent": ("parse", "failed"), "spineless": ("parse", "failed")}
    again = corpus.tables()["segments"].groupBy("segment_id").count().filter("count > 1")
    assert again.isEmpty()
    assert cli.main(["status", "--workspace", corpus.path], p, spark) == cli.OK
    out = capsys.readouterr().out
    assert "parse: pending (failed: the book has no text)" in out and "assemble: completed" in out


def voiced_corpus(spark, tmp_path, n, speech):
    corpus = Corpus(spark, f"file://{tmp_path}/ws", Providers(None, speech, None, files(spark, "/n.wav"), encode_file))
    corpus.tables()
    state = dict.fromkeys(STAGES[:4], "completed")
    rows = [("p", 0, i, 0, f"s{i}", f"text {i}", "n", "narrator", 1.0, "approved", None, "pending", None) for i in range(n)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    corpus.save(projects=frame([("p", 3, "n", "/w", "T", "A", "/b.epub", None, state, "{}")], PROJECTS), segments=frame(rows, SEGMENTS), speakers=frame([("p", 0, "n", "narrator", "narrator", "v", "unknown")], SPEAKERS), voice_clips=frame([("p", 0, "v", "/n.wav", "n")], VOICE_CLIPS))
    return corpus


def test_a_stopped_stage_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "A_TASK", 4)
    calls = tmp_path / "calls"
    calls.mkdir()

    def speech():
        def say(text, clip, params):
            time.sleep(0.15)
            (calls / f"{text}-{time.time_ns()}").touch()
            return audio.encode(np.full(50, 0.2), 8000)

        return say

    n = 120
    corpus = voiced_corpus(spark, tmp_path, n, speech)
    counts = []
    corpus.watch = Watch(counts.append)
    threading.Thread(target=lambda: (wait_for(lambda: len(os.listdir(calls)) > 40), corpus.watch.stop())).start()
    r = corpus.run()
    assert (r.status, r.message) == ("stopped", "1 stopped at synthesize (stopped)")
    done = {row["text"] for row in corpus.tables()["segments"].filter("audio_status = 'completed'").collect()}
    assert 0 < len(done) < n and corpus.tables()["audio"].count() == len(done)
    assert counts and counts[-1].units == n and 0 < max(c.units_done for c in counts) < n and counts[-1].tasks_done < counts[-1].tasks
    before = collections.Counter(x.rsplit("-", 1)[0] for x in os.listdir(calls))
    assert "synthesize" not in corpus.tables()["projects"].first()["stage_status"]
    corpus.watch = Watch()
    assert corpus.synthesize().status == "completed"
    after = collections.Counter(x.rsplit("-", 1)[0] for x in os.listdir(calls))
    assert all(after[t] == before[t] for t in done) and len(after) == n
    assert sum(after.values()) <= n + 4 * 4  # at most the tasks at work when it was stopped began anew
    t = corpus.tables()
    assert t["segments"].filter("audio_status = 'completed'").count() == n == t["audio"].count()
    assert render.unrendered(t["segments"], t["audio"].select("cache_key")).isEmpty()
    assert not os.listdir(tmp_path / "ws" / "answers")


def wait_for(what, most_s=60):
    end = time.time() + most_s
    while not what() and time.time() < end:
        time.sleep(0.02)


def test_a_stopped_job_commits_nothing(spark, tmp_path):
    watch = Watch()
    threading.Thread(target=lambda: (time.sleep(1), watch.stop())).start()

    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    begun = time.time()
    with pytest.raises(StoppedError):
        watch.run(spark, "slow", lambda: spark.range(4).mapInArrow(slow, "id long").count())
    assert time.time() - begun < 20 and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(StoppedError, match="wasn't begun"):
        watch.run(spark, "next", lambda: 1)


def test_command_line_with_named_providers(spark, tmp_path, capsys):
    providers.register_language("scripted", lambda c: Scripted())
    providers.register_speech("tone", lambda c: speak())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(book([("1.xhtml", '<p>"Hello there," said Alice.</p>')]))
    (tmp_path / "clips").mkdir()
    for name in ("w.wav", "d.wav"):
        (tmp_path / "clips" / name).write_bytes(b"x")
    clip = lambda n: f"file:{tmp_path}/clips/{n}.wav"
    call = lambda *a: cli.main([*a, "--workspace", f"file://{tmp_path}/ws"], None, spark)
    assert call("new", f"{tmp_path}/in") == cli.OK
    assert call("run", "--until", "attribute", "--provider", "nobody") == cli.PRECONDITION
    assert call("run", "--until", "attribute") == cli.ERROR and "no language provider" in capsys.readouterr().out
    assert call("run", "--until", "attribute", "--provider", "Scripted", "--progress") == cli.OK
    assert "tasks" in capsys.readouterr().out
    assert call("assign-voice", "--rest", "--man", clip("d"), "--clips", f"{tmp_path}/clips") == cli.PRECONDITION
    assert "no clip for categories: unknown (speakers: narrator); woman (speakers: Alice); pass --woman / --default" in capsys.readouterr().err
    assert call("assign-voice", "--rest", "--woman", clip("w"), "--default", clip("d"), "--clips", f"{tmp_path}/clips") == cli.OK
    assert "assigned clips to 2 speakers: unknown x1, woman x1" in capsys.readouterr().out
    assert call("run", "--until", "synthesize", "--speech", "tone", "--clips", f"{tmp_path}/clips") == cli.OK
    assert call("run", "--until", "synthesize", "--speech", "tone", "--clips", f"{tmp_path}/clips") == cli.OK and "nothing to do" in capsys.readouterr().out
    assert call("expire", "--keep", "1") == cli.OK


def test_another_segmenter(spark):
    """Direct speech between dashes, as some languages set it."""
    dashes = lambda text: F.transform(F.filter(F.split(text, "—"), lambda x: F.trim(x) != ""), lambda x, i: F.struct(F.trim(x).alias("text"), ((i % 2) == 1).alias("is_quote")))
    lines = spark.createDataFrame([("p", 0, 0, 'He said — "Come" here — and left.')], "project_id string, chapter_pos int, line_pos int, text string")
    narr = spark.createDataFrame([("p", "n")], "project_id string, narrator_id string")
    got = segment.line_segments(lines, narr, segmenter=dashes).orderBy("seg_pos").collect()
    assert [(r["text"], r["review_status"]) for r in got] == [("He said", "approved"), ('"Come" here', "needs_review"), ("and left.", "approved")]
    assert len(segment.line_segments(lines, narr).collect()) == 3


def test_answers_are_read_alike(spark):
    """On the JVM by the declared schema, and in a task where the next window needs the names."""
    import json

    from folioflow.operators import attribute

    entry = lambda i, **x: {"segment_id": i, **x}
    answers = [
        {"attributions": [entry("a", speaker="Ann", confidence=0.5, rationale="r"), entry("b", speaker="The Narrator")]}, {"attributions": [entry("a", speaker="Ann"), entry("a", speaker="Bob", confidence="0.25")]}, {"attributions": []}, {"attributions": [entry("zz", speaker="x")]},
        {"attributions": [entry("a", speaker=None, confidence="much")]}, {"attributions": [entry("b", speaker=7, confidence=None)]}, {"attributions": 3}, {}, {"other": []}, {"attributions": [{"speaker": "x"}]}, {"attributions": [entry("a", speaker="Ann"), {"speaker": "x"}]}, {"attributions": None}, [1], 5, "text",
    ]
    raw = [json.dumps(a) for a in answers] + ["", "no JSON", '{"attributions": [', "null"]
    frame = spark.createDataFrame([(i, r, ["a", "b"]) for i, r in enumerate(raw)] + [(99, None, ["a", "b"]), (98, raw[0], [])], "k int, answer string, candidates array<string>")
    got = collections.defaultdict(list)
    for r in attribute.read_attributions(frame).orderBy("k", "at").collect():
        got[r["k"]].append(r)
    for i, text in enumerate(raw):
        try:
            want = [(a.segment_id, a.speaker, a.confidence, a.rationale != "missing") for a in attribute.parse_attributions(text, ["a", "b"])]
            assert [tuple(r[c] for c in ("segment_id", "speaker", "confidence", "answered")) for r in got[i]] == want and not got[i][0]["malformed"], text
        except LanguageProviderError:
            assert all(r["malformed"] and not r["answered"] and r["speaker"] is None for r in got[i]) and len(got[i]) == 2, text
    assert [(r["answered"], r["malformed"]) for r in got[99]] == [(False, False)] * 2 and not got[98]
    told = [{"classifications": [{"speaker_id": "s", "category": " BOY ", "confidence": 1}]}, {"classifications": [{"speaker_id": "s", "category": 3}]}, {"classifications": [{"category": "boy"}]}, {}]
    frame = spark.createDataFrame([(i, json.dumps(t), ["s", "t"]) for i, t in enumerate(told)], "k int, answer string, wanted array<string>")
    assert sorted(tuple(r) for r in attribute.read_categories(frame).collect()) == [(0, "s", "boy", 1.0), (0, "t", "unknown", 0.0), (1, "s", "unknown", 0.0), (1, "t", "unknown", 0.0)]


def short_book(data, stem):
    """A parser of another format: a chapter a line."""
    from folioflow.errors import EbookParseError
    from folioflow.sources.epub import Book, Chapter

    if not data:
        raise EbookParseError("empty")
    return Book(stem.upper(), "nobody", [Chapter(i, "", f"Line {i}", [x]) for i, x in enumerate(data.decode().splitlines(), 1)])


def test_books_as_a_data_source(spark, tmp_path):
    from folioflow.sources import book_source

    book_source.register(spark)
    (tmp_path / "deep").mkdir()
    for name, data in (("a.epub", book(SAMPLE)), ("deep/b.EPUB", book(SAMPLE, "Deep")), ("c.epub", b"broken"), ("d.epub", book([])), ("e.lines", b"one\ntwo"), ("f.lines", b""), ("g.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    read = spark.read.format("books").option("partitionBytes", 1).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 4
    rows = {(r["path"].rsplit("/", 1)[1], r["chapter_pos"]): r for r in read.collect()}
    assert rows.keys() == {("a.epub", 0), ("a.epub", 1), ("b.EPUB", 0), ("b.EPUB", 1), ("c.epub", None), ("d.epub", None)}
    assert rows["b.EPUB", 1]["title"] == "Deep" and rows["c.epub", None]["error"] and rows["d.epub", None]["error"] is None and rows["c.epub", None]["size"] == 6
    assert spark.read.format("books").load(f"{tmp_path}/a.epub").select("chapter_title").count() == 2
    other = spark.read.format("books").option("suffix", ".lines").option("parser", f"{__name__}:short_book").load(str(tmp_path))
    assert sorted((r["title"], r["chapter_title"], r["lines"], r["error"]) for r in other.filter("error is null").collect()) == [("E", "Line 1", ["one"], None), ("E", "Line 2", ["two"], None)]
    assert other.filter("error is not null").count() == 1
    for bad in (spark.read.format("books").option("mode", "failfast").load(str(tmp_path)), spark.read.format("books").load(f"{tmp_path}/none")):
        with pytest.raises(Exception, match="zip|FileNotFound|none"):
            bad.collect()
