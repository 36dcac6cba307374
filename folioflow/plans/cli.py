"""Command line: new, run, status, speakers, assign-voice, expire."""

from __future__ import annotations

import argparse
import importlib
import signal
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import ConfigError, FolioError, PreconditionError
from ..operators import actions, gate, resolve, voice
from ..schema import CATEGORIES, STAGES
from . import providers as named
from .progress import Watch, printer
from .session import Corpus, Providers

# Fixed exit codes.
OK, ERROR, PRECONDITION, REVIEW, STOPPED = 0, 1, 2, 3, 4
#: Categories that an option names a clip for.
VOICED = tuple(c for c in CATEGORIES if c != "unknown")
#: Rows that a listing of the command line prints of each kind at most.
SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    sub = p.add_subparsers(dest="command", required=True)
    new = sub.add_parser("new", help="projects for the books of a folder")
    new.add_argument("ebooks")
    run = sub.add_parser("run", help="the stages, from where each project stands")
    run.add_argument("--until", choices=STAGES)
    run.add_argument("--auto-accept", action="store_true", help="accept what needs a review and go on")
    run.add_argument("--progress", action="store_true", help="print counts of tasks and segments")
    status = sub.add_parser("status")
    speakers = sub.add_parser("speakers")
    assign = sub.add_parser("assign-voice")
    assign.add_argument("speaker", nargs="?")
    assign.add_argument("clip", nargs="?")
    assign.add_argument("--rest", action="store_true", help="clips by category for all speakers without a voice")
    for c in VOICED:
        assign.add_argument(f"--{c}", help=f"clip of speakers of category {c}")
    assign.add_argument("--default", help="clip of all others")
    assign.add_argument("--project", help="id of the project the speaker is in")
    expire = sub.add_parser("expire", help="remove old versions")
    expire.add_argument("--keep", type=int, default=5)
    for c in (new, run, status, speakers, assign, expire):
        c.add_argument("--workspace", required=True)
    for c in (run, status, speakers, assign):
        c.add_argument("--clips", help="folder of voice clips")
    run.add_argument("--provider", help="name of the language provider")
    run.add_argument("--speech", help="name of the speech provider")
    run.add_argument("--dictionary", help="Parquet table of word and freq")
    run.add_argument("--plugin", action="append", default=[], help="module that registers providers when it is imported")
    return p


def given_providers(args, config: Config, spark: SparkSession) -> Providers:
    """What the options and the environment name; a provider named `none` is none."""
    for module in getattr(args, "plugin", []):
        importlib.import_module(module)
    out = Providers()
    if args.command == "run":
        language, speech = args.provider or config.language_provider, args.speech or config.speech_provider
        out.language = None if language == "none" else named.language(config, language)
        out.speech = None if speech == "none" else named.speech(config, speech)
        out.dictionary = spark.read.parquet(args.dictionary) if args.dictionary else None
    if getattr(args, "clips", None):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.clips)
        out.clip_files = files.select("path")
    return out


def main(argv: list[str] | None = None, providers: Providers | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    watch = Watch(printer() if getattr(args, "progress", False) else None)
    old = signal.signal(signal.SIGINT, lambda *_: watch.stop())
    try:
        spark = spark or SparkSession.builder.appName("folioflow").getOrCreate()
        config = Config.from_env()
        corpus = Corpus(spark, args.workspace, providers or given_providers(args, config, spark), config, watch)
        return COMMANDS[args.command](corpus, args)
    except (PreconditionError, ConfigError) as e:
        print(f"error: {e}", file=sys.stderr)
        return PRECONDITION
    except (FolioError, ValueError, ImportError) as e:
        print(f"error: {e}", file=sys.stderr)
        return ERROR
    finally:
        signal.signal(signal.SIGINT, old)


def new(corpus: Corpus, args) -> int:
    corpus.create(args.ebooks)
    print(f"{corpus.tables()['projects'].count()} projects in {corpus.path}")
    return OK


def run(corpus: Corpus, args) -> int:
    r = corpus.run(args.until)
    if args.auto_accept and any(c["status"] == "needs_review" for c in r.counts):
        corpus.auto_accept()
        r = corpus.run(args.until)
    print(r.message or "nothing to do")
    return {"completed": OK, "needs_review": REVIEW, "stopped": STOPPED}.get(r.status, ERROR)


def status(corpus: Corpus, args) -> int:
    t = corpus.tables()
    blocked = corpus.review_state(t).select("project_id", F.col("summary").alias("blocked"))
    told = t["stage_results"].select("project_id", "stage", F.col("status").alias("last"), "message")
    rows = gate.stage_rows(t["projects"]).join(told, ["project_id", "stage"], "left").join(blocked, "project_id", "left")
    for r in rows.orderBy("project_id", "stage_pos").limit(SHOWN * len(STAGES)).collect():
        last = f" ({r['last']}: {r['message']})" if r["last"] not in (None, "completed") and not r["is_complete"] else ""
        print(f"{r['project_id']} {'>' if r['is_next'] else ' '} {r['stage']}: {r['status']}{last}")
        if r["stage"] == "review" and not r["is_complete"]:
            print(f"{r['project_id']}     {r['blocked']}")
    return OK


def speakers(corpus: Corpus, args) -> int:
    t = corpus.tables()
    for r in voice.voice_rows(t["segments"], t["speakers"], t["voice_clips"], corpus.clip_files()).orderBy("project_id", "speaker_pos").limit(SHOWN).collect():
        print(f"{r['project_id']} {r['speaker_pos']} {r['name']} ({r['category']}): {r['clip_label'] or '-'}" + " needs a voice" * r["needs_voice"])
    return OK


def assign(corpus: Corpus, args) -> int:
    if args.rest:
        if args.speaker or args.clip:
            raise PreconditionError("--rest goes without a speaker and a clip")
        counts = corpus.assign_rest({c: getattr(args, c) for c in (*VOICED, "default")}).collect()
        print(f"assigned clips to {sum(r['assigned'] for r in counts)} speakers: " + ", ".join(f"{r['category']} x{r['assigned']}" for r in counts))
        return OK
    if not args.speaker or not args.clip:
        raise PreconditionError("name a speaker and a clip, or --rest")
    t = corpus.tables()
    hits = resolve.find_speaker(t["speakers"], args.speaker, args.project).limit(2).collect()
    if not hits:
        raise ValueError(f"no speaker {args.speaker!r}")
    if len(hits) > 1:
        raise PreconditionError(f"speaker {args.speaker!r} stands in several projects: name one with --project")
    h = hits[0]
    clips, clip = actions.register_clip(t["voice_clips"], corpus.clip_files(), h["project_id"], args.clip)
    pair = corpus.spark.createDataFrame([(h["project_id"], h["speaker_id"], clip)], "project_id string, speaker_id string, clip_id string")
    told = actions.assign_voices(t["speakers"], clips, pair)
    corpus.save(voice_clips=clips, speakers=told, projects=actions.stale(t["projects"], pair.select("project_id"), actions.AUDIO))
    return OK


def expire(corpus: Corpus, args) -> int:
    print(f"{len(corpus.expire(args.keep))} folders removed")
    return OK


COMMANDS = {"new": new, "run": run, "status": status, "speakers": speakers, "assign-voice": assign, "expire": expire}

if __name__ == "__main__":
    sys.exit(main())
