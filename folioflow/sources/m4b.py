"""The finished audiobook: one file per book, put together by an encoder from a list of sounds and a file of chapters."""

from __future__ import annotations

import os
import re
import shutil
import struct
import subprocess
import tempfile
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssemblyError, PreconditionError
from .audio import silence

#: Fixed value: the rate of the encoded sound.
BITRATE = "128k"
#: How files of the kinds of cover begin.
MAGIC = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")
_SILENCE = re.compile(r"silence_(\d+)ms_(\d+)hz_(\d+)ch_(\d+)b\.wav\Z")
COVERS = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg"}
#: Where finished files wait for publish(), below the folder of audiobooks.
STAGING = ".staging"

#: listing path, metadata path, output path, cover path or null.
Encoder = Callable[[str, str, str, str | None], None]


def plain_name(title: str | None) -> str:
    """A file name from a title, as functions.text.sanitize_filename makes it."""
    kept = "".join(c for c in title or "" if c not in '/\\:*?"<>|' and unicodedata.category(c)[0] != "C")
    return re.sub(r"\s+", " ", kept).strip() or "audiobook"


def ffmpeg(listing: str, metadata: str, output: str, cover: str | None) -> None:
    """Joins, encodes and tags with the ffmpeg binary."""
    if not shutil.which("ffmpeg"):
        raise AssemblyError("ffmpeg isn't installed")
    art = ["-i", cover] if cover else []
    maps = ["-map", "0:a", *(["-map", "2:v", "-c:v", "copy", "-disposition:v:0", "attached_pic"] if cover else [])]
    run = subprocess.run(["ffmpeg", "-y", "-f", "concat", "-safe", "0", "-i", listing, "-i", metadata, *art, "-map_metadata", "1", "-map_chapters", "1", *maps, "-c:a", "aac", "-b:a", BITRATE, "-f", "mp4", output], capture_output=True, text=True, check=False)
    if run.returncode:
        raise AssemblyError(run.stderr[-500:])


def whole_picture(data: bytes) -> bool:
    """Whether a PNG has all its chunks with the right check sums, or a JPEG its end."""
    if data.startswith(MAGIC[1]):
        return data.rstrip(b"\0").endswith(b"\xff\xd9")
    at, kinds = len(MAGIC[0]), []
    if not data.startswith(MAGIC[0]):
        return False
    while at + 12 <= len(data) and b"IEND" not in kinds:
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            return False
        kinds.append(kind)
        at += 12 + n
    return kinds[:1] == [b"IHDR"] and b"IDAT" in kinds and b"IEND" in kinds


def absolute(listing: str, folder: str) -> str:
    """The listing with the paths of the sounds in a folder; makes the pauses that it names."""
    out = []
    for line in listing.splitlines():
        name = os.path.basename(line.removeprefix("file '").removesuffix("'").replace("'\\''", "'"))
        path = os.path.join(folder, name)
        if (m := _SILENCE.match(name)) and not os.path.exists(path):
            ms, *form = map(int, m.groups())
            with open(path, "wb") as f:
                f.write(silence(ms / 1000, *form)[1])
        out.append("file '" + path.replace("'", "'\\''") + "'\n")
    return "".join(out)


def assemble(listing: str, metadata: str, folder: str, cover: str | None = None, encoder: Encoder = ffmpeg) -> str:
    """The path of one book, made in a folder of the task's own. A cover that the encoder can't take is left out."""
    if not listing.strip():
        raise AssemblyError("there is nothing to play")
    names = {}
    for name, content in (("list", listing), ("chapters", metadata)):
        names[name] = os.path.join(folder, f"{name}.txt")
        with open(names[name], "w", encoding="utf-8") as f:
            f.write(content)
    made = os.path.join(folder, "book.m4b")
    try:
        encoder(names["list"], names["chapters"], made, cover)
    except (AssemblyError, OSError):
        if cover is None:
            raise
        encoder(names["list"], names["chapters"], made, None)
    if not os.path.isfile(made):
        raise AssemblyError("the encoder made no file")
    return made


def open_filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, and the folder in it: a plain path or file:, hdfs:, s3: (s3a:, s3n:), gs: or abfs:."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), uri.rstrip("/")
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.strip("/")
    try:
        fs, path = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    except (pa.ArrowInvalid, OSError, NotImplementedError) as e:
        raise PreconditionError(f"audiobooks can't be written to {uri}: {e}") from e
    return fs, path.rstrip("/")


#: A folder's URI -> its file system and the path in it.
FileSystems = Callable[[str], tuple[pa.fs.FileSystem, str]]


def cover_file(uri: str | None, folder: str, filesystems: FileSystems) -> str | None:
    """A copy of a cover that is there, whole, and of a kind that can be embedded; one that isn't is left out, no reason to fail."""
    kind = os.path.splitext(uri or "")[1].lower()
    if kind not in COVERS:
        return None
    try:
        fs, path = filesystems(uri)
        with fs.open_input_stream(path) as f:
            data = f.read()
    except (OSError, PreconditionError):
        return None
    if not whole_picture(data):
        return None
    copy = os.path.join(folder, f"cover{kind}")
    with open(copy, "wb") as f:
        f.write(data)
    return copy


def assemble_books(books: DataFrame, folder: str, encoder: Encoder = ffmpeg, sounds: DataFrame | None = None, filesystems: FileSystems = open_filesystem) -> DataFrame:
    """project_id, staged, output, error of each row of books (project_id, title, listing, metadata, cover_image_path). The sounds
    (project_id, path, wav) of a book stream to one task, which puts them into a scratch folder of its own, makes the pauses, has the
    encoder join them, and ships the finished file to a staging folder below `folder`, on whatever file system that is. publish() puts
    the files in their places. Each project has its own folder, so equal titles don't meet. A task that is killed or repeated leaves
    nothing but staged files, which no one reads."""
    schema = pa.schema([("project_id", pa.string()), ("staged", pa.string()), ("output", pa.string()), ("error", pa.string())])
    filesystems(folder)  # refused here rather than in every task
    stage = f"{folder.rstrip('/')}/{STAGING}/{uuid.uuid4().hex}"

    def book(r: dict, tmp: str) -> tuple:
        name = f"{plain_name(r['project_id'])}/{plain_name(r['title'])}.m4b"
        try:
            made = assemble(absolute(r["listing"] or "", tmp), r["metadata"], tmp, cover_file(r["cover_image_path"], tmp, filesystems), encoder)
            fs, top = filesystems(stage)
            at = f"{top}/{uuid.uuid4().hex}.m4b"
            fs.create_dir(top)
            with open(made, "rb") as f, fs.open_output_stream(at) as out:
                shutil.copyfileobj(f, out, 1 << 20)
            return r["project_id"], f"{stage}/{at.rsplit('/', 1)[1]}", f"{folder.rstrip('/')}/{name}", None
        except (AssemblyError, OSError) as e:
            return r["project_id"], None, None, str(e)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tmp = None, None
        try:
            for b in batches:
                for r in b.to_pylist():
                    if tmp is None or r["project_id"] != now:
                        if tmp is not None:
                            tmp.cleanup()
                        now, tmp = r["project_id"], tempfile.TemporaryDirectory()
                    if r["path"] is not None:
                        with open(os.path.join(tmp.name, os.path.basename(r["path"])), "wb") as f:
                            f.write(r["wav"])
                        continue
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, book(r, tmp.name), strict=True))], schema=schema)
        finally:
            if tmp is not None:
                tmp.cleanup()

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    text = ["title", "listing", "metadata", "cover_image_path"]
    rows = books.select("project_id", F.lit(True).alias("last"), none("string", "path"), none("binary", "wav"), *text)
    if sounds is not None:
        rows = rows.unionByName(sounds.select("project_id", F.lit(False).alias("last"), "path", "wav", *[none("string", c) for c in text]))
    return rows.repartition("project_id").sortWithinPartitions("project_id", "last").mapInArrow(task, "project_id string, staged string, output string, error string")


def publish(made: DataFrame, filesystems: FileSystems = open_filesystem) -> DataFrame:
    """project_id, output, error: the staged files of assemble_books, whose rows have been written down, moved to their places. A file
    that an earlier try has moved is in its place already."""
    schema = pa.schema([("project_id", pa.string()), ("output", pa.string()), ("error", pa.string())])

    def put(staged: str, output: str) -> str | None:
        fs, source = filesystems(staged)
        _, target = filesystems(output)
        here, there = (x.type != pa.fs.FileType.NotFound for x in fs.get_file_info([source, target]))
        if here:
            fs.create_dir(target.rsplit("/", 1)[0])
            if there:
                fs.delete_file(target)
            fs.move(source, target)
        return None if here or there else "the finished file is gone"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                error = r["error"]
                if r["staged"]:
                    try:
                        error = put(r["staged"], r["output"])
                    except OSError as e:
                        error = str(e)
                out.append({"project_id": r["project_id"], "output": None if error else r["output"], "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return made.mapInArrow(task, "project_id string, output string, error string")


def clear_staging(folder: str, filesystems: FileSystems = open_filesystem) -> None:
    """Removes what tasks that were repeated or killed have left; not while another run writes to the same folder."""
    fs, top = filesystems(f"{folder.rstrip('/')}/{STAGING}")
    if fs.get_file_info(top).type != pa.fs.FileType.NotFound:
        fs.delete_dir(top)


def first_output(spark: SparkSession, folder: str) -> str | None:
    """The path of the first audiobook below a folder, in order of paths; null if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.m4b").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.min("path")).first()[0]
