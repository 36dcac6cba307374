"""EPUB books and single HTML pages as tables of chapters and lines."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EbookParseError
from ..schema import make_id
from .html import document_lines

# Fixed names of the format.
_CONTAINER = "META-INF/container.xml"
_DOCUMENTS = frozenset({"application/xhtml+xml", "text/html"})


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(root, name: str):
    return (e for e in root.iter() if _local(e) == name)


@dataclass
class Chapter:
    position: int
    href: str
    title: str
    lines: list[str]


@dataclass
class Book:
    title: str
    author: str
    chapters: list[Chapter] = field(default_factory=list)


def without_fragment(href: str) -> str:
    return href.split("#", 1)[0]


def first_text(root, name: str) -> str | None:
    for e in _all(root, name):
        return (e.text or "").strip() or None
    return None


def contents(archive: zipfile.ZipFile, base: str, items: dict[str, dict]) -> dict[str, str]:
    """Labels of the table of contents by file, depth first, the first label of a file counts: the navigation document, else the NCX."""
    out: dict[str, str] = {}

    def put(folder: str, href: str | None, label: str | None) -> None:
        label = " ".join((label or "").split())
        href = without_fragment(unquote((href or "").strip()))
        if href and label:
            out.setdefault(posixpath.normpath(posixpath.join(folder, href)), label)

    def read(item: dict):
        name = posixpath.normpath(posixpath.join(base, unquote(item["href"])))
        return posixpath.dirname(name), ElementTree.fromstring(archive.read(name))

    ncx = [i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"]
    nav = [i for i in items.values() if "nav" in i.get("properties", "").split()]
    for item in nav[:1]:
        folder, root = read(item)
        for part in _all(root, "nav"):
            if any(k.endswith("type") and "toc" in v.split() for k, v in part.attrib.items()):
                for a in _all(part, "a"):
                    put(folder, a.get("href"), "".join(a.itertext()))
    if not out:
        for item in ncx[:1]:
            folder, root = read(item)
            for point in _all(root, "navPoint"):
                label = next((e for e in point if _local(e) == "navLabel"), None)
                target = next((e for e in point if _local(e) == "content"), None)
                put(folder, target.get("src") if target is not None else None, "".join(label.itertext()) if label is not None else None)
    return out


def parse_epub(data: bytes, stem: str = "book", implied_close: bool = False) -> Book:
    """The book: chapters are the documents of the spine in its order, without those marked linear="no", missing ones and the navigation.
    A chapter's title: label in the contents, else its first heading, else its item's title, else `Chapter n`."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            container = ElementTree.fromstring(z.read(_CONTAINER))
            package = next(_all(container, "rootfile")).get("full-path") or ""
            base = posixpath.dirname(package)
            root = ElementTree.fromstring(z.read(package))
            items = {e.get("id"): dict(e.attrib) for e in _all(root, "item") if e.get("id")}
            labels = contents(z, base, items)
            book = Book(first_text(root, "title") or stem, first_text(root, "creator") or "Unknown")
            for ref in _all(root, "itemref"):
                item = items.get(ref.get("idref"))
                if (ref.get("linear") or "yes").lower() == "no" or item is None or item.get("media-type") not in _DOCUMENTS or "nav" in item.get("properties", "").split():
                    continue
                name = posixpath.normpath(posixpath.join(base, unquote(item["href"])))
                if name not in z.namelist():
                    continue
                heading, lines = document_lines(z.read(name).decode("utf-8", "replace"), implied_close)
                n = len(book.chapters) + 1
                book.chapters.append(Chapter(n, name, labels.get(name) or heading or item.get("title") or f"Chapter {n}", lines))
            return book
    except EbookParseError:
        raise
    except Exception as e:  # whatever a broken archive sets off is one kind of error to the caller
        raise EbookParseError(f"{stem}: {e}") from e


Parser = Callable[[bytes, str], Book]
#: Parsers by lower-case suffix.
PARSERS: dict[str, Parser] = {".epub": parse_epub}


def parser_for(path: str) -> Parser:
    suffix = posixpath.splitext(path)[1].lower()
    if suffix not in PARSERS:
        raise EbookParseError(f"no parser for {path!r}")
    return PARSERS[suffix]


_NAMES = {"pathGlobFilter": "*.[eE][pP][uU][bB]", "recursiveFileLookup": "true"}


#: Bytes that opening a file counts for when Spark packs books into tasks; by its own 4 MB a task would hold some thirty, however small.
OPEN_COST = 1 << 16
#: Files that are listed at once: the driver holds some 2 kB for each of them until they are read.
MOST_NAMES = 50_000


#: A file counts for little when tasks are packed, and the names found aren't cached in the driver: each list of them is read once.
_PACKED = {"spark.sql.files.openCostInBytes": str(OPEN_COST), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


@contextmanager
def packed(spark: SparkSession) -> Iterator[None]:
    """While books are read: tasks of about as many bytes as other readers' tasks, and no cache of names."""
    before = {k: spark.conf.get(k) for k in _PACKED}
    for k, v in _PACKED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _plain(path: str) -> str:
    """A path spelt so that no character of it is a wildcard."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def parts(spark: SparkSession, folder: str, most: int | None = None) -> Iterator[str | list[str]]:
    """What lies below a folder, in lists of folders, or of files, with `most` files (MOST_NAMES) below each list at most, so that the
    driver never holds the names of more. A pattern stays as it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):  # a pattern, or nothing
        yield folder
        return
    yield from _parts(fs, fs.getFileStatus(at).getPath(), most or MOST_NAMES)


def _parts(fs, at, most: int) -> Iterator[list[str]]:
    if fs.getContentSummary(at).getFileCount() <= most:
        yield [at.toString()]
        return
    held, n, own = [], 0, []
    found = fs.listStatusIterator(at)
    while found.hasNext():
        x = found.next()
        name, inner = x.getPath().getName(), x.isDirectory()
        # Spark's readers don't see these either.
        if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
            continue
        if not inner:
            own.append(x.getPath().toString())
            if len(own) >= most:
                yield own
                own = []
            continue
        k = fs.getContentSummary(x.getPath()).getFileCount()
        if k > most:
            yield from _parts(fs, x.getPath(), most)
            continue
        if held and n + k > most:
            yield held
            held, n = [], 0
        held.append(x.getPath().toString())
        n += k
    yield from (x for x in (own, held) if x)


def book_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """project_id, path of the books below a folder, or of a list that parts() gives; only their names are read."""
    path = [_plain(p) for p in path] if isinstance(path, list) else path
    files = spark.read.format("binaryFile").options(**_NAMES).load(path).select("path")
    return files.select(make_id("prj", "path").alias("project_id"), "path")


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few paths that exist, spelt so that no character of them is a wildcard."""
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return [_plain(p) for p, x in zip(paths, at, strict=True) if x.getFileSystem(conf).exists(x)]


BOOK_ROWS = "path string, title string, author string, chapter_pos int, chapter_title string, lines array<string>, error string"


def read_books(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """The rows of parsed_books for the books below a folder, or for given files and folders (those missing have no row), and project_id."""
    if isinstance(path, list) and not (path := _there(spark, path)):
        return spark.createDataFrame([], BOOK_ROWS).withColumn("project_id", make_id("prj", "path"))
    files = spark.read.format("binaryFile").options(**_NAMES).load(path).select("path", "content")
    return parsed_books(files, strict).withColumn("project_id", make_id("prj", "path"))


def parsed_books(files: DataFrame, strict: bool = True) -> DataFrame:
    """A row per chapter of the books in files (path, content): path, title, author, chapter_pos, chapter_title, lines, error. Every book
    has a row: one without any chapter has one with neither chapter nor error, a broken one (unless `strict`, when it fails the query)
    one with its error. A book is parsed in one piece; Spark packs files into tasks by their bytes."""
    types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in BOOK_ROWS.split(", "))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stem = posixpath.splitext(posixpath.basename(unquote(name)))[0]
                try:
                    book = parser_for(name)(content.as_py() or b"", stem)
                    rows = [(name, book.title, book.author, c.position - 1, c.title, c.lines, None) for c in book.chapters]
                    rows = rows or [(name, book.title, book.author, None, None, None, None)]
                except EbookParseError as e:
                    if strict:
                        raise
                    rows = [(name, stem, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(task, BOOK_ROWS)


def page_lines(pages: DataFrame, html: str = "html", implied_close: bool = False) -> DataFrame:
    """All columns but html, with heading and lines, of single content documents."""
    kept = [c for c in pages.columns if c != html]
    schema = pages.select(*kept, F.lit("").alias("heading"), F.array(F.lit("")).alias("lines")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(html)
            got = [document_lines(h, implied_close) for h in b.column(at).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[*kept, "heading", "lines"])

    return pages.mapInArrow(task, schema)


def chapter_title(toc, heading, item, number):
    """The first that says something: contents label, heading, item title, `Chapter n`."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(toc), blank(heading), blank(item), F.concat(F.lit("Chapter "), number.cast("string")))


def book_tables(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters (order from 1) and lines (order from 0) of read_books."""
    good = books.filter("chapter_pos is not null")
    chapter_id = make_id("ch", "project_id", "chapter_pos")
    chapters = good.select("project_id", "chapter_pos", chapter_id.alias("chapter_id"), (F.col("chapter_pos") + 1).alias("order"), F.col("chapter_title").alias("title"))
    lines = good.select("project_id", "chapter_pos", F.posexplode("lines").alias("line_pos", "text"))
    lines = lines.select("project_id", "chapter_pos", "line_pos", make_id("ln", "project_id", "chapter_pos", "line_pos").alias("line_id"), F.col("line_pos").alias("order"), "text")
    return chapters, lines


def silent_books(books: DataFrame) -> DataFrame:
    """project_id of books without a single line: parsing them has failed, an empty chapter alone hasn't."""
    return books.groupBy("project_id").agg(F.coalesce(F.sum(F.size(F.coalesce("lines", F.array().cast("array<string>")))), F.lit(0)).alias("n")).filter("n = 0").select("project_id")


def book_results(books: DataFrame, wanted: DataFrame) -> DataFrame:
    """project_id, status, message of parsing: a broken book has failed, one without a line, too, and one without a file."""
    n = F.sum(F.size(F.coalesce("lines", F.array().cast("array<string>"))))
    found = books.groupBy("project_id").agg(F.max("error").alias("error"), n.alias("n"))
    message = F.when(F.col("n").isNull(), "the book's file is missing").when(F.col("error").isNotNull(), F.col("error")).when(F.col("n") == 0, "the book has no text").otherwise("book parsed")
    out = wanted.join(found, "project_id", "left").withColumn("message", message)
    good = F.coalesce((F.col("n") > 0) & F.col("error").isNull(), F.lit(False))
    return out.select("project_id", F.when(good, "completed").otherwise("failed").alias("status"), "message")


def merged_metadata(projects: DataFrame, books: DataFrame) -> DataFrame:
    """Projects with the parsed title and author where there are any."""
    new = books.groupBy("project_id").agg(F.min("title").alias("t"), F.min("author").alias("a"))
    some = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return projects.join(new, "project_id", "left").withColumns({"title": some("t", "title"), "author": some("a", "author")}).select(*projects.columns)
