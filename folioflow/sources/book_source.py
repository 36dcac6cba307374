"""EPUB books as a Spark data source: spark.read.format("books").load(folder).

A row per chapter, as epub.parsed_books gives them, with the file's size; a broken book is a row whose `error` says why (or fails the query,
with option `mode` = `failfast`). Files are packed into partitions of about `partitionBytes` of them, each file whole. Folders are
listed and files read through the file systems of sources.m4b.open_filesystem, so mounted folders, hdfs:, s3:, gs: and abfs: work;
where only Spark's own readers reach a store, epub.read_books does the same by binaryFile. Option `parser` names a function
(`package.module:function`, bytes and file stem in, Book out) for files with the suffix of option `suffix`, so other formats of books
need no change here.
"""

from __future__ import annotations

import importlib
import json
import posixpath
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EbookParseError
from .epub import BOOK_ROWS, Parser, parser_for
from .m4b import open_filesystem

#: Bytes of files in a partition, where no option says otherwise.
PARTITION_BYTES = 64 << 20
MODES = ("permissive", "failfast")
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


class Files(InputPartition):
    """Paths, within their file system, and sizes, packed: the planner holds all partitions at once."""

    def __init__(self, files: Sequence[tuple[str, int]]):
        self.packed = zlib.compress(json.dumps(list(files)).encode())

    @property
    def files(self) -> list[tuple[str, int]]:
        return [(path, size) for path, size in json.loads(zlib.decompress(self.packed))]


class BookReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.arrow = pa.schema([(f.name, _TYPES[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in schema.fields])
        self.uri = options["path"]
        self.suffix = options.get("suffix", ".epub").lower()
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.mode = options.get("mode", MODES[0]).lower()
        self.parser = options.get("parser")
        if self.mode not in MODES:
            raise ValueError(f"mode can't be {self.mode!r}")

    def _listed(self) -> Iterator[tuple[str, int]]:
        """Paths and sizes of the files, in order within a folder; one folder is listed at a time."""
        fs, top = open_filesystem(self.uri)
        found = fs.get_file_info(top)
        if found.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        folders = [top] if found.type == pa.fs.FileType.Directory else []
        here = [] if folders else [found]
        while here or folders:
            if not here:
                here = fs.get_file_info(pa.fs.FileSelector(folders.pop()))
            folders += sorted((f.path for f in here if f.type == pa.fs.FileType.Directory), reverse=True)
            yield from sorted((f.path, f.size) for f in here if f.type == pa.fs.FileType.File and f.path.lower().endswith(self.suffix) and not f.base_name.startswith("."))
            here = []

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        held, size = [], 0
        for path, n in self._listed():
            if held and size + n > self.bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Files(held)] if held or not out else out

    def _parser(self, path: str) -> Parser:
        if not self.parser:
            return parser_for(path)
        module, _, name = self.parser.partition(":")
        return getattr(importlib.import_module(module), name)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_filesystem(self.uri)
        for path, size in partition.files:
            stem = posixpath.splitext(posixpath.basename(path))[0]
            base = {"path": path, "size": size, "title": stem}
            try:
                with fs.open_input_stream(path) as f:
                    book = self._parser(path)(f.read(), stem)
                head = base | {"title": book.title, "author": book.author}
                rows = [head | {"chapter_pos": c.position - 1, "chapter_title": c.title, "lines": c.lines} for c in book.chapters] or [head]
            except EbookParseError as e:
                if self.mode == "failfast":
                    raise
                rows = [base | {"error": str(e)}]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.names} for r in rows], schema=self.arrow)


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return f"{BOOK_ROWS}, size long"

    def reader(self, schema) -> BookReader:
        return BookReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes format("books") known to the session."""
    spark.dataSource.register(Books)
