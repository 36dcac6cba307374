"""Folders of many small books: how they are written, listed, packed into tasks and parsed."""

import pickle

import pyarrow as pa
import pyarrow.parquet as pq

from folioflow.plans import catalog_books
from folioflow.plans.session import Corpus
from folioflow.sources import epub
from folioflow.sources.book_source import BookReader
from folioflow.sources.epub import BOOK_ROWS
from pyspark.sql.types import StructType


def written(spark, folder, ids):
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [f"line one of {i}\nline two" for i in ids]}), f"{folder}/documents.parquet")
    catalog_books.write_out(spark, str(folder), f"file://{folder}/in")
    return folder / "in"


def test_listing_is_packed(spark, tmp_path):
    top = written(spark, tmp_path, range(400, 2500))
    assert sorted(len(list(f.iterdir())) for f in top.iterdir()) == [500, 600, 1000]
    reader = BookReader(StructType.fromDDL(f"{BOOK_ROWS}, size long"), {"path": str(top), "partitionbytes": "200000"})
    parts = reader.partitions()
    found = [f for p in parts for f in p.files]
    assert sorted(path for path, _ in found) == sorted(map(str, top.rglob("*.epub"))) and all(sum(n for _, n in p.files) <= 200_000 for p in parts)
    assert len(pickle.dumps(parts)) < 25 * len(found)


def test_small_books_share_tasks(spark, tmp_path):
    top = written(spark, tmp_path, range(0, 400))
    corpus = Corpus(spark, f"file://{tmp_path}/ws")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    corpus.create(f"file://{top}")
    corpus.parse()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    t = corpus.tables()
    assert t["projects"].count() == 400 and t["chapters"].select("project_id").distinct().count() == 300
    folders = [f for f in (tmp_path / "ws" / "tables" / "lines").iterdir()]
    assert sum(len(list(f.glob("part-*.parquet"))) for f in folders) <= 4


def test_names_are_listed_in_parts(spark, tmp_path, monkeypatch):
    top = written(spark, tmp_path, [*range(0, 130), *range(1000, 1150), *range(2000, 2100), *range(3000, 3020)])
    (top / "_hidden").mkdir()
    (top / "_hidden" / "1.epub").write_bytes(b"no book")
    (top / "[a]*").mkdir()
    for i in range(3):
        (top / f"{i}.epub").write_bytes(b"no book")
        (top / "[a]*" / f"{i}.epub").write_bytes(b"no book")
    assert [len(p) for p in epub.parts(spark, f"file://{top}")] == [1]
    found = list(epub.parts(spark, f"file://{top}", 60))
    names = [r["path"] for p in found for r in epub.book_files(spark, p).collect()]
    assert len(found) > 6 and sorted(names) == sorted(f"file:{f}" for f in top.rglob("*.epub") if "_hidden" not in str(f))
    assert max(epub.book_files(spark, p).count() for p in found) <= 60
    # The driver lists no more than so many at once, in both stages that read the folder.
    monkeypatch.setattr(epub, "MOST_NAMES", 60)
    asked = []
    read = epub.book_files, epub.read_books
    monkeypatch.setattr(epub, "book_files", lambda s, p: asked.append(p) or read[0](s, p))
    monkeypatch.setattr(epub, "read_books", lambda s, p, strict=True: asked.append(p) or read[1](s, p, strict))
    corpus = Corpus(spark, f"file://{tmp_path}/ws")
    corpus.create(f"file://{top}")
    told = corpus.parse().projects
    assert asked == found * 2
    t = corpus.tables()
    assert t["projects"].count() == told.count() == 406
    want = {i for i in [*range(0, 130), *range(1000, 1150), *range(2000, 2100), *range(3000, 3020)] if i % 8 not in (5, 6)}
    assert t["chapters"].select("project_id").distinct().count() == len(want) == told.filter("status = 'completed'").count()
    assert not list((tmp_path / "ws" / "answers").iterdir())
