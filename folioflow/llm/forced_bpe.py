r"""Byte-level BPE by forced-boundary splitting, and its decoding.

A merge joins two tokens into one of the vocabulary, so where two neighbouring bytes stand together inside no token of the vocabulary, no
merge ever crosses: a certain cut. A table of 256 x 256 byte pairs finds these cuts in a whole batch of texts at once. The cuts that the
tokenizer makes before it merges (at added tokens, between runs of letters, digits, white space and other characters, and around English
contractions) are found on arrays, too. What lies between two cuts is a fragment: fragments are encoded independently, equal ones of a
batch once, and their ids are joined in order. Which of the four kinds a character is, the tokenizer itself is asked, once for each
code point: its Unicode tables decide.

Merging within a fragment follows rank, then place, by a heap over a linked list, so a run of one character of any length takes n log n
steps. A worker keeps the ids of the first fragments it meets, up to a bound in number.

Each text is encoded on its own and whole: nothing is shuffled. A null text has no ids and decodes to the empty text. Very long texts
are batches of their own. Rows that repeat an id stay rows. Ids that the vocabulary lacks decode to nothing, bytes that aren't UTF-8 to
U+FFFD, as the library does. Columns pass through, but for those called like an output, which are replaced; an empty table gives an
empty result. Tokenizers of another make than byte-level BPE over that pattern are refused.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import gathered, small_batches, tidy
from .encoding import default_path

#: Fragments that a worker keeps, the longest of them in bytes, and bytes of text encoded at once.
KEPT, LONGEST, TOGETHER = 200_000, 64, 4_000_000
LETTER, DIGIT, WHITE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: What the tokenizer cuts off after an apostrophe; fixed values of its pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_open: dict[str, "ForcedBpe"] = {}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 of each in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ForcedBpe:
    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not said.get("normalizer")
        if not plain or any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        # Fixed rule of byte-level vocabularies: a visible character stands for itself, each other byte for the next one from 256 on.
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in seen]
        byte = {chr(b if b in seen else 256 + hidden.index(b)): b for b in range(256)}
        raw = lambda t: bytes(byte[c] for c in t)
        ids = model["vocab"]
        self.byte_id = [ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Of two neighbouring ids, the rank of their merge and the id it gives.
        self.merges = {(ids[x], ids[y]): (rank, ids[x + y]) for rank, (x, y) in enumerate(pairs)}
        self.added = {t["content"].encode(): t["id"] for t in said["added_tokens"]}
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        #: Whether a byte may not be followed by another within a token.
        self.forced = np.ones((256, 256), dtype=bool)
        bytes_of = {i: raw(t) for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        for token in ids:
            t = np.frombuffer(raw(token), np.uint8)
            self.forced[t[:-1], t[1:]] = False
        size = max(bytes_of) + 1
        self.dtype = np.dtype("<u4")
        self.lengths = np.array([len(bytes_of.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all_bytes = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.kept: dict[bytes, bytes] = {t: np.array([i], self.dtype).tobytes() for t, i in self.added.items()}

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; new ones are tried between a letter, a digit and a mark: the tokenizer joins like to like."""
        out = self.kind[points]
        if (out == UNKNOWN).any():
            for p in np.unique(points[out == UNKNOWN]).tolist():
                found = {span for _, span in self.cut.pre_tokenize_str(f"a{chr(p)}1{chr(p)}.{chr(p)}")}
                self.kind[p] = LETTER if (0, 2) in found else DIGIT if (1, 4) in found else OTHER if (3, 6) in found else WHITE
            out = self.kind[points]
        return out

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the tokenizer begins a new word; first: where a text begins."""
        kind = self.kinds(points)
        same = np.zeros(len(points), dtype=bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
        start = ~same
        white = kind == WHITE
        # The last white character before another one goes apart from those before it, and, if it is a space, with what follows.
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
        start[last] = True
        start[last + 1] = points[last] != 32
        marks = np.flatnonzero((points == 39) & start)
        for letters in CONTRACTIONS:
            end = marks + 1 + len(letters)
            here = marks[end <= len(points)]
            for k, c in enumerate(letters, 1):
                here = here[(points[here + k] == ord(c)) & ~first[here + k]]
            start[here + 1] = False
            after = here + 1 + len(letters)
            start[after[after < len(points)]] = True
        return start

    def fragments(self, data: bytes, texts: np.ndarray) -> np.ndarray:
        """Where each fragment of the joined texts begins, and the end; texts: where each text begins, and the end."""
        size = len(data)
        edge = np.zeros(size + 1, dtype=bool)
        edge[texts] = True
        spans = []
        if self.find_added and any(t in data for t in self.added):
            for i, j in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True):
                spans += [(i + x.start(), i + x.end()) for x in self.find_added.finditer(data[i:j])]
            edge[np.array(spans, dtype=np.int64).ravel()] = True
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        where = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        cuts = edge.copy()
        cuts[where[self.word_starts(points, edge[where])]] = True
        b = np.frombuffer(data, np.uint8)
        cuts[1:size] |= self.forced[b[:-1], b[1:]]
        for i, j in spans:
            cuts[i + 1 : j] = False
        return np.flatnonzero(cuts)

    def merged(self, fragment: bytes) -> bytes:
        """The ids of a fragment, as bytes."""
        ids = [self.byte_id[b] for b in fragment]
        n = len(ids)
        merges = self.merges
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, new, x, y = heapq.heappop(heap)
                j = after[i] if ids[i] == x else n
                if j >= n or ids[j] != y:
                    continue  # one of the two is part of another token by now
                ids[i], ids[j] = new, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if m := merges.get((new, ids[k])):
                        heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
                if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                    heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
            ids = [i for i in ids if i >= 0]
        return np.array(ids, self.dtype).tobytes()

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = bytes(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]) if len(column) and offsets[-1] > offsets[0] else b""
        texts = offsets - offsets[0]
        if not data:
            return [b""] * len(column)
        cuts = self.fragments(data, texts)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        parts = []
        for f in distinct:
            ids = self.kept.get(f)
            if ids is None:
                ids = self.merged(f)
                if len(self.kept) < KEPT and len(f) <= LONGEST:
                    self.kept[f] = ids
            parts.append(ids)
        each = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        where = np.cumsum(each) - each
        counts = each[at]
        out = np.frombuffer(b"".join(parts), self.dtype)[spread(where[at], counts)].tobytes()
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(cuts, texts)] * 4
        return [out[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids, special ones included."""
        i = np.frombuffer(ids or b"", self.dtype)
        i = i[i < len(self.lengths)]
        return self.all_bytes[spread(self.starts[i], self.lengths[i])].tobytes().decode("utf-8", "replace")


def bpe(path: str) -> ForcedBpe:
    """This worker's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = ForcedBpe(path)
    return _open[path]


def _with(docs: DataFrame, source: str, made: dict, task) -> DataFrame:
    """docs through task with columns more; a column of docs called like one of them goes, unless it is the source."""
    new = {c.lower() for c in made}
    if source.lower() in new:
        raise ValueError(f"{source} is called as an output is")
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    return docs.select(*[f.name for f in kept]).mapInArrow(tidy(task), StructType(kept + [StructField(c, t) for c, t in made.items()]))


def encode(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs with n_tokens and ids, little-endian unsigned 32-bit integers in one binary value."""
    path = tokenizer or default_path()
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe(path)
        for b in gathered(batches, text, TOGETHER):
            ids = e.encode(b.column(b.schema.get_field_index(text)))
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n, pa.array(ids, pa.binary())], names=[*b.schema.names, "n_tokens", "ids"])

    return _with(docs, text, {"n_tokens": LongType(), "ids": BinaryType()}, task)


def decode(coded: DataFrame, *, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """coded with decoded, the text of its ids."""
    path = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe(path)
        for b in gathered(batches, ids, 4 * TOGETHER):
            texts = [e.decode(x.as_buffer()) if x.is_valid else "" for x in b.column(b.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return _with(coded, ids, {"decoded": StringType()}, task)


def op12_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    back = decode(coded)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
