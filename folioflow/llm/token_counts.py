"""Edit-aware token counts: a segment tree over each document's pre-token runs, of which an edit re-encodes only what it touches.

A document is cut into runs of some 160 characters, before spaces with other than white space on both sides, where the tokenizer
always cuts. Leaves hold a run and its token count; inner nodes hold the sums of characters and tokens below. An edit (start, end,
replacement, in characters of the text as it then is) descends to the leaves it touches and takes one more run on either side as
boundary context, whose outer ends are old, safe cuts. Their text is cut and encoded anew and the sums above are updated, in time
logarithmic in the length of the document; when an edit makes more than twice the runs of the leaves it took, or empties all of
them, the tree is built afresh from its runs without encoding the others.

Edits are an array of structs (start, end, text) beside the text, applied in order; places beyond the text count as its end, an end
before its start as the start, negative ones as 0, nulls as 0 and empty text. A null text is empty; no or null edits leave it as it is.
Texts and edits pass through one map over the rows, each whole. The first edits of up to `ROWS` texts of a batch are encoded together, then
their second ones, and so on; a row with many edits costs no other row anything. Very long texts are batches of their own; rows that repeat
an id, or have none, are rows of their own; an empty table gives an empty result. Columns other than those named aren't read and may have
any name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, gathered, small_batches, tidy
from .encoding import Encoder, default_path, encoder

#: Characters of a run, about, those up to which runs are counted by the library alone, and those of edits that are encoded at a time.
RUN, SHORT, ENCODED = 160, 20_000, 2_000_000
#: Trees that a task holds at a time.
ROWS = 2000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def runs(text: str, size: int = RUN) -> list[str]:
    """The text in runs of at least `size` characters where there is a safe cut, joined again by "".join."""
    out, start = [], 0
    while start < len(text):
        m = _CUT.search(text, start + size)
        end = m.start() if m else len(text)
        out.append(text[start:end])
        start = end
    return out


class TokenTree:
    """A text with its token count, kept up to date under edits."""

    def __init__(self, text: str | list[str], enc: Encoder, counts: list[int] | None = None):
        """Of a text, or of its runs."""
        self.enc = enc
        pieces = runs(text) if isinstance(text, str) else text
        self.encoded = 0 if counts is not None else sum(map(len, pieces))
        self.open: tuple[int, int, list[str]] = 0, 0, []
        self._build(pieces, count(enc, pieces) if counts is None else counts)

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = 1
        while self.leaves < len(pieces):
            self.leaves *= 2
        self.used = len(pieces)
        self.text = pieces + [""] * (self.leaves - len(pieces))
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (p, n) in enumerate(zip(pieces, counts, strict=True)):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = len(p), n
        for i in range(self.leaves - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and the characters before that leaf; the last leaf in use for the end of the text."""
        if place >= self.chars[1]:
            return self.used - 1, self.chars[1] - self.chars[self.leaves + self.used - 1]
        i, before = 1, 0
        while i < self.leaves:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.leaves, before

    def edit(self, start: int | None, end: int | None, text: str | None) -> None:
        self.close(count(self.enc, self.begin(start, end, text)))

    def begin(self, start: int | None, end: int | None, text: str | None) -> list[str]:
        """The runs that an edit makes, to be encoded; close() takes their counts and is to follow."""
        start = min(max(start or 0, 0), self.n_chars)
        end = min(max(end or 0, start), self.n_chars)
        if not self.used:
            return self._opened(0, -1, text or "")
        first, before = self.find(start)
        last = first if end == start else self.find(end - 1)[0]
        first = self._beside(first, -1)
        last = self._beside(last, 1)
        old = "".join(self.text[first : last + 1])
        before = self._before(first)
        return self._opened(first, last, old[: start - before] + (text or "") + old[end - before :])

    def _opened(self, first: int, last: int, new: str) -> list[str]:
        self.open = first, last, runs(new)
        self.encoded += len(new)
        return self.open[2]

    def close(self, counts: list[int]) -> None:
        first, last, pieces = self.open
        room = last - first + 1
        if not self.used:
            self._build(pieces, counts)
            return
        if len(pieces) > 2 * room + 2 or not pieces and room == self.used:
            kept = [(self.text[i], self.tokens[self.leaves + i]) for i in range(self.used) if self.text[i] and not first <= i <= last]
            low = sum(1 for i in range(first) if self.text[i])
            both = kept[:low] + list(zip(pieces, counts, strict=True)) + kept[low:]
            self._build([p for p, _ in both], [n for _, n in both])
            return
        if len(pieces) > room:  # the last leaf takes what is left over
            pieces[room - 1 :] = ["".join(pieces[room - 1 :])]
            counts[room - 1 :] = [sum(counts[room - 1 :])]
        for k in range(room):
            i = first + k
            self.text[i] = pieces[k] if k < len(pieces) else ""
            at = self.leaves + i
            self.chars[at], self.tokens[at] = len(self.text[i]), counts[k] if k < len(pieces) else 0
        up = {(self.leaves + i) // 2 for i in range(first, last + 1)}
        while up and max(up):
            for i in up:
                self._sum(i)
            up = {i // 2 for i in up if i > 1}

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf that isn't empty, or the last leaf in use on that side."""
        i = leaf + step
        while 0 <= i < self.used and not self.text[i]:
            i += step
        return min(max(i, 0), self.used - 1)

    def _before(self, leaf: int) -> int:
        i, before = self.leaves + leaf, 0
        while i > 1:
            if i & 1:
                before += self.chars[i - 1]
            i //= 2
        return before

    def whole(self) -> str:
        return "".join(self.text[: self.used])


def count(enc: Encoder, pieces: list[str]) -> list[int]:
    """The tokens of each run."""
    return [enc.count(p) for p in pieces] if sum(map(len, pieces)) <= SHORT else enc.counts(pieces)


def edit_all(enc: Encoder, trees: list[TokenTree], edits: list[list[dict | None] | None]) -> None:
    """Edits each text: the first edits of all texts together, then the second ones, and so on."""
    left = [(t, iter(todo)) for t, todo in zip(trees, edits, strict=True) if todo]
    while left:
        held, size, more = [], 0, []
        for tree, todo in left:
            try:
                e = next(todo) or {}
            except StopIteration:
                continue
            more.append((tree, todo))
            held.append((tree, tree.begin(e.get("start"), e.get("end"), e.get("text"))))
            size += sum(map(len, held[-1][1]))
            if size >= ENCODED:
                _close(enc, held)
                held, size = [], 0
        _close(enc, held)
        left = more


def _close(enc: Encoder, held: list[tuple[TokenTree, list[str]]]) -> None:
    counts = iter(count(enc, [p for _, pieces in held for p in pieces]))
    for tree, pieces in held:
        tree.close(list(itertools.islice(counts, len(pieces))))


def edited_counts(docs: DataFrame, edits: str = "edits", *, tokenizer: str | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_edits, n_tokens_before, n_tokens, n_chars, chars_encoded (after the first count) and, if asked for, text."""
    tokenizer = tokenizer or default_path()
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("chars_encoded", pa.int64())] + [("text", pa.string())] * texts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in gathered(batches, "text", 4_000_000):
            for i in range(0, len(part), ROWS):
                ids, whole, changes = columns(part.slice(i, ROWS), "doc_id", "text", "edits")
                cut = [runs(t or "") for t in whole]
                counts = iter(enc.counts([p for c in cut for p in c]))
                trees = [TokenTree(c, enc, list(itertools.islice(counts, len(c)))) for c in cut]
                first = [t.n_tokens for t in trees]
                edit_all(enc, trees, changes)
                out = [(d, len(todo or []), n, t.n_tokens, t.n_chars, t.encoded, *[t.whole()] * texts) for d, todo, n, t in zip(ids, changes, first, trees, strict=True)]
                yield batch(schema, *zip(*out, strict=True))

    rows = docs.select("doc_id", "text", F.col(edits).alias("edits"))
    return rows.mapInArrow(tidy(task), "doc_id long, n_edits long, n_tokens_before long, n_tokens long, n_chars long, chars_encoded long" + ", text string" * texts)


def sample_edits(text: str = "text"):
    """Four edits of any text, from its length alone: a new beginning, a word in the middle, a cut at three quarters, a new end."""
    n = F.coalesce(F.length(text), F.lit(0))
    one = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    return F.array(one(F.lit(0), F.lit(0), "Revised. "), one(n / 2, n / 2 + 9, " amended"), one(n * 3 / 4, n * 3 / 4 + 40, ""), one(n + 100, n + 100, "\nThe end."))


def op1_edit_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_counts(docs.withColumn("edits", sample_edits()))
