"""Byte-level BPE ids by the tokenizers library, with every piece between spaces encoded once.

The tokenizer cuts a text before each space that is followed by a character other than white space, or preceded by one, and around a
line break between two such characters, and no token crosses a cut; so a text may be cut there and the ids of its pieces joined. Texts
with three characters of white space together, or with two at the end, and texts that hold one of the tokenizer's added tokens, as
<|endoftext|>, are encoded whole. Likewise letters after a space are a word of their own, and so are ASCII marks after them up to the
next space; such words go to the library's merges directly, as byte-level words, many in one text; all other pieces go through the
whole tokenizer. Pieces, their ids and the places of both stay in Arrow arrays. A worker keeps the ids of the first pieces it meets,
up to a bound in number: frequent pieces come early. The other pieces of a batch are encoded once for that batch.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps, some 4 MB of them, and the longest of them in characters.
KEPT, LONGEST = 120_000, 64
#: Words that are encoded as one text, and such texts at a time.
RUN, RUNS = 2000, 8

#: Stand for a line break before a piece, and for marks right after the piece before; texts that have these private-use characters
#: are encoded whole.
_BREAK, _MARKS = "\ue000", "\ue001"
#: In Arrow's syntax, where white space has to be spelled out.
_WHITE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_ODD = rf"{_WHITE}{{3}}|{_WHITE}{{2}}\z|[\x{{e000}}\x{{e001}}]"
#: A letter and the ASCII marks between it and a space or the end.
_MARKED = r"(\pL)([!-/:-@\[-^`{-~]+)( |\z)"
_open: dict[str, "Encoder"] = {}


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Binary values from their bytes and where each ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Found in a text before it is cut into words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u4" if len(vocabulary) > 1 << 16 else "<u2")
        #: Bytes of each token: a byte-level vocabulary has one character for each byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        # Fixed rule of byte-level vocabularies: a visible character stands for itself, each other byte for the next one from 256 on.
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in seen]
        self.letters = {b: chr(b if b in seen else 256 + hidden.index(b)) for b in range(256)}
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.line = self.ids(self.tokenizer, ["\n"])[0].tobytes()
        #: Pieces and their ids, as bytes.
        self.kept, self.kept_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def ids(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def word_ids(self, words: pa.LargeStringArray, space: str) -> pa.LargeBinaryArray:
        """The ids of words of letters after `space`: the letter of a space, or nothing."""
        table = {**self.letters, 32: f" {space}"}
        sizes = pc.binary_length(words).to_numpy() + len(space)
        out = [pa.array([], pa.large_binary())]
        for i in range(0, len(words), RUN * RUNS):
            part = words.slice(i, RUN * RUNS)
            runs = pa.ListArray.from_arrays(pa.array([*range(0, len(part), RUN), len(part)], pa.int32()), part)
            texts = [space + r.decode("latin-1").translate(table) for r in pc.binary_join(runs, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()]
            ids = np.concatenate(self.ids(self.words, texts))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[i : i + len(part)])) + 1
            out.append(_blobs(ids, ends * self.dtype.itemsize))
        return pa.concat_arrays(out)

    def learn(self, new: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of these pieces after a space; keeps what there is room for."""
        plain = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        broken = pc.starts_with(new, _BREAK).to_numpy(zero_copy_only=False)
        bare = pc.utf8_slice_codeunits(new.filter(pa.array(broken)), 1)
        letters = pc.utf8_is_alpha(bare)
        broken[broken] = letters.to_numpy(zero_copy_only=False)
        other = ~(plain | broken)
        texts = [p if p[:1] == _BREAK else p[1:] if p[:1] == _MARKS else f" {p}" for p in new.filter(pa.array(other)).to_pylist()]
        coded = self.ids(self.tokenizer, [t[1:] if t[:1] == _BREAK else t for t in texts])
        groups = [
            self.word_ids(new.filter(pa.array(plain)), self.letters[32]),
            pc.binary_join_element_wise(pa.scalar(self.line, pa.large_binary()), self.word_ids(bare.filter(letters), ""), pa.scalar(b"", pa.large_binary())),
            pa.array([self.line * (t[:1] == _BREAK) + x.tobytes() for t, x in zip(texts, coded, strict=True)], pa.large_binary()),
        ]
        place = np.empty(len(new), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(g) for g in (plain, broken, other)])] = np.arange(len(new))
        found = pa.concat_arrays(groups).take(pa.array(place))
        if (room := KEPT - len(self.kept)) > 0:
            short = pc.less_equal(pc.utf8_length(new), LONGEST)
            self.kept, self.kept_ids = (pa.concat_arrays([old, more.filter(short).slice(0, room)]) for old, more in ((self.kept, new), (self.kept_ids, found)))
        return found

    def _coded(self, texts: list[str | None] | pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """The ids of different pieces, which of them the texts hold, where each text's begin (and the end), and the ids of texts encoded whole."""
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()), "")
        strange = pc.match_substring_regex(column, _ODD)
        for token in self.added:
            strange = pc.or_(strange, pc.match_substring(column, token))
        odd = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
        whole = dict(zip(odd, self.ids(self.tokenizer, column.take(pa.array(odd, pa.int64())).to_pylist()), strict=True))
        if odd:
            column = pc.if_else(strange, pa.scalar("", pa.large_string()), column)
        column = pc.replace_substring(column, "\n", f" {_BREAK}")
        column = pc.replace_substring_regex(column, _MARKED, rf"\1 {_MARKS}\2\3")
        cut = pc.split_pattern(column, " ")
        starts = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        heads = cut.values.take(pa.array(starts[:-1])).dictionary_encode()  # the first piece of a text has no space before it
        at, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        del column, cut, coded
        place = pc.index_in(pieces, self.kept)
        known, ids = place.is_valid().to_numpy(zero_copy_only=False), self.kept_ids
        place = place.fill_null(0).to_numpy().astype(np.int64)
        place[~known] = len(ids) + np.arange(len(known) - known.sum())
        found = self.learn(pieces.filter(pa.array(~known)))
        first = pa.array([x.tobytes() for x in self.ids(self.tokenizer, heads.dictionary.to_pylist())], pa.large_binary())
        at = place[at]
        at[starts[:-1]] = len(ids) + len(found) + heads.indices.to_numpy()
        return pa.concat_arrays([ids, found, first]), at, starts, whole

    def many(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype; of a null text, none."""
        table, at, starts, whole = self._coded(texts)
        joined = table.take(pa.array(at))
        out = joined.buffers()[2]
        out = out.to_pybytes() if out else b""
        bounds = np.frombuffer(joined.buffers()[1], np.int64)[starts].tolist() if len(starts) > 1 else [0]
        result = [out[i:j] for i, j in itertools.pairwise(bounds)]
        for i, x in whole.items():
            result[i] = x.tobytes()
        return result

    def counts(self, texts: list[str | None] | pa.Array) -> list[int]:
        """The number of ids of each text."""
        table, at, starts, whole = self._coded(texts)
        sizes = pc.binary_length(table).to_numpy() // self.dtype.itemsize
        result = np.diff(np.concatenate(([0], np.cumsum(sizes[at])))[starts]).tolist()
        for i, x in whole.items():
            result[i] = len(x)
        return result

    def count(self, text: str) -> int:
        """The number of ids of a short text, by the library alone."""
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
