"""Sorted 64-bit keys in compressed blobs, for exchanges of many small facts in few rows."""

from __future__ import annotations

import numpy as np
import zstandard

_pack = zstandard.ZstdCompressor(level=1)
_unpack = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, all first bytes first, compressed."""
    v = np.ascontiguousarray(values)
    return v.dtype.str.encode().ljust(4) + _pack.compress(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes() if len(v) else b"")


def unpack(blob: bytes) -> np.ndarray:
    kind = np.dtype(bytes(blob[:4]).decode().strip())
    raw = _unpack.decompress(bytes(blob[4:]))
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel() if raw else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max()) if len(counts) else 0
    return pack(counts.astype("<u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<u8"))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of the 64-bit space begins in the sorted keys, and the end."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
