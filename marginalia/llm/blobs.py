"""Sorted integers and small columns as compressed bytes, so that millions of them cross a shuffle as one row."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def _planes(values: np.ndarray) -> bytes:
    """The bytes of each weight together: the high ones of small numbers are zeros and vanish in compression."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(raw.T).tobytes())


def _unplanes(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers."""
    if not len(values):
        return b""
    return _planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.dtype(np.uint64)), dtype=np.uint64) if data else np.empty(0, np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any fixed-width integers or floats."""
    return _planes(values) if len(values) else b""


def unpack(data: bytes, dtype: type) -> np.ndarray:
    return _unplanes(data, np.dtype(dtype)) if data else np.empty(0, dtype)
