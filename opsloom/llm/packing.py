"""Numbers as short binary values, for blocks that are written or shuffled."""

from __future__ import annotations

import numpy as np
import zstandard

U64 = np.uint64


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def pack_planes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, then all second ones; high bytes, mostly 0, vanish."""
    raw = np.ascontiguousarray(x, dtype=f"<u{width}").view(np.uint8).reshape(-1, width)
    return pack(raw.T)


def unpack_planes(raw: bytes, width: int = 8) -> np.ndarray:
    planes = unpack(raw, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(planes).view(f"<u{width}").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack_planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(raw), dtype=U64)


def unpack_counts(raw: bytes) -> np.ndarray:
    return unpack_planes(raw).astype(np.int64)
