"""Windows and chunks of a block's bytes: repetition, periods, patterns.  Each function reads all bytes of one block.

Windows are told apart exactly: those of 2s bytes are pairs of windows of s bytes,
so every size costs one sort of integers.  A block of n bytes takes about 60 n bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZES = (4, 8, 16, 32, 64)
PERIODS = (2, 4, 8, 16)
CHUNK = 32
#: Chunks that follow a chunk and are compared with it.
SIMILAR, ALIKE = 10, 19
TOP, LEAST = 100, 3

# Byte strings counted by the domain's pattern densities.
SYSTEM_PROGRAM = b"\x11" * 32
TOKEN_PROGRAM = b"\x06\xdd\xf6\xe1"
INSTRUCTIONS = (b"\x01\x02\x03\x04", b"\x00\x00\x00\x01", b"\x02\x00\x00\x00")
CONSTANTS = (b"\xff\xfe", b"\x01", b"\x00")


def windows(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size that fits: size, first place of each different window in the order of their bytes, how often it occurs."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    n, rank = len(b), None
    for size in SIZES:
        if n < size:
            return
        if rank is None:
            key = (b[: n - 3] << 24) | (b[1 : n - 2] << 16) | (b[2 : n - 1] << 8) | b[3:]
        else:
            half = size // 2
            key = rank[: n - size + 1] * np.int64(n) + rank[half : half + n - size + 1]
        _, first, rank, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        yield size, first, counts


def patterns(raw: bytes) -> list[tuple[int, str, int, int]]:
    """The ``TOP`` windows that occur ``LEAST`` times or more by bytes covered: rank, bytes in hex, frequency, bytes covered."""
    found = []
    for size, first, counts in windows(raw):
        often = np.flatnonzero(counts >= LEAST)
        for i in often[np.lexsort((often, -counts[often]))][:TOP].tolist():
            at, c = int(first[i]), int(counts[i])
            found.append((-c * size, -size, raw[at : at + size], c))
    return [(i + 1, p.hex().upper(), c, -gain) for i, (gain, _, p, c) in enumerate(sorted(found)[:TOP])]


def repetition(raw: bytes) -> list[float]:
    """Share of the windows of each size that occur more than once."""
    out = dict.fromkeys(SIZES, 0.0)
    for size, _, counts in windows(raw):
        if len(raw) >= 2 * size:
            out[size] = float(counts[counts > 1].sum() / counts.sum())
    return list(out.values())


def _chunks(raw: bytes, size: int) -> np.ndarray:
    n = len(raw) // size
    return np.frombuffer(raw, dtype=np.uint8, count=n * size).reshape(n, size)


def periodicity(raw: bytes) -> list[float]:
    """Share of equal adjacent chunks of each of ``PERIODS``."""
    out = []
    for p in PERIODS:
        c = _chunks(raw, p)
        out.append(float((c[1:] == c[:-1]).all(axis=1).sum() / (len(c) - 1)) if len(c) > 1 else 0.0)
    return out


def widest_period(raw: bytes) -> float:
    """The largest share of equal adjacent chunks of 2 to 16 bytes; the last pair of chunks is not looked at."""
    best = 0.0
    for p in range(2, 17) if len(raw) >= 16 else ():
        c = _chunks(raw, p)
        if len(c) >= 3:
            best = max(best, float((c[1:-1] == c[:-2]).all(axis=1).sum() / (len(c) - 2)))
    return best


def near_duplicates(raw: bytes) -> float:
    """Mean similarity of chunks with the ``ALIKE`` following ones, of which only those alike but not the same count."""
    c, total, pairs = _chunks(raw, CHUNK), 0.0, 0
    for d in range(1, min(ALIKE, len(c) - 1) + 1):
        same = c[d:] == c[:-d]
        pairs += len(same)
        share = same.mean(axis=1)
        total += float(share[(same[:, :8].mean(axis=1) > 0.6) & (share > 0.7) & (share < 0.95)].sum())
    return total / pairs if pairs else 0.0


def chunk_similarity(raw: bytes) -> tuple[int, int, float]:
    """Chunks, pairs of a chunk and one of the ``SIMILAR`` following ones, and the mean share of equal bytes in the first 8 of a pair."""
    c, total, pairs = _chunks(raw, CHUNK)[:, :8], 0.0, 0
    for d in range(1, min(SIMILAR, len(c) - 1) + 1):
        same = c[d:] == c[:-d]
        pairs += len(same)
        total += float(same.mean(axis=1).sum())
    return len(c), pairs, total / pairs if pairs else 0.0


def _occurrences(raw: bytes, pattern: bytes) -> int:
    n, at = 0, raw.find(pattern)
    while at >= 0:
        n, at = n + 1, raw.find(pattern, at + 1)
    return n


def densities(raw: bytes) -> list[float]:
    """Occurrences, overlapping ones too, of the fixed byte strings by length."""
    n = len(raw)
    counted = [sum(_occurrences(raw, p) for p in ps) for ps in ((SYSTEM_PROGRAM,), (TOKEN_PROGRAM,), INSTRUCTIONS, CONSTANTS)]
    return [c / max(n, least) for c, least in zip(counted, (32, 4, 1, 1), strict=True)]
