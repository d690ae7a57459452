"""Lossless byte codecs, each ``bytes -> bytes`` with an exact inverse, and Arrow functions over them.

All share one stream form, in which nothing needs an escape: a stream is a row
of steps, each a number (written in groups of seven bits) whose lowest bit says
what it is: even for so many literal bytes that follow, odd for a reference.
Dictionaries travel with the data.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]

# Instruction templates and filler keys known from the start.
TEMPLATES = tuple(bytes.fromhex(x) for x in ("02000000", "03000000", "07000000", "01020304"))
TRANSFER_KEYS = (b"\x06" * 32, b"\x0b" * 32)


def put(out: bytearray, n: int) -> None:
    """Append a whole number, seven bits a byte, low ones first."""
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
    return n | data[at] << shift, at + 1


def _stream(steps: Iterable[bytes | int]) -> bytes:
    """Literal runs and references as a stream; neighbouring literals are joined."""
    out, held = bytearray(), bytearray()
    for s in steps:
        if isinstance(s, int):
            if held:
                put(out, len(held) << 1)
                out += held
                held.clear()
            put(out, s << 1 | 1)
        else:
            held += s
    if held:
        put(out, len(held) << 1)
        out += held
    return bytes(out)


def _expand(data: bytes, at: int, refer: Callable[[int, bytearray], bytes]) -> bytes:
    out = bytearray()
    while at < len(data):
        n, at = get(data, at)
        if n & 1:
            out += refer(n >> 1, out)
        else:
            out += data[at : at + (n >> 1)]
            at += n >> 1
    return bytes(out)


def window_dictionary(sizes: tuple[int, ...], limit: int, least: int = 2, seeds: tuple[bytes, ...] = ()) -> Codec:
    """Repeated windows of the sizes, best gain first, become references into a dictionary that is sent along."""

    def mine(data: bytes) -> list[bytes]:
        gain: Counter[bytes] = Counter()
        for size in sizes:
            seen = Counter(data[i : i + size] for i in range(len(data) - size + 1))
            gain.update({w: c * size for w, c in seen.items() if c >= least})
        best = sorted(gain.items(), key=lambda x: (-x[1], x[0]))[: limit * 4]
        return [w for w, _ in best][:limit]

    def encode(data: bytes) -> bytes:
        entries = [w for w in mine(data) if w not in seeds]
        place = {w: i for i, w in enumerate([*seeds, *entries])}
        order = sorted({len(w) for w in place}, reverse=True)
        steps: list[bytes | int] = []
        used: dict[int, int] = {}
        i = 0
        while i < len(data):
            for size in order:
                if (k := place.get(data[i : i + size])) is not None:
                    steps.append(used.setdefault(k, len(used)))
                    i += size
                    break
            else:
                steps.append(data[i : i + 1])
                i += 1
        every, out = [*seeds, *entries], bytearray()
        put(out, len(used))
        for k in used:
            put(out, len(every[k]))
            out += every[k]
        return bytes(out) + _stream(steps)

    def decode(data: bytes) -> bytes:
        n, at = get(data, 0)
        words = []
        for _ in range(n):
            size, at = get(data, at)
            words.append(data[at : at + size])
            at += size
        return _expand(data, at, lambda k, _: words[k])

    return encode, decode


def run_length(least: int = 4) -> Codec:
    """Runs of one byte become its repetition."""

    def encode(data: bytes) -> bytes:
        steps, i = [], 0
        while i < len(data):
            j = i + 1
            while j < len(data) and data[j] == data[i]:
                j += 1
            steps.append((j - i) << 8 | data[i] if j - i >= least else data[i:j])
            i = j
        return _stream(steps)

    return encode, lambda data: _expand(data, 0, lambda n, _: bytes([n & 255]) * (n >> 8))


def lz77(window: int = 255, least: int = 4, most: int = 255) -> Codec:
    """Matches in what was just seen become distance and length."""

    def encode(data: bytes) -> bytes:
        steps, i, last = [], 0, {}
        while i < len(data):
            key = data[i : i + least]
            j = last.get(key, -1) if len(key) == least else -1
            n = 0
            if j >= 0 and i - j <= window:
                n = least
                while i + n < len(data) and n < most and data[j + n] == data[i + n]:
                    n += 1
            step = max(n, 1)
            for k in range(i, i + step):
                last[data[k : k + least]] = k
            steps.append(n << 8 | (i - j) if n else data[i : i + 1])
            i += step
        return _stream(steps)

    def copy(n: int, out: bytearray) -> bytes:
        size, back = n >> 8, n & 255
        piece = bytes(out[-back:])
        return (piece * (size // back + 1))[:size]

    return encode, lambda data: _expand(data, 0, copy)


def hash_delta(history: int = 100) -> Codec:
    """32-byte chunks: a repeat of a recent one is its age, one differing from the last in few bytes those bytes."""

    def encode(data: bytes) -> bytes:
        steps, recent = [], []
        for i in range(0, len(data), 32):
            c = data[i : i + 32]
            if len(c) < 32:
                steps.append(c)
                continue
            if c in recent:
                steps.append((len(recent) - 1 - recent.index(c)) << 1)
            elif recent and sum(a != b for a, b in zip(c, recent[-1], strict=True)) <= 8:
                diff = [(k, b) for k, (a, b) in enumerate(zip(recent[-1], c, strict=True)) if a != b]
                n = 1  # a leading one marks where the list of differing bytes starts
                for k, b in diff:
                    n = n << 13 | k << 8 | b
                steps.append(n << 1 | 1)
            else:
                steps.append(c)
            recent = [*recent, c][-history:]
        return _stream(steps)

    def decode(data: bytes) -> bytes:
        recent: list[bytes] = []
        out, at = bytearray(), 0
        while at < len(data):
            n, at = get(data, at)
            if n & 1:
                n >>= 1
                if n & 1:
                    n >>= 1
                    c = bytearray(recent[-1])
                    while n > 1:
                        c[n >> 8 & 31] = n & 255
                        n >>= 13
                    chunks = [bytes(c)]
                else:
                    chunks = [recent[len(recent) - 1 - (n >> 1)]]
            else:
                raw = data[at : at + (n >> 1)]
                at += n >> 1
                chunks = [raw[i : i + 32] for i in range(0, len(raw), 32)]
            for c in chunks:
                out += c
                if len(c) == 32:
                    recent = [*recent, c][-history:]
        return bytes(out)

    return encode, decode


def metadata_section() -> Codec:
    """Timestamps and empty nonces, found by a scan, are kept short; all else is literal."""

    def encode(data: bytes) -> bytes:
        steps, i = [], 0
        while i < len(data):
            if data[i : i + 32] == bytes(32):
                steps.append(0)
                i += 32
            elif i + 8 <= len(data) and 1577836800 < (t := int.from_bytes(data[i : i + 8], "little")) < 1893456000:
                steps.append(t - 1577836800)
                i += 8
            else:
                steps.append(data[i : i + 1])
                i += 1
        return _stream(steps)

    return encode, lambda data: _expand(data, 0, lambda n, _: bytes(32) if n == 0 else (n + 1577836800).to_bytes(8, "little"))


def deflate(level: int = 9) -> Codec:
    """Raw DEFLATE."""

    def encode(data: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    return encode, lambda data: zlib.decompress(data, -15)


def chain(*codecs: Codec) -> Codec:
    """One after another; decoding goes back."""

    def encode(data: bytes) -> bytes:
        for e, _ in codecs:
            data = e(data)
        return data

    def decode(data: bytes) -> bytes:
        for _, d in reversed(codecs):
            data = d(data)
        return data

    return encode, decode


def tagged(tag: int, codec: Codec) -> Codec:
    """A version byte in front, checked when decoding."""

    def decode(data: bytes) -> bytes:
        if not data or data[0] != tag:
            raise ValueError(f"not a package of version {tag}")
        return codec[1](data[1:])

    return lambda data: bytes([tag]) + codec[0](data), decode


def best_of(*codecs: Codec) -> Codec:
    """The shortest of all results, the first of equals; its number in front."""

    def encode(data: bytes) -> bytes:
        return min((bytes([i]) + c[0](data) for i, c in enumerate(codecs)), key=len)

    return encode, lambda data: codecs[data[0]][1](data[1:])


ACCOUNTS = window_dictionary((32,), 65_536)
PROGRAMS = window_dictionary((32,), 4_096)
STAGE1 = chain(ACCOUNTS, hash_delta())
STAGE2 = chain(window_dictionary((8, 4), 1_000, 3, TEMPLATES), metadata_section())
STAGE3 = best_of(window_dictionary((4,), 256, 3), run_length(), chain(window_dictionary((4,), 256, 3), run_length()))
CODECS: dict[str, Codec] = {
    "enc1_account_dictionary": ACCOUNTS,
    "enc3_program_clusters": PROGRAMS,
    "enc6_hash_delta": hash_delta(),
    "enc7_stage1": STAGE1,
    "enc8_templates": window_dictionary((4,), 1_000, 3, TEMPLATES),
    "enc11_metadata": metadata_section(),
    "enc12_stage2": STAGE2,
    "enc13_run_length": run_length(),
    "enc14_stage3": STAGE3,
    "enc15_lz77": lz77(),
    "enc16_pattern_dictionary": window_dictionary((32, 16, 8, 4), 1_000),
    "enc17_multi_layer": chain(window_dictionary((32, 16, 8, 4), 1_000), deflate(1)),
    "enc18_production": chain(window_dictionary((64, 32, 8), 1_000), deflate(9)),
    "enc19_dictionary_package": tagged(1, window_dictionary((64, 32, 8), 1_000)),
    "enc20_ensemble": best_of(chain(window_dictionary((16, 8), 256), deflate(1)), run_length(), deflate(6)),
    "enc21_token_transfer": chain(window_dictionary((32, 8), 128, 2, TRANSFER_KEYS), deflate(1)),
    "enc22_repetitive": chain(window_dictionary((64, 32, 16, 8, 4), 100, 3), deflate(1)),
    "enc23_deflate": deflate(9),
    "enc24_version1": tagged(0, chain(STAGE1, deflate(1))),
    "enc24_version2": tagged(1, chain(STAGE1, STAGE2, deflate(1))),
    "enc24_version3": tagged(2, chain(STAGE1, STAGE2, STAGE3, deflate(1))),
    "enc25_archival_preset": deflate(9),
    "sup10_hybrid": best_of(chain(STAGE1, deflate(1)), lz77(), deflate(6)),
    "sup11_optimised": best_of(chain(window_dictionary((32, 16), 256), deflate(9)), deflate(9)),
}


def encoder(name: str):
    """Arrow function ``binary -> binary`` that encodes."""
    return _udf(name, 0)


def decoder(name: str):
    """Arrow function ``binary -> binary`` that decodes."""
    return _udf(name, 1)


def _udf(name: str, way: int):
    def run(s: pd.Series) -> pd.Series:
        f = CODECS[name][way]
        return pd.Series([None if x is None else f(bytes(x)) for x in s], dtype=object)

    return F.pandas_udf(run, T.BinaryType())
