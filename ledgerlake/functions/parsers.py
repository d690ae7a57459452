"""Generators and cursor parsers over block bytes, as plain functions and as row-producing Arrow maps."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd

# Header tag, program names and amounts of the synthetic block layout.
HEADER = b"SOLANA_BLOCK_V1"
PROGRAMS = (b"p" * 43, b"q" * 32, b"r" * 44, b"s" * 44)
AMOUNTS = (1_000_000_000, 100_000_000, 10_000_000)


def synthetic_block(slot: int, n: int) -> bytes:
    """Header of 63 bytes, then ``n`` records: signature, program, amount, filler, index."""
    out = [HEADER, slot.to_bytes(8, "little"), bytes(32), (1_609_459_200 + slot * 400 // 1000).to_bytes(8, "little")]
    for i in range(n):
        out += [bytes([i % 256]) * 64, PROGRAMS[i % 4], AMOUNTS[i % 3].to_bytes(8, "little"), bytes(4), i.to_bytes(4, "little")]
    return b"".join(out)


def records(block: bytes) -> Iterator[tuple[int, int, int]]:
    """Index, program and amount of each record; the program is matched, so records never drift."""
    at, i = 63, 0
    while at + 64 < len(block):
        k = next((k for k, p in enumerate(PROGRAMS) if block.startswith(p, at + 64)), None)
        if k is None:
            return
        end = at + 64 + len(PROGRAMS[k])
        yield i, k, int.from_bytes(block[end : end + 8], "little")
        at, i = end + 16, i + 1


def split_transactions(block: bytes) -> list[tuple[int, int]]:
    """Offset and size of each transaction: marker 01 after a 36-byte header, ended before the next marker."""
    out, at = [], 36
    while at < len(block):
        if block[at] != 1:
            at += 1
            continue
        end = block.find(b"\x01", at + 2)
        end = len(block) if end < 0 else end
        out.append((at, end - at))
        at = end
    return out


def analyse_transaction(tx: bytes) -> tuple[int, int]:
    """Number of 32-byte addresses (fewer than 28 zeros) after the marker, and of 4-byte instructions after them."""
    at, accounts = 1, 0
    while at + 32 <= len(tx) and tx[at : at + 32].count(0) < 28:
        accounts += 1
        at += 32
    return accounts, max(0, (len(tx) - at) // 4)


def extract_metadata(data: bytes) -> list[tuple[int, int, str]]:
    """Offset, size and kind found by a scan: timestamp, then nonce, else on by one byte."""
    out, at = [], 2 if data[:2] == b"\xf0\x02" else 0
    while at < len(data):
        if at + 8 <= len(data) and 1577836800 < int.from_bytes(data[at : at + 8], "little") < 1893456000:
            out.append((at, 8, "timestamp"))
            at += 8
        elif at + 32 <= len(data) and data[at : at + 32].count(0) > 20:
            out.append((at, 32, "nonce"))
            at += 32
        else:
            at += 1
    return out


def base58(data: bytes) -> str:
    """Base 58 with the usual alphabet; leading zero bytes are ones."""
    digits, n, out = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = digits[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def _uniform(b: bytes) -> bool:
    return b in (bytes(len(b)), b"\xff" * len(b))


def likely_pubkey(b: bytes) -> bool:
    """32 bytes, not uniform, no byte more than 16 times."""
    return len(b) == 32 and not _uniform(b) and max(Counter(b).values()) <= 16


def likely_program(b: bytes) -> bool:
    """At least 16 distinct bytes, none 8 times or more, no filler at the ends."""
    return len(b) == 32 and not _uniform(b) and len(set(b)) >= 16 and b[:2] not in (b"\0\0", b"\xff\xff") and b[-2:] != b"\0\0" and max(Counter(b).values()) < 8


def pre_compressed(b: bytes) -> bool:
    """Many marker bytes, few distinct ones, or filler runs."""
    if not b:
        return False
    marks = sum(b.count(x) for x in (255, 254, 0)) / len(b)
    return marks > 0.1 or len(set(b)) / 256 < 0.3 or b"\xff\xff" in b or b"\0\0\0" in b or any(bytes([x]) * 4 in b for x in set(b))


def likely_blockhash(b: bytes, last: bytes | None) -> bool:
    """Enough distinct bytes, or close to the last hash."""
    if len(b) != 32 or _uniform(b) or len(set(b)) < 8:
        return False
    return (last is not None and sum(x == y for x, y in zip(b, last, strict=False)) >= 8) or len(set(b)) >= 16


def likely_address(b: bytes) -> bool:
    """Fewer than 28 zero bytes."""
    return b.count(0) < 28


def likely_nonce(b: bytes) -> bool:
    """32 bytes with more than 20 zeros."""
    return len(b) == 32 and b.count(0) > 20


def feature_vector(data: bytes, width: int = 128) -> list[float]:
    """Statistical, pattern, structural and entropy features, padded and clamped to [0, 1]."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.float64)
    if not len(x):
        return [0.0] * width
    p = np.bincount(x.astype(int), minlength=256) / len(x)
    h = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    d = np.diff(x)
    chunks = [data[i : i + 32] for i in range(0, len(data), 32)]
    out = [x.mean() / 255, x.std() / 255, x.min() / 255, x.max() / 255, (x.max() - x.min()) / 255, h / 8, len(np.unique(x)) / 256]
    out += (p.reshape(8, 32).sum(1)).tolist()
    out += [(d == 0).mean() if len(d) else 0, (d % 256 == 1).mean() if len(d) else 0, (np.sign(d[1:]) != np.sign(d[:-1])).mean() if len(d) > 1 else 0]
    out += [math.log2(len(x)) / 32, len(x) % 1024 / 1024, len(set(chunks)) / len(chunks), p[0], p[1], p[3], p[201:].sum()]
    out += np.sort(p)[::-1][:5].tolist()
    for k in (2, 4, 8, 16):
        n = len(data) // k
        out.append(float(np.mean([data[i * k : i * k + k] == data[i * k + k : i * k + 2 * k] for i in range(n - 1)])) if n > 1 else 0.0)
    return [float(min(1.0, max(0.0, v))) for v in (out + [0.0] * width)[:width]]


def block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed records of each (slot, n) of a synthetic block: slot, i, program, amount."""
    for b in batches:
        rows = [(s, *r) for s, n in zip(b["slot"], b["n"], strict=True) for r in records(synthetic_block(int(s), int(n)))]
        yield pd.DataFrame(rows, columns=["slot", "i", "program", "amount"])
