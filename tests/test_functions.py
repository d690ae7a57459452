"""Codecs round trip, parsers and folds against plain statements of their rules."""

import random
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.functions import byte_windows, parsers
from ledgerlake.functions.codecs import CODECS
from ledgerlake.operators import replay

_random = random.Random(7)
_KEY = bytes(range(32))
CASES = [
    b"", b"a", bytes(31), bytes(32), bytes(33), bytes(range(256)) * 3, b"\xff\xfe\xfd\xfc\xfa\x7e\x80\x20\x01" * 40, b"\x06" * 64 + b"\x0b" * 64,
    _KEY * 5, _KEY + bytes([9]) + _KEY[1:] + _KEY, bytes(_random.randrange(256) for _ in range(3000)),
    b"".join(bytes(_random.randrange(256) for _ in range(32)) * 2 for _ in range(300)), parsers.synthetic_block(244000000, 75),
]


@pytest.mark.parametrize("name", sorted(CODECS))
def test_round_trip(name):
    encode, decode = CODECS[name]
    for data in CASES:
        assert decode(encode(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(sorted(CODECS)))
def test_round_trip_any(data, name):
    encode, decode = CODECS[name]
    assert decode(encode(data)) == data


def test_versions_are_told_apart():
    coded = CODECS["enc24_version1"][0](b"abc")
    with pytest.raises(ValueError, match="version"):
        CODECS["enc24_version2"][1](coded)


@pytest.mark.parametrize(("n", "size"), [(50, 6094), (75, 9116), (100, 12138)])
def test_block_sizes_and_records(n, size):
    block = parsers.synthetic_block(244000000, n)
    assert len(block) == size
    assert [(i, k) for i, k, _ in parsers.records(block)] == [(i, i % 4) for i in range(n)]


def test_base58():
    assert parsers.base58(b"\0\0abc") == "11ZiCa"


def test_heuristics():
    assert parsers.likely_pubkey(_KEY)
    assert not parsers.likely_pubkey(bytes(32))
    assert parsers.likely_program(bytes(range(1, 33)))
    assert parsers.pre_compressed(b"\xff\xff" + _KEY)
    assert parsers.likely_nonce(bytes(21) + b"x" * 11)
    assert not parsers.likely_address(bytes(28) + b"abcd")


def test_wallet_keeps_limits():
    rows = pd.DataFrame({"amount": [600_000, 600_000, 400_000], "ts_s": [0, 1, 2]})
    assert replay.wallet(rows) == {"accepted": 2, "rejected": 1, "balance": 1_000_000}


def test_caches():
    rows = pd.DataFrame({"slot": [1, 2, 1, 1, 3], "size_bytes": [10] * 5, "ts_s": [0, 1, 2, 90_000, 90_001]})
    assert replay.tiered_cache(rows) == {"hits": 1, "misses": 4, "demoted": 0, "expired": 1}
    assert replay.sequential_access(rows) == {"sequential": 1, "accesses": 5}


def _plain_windows(raw, size):
    return Counter(raw[i : i + size] for i in range(len(raw) - size + 1))


@given(st.one_of(st.binary(max_size=300), st.text("ab", max_size=400).map(str.encode)))
@settings(max_examples=100, deadline=None)
def test_windows_equal_plain_counts(raw):
    every = [(-c * s, -s, w, c) for s in byte_windows.SIZES for w, c in _plain_windows(raw, s).items() if c >= 3]
    assert byte_windows.patterns(raw) == [(i + 1, w.hex().upper(), c, -g) for i, (g, _, w, c) in enumerate(sorted(every)[:100])]
    for size, share in zip(byte_windows.SIZES, byte_windows.repetition(raw), strict=True):
        counts = _plain_windows(raw, size).values()
        assert share == (sum(c for c in counts if c > 1) / sum(counts) if len(raw) >= 2 * size else 0)


def test_chunks_of_known_blocks():
    block = bytes(range(32))
    near = bytes([255] * 4) + block[4:28] + bytes([9, 9, 9, 9])
    assert byte_windows.periodicity(b"ab" * 16) == [1, 1, 1, 1]
    assert byte_windows.periodicity(b"") == [0, 0, 0, 0] and byte_windows.widest_period(b"abc" * 20) == 1
    assert byte_windows.near_duplicates(block + block) == 0
    changed = block[:28] + bytes([9, 9, 9, 9])
    assert byte_windows.near_duplicates(block + changed) == 28 / 32
    assert byte_windows.near_duplicates(block + near) == 0  # half of the first eight bytes differ
    assert byte_windows.chunk_similarity(block + near + b"tail") == (2, 1, 0.5)
    assert byte_windows.chunk_similarity(b"") == (0, 0, 0.0)
    assert byte_windows.densities(b"\x11" * 33 + b"\x06\xdd\xf6\xe1\xff\xfe\x00\x00\x00\x01") == [2 / 43, 1 / 43, 1 / 43, 5 / 43]


def test_windows_of_a_long_block():
    assert byte_windows.patterns(b"x" * 1_000_000)[0] == (1, "78" * 64, 999_937, 63_995_968)
