"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Method.  The distinct pieces (pre-token matches) of a batch of texts form a
small corpus.  An inverted index leads from each token pair, named by the rank
of the token it makes, to the positions in that corpus at which the pair
stands.  Ranks are taken in ascending order; applying one visits only the
positions in its list, joins the two tokens there and puts the pairs with the
new token's two neighbours into the index.  Every piece thus goes through all
merges once per batch however often it occurs in the texts.

Scale.  No shuffle and no state beyond a batch but a cache of pieces with a
fixed number of entries, so memory is bounded by the Arrow batch and the cache.
The ranks (a vocabulary file of fixed size) are read once on the driver and
broadcast.  A lost executor repeats only its own partitions.

Cases.  Null text counts as empty; empty text has no tokens and the hashes of
the empty string.  Repeated rows give repeated rows.  An empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import mix64, pieces, placed_hashes, texts_of

#: Pieces whose encodings a Python worker keeps.
CACHE = 300_000
#: Characters encoded at once; some 150 bytes of memory are taken for each.
CHARS = 500_000
#: Fixed value: the pattern for which :meth:`Codec.starts` has a vectorised form.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _LETTER = 0, 1
#: Characters and tokens of the pieces that a worker keeps, at most.
HELD = 8_000_000
#: White space before which any text can be cut without changing a match of ``PLAIN``.
_safe = regex.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one vocabulary; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.cache_size = ranks, cache
        self.vocab = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).finditer
        self.plain = pattern == PLAIN
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = r
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()] or [-1], dtype=np.int64)
        if not len(self.pair_key):
            self.pair_key = np.array([-1], dtype=np.int64)
        self.bytes_flat = np.frombuffer(b"".join([self.vocab[i] for i in sorted(self.vocab)]), dtype=np.uint8)
        ids = np.array(sorted(self.vocab), dtype=np.int64)
        self.bytes_len = np.zeros(int(ids[-1]) + 1, dtype=np.int64)
        self.bytes_len[ids] = [len(self.vocab[i]) for i in ids.tolist()]
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        digits = [f"{i} ".encode() for i in range(int(ids[-1]) + 1)]
        self.digits_len = np.array([len(d) for d in digits], dtype=np.int64)
        width = int(self.digits_len.max())
        self.digits = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in digits]), dtype=np.uint8).reshape(-1, width)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.slot = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # hashes of pieces, ascending, and their places below
        self.flat, self.at, self.len = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.chars, self.chars_at, self.chars_len = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; -1 if none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words and the number of each word's, all merges applied in the order of their ranks."""
        whole = [self.ranks.get(w, -1) for w in words]  # a word that is a token is that token
        lengths = np.array([len(w) if r < 0 else 0 for w, r in zip(words, whole, strict=True)], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sym = self.byte[np.frombuffer(b"".join([w for w, r in zip(words, whole, strict=True) if r < 0]), dtype=np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = lengths > 0
        nxt[ends[some] - 1] = -1
        prv[starts[some]] = -1
        cur = np.full(n, -1, dtype=np.int64)  # rank of the pair that starts at a position
        inner = np.flatnonzero(nxt >= 0)
        cur[inner] = self._rank(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        live = np.flatnonzero(cur >= 0)
        if len(live):
            enter(live, cur[live])
        early: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            p = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            p = p[cur[p] == r]
            if not len(p):
                continue
            j = nxt[p]
            if len(p) > 1 and (touch := j[:-1] == p[1:]).any():  # of overlapping pairs, the left one goes first
                keep, taken = np.ones(len(p), dtype=bool), True
                for k, t in enumerate(touch.tolist(), 1):
                    keep[k] = taken = not (t and taken)
                p, j = p[keep], j[keep]
            sym[p] = r
            sym[j] = cur[j] = -1
            after = nxt[j]
            nxt[p] = after
            right = after >= 0
            prv[after[right]] = p[right]
            cur[p] = -1
            pr = p[right]
            cur[pr] = self._rank(sym[pr], sym[after[right]])
            before = prv[p]
            before = before[before >= 0]
            if len(before):
                cur[before] = self._rank(sym[before], sym[nxt[before]])
                pr = np.concatenate([pr, before])
            made = cur[pr]
            pr, made = pr[made >= 0], made[made >= 0]
            if len(pr):
                if (low := made < r).any():
                    early.append(pr[low])
                enter(pr, made)
        kept = np.flatnonzero(sym >= 0)
        own = np.array(whole, dtype=np.int64)
        counts = np.where(own >= 0, 1, np.searchsorted(kept, ends) - np.searchsorted(kept, starts))
        ids = np.empty(int(counts.sum()), dtype=np.int64)
        single = (np.cumsum(counts) - counts)[own >= 0]
        rest = np.ones(len(ids), dtype=bool)
        rest[single] = False
        ids[single], ids[rest] = own[own >= 0], sym[kept]
        if early:  # a merge made an earlier one possible: such words alone are merged one step at a time
            out = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.unique(np.searchsorted(ends, np.concatenate(early), side="right")).tolist():
                out[k] = np.array(self.stepwise(words[k]), dtype=np.int64)
            ids, counts = np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)
        return ids, counts

    def stepwise(self, word: bytes) -> list[int]:
        """Token ids of one word: the leftmost pair of least rank, again and again."""
        ids = np.array(self.byte[list(word)], dtype=np.int64)
        while len(ids) > 1:
            ranks = self._rank(ids[:-1], ids[1:])
            if (ranks < 0).all():
                break
            i = int(np.where(ranks < 0, np.iinfo(np.int64).max, ranks).argmin())
            ids = np.concatenate([ids[:i], ranks[i : i + 1], ids[i + 2 :]])
        return ids.tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, as an array."""
        return self.bytes_flat[_spread(self.bytes_at[ids], self.bytes_len[ids])]

    def starts(self, text: str, begins: np.ndarray) -> np.ndarray:
        """Where pieces start in the joined ``text``, whose parts begin at ``begins`` and are matched separately."""
        n = len(text)
        if not self.plain:  # any pattern whose matches cover the text
            ends = np.concatenate([begins[1:], [n]]).tolist()
            return np.array([m.start() for a, b in zip(begins.tolist(), ends, strict=True) for m in self.find(text, a, b, partial=False)], dtype=np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = _kinds()[code]
        first = np.zeros(n + 1, dtype=bool)  # of a text
        first[begins] = first[n] = True
        start = np.empty(n + 1, dtype=bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start |= first
        # white space before another piece: its last character stands alone, or, if a space, goes with what follows
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        for i in np.flatnonzero((code[:-1] == 39) & start[: n - 1] & (kind[1:] == _LETTER) & ~first[1:n]).tolist():
            pair = text[i + 1 : i + 3]
            k = 1 if pair[0] in "stmd" else 2 if pair in ("re", "ve", "ll") else 0
            if k and not first[i + 1 : i + 1 + k].any():
                start[i + 1] = False
                start[i + 1 + k] = True
        return np.flatnonzero(start[:n])

    def run(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        texts = [t or "" for t in texts]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        text = "".join(texts)
        if not text:
            return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        begins = np.unique(bounds[:-1][lengths > 0])
        start = self.starts(text, begins)
        end = np.concatenate([start[1:], [len(text)]])
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        hashed, one, which = np.unique(self._hashes(code, start, end), return_index=True, return_inverse=True)
        if len(self.slot) + len(hashed) > self.cache_size or len(self.flat) + len(self.chars) > HELD:
            self._forget()
        place = np.full(len(hashed), -1, dtype=np.int64)
        if len(self.hash):
            near = np.minimum(np.searchsorted(self.hash, hashed), len(self.hash) - 1)
            place = np.where(self.hash[near] == hashed, self.slot[near], -1)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            among = np.searchsorted(self.hash, hashed[new])
            self.hash, self.slot = np.insert(self.hash, among, hashed[new]), np.insert(self.slot, among, place[new])
            a, b = start[one[new]], end[one[new]]
            ids, counts = self.replay([text[i:j].encode("utf-8") for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts) - counts])
            self.len = np.concatenate([self.len, counts])
            self.flat = np.concatenate([self.flat, ids])
            self.chars_at = np.concatenate([self.chars_at, len(self.chars) + np.cumsum(b - a) - (b - a)])
            self.chars_len = np.concatenate([self.chars_len, b - a])
            self.chars = np.concatenate([self.chars, code[_spread(a, b - a)]])
        use = place[which]
        counts = self.len[use]
        ids = self.flat[_spread(self.at[use], counts)]
        # pieces are told apart by their characters: where a hash names others, such pieces are merged anew
        size = end - start
        alike = self.chars_len[use] == size
        mine, theirs = code[_spread(start[alike], size[alike])], self.chars[_spread(self.chars_at[use[alike]], size[alike])]
        if not alike.all() or not np.array_equal(mine, theirs):
            words = [text[a:b].encode("utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            some, n = self.replay(list(known))
            use = np.array([known[w] for w in words], dtype=np.int64)
            counts = n[use]
            ids = some[_spread((np.cumsum(n) - n)[use], counts)]
        done = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(done[np.searchsorted(start, bounds)])

    def _hashes(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece, of its characters at their places."""
        with np.errstate(over="ignore"):
            return mix64(placed_hashes(code, start, end) + (end - start).astype(np.uint64))

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str], list[bytes]]:
        """Of each text: SHA-256 of its ids in decimal, of its decoded bytes, and these bytes."""
        done = np.concatenate([[0], np.cumsum(counts)])
        table, width = self.digits[ids], self.digits_len[ids]
        said = table[np.arange(table.shape[1]) < width[:, None]].tobytes()
        told = np.concatenate([[0], np.cumsum(width)])[done].tolist()
        data = self.decode(ids).tobytes()
        cut = np.concatenate([[0], np.cumsum(self.bytes_len[ids])])[done].tolist()
        decoded = [data[a:b] for a, b in pairwise(cut)]
        return [sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(told)], [sha256(d).hexdigest() for d in decoded], decoded

    def batches(self, texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of texts, their ids and counts, for runs of texts with about ``chars`` characters.

        A longer text is encoded in parts, cut where no match goes on.
        """
        at = size = 0
        for k, text in enumerate(texts, 1):
            size += len(text or "")
            if size > chars or k == len(texts):
                if len(text or "") > 2 * chars and self.plain:
                    if k - 1 > at:
                        yield k - 1 - at, *self.run(texts[at : k - 1])
                    ids = np.concatenate([self.run([part])[0] for part in self._parts(text, chars)])
                    yield 1, ids, np.array([len(ids)], dtype=np.int64)
                else:
                    yield k - at, *self.run(texts[at:k])
                at, size = k, 0

    @staticmethod
    def _parts(text: str, chars: int) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = _safe.search(text, at + chars)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end


def _spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices at, at + 1, ... of each segment, one segment after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - count), count)


@cache
def _kinds() -> np.ndarray:
    """By code point: white space 0, letter 1, number 2, other 3."""
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, 3, dtype=np.uint8)
    for k, what in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(what, every):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
    return kinds


_CODECS: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """The worker's codec, kept over tasks."""
    key = (ranks.id if hasattr(ranks, "id") else 0, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, ids: bool = True, text: bool = False) -> DataFrame:
    """Encode each document's whole text and decode the ids again.

    ``vocabulary`` is the path of the ranks file, ``pattern`` the pre-token
    pattern.  Returns ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, as asked, ``ids`` and ``decoded`` (the bytes).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in pieces(batches):
            at = 0
            for n, found, counts in codec.batches(batch.column(1).to_pylist()):
                id_hash, text_hash, decoded = codec.digests(found, counts)
                cols = [batch.column(0).slice(at, n), pa.array(counts), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(found.astype(np.int32))))
                if text:
                    cols.append(pa.array(decoded, pa.binary()))
                at += n
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * text
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * text
    return texts_of(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and the ``decoded`` bytes of a frame with ``doc_id`` and ``ids`` (null: no ids)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            out = [b"".join([vocab[i] for i in x or []]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
