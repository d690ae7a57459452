"""Substring dedup by sliding sentence spans.

Method.  A text is cut into sentences (at white space after a full stop,
question or exclamation mark, and at line ends); a sentence is compared by its
words, lower-cased.  Runs of at least ``sentences`` consecutive sentences with at
least ``words`` words, or of at least ``long_words`` words, are spans.  From every
sentence, and up to every sentence, the shortest one is hashed: every longer
repetition is a union of such.  Hashes have 128 bits, so that no two different
runs of any corpus are taken for one.  Hashes met more than once over the whole corpus are joined back to their places,
the first place (by ``doc_id``, the text's hash, then position) is kept, and every sentence
covered by any other place is removed.

Scale.  Counting hashes aggregates before the shuffle; only repeated ones come
back, one row per place, through a join that adaptive execution splits when a
passage is very common.  Documents are shuffled once, by id, for the removal.

Cases.  Null and empty texts stay as they are, as do rows without an id.  Rows
equal in id and text count as one document and are treated alike.  Texts with
fewer sentences or words than a run needs are never touched.  A repetition
inside one document counts.  An empty table gives an empty result.  All columns
of the input are carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import LOWER, durable, pieces

SENTENCES = 2
WORDS = 20
#: With so many words a single sentence is a span.
LONG_WORDS = 25

_cuts = re.compile(r"(?<=[.!?])\s+|\n\s*").finditer


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, the white space after it included; parts without a word go with the one before."""
    ends = [m.end() for m in _cuts(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out: list[tuple[int, int]] = []
    at = 0
    for e in ends:
        if e > at:
            if out and not text[at:e].strip():
                out[-1] = (out[-1][0], e)
            else:
                out.append((at, e))
            at = e
    return out


def spans_of(text: str, sentences: int, words: int, long_words: int) -> list[tuple[int, int, int, int]]:
    """Both halves of the hash, first sentence and end of the shortest sufficient runs from and up to each sentence."""
    parts = sentences_of(text)
    done, hashes = [0], []
    for a, b in parts:
        own = text[a:b].encode("utf-8").translate(LOWER).split()
        done.append(done[-1] + len(own))
        hashes.append(xxhash.xxh3_128_digest(b" ".join(own)))

    def enough(i: int, j: int) -> bool:
        return done[j] - done[i] >= long_words or (j - i >= sentences and done[j] - done[i] >= words)

    runs = set()
    j = 0
    for i in range(len(parts)):
        j = max(j, i + 1)
        while j <= len(parts) and not enough(i, j):
            j += 1
        if j > len(parts):
            break
        runs.add((i, j))
    i = 0
    for j in range(1, len(parts) + 1):
        if enough(i, j):
            while i + 1 < j and enough(i + 1, j):
                i += 1
            runs.add((i, j))
    out = []
    for i, j in sorted(runs):
        h = xxhash.xxh3_128_digest(b"".join(hashes[i:j]))
        out.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), i, j))
    return out


def repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash`` and the ``spans`` (start, end) of sentences that repeat an earlier place."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owner, flat = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = spans_of(text, sentences, words, long_words)
                owner += [k] * len(own)
                flat += own
            take = pa.array(owner, pa.int32())
            cols = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], names=["doc_id", "text_hash", "span", "rest", "start", "end"])

    rows = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = rows.mapInArrow(hashed, "doc_id long, text_hash long, span long, rest long, start int, end int")
    often = spans.groupBy("span", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    held = durable(spans.join(often, ["span", "rest"]))
    place = F.struct("doc_id", "text_hash", "start")
    first = held.groupBy("span", "rest").agg(F.min(place).alias("first"))
    later = held.join(first, ["span", "rest"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def without(text: str, spans: list[dict]) -> tuple[str, int, list[int]]:
    """The text without the covered sentences, the number of sentences, and which went."""
    parts = sentences_of(text)
    gone = sorted({i for s in spans for i in range(s["start"], s["end"])})
    if not gone:
        return text, len(parts), gone
    lost = set(gone)
    return "".join([text[a:b] for i, (a, b) in enumerate(parts) if i not in lost]), len(parts), gone


def dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """The struct ``row`` of each row of ``docs``, its new ``text``, ``n_sentences`` and the list ``removed``."""
    found = repeated_sentences(docs, sentences, words, long_words).toDF("r_id", "r_hash", "spans")
    rows = docs.select(F.struct("*").alias("row")).withColumn("h", F.xxhash64("row.text"))
    joined = rows.join(found, (F.col("row.doc_id").cast("long") == F.col("r_id")) & (F.col("h") == F.col("r_hash")), "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row = batch.column(0)
            got = [(t, 0, []) if t is None else without(t, s or []) for t, s in zip(row.field(row.type.get_field_index("text")).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.list_(pa.int32()))], names=["row", "text", "n_sentences", "removed"])

    return joined.mapInArrow(run, T.StructType([rows.schema["row"]]).add("text", "string").add("n_sentences", "long").add("removed", T.ArrayType(T.IntegerType())))
