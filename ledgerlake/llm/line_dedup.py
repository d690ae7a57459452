"""Line dedup by winnowing over line hashes (Schleimer, Wilkerson and Aiken, 2003).

Method.  A document is the sequence of its lines that are not blank, stripped
and hashed.  Hashes of ``gram`` consecutive lines are taken over windows of
``window`` such grams, and each window's minimum (the rightmost of equals) is
kept as a fingerprint.  Any run of ``gram + window - 1`` lines that two places
share has a fingerprint in common, while about two in ``window + 1`` positions are
stored.  By default the window is one gram, so that every line of every repetition
of two lines goes, whichever earlier place holds it; a larger window stores less
and is certain of longer runs only.  Fingerprints are joined to
the first place that holds them; each match is extended line by line in both
directions, and the later run, at least ``gram`` lines, is deleted.

Order.  Places go by ``doc_id``, then the text's hash, then the line.  A deleted
line always equals an earlier one, so the earliest copy of any line stays.

Scale.  Fingerprints are pre-aggregated before they are shuffled and joined to
one row per fingerprint, so a passage in a third of all documents gives one row
per place; adaptive execution splits the skewed join.  Documents are shuffled
once, by id, for the deletion.

Cases.  Null and empty texts have no lines and stay as they are, as do rows
without an id.  Rows equal in id and text count as one document and are treated
alike.  Blank lines between two deleted ones go with them.  An empty table gives an
empty result.  All columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import durable, mix64, pieces

#: Every repetition of ``GRAM + WINDOW - 1`` lines is found, so of two, which is also the least that is deleted.
GRAM = 2
WINDOW = 1


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def winnow(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Gram hashes and the places of the window minima among them."""
    if len(hashes) < gram:
        return np.empty(0, dtype=np.uint64), []
    with np.errstate(over="ignore"):
        g = np.zeros(len(hashes) - gram + 1, dtype=np.uint64)
        for i in range(gram):
            g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(g)])
    w = min(window, len(g))
    seen = np.lib.stride_tricks.sliding_window_view(g, w)
    return g, sorted(set((np.arange(len(seen)) + w - 1 - seen[:, ::-1].argmin(axis=1)).tolist()))


def extend(own: list[int], first: list[int], p: int, q: int, gram: int, same: bool) -> tuple[int, int]:
    """The longest run of ``own`` around p that equals ``first`` around q."""
    a, b = p, p + gram
    d = q - p
    while a > 0 and a + d > 0 and own[a - 1] == first[a - 1 + d] and not (same and a - 1 <= q):
        a -= 1
    while b < len(own) and b + d < len(first) and own[b] == first[b + d]:
        b += 1
    return a, b


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_hash`` and the ``runs`` (start, end) of its non-blank lines to delete."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            all_hashes, prints = [], []
            for text in batch.column(2).to_pylist():
                lines, places = lines_of(text)
                h = np.array([xxhash.xxh3_64_intdigest(lines[i].strip().encode("utf-8")) for i in places], dtype=np.uint64)
                g, chosen = winnow(h, gram, window)
                all_hashes.append(h.astype(np.int64))
                prints.append([{"gram": int(x), "pos": i} for i, x in zip(chosen, g[chosen].astype(np.int64).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(all_hashes, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())])))],
                names=["doc_id", "text_hash", "lines", "prints"],
            )

    rows = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    own = durable(rows.mapInArrow(hashed, "doc_id long, text_hash long, lines array<long>, prints array<struct<gram:long,pos:int>>"))
    place = F.struct("doc_id", "text_hash", "pos")
    prints = own.select("doc_id", "text_hash", F.explode("prints").alias("p")).select("doc_id", "text_hash", "p.gram", "p.pos").distinct()
    first = prints.groupBy("gram").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = prints.join(first, "gram").filter(place != F.col("first"))
    met = met.groupBy("doc_id", "text_hash", F.col("first.doc_id").alias("f_id"), F.col("first.text_hash").alias("f_hash")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("first.pos").alias("at")))).alias("met"))
    lines = own.select("doc_id", "text_hash", "lines").dropDuplicates(["doc_id", "text_hash"])
    met = met.join(lines, ["doc_id", "text_hash"]).join(lines.toDF("f_id", "f_hash", "f_lines"), ["f_id", "f_hash"])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for d, h, fd, fh, met_, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends: dict[int, int] = {}  # per diagonal, where the last run ends
                runs = []
                for m in met_:
                    p, q = m["pos"], m["at"]
                    if ends.get(p - q, -1) >= p + gram:
                        continue
                    run = extend(a, b, p, q, gram, (d, h) == (fd, fh))
                    ends[p - q] = run[1]
                    runs.append({"start": run[0], "end": run[1]})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "text_hash", "runs"])

    found = met.select("doc_id", "text_hash", "f_id", "f_hash", "met", "lines", "f_lines").mapInArrow(extended, "doc_id long, text_hash long, runs array<struct<start:int,end:int>>")
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))


def without(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the runs, its number of non-blank lines, and how many of them went."""
    lines, places = lines_of(text)
    gone, n = set(), set()
    for r in runs:
        n.update(range(r["start"], r["end"]))
        gone.update(range(places[r["start"]], places[r["end"] - 1] + 1))
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(places), len(n)


def dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The struct ``row`` of each row of ``docs``, its new ``text``, ``n_lines`` and ``n_removed``."""
    runs = repeated_runs(docs, gram, window).toDF("r_id", "r_hash", "runs")
    rows = docs.select(F.struct("*").alias("row")).withColumn("h", F.xxhash64("row.text"))
    joined = rows.join(runs, (F.col("row.doc_id").cast("long") == F.col("r_id")) & (F.col("h") == F.col("r_hash")), "left").select("row", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row = batch.column(0)
            got = [(t, 0, 0) if t is None else without(t, r or []) for t, r in zip(row.field(row.type.get_field_index("text")).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=["row", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, T.StructType([rows.schema["row"]]).add("text", "string").add("n_lines", "long").add("n_removed", "long"))
