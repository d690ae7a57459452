"""Shared helpers: table access, durable cuts of lineage, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again, its lineage cut.

    Unlike a checkpoint, which counts the rows and then computes them anew to
    write them, this computes them once.  The folder is the session's
    ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
    temporary folder takes its place.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ckpt"))
    folder = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Remove durable tables that nothing will read again, and let Spark's cleaner remove the shuffles they were made by."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def texts_of(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named columns, nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *also)


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it can return free memory."""
    lib = ctypes.CDLL(None)
    return lib if hasattr(lib, "malloc_trim") else None


def give_back() -> None:
    """Return to the system what this process has freed.

    A worker serves task after task, also of other operators, and would
    otherwise keep the free room of the largest of them.
    """
    pa.default_memory_pool().release_unused()
    if lib := _libc():
        lib.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one stays small."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0xD6E8FEB86659FD93
_STEP = 1 << 20  # bytes hashed at once

with np.errstate(over="ignore"):
    #: A random word for every byte at each of a word's first 64 places.
    _PLACED = mix64(np.arange(1, (64 << 8) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def placed_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, before: int = 0) -> np.ndarray:
    """The sum, modulo 2^64, of a random word for each value and its place in its run, for runs start to end.

    Tabulation over places, which no choice of values makes collide by its
    algebra, as polynomials modulo 2^64 do.  The first run goes on from ``before``.
    """
    length = end - start
    done = np.cumsum(length)
    at = np.arange(int(done[-1]) if len(done) else 0)
    place = at - np.repeat(done - length, length)
    if before and len(length):
        place[: length[0]] += before
    own = values[at + np.repeat(start - (done - length), length)].astype(np.int64)
    with np.errstate(over="ignore"):
        near = (place < 64) & (own < 256)
        if near.all():
            word = _PLACED[place << 8 | own]
        else:
            word = np.empty(len(at), dtype=_U)
            word[near] = _PLACED[place[near] << 8 | own[near]]
            far = ~near
            word[far] = mix64(mix64(place[far].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(_BASE)) + own[far].astype(_U) * _U(0xBF58476D1CE4E5B9))
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(word, dtype=_U)])
        return total[done] - total[done - length]


#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes that are not ASCII white space, in order."""
    hashes, lengths = [], []
    going = 0  # bytes that the last word has so far, if it may go on
    for at in range(0, len(data), _STEP):
        b = np.frombuffer(data, dtype=np.uint8, count=min(_STEP, len(data) - at), offset=at)
        word = np.concatenate([[False], ~_SPACE[b], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        on = bool(going) and bool(word[1])
        h, n = placed_hashes(b, start, end, going if on else 0), end - start
        with np.errstate(over="ignore"):
            if on:
                h[0] += hashes[-1][-1]
                n[0] += going
                hashes[-1], lengths[-1] = hashes[-1][:-1], lengths[-1][:-1]
        going = int(n[-1]) if len(end) and end[-1] == len(b) else 0
        hashes.append(h)
        lengths.append(n)
    if not hashes:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        return mix64(np.concatenate(hashes) + np.concatenate(lengths).astype(_U))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``size`` lower-cased words of each text.

    Returns the values, ascending within each text, and the number of each.
    With fewer words the whole sequence is one shingle; without words none.
    """
    sets = []
    with np.errstate(over="ignore"):
        for text in texts:
            w = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
            if 0 < len(w) < size:
                s = np.array([_U(len(w))])
                for x in w:
                    s = mix64(s * _U(_BASE) + x)
            elif len(w):
                n = len(w) - size + 1
                s = np.full(n, _U(size))
                for i in range(size):
                    s = mix64(s * _U(_BASE) + w[i : i + n])
                s = np.unique(s)
            else:
                s = w
            sets.append(s)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=_U)), np.array([len(s) for s in sets], dtype=np.int64)
