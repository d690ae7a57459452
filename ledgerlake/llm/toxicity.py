"""Toxicity by a factorization machine over hashed terms.

Method.  A document's terms are its distinct lower-cased words and their
prefixes of three to six characters, hashed into a fixed number of buckets.
On a bounded sample of labelled rows the buckets that tell the classes apart
are selected, and a second-order factorization machine (Rendle, 2010) is
trained on their presence: a weight per term and, through the product of two
latent vectors, one per pair of terms, so that an insult next to the mention of
a group can weigh more than the two apart.

Scale.  The fit reads at most ``sample`` labelled rows, those with the smallest
hash of their id, in one task; what it returns has a fixed size and is
broadcast.  Scoring is one pass without a shuffle over whole texts.

Cases.  Null text counts as empty; an empty text has the score that the bias
alone gives.  Null labels are ignored; repeated rows count each.  Without
labels of both classes every score is the share of label 1, or 0.  An empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pieces, texts_of

#: Labelled rows that the fit reads at most.
SAMPLE = 20_000
BUCKETS = 1 << 20
TERMS = 4096
LATENT = 8
LEAST_Z = 4.5
CACHE = 150_000

_words = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(word: str) -> list[int]:
    """Buckets of a word: itself and its prefixes."""
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in {word, *(f"^{word[:n]}" for n in range(3, 7) if len(word) > n)}]


class Terms:
    """Distinct buckets of a text, with what is known of words kept in a bounded table."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.known = wanted, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        for w in set(_words((text or "").lower())):
            t = known.get(w)
            if t is None:
                t = terms(w)
                if self.wanted is not None:
                    t = tuple(self.wanted[x] for x in t if x in self.wanted)  # no place for most words
                if len(known) >= CACHE:
                    known.clear()
                known[w] = t
            if t:
                out.update(t)
        return np.array(sorted(out), dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Machine:
    """Bias, weights and latent vectors of the selected buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, weight: np.ndarray, latent: np.ndarray):
        self.buckets, self.bias, self.weight, self.latent = buckets, bias, weight, latent

    def sums(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and sum of the latent vectors of each row of terms."""
        v = self.latent[flat]
        cuts = np.concatenate([[0], ends])

        def total(x: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])[cuts], axis=0)

        s, q = total(v), total(np.concatenate([v * v, self.weight[flat, None]], axis=1))
        return self.bias + q[:, -1] + 0.5 * ((s * s).sum(1) - q[:, :-1].sum(1)), s

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of places in ``buckets``."""
        if not rows:
            return np.empty(0)
        flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        return _sigmoid(self.sums(flat, np.cumsum([len(r) for r in rows]))[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, latent: int = LATENT, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Machine:
    """Select buckets and train by Adam on the logistic loss."""
    n, pos = len(rows), int(labels.sum())
    share = pos / n if n else 0.0
    none = Machine(np.empty(0, dtype=np.int64), float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, latent)))
    if not 0 < pos < n:
        return none
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, y in zip(rows, labels, strict=True):
        seen[r] += 1
        toxic[r] += y
    p = seen / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(toxic / pos - (seen - toxic) / (n - pos)) / np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)))
    z[~np.isfinite(z) | (seen < 3)] = 0
    best = np.argsort(-z, kind="stable")[:TERMS]
    chosen = np.sort(best[z[best] >= LEAST_Z])
    if not len(chosen):
        return none
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = [q[q >= 0] for q in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    m = Machine(chosen, none.bias, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), latent)))
    first, second, step = np.zeros((len(chosen), latent + 1)), np.zeros((len(chosen), latent + 1)), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            part = order[a : a + 256]
            own = [kept[i] for i in part]
            flat, sizes = np.concatenate(own), np.array([len(x) for x in own])
            logit, s = m.sums(flat, np.cumsum(sizes))
            g = (_sigmoid(logit) - labels[part]) / len(part)
            gr = np.repeat(g, sizes)
            gv = gr[:, None] * (np.repeat(s, sizes, axis=0) - m.latent[flat])
            grad = np.stack([np.bincount(flat, x, len(chosen)) for x in (gr, *gv.T)], axis=1)
            grad += decay * np.concatenate([m.weight[:, None], m.latent], axis=1)
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            m.weight = m.weight - move[:, 0]
            m.latent = m.latent - move[:, 1:]
            m.bias -= rate * float(g.sum())
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the ``sample`` labelled rows with the smallest hash of their id, held-out rows left out."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .withColumn("h", F.xxhash64("id"))
    )
    most = known.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if most is None:
        return fit([], np.empty(0))
    # rows with equal hashes have equal ids, so the bound holds but for repeated rows of one id
    some = F.broadcast(known.filter(F.col("h") <= most).orderBy("h", "toxic").limit(sample))
    rows = texts_of(docs).join(some, F.col("doc_id") == F.col("id")).select("h", "toxic", "text").repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, keys, ys, found = Terms(), [], [], []
        for batch in batches:
            found += [of(t).astype(np.int32) for t in batch["text"]]
            keys += batch["h"].tolist()
            ys += batch["toxic"].tolist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], ys[i], len(found[i]), found[i].tobytes()))
        m = fit([found[i] for i in order], np.array([ys[i] for i in order]))
        yield pd.DataFrame({"buckets": [m.buckets.tolist()], "bias": [m.bias], "weight": [m.weight.tolist()], "latent": [m.latent.ravel().tolist()]})

    r = rows.mapInPandas(run, "buckets array<long>, bias double, weight array<double>, latent array<double>").first()
    if r is None:
        return fit([], np.empty(0))
    weight = np.array(r["weight"], dtype=np.float64)
    return Machine(np.array(r["buckets"], dtype=np.int64), r["bias"], weight, np.array(r["latent"], dtype=np.float64).reshape(len(weight), LATENT))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        of = Terms({int(b): i for i, b in enumerate(m.buckets)})
        for batch in pieces(batches):
            got = m.score([of(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        of = Terms({int(b): i for i, b in enumerate(m.buckets)})
        for batch in pieces(batches):
            got = m.score([of(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)
