"""N-gram Jaccard join by T-occurrence search (DivideSkip; Li, Lu and Lu, 2008).

Method.  A text's shingles are hashed to 64 bits.  Texts with equal sets form
one class, of which one representative goes on.  Two sets can only be similar
enough if they share one of each set's rarest few shingles (prefix filter), so
these few alone are grouped over the corpus.  A group's smallest id is its hub.
Searches then find the links: the inverted lists of a block of candidates are
divided into short lists, which are merged on a heap, and long ones, in which
the candidates met often enough are probed by binary search; what reaches the
required overlap is linked.  First every hub is searched among its members.
Only where members still lie in different components are those outside the
hub's component searched, in blocks, among all members of the hub's groups.
Since every linked pair shares such a group, no link between components is missed.
Before either search, sketches of a few bytes rule out members that differ in
too many shingles already there, so that only texts likely to be similar are moved.

How rare a shingle is only orders a set.  Shingles met twice in any batch are
counted and the ``FREQUENT`` commonest (a fixed bound) broadcast; all others
come first.  Any such order gives the same links.

Scale.  A few rows per document are shuffled, and the texts of documents that
share a rare shingle.  A group of copies of any size costs a row per copy; pairs
inside a group are never listed, links are stars and spanning edges.  Hubs with
many members are dealt to several tasks.

Cases.  Null and empty texts have empty sets and link with nothing, their
component is their own id.  Fewer words than the shingle size make one shingle.
Repeated rows of an id share a component.  Rows without an id get null.
An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, durable, pieces, shingle_sets, texts_of
from ledgerlake.llm.components import components

#: Shingles whose counts are broadcast at most (16 bytes each).
FREQUENT = 1 << 18
#: Members that a search task takes from one hub at most, and about so many rows in all.
BLOCK = 512
#: One in so many shingles is in a sketch.
SAMPLED = 8
#: Ids of the documents to be searched are broadcast up to so many (some 16 MB), else shuffled.
BROADCAST_IDS = 1_000_000


def _split(texts: list[str | None], size: int) -> list[np.ndarray]:
    flat, counts = shingle_sets(texts, size)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []


def _least(n: int, num: int, den: int) -> int:
    """The smallest overlap of a set of n shingles with a similar one."""
    return -(-num * n // den)


class Index:
    """Inverted lists of the shingles of a block of candidates."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.token, first = np.unique(flat[order], return_index=True)
        self.bounds = np.concatenate([first, [len(flat)]])

    def search(self, query: np.ndarray, num: int, den: int, skip=None) -> Iterator[int]:
        """Candidates whose Jaccard similarity with ``query`` is at least num / den.

        ``skip(c)`` is asked before a candidate is probed.
        """
        if not len(query) or not len(self.token):
            return
        least = _least(len(query), num, den)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        if len(at) < least:
            return
        length = self.bounds[at + 1] - self.bounds[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1)) if longest > 1 else 0)
        short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]
        lists = [self.owner[a:b].tolist() for a, b in zip(self.bounds[short].tolist(), self.bounds[short + 1].tolist(), strict=True)]
        probed = np.sort(self.token[long_])
        for c, met in groupby(heapq.merge(*lists)):
            count = sum(1 for _ in met)
            size = int(self.sizes[c])
            if count < least - n_long or den * min(size, len(query)) < num * max(size, len(query)) or (skip is not None and skip(c)):
                continue
            if n_long:
                own = self.sets[c]
                where = np.minimum(np.searchsorted(own, probed), size - 1)
                count += int((own[where] == probed).sum())
            if den * count >= num * (size + len(query) - count):
                yield c


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``FREQUENT`` commonest of the shingles met more than once in a batch, and how often they were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 5000):
            distinct = list({s.tobytes(): s for s in _split(batch.column(1).to_pylist(), size)}.values())
            if distinct:
                token, times = np.unique(np.concatenate(distinct), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token[times > 1].astype(np.int64)), pa.array(times[times > 1])], names=["token", "times"])

    met = texts_of(docs).mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rows = met.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], rows.column("times").to_numpy()[order]


def sets_of(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Per row ``doc_id``, ``n``, the ``key`` of its set, its ``rare`` shingles and the ``sketch``.

    Similar sets share one of their rare shingles.  The sketch is a sample of the
    set, the same shingles of any set, cut to 16 bits: two sketches never differ in
    more places than the sets do.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, times = held.value
        for batch in pieces(batches):
            n, key, rare, sketch = [], [], [], []
            for s in _split(batch.column(1).to_pylist(), size):
                count = np.zeros(len(s), dtype=np.int64)
                if len(token) and len(s):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    count = np.where(token[at] == s, times[at], 0)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                rare.append(s[np.lexsort((s, count))[: len(s) - _least(len(s), num, den) + 1 if len(s) else 0]].astype(np.int64))
                sketch.append(np.unique((s[s % np.uint64(SAMPLED) == 0] >> np.uint64(24)).astype(np.uint16)).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)
            flat = np.concatenate(rare) if rare else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sketch, pa.binary())],
                names=["doc_id", "n", "key", "rare", "sketch"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, key binary, rare array<long>, sketch binary")


class Sketches:
    """Inverted lists of the sketches of a block of candidates."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray):
        sets = [np.frombuffer(x, dtype=np.uint16) for x in sketches]
        self.sizes, self.counts = sizes, np.array([len(x) for x in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.counts)
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint16)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.bounds = np.searchsorted(flat[order], np.arange((1 << 16) + 1))

    def maybe(self, sketch: bytes, n: int, num: int, den: int) -> np.ndarray:
        """Whether each candidate can be similar to a set of n shingles with this sketch; no similar one is ruled out."""
        q = np.frombuffer(sketch, dtype=np.uint16).astype(np.int64)
        parts = [self.owner[a:b] for a, b in zip(self.bounds[q].tolist(), self.bounds[q + 1].tolist(), strict=True) if b > a]
        both = np.bincount(np.concatenate(parts), minlength=len(self.sizes)) if parts else np.zeros(len(self.sizes), dtype=np.int64)
        differ = len(q) + self.counts - 2 * both
        fits = den * np.minimum(self.sizes, n) >= num * np.maximum(self.sizes, n)
        return fits & ((den + num) * differ <= (den - num) * (self.sizes + n))


def _sets_by(table: pa.Table, size: int) -> list[np.ndarray]:
    return _split(table.column("text").to_pylist(), size)


def _together(left: DataFrame, right: DataFrame, key: str):
    """Both sides grouped by ``key``; their columns get new identities, as both come from one table."""
    return left.toDF(*left.columns).groupBy(key).cogroup(right.toDF(*right.columns).groupBy(key))


def _rows_by(t: pa.Table, *keys: str) -> dict[tuple, list[int]]:
    """Rows of a table by the values of its keys."""
    of: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(*(t.column(x).to_pylist() for x in keys), strict=True)):
        of.setdefault(k, []).append(i)
    return of


def _sized(ids: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it is small."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id`` and ``text`` of the documents in ``pairs`` (``hub``, ``id``), dealt by ``id`` once for repeated rows and joins."""
    wanted = _sized(pairs.select("id").union(pairs.select("hub")).distinct())
    return texts_of(docs).withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").repartition("id").dropDuplicates(["id", "text"])


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    sets = durable(sets_of(docs, size, num, den))
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    member = durable(sets.select("doc_id", "n", "key").join(classes, "key", "left"))
    copies = member.filter("doc_id <> rep").select("doc_id", "key").distinct()
    own = sets.filter("n > 0 and doc_id is not null").join(_sized(copies), ["doc_id", "key"], "left_anti")
    grams = own.select("doc_id", F.explode("rare").alias("token"))
    groups = grams.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).filter("hub < top").select("token", "hub")
    near = durable(grams.join(groups, "token").filter("doc_id <> hub").select("hub", F.col("doc_id").alias("id")).distinct())
    sketches = own.select(F.col("doc_id").alias("id"), "n", "sketch")
    sketches = durable(sketches.join(_sized(near.select("id").union(near.select("hub")).distinct()), "id", "left_semi"))
    discard(sets)

    # members whose sketches allow that they are similar to their hub
    total = near.count()
    dealt = near.join(near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "hub")
    task = F.pmod(F.xxhash64("hub", "part"), F.lit(max(1, total // BLOCK))).alias("task")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select(task, "hub", "part", "id")
    hubs = dealt.select("task", "hub", "part").distinct()

    def allow(left: pa.Table, right: pa.Table) -> pa.Table:
        of = _rows_by(right, "hub", "part")
        ids, n, sketch = right.column("id").to_pylist(), right.column("n").to_numpy(), right.column("sketch").to_pylist()
        a, b = [], []
        for hub, part, hn, hs in zip(*(left.column(c).to_pylist() for c in ("hub", "part", "n", "sketch")), strict=True):
            rows = of.get((hub, part), [])
            may = Sketches([sketch[i] for i in rows], n[rows]).maybe(hs, hn, num, den)
            b += [ids[i] for i, m in zip(rows, may.tolist(), strict=True) if m]
            a += [hub] * int(may.sum())
        return pa.table({"a": a, "b": b}, schema=_EDGE)

    allowed = _together(hubs.join(sketches.withColumnRenamed("id", "hub"), "hub"), dealt.join(sketches, "id"), "task").applyInArrow(allow, "a long, b long")
    stars_near = durable(allowed.select(F.col("a").alias("hub"), F.col("b").alias("id")))

    # every such hub among its members
    texts = _texts(docs, stars_near)
    total = stars_near.count()
    dealt = stars_near.join(stars_near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "hub")
    task = F.pmod(F.xxhash64("hub", "part"), F.lit(max(1, total // BLOCK))).alias("task")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select(task, "hub", "part", "id")
    members = dealt.join(texts, "id")
    hubs = dealt.select("task", "hub", "part").distinct().join(texts.withColumnRenamed("id", "hub"), "hub")

    def star(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        of = _rows_by(right, "hub", "part")
        ids, sets = right.column("id").to_pylist(), _sets_by(right, size)
        for hub, part, query in zip(left.column("hub").to_pylist(), left.column("part").to_pylist(), _sets_by(left, size), strict=True):
            own = of.get((hub, part), [])
            for c in Index([sets[i] for i in own]).search(query, num, den):
                a.append(hub)
                b.append(ids[own[c]])
        return pa.table({"a": a, "b": b}, schema=_EDGE)

    stars = durable(_together(hubs, members, "task").applyInArrow(star, "a long, b long"))
    discard(stars_near)
    # an id with several rows can have several representatives
    twice = member.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    first = components(stars.union(twice))
    discard(stars)

    # where a hub's members lie in several components: those outside its own among all
    placed = near.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(first.select(F.col("id").alias("hub"), F.col("component").alias("home")), "hub", "left").withColumn("home", F.coalesce("home", "hub"))
    placed = placed.withColumn("out", F.col("component") != F.col("home"))
    open_ = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("n_out")).filter("n_out > 0 and n > 1")
    open_ = open_.select("hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_out") / BLOCK).cast("int").alias("out_blocks"))
    rest = durable(placed.join(open_, "hub").select("hub", "id", "component", "out", "blocks", "out_blocks"))
    discard(near)

    def dealt_out(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those outside against all, in blocks: queries and candidates by task."""
        task = F.pmod(F.xxhash64("hub", "q", "c"), F.lit(max(1, rest.count() // BLOCK))).alias("task")
        asked = rest.filter("out").withColumn("q", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("out_blocks")).cast("int"))
        asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        among = rest.withColumn("c", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks")).cast("int"))
        among = among.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)))
        return tuple(x.select(task, "hub", "q", "c", "id", "component") for x in (asked, among))

    def partners(left: pa.Table, right: pa.Table) -> pa.Table:
        """Hub and id of whatever may have a similar one in another component."""
        found: set[tuple[int, int]] = set()
        of = _rows_by(right, "hub", "q", "c")
        ids, n, sketch, component = right.column("id").to_numpy(), right.column("n").to_numpy(), right.column("sketch").to_pylist(), right.column("component").to_numpy()
        qid, qn, qs, qc = (left.column(c).to_pylist() for c in ("id", "n", "sketch", "component"))
        for k, queries in _rows_by(left, "hub", "q", "c").items():
            rows = of.get(k, [])
            index = Sketches([sketch[i] for i in rows], n[rows])
            for i in queries:
                may = index.maybe(qs[i], qn[i], num, den) & (component[rows] != qc[i])
                if may.any():
                    found.add((k[0], qid[i]))
                    found.update((k[0], x) for x in ids[rows][may].tolist())
        return pa.table({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=_EDGE)

    asked, among = dealt_out(rest)
    open_ids = _together(asked.join(sketches, "id"), among.join(sketches, "id"), "task").applyInArrow(partners, "a long, b long").distinct()
    every, rest = rest, durable(rest.join(open_ids.select(F.col("a").alias("hub"), F.col("b").alias("id")), ["hub", "id"]))
    discard(every, sketches)
    texts = _texts(docs, rest.select("id", "hub").withColumn("hub", F.col("id")))
    asked, among = dealt_out(rest)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        edges: set[tuple[int, int]] = set()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        sides = []
        for t in (left, right):
            sides.append((_rows_by(t, "hub", "q", "c"), t.column("id").to_pylist(), t.column("component").to_pylist(), _sets_by(t, size)))
        (asks, qid, qcomp, qset), (holds, cid, ccomp, cset) = sides
        for k, queries in asks.items():
            own = holds.get(k, [])
            index = Index([cset[i] for i in own])
            for q in queries:
                for c in index.search(qset[q], num, den, lambda c, q=q: root(ccomp[own[c]]) == root(qcomp[q])):
                    x, y = root(qcomp[q]), root(ccomp[own[c]])
                    parent[max(x, y)] = min(x, y)
                    edges.add((qcomp[q], ccomp[own[c]]))
        return pa.table({"a": [x for x, _ in edges], "b": [x for _, x in edges]}, schema=_EDGE)

    found = _together(asked.join(texts, "id"), among.join(texts, "id"), "task").applyInArrow(search, "a long, b long")
    second = components(found.distinct())
    discard(rest)
    whole = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("over")), "component", "full")
    whole = whole.select(F.coalesce("id", "component").alias("rep"), F.coalesce("over", "component").alias("component_id"))
    out = member.join(whole, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
