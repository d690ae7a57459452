"""Approximate nearest neighbours: a graph built by NN-descent (Dong, Moses and Li, 2011), searched greedily.

Build.  Every distinct vector is a node.  Its first neighbours come from blocks
of vectors on the same side of random hyperplanes.  Each round then joins, for
every node, its neighbours and up to ``REVERSE`` nodes that hold it as a neighbour:
any two of them, at least one new since the last round, are compared, and either
enters the other's list if it is nearer than the last one there.  Rounds end when
at most the share ``SETTLED`` of the list entries is new.  They are Spark joins:
lists are joined with the vectors they name, once per task, and what is found is
merged by the task of the node that it is for.

Search.  A node that is asked for keeps a beam of the nearest nodes met, at first
its own list and a few long vectors; each step joins the nodes that lists of the beam
name with their vectors and lists, scores them and goes on as far as the nodes met in
its task lead, until all of the beam are expanded; no node is asked for again by a search
that has scored it.  At the end the beam is scored in double precision.

Vectors of unequal norm are brought to one by a further component, so that the
largest inner product is the nearest node.  Vectors of unequal length are never
compared; all lengths are indexed.

Scale.  A round moves each list a bounded number of times (neighbours per node are
the method's own bound) and each vector once to every task with a node near
it: tasks are made of nodes on the same side of hyperplanes, and are as few as the
bytes of their own vectors allow.  How many tasks a vector reaches depends on their
number, not on the nodes: all of them while they are few, some 80 at most when they are many.
Blocks have a bounded size, as larger sides are dealt at random.  Hyperplanes pass
through the mean of at most ``SAMPLE`` vectors; this and the ids of the first nodes
of every search are all that the driver gets.  Of equal vectors one is a node, and
it is searched once; results are widened to its k + 1 smallest ids, so a group of
copies costs a row each.  Recall is measured against brute force in the tests.

Cases.  Vectors that are null, zero, or hold null, NaN or infinity take no part.
Rows with the query's id never answer it.  Fewer candidates than k are all
returned: a search starts from k + 1 nodes at least.  Of several vectors of one
query id the one with the smallest node id is asked.  Products beyond the range of
doubles are infinite.  Only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, durable
from ledgerlake.llm.vafile import usable

NEIGHBOURS = 40
REVERSE = 40
#: Rounds end when at most this share of the list entries is new.
SETTLED = 0.01
#: Sets of hyperplanes, each of which cuts the vectors into blocks of about ``LEAF``.
TREES = 12
LEAF = 256
#: Vectors whose mean the hyperplanes pass through.
SAMPLE = 2048
BEAM = 128
#: Longest vectors, from which every search starts besides its own list.
ENTRIES = 32
#: Bytes of the vectors of a task's own nodes, and the tasks that a smaller input is dealt to all the same.
BLOCK_BYTES = 1 << 21
TASKS = 8
#: Searches of a task.
QUERY_BLOCK = 128
#: Pairs that a local join or a merge holds before it keeps the best of them.
PAIRS = 1_500_000


def _together(left: DataFrame, right: DataFrame, key: str):
    """Both sides grouped by ``key``, in as many partitions as the session sets: tasks are few and long, small as their rows are."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.toDF(*left.columns).repartition(parts, key).groupBy(key).cogroup(right.toDF(*right.columns).repartition(parts, key).groupBy(key))


def _matrix(packed: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), -1) if packed else np.empty((0, 1), dtype=np.float32)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of each list."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _best(u: np.ndarray, v: np.ndarray, sim: np.ndarray, old: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest distinct v of each u, u ascending and nearest first; ``old`` marks those known before, which stay so."""
    order = np.lexsort((~old, v, u))
    u, v, sim, old = u[order], v[order], sim[order], old[order]
    one = np.ones(len(u), dtype=bool)
    one[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, sim, old = u[one], v[one], sim[one], old[one]
    order = np.lexsort((v, -sim, u))
    u, v, sim, old = u[order], v[order], sim[order], old[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, dtype=np.int64)
    keep = np.arange(len(u)) - np.repeat(first, np.diff(np.concatenate([first, [len(u)]]))) < k
    return u[keep], v[keep], sim[keep], old[keep]


def _as_lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


_FOUND = "task long, ids array<long>, counts array<int>, near array<long>, sim array<float>"
_GRAPH = "task long, id long, v binary, near array<long>, sim array<float>, new array<boolean>"


def _found(ids: np.ndarray, tasks: np.ndarray, u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.Table:
    """What was found, a row for each task that it is for: its nodes, the length of each one's list, and the lists; u and v are places in ``ids``."""
    order = np.argsort(tasks[u], kind="stable")  # u stays together
    u, v, sim = u[order], v[order], sim[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, dtype=np.int64)
    own, counts = u[first], np.diff(np.concatenate([first, [len(u)]]))
    home, nodes = np.unique(tasks[own], return_counts=True)
    entries = np.add.reduceat(counts, np.cumsum(nodes) - nodes) if len(nodes) else nodes
    return pa.table({"task": home, "ids": _as_lists(nodes, ids[own]), "counts": _as_lists(nodes, counts.astype(np.int32)), "near": _as_lists(entries, ids[v]), "sim": _as_lists(entries, sim.astype(np.float32))})


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``task``, ``id``, ``d``, ``x`` as double array, ``v`` as packed unit vector) and the ``copies`` (``id``, ``vec_id``) of each."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x")) & F.exists("x", lambda x: x != 0)).distinct()
    nodes = durable(rows.groupBy("x").agg(F.min("vec_id").alias("id")).select("id", "x"))
    widest = F.array_max(F.transform("x", F.abs))
    norm = widest * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + (x / widest) * (x / widest)))
    top = min(nodes.agg(F.max(norm)).first()[0] or 1.0, 1.7e308)
    lengths = {r["d"]: r["count"] for r in nodes.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1000).collect()}
    sample = nodes.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    means = {d: np.mean([_unit(np.array([r["x"]]) / top)[0] for r in sample if len(r["x"]) == d] or [np.zeros(d + 1)], axis=0).astype(np.float32) for d in lengths}

    def pack(batches):
        for batch in batches:
            v, code, xs = [], [], batch.column(1).to_pylist()
            for x in xs:
                u = _unit(np.array([x]) / top)
                v.append(u[0].tobytes())
                code.append(int(codes(u, 0, block_of(len(x), lengths.get(len(x), 1)), lengths, means)[0]))
            sizes = pa.array([len(x) for x in xs], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(1), pa.array(v, pa.binary()), pa.array(code, pa.int64())], names=["id", "d", "x", "v", "code"])

    packed = durable(nodes.mapInArrow(pack, "id long, d int, x array<double>, v binary, code long"))
    most = F.greatest(F.lit(LEAF), F.floor(F.lit(BLOCK_BYTES) / (4 * (F.col("d") + 1))))
    parts = packed.groupBy("d", "code").agg(F.count(F.lit(1)).alias("n")).select("d", "code", F.ceil(F.col("n") / (2 * most)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts"))
    placed = durable(packed.join(parts, ["d", "code"]).select(F.xxhash64("d", "code", part).alias("task"), "id", "d", "x", "v"))
    placed.cuts = (lengths, means)
    copies = rows.join(nodes, "x").select("id", "vec_id")
    return placed, copies


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of norm one at most with a further component that makes it one."""
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]
    return np.concatenate([x, rest], axis=1).astype(np.float32)


def block_of(d: int, count: int) -> int:
    """Nodes of a task, of ``count`` vectors of ``d`` components: as many as ``BLOCK_BYTES`` hold, fewer if there would not be ``TASKS`` tasks."""
    return max(LEAF, min(BLOCK_BYTES // (4 * (d + 1)), math.ceil(count / TASKS)))


def codes(v: np.ndarray, tree: int, block: int, lengths: dict[int, int], means: dict[int, np.ndarray], seed: int = 5) -> np.ndarray:
    """On which sides of a tree's hyperplanes vectors of one length lie; blocks of about ``block``."""
    d = v.shape[1] - 1
    bits = max(0, math.ceil(math.log2(max(1, lengths.get(d, 1)) / block)))
    planes = np.random.default_rng([seed, tree, d]).normal(size=(d + 1, bits)).astype(np.float32)
    return (((v - means[d]) @ planes > 0).astype(np.int64) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(v), dtype=np.int64)


def start(nodes: DataFrame) -> DataFrame:
    """The graph of nearest neighbours within blocks of all trees."""
    lengths, means = nodes.cuts

    def sides(batches):
        for batch in batches:
            packed, d = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for own in np.unique(d):
                rows = np.flatnonzero(d == own)
                v = _matrix([packed[i] for i in rows])
                few = batch.take(pa.array(rows))
                for tree in range(TREES):
                    leaf = codes(v, tree + 1, LEAF, lengths, means) * TREES + tree
                    yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), few.column(2), few.column(3), pa.array(leaf)], names=["task", "id", "v", "d", "leaf"])

    placed = nodes.select("task", "id", "v", "d").mapInArrow(sides, "task long, id long, v binary, d int, leaf long")
    parts = placed.groupBy("d", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).cast("int").alias("parts"))
    dealt = placed.join(parts, ["d", "leaf"]).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "id", "leaf"), F.col("parts")))

    def near(t: pa.Table) -> pa.Table:
        ids, v = t.column("id").to_numpy(), _matrix(t.column("v").to_pylist())
        sim = v @ v.T
        np.fill_diagonal(sim, -np.inf)
        k = min(NEIGHBOURS, len(ids) - 1)
        c = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(ids), 0), dtype=np.int64)
        r = np.repeat(np.arange(len(ids)), k)
        return _found(ids, t.column("task").to_numpy(), r, c.ravel(), np.take_along_axis(sim, c, 1).ravel())

    empty = nodes.select("task", "id", "v", F.expr("cast(array() as array<long>)").alias("near"), F.expr("cast(array() as array<float>)").alias("sim"), F.expr("cast(array() as array<boolean>)").alias("new"))
    return merged(empty, dealt.groupBy("d", "leaf", "part").applyInArrow(near, _FOUND))


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """The known lists with what was found for them, block by block; ``new`` marks entries that were not known."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        order = np.argsort(ids)
        (near, n), (sim, _) = (_lists(left.column(c)) for c in ("near", "sim"))
        (more, _), (msim, _), (of, _), (m, _) = (_lists(right.column(c)) for c in ("near", "sim", "ids", "counts"))
        at = order[np.searchsorted(ids[order], of)] if len(of) else np.empty(0, dtype=np.int64)
        u, v, s, old = np.repeat(np.arange(len(ids)), n), near, sim.astype(np.float32), np.ones(len(near), dtype=bool)
        u, v, s, old = _best(u, v, s, old, NEIGHBOURS)
        ends = np.cumsum(m, dtype=np.int64)
        a = done = 0
        while a < len(at):  # whole lists of some PAIRS entries at a time
            b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            end = int(ends[b - 1])
            u, v, s = np.concatenate([u, np.repeat(at[a:b], m[a:b])]), np.concatenate([v, more[done:end]]), np.concatenate([s, msim[done:end].astype(np.float32)])
            u, v, s, old = _best(u, v, s, np.concatenate([old, np.zeros(end - done, dtype=bool)]), NEIGHBOURS)
            a, done = b, end
        counts = np.bincount(u, minlength=len(ids))
        return pa.table({"task": left.column("task"), "id": left.column("id"), "v": left.column("v"), "near": _as_lists(counts, v.astype(np.int64)), "sim": _as_lists(counts, s), "new": _as_lists(counts, ~old)})

    return durable(_together(known, found, "task").applyInArrow(best, _GRAPH))


def descend(graph: DataFrame) -> DataFrame:
    """One round: neighbours of neighbours are compared, lists take what is nearer."""
    edges = graph.select("id", F.explode(F.arrays_zip("near", "sim", "new")).alias("e")).select("id", F.col("e.near").alias("to"), F.col("e.sim").alias("sim"), F.col("e.new").alias("new"))
    back = Window.partitionBy("to").orderBy(F.desc("sim"), "id")
    reverse = edges.withColumn("rank", F.row_number().over(back)).filter(F.col("rank") <= REVERSE)
    reverse = reverse.groupBy(F.col("to").alias("id")).agg(F.collect_list("id").alias("from"), F.collect_list("new").alias("fresh"))
    around = graph.select("task", "id", "near", "new").join(reverse, "id", "left")
    around = durable(around.select("task", F.concat("near", F.coalesce("from", F.expr("array()"))).alias("members"), F.concat("new", F.coalesce("fresh", F.expr("array()"))).alias("fresh")).filter(F.exists("fresh", lambda x: x)))
    last = F.when(F.size("sim") >= NEIGHBOURS, F.element_at("sim", -1)).otherwise(F.lit(-2.0)).cast("float")
    wanted = around.select(F.col("task").alias("hubs"), F.explode("members").alias("id")).distinct()
    held = wanted.join(graph.select("id", F.col("task").alias("home"), "v", last.alias("least")), "id").withColumnRenamed("hubs", "task")

    def compare(t: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, home, v, least = vectors.column("id").to_numpy(), vectors.column("home").to_numpy(), _matrix(vectors.column("v").to_pylist()), vectors.column("least").to_numpy()
        order = np.argsort(ids)
        (member, counts), (fresh, _) = _lists(t.column("members")), _lists(t.column("fresh"))
        place, fresh, ends = order[np.searchsorted(ids[order], member)], fresh.astype(bool), np.cumsum(counts)
        kept = [np.empty(0, dtype=d) for d in (np.int64, np.int64, np.float32)]
        held, size = [], 0

        def keep(kept):
            u, w, s = (np.concatenate([a, *b]) for a, b in zip(kept, zip(*held, strict=True), strict=True))
            return list(_best(u, w, s, np.zeros(len(u), dtype=bool), NEIGHBOURS)[:3])

        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            p, new = place[a:b], fresh[a:b]
            order = np.lexsort((~new, p))
            p, new = p[order], new[order]
            one = np.concatenate([[True], p[1:] != p[:-1]])
            p, new = p[one], new[one]
            x = v[p]
            sim = x @ x.T
            np.fill_diagonal(sim, -3)
            i, j = np.nonzero((sim > least[p][:, None]) & (new[:, None] | new[None, :]))
            held.append((p[i], p[j], sim[i, j]))
            size += len(i)
            if size > PAIRS:
                kept, held[:], size = keep(kept), [], 0
        if held:
            kept = keep(kept)
        return _found(ids, home, *kept)

    found = _together(around, held, "task").applyInArrow(compare, _FOUND)
    better = merged(graph.withColumn("new", F.transform("new", lambda x: F.lit(False))), found)
    discard(around, graph)
    return better


def build(nodes: DataFrame) -> DataFrame:
    """The neighbour graph of all nodes, improved until the lists hardly change."""
    graph, settled = start(nodes), False
    while not settled:
        graph = descend(graph)
        fresh, held = graph.agg(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("new"))).first()
        settled = (fresh or 0) <= SETTLED * (held or 0)
    return graph


def _gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The lists of some rows, one after another."""
    return np.concatenate([flat[starts[r] : ends[r]] for r in rows.tolist()]) if len(rows) else flat[:0]


_STATE = "task long, query long, q binary, beam array<long>, scores array<float>, seen array<long>, want array<long>"


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """The nearest nodes met for each node asked (``id``): ``query``, ``id``, ``score``."""
    width = max(beam, k + 1)
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    entries = [r["id"] for r in nodes.select("id", norm.alias("norm")).orderBy(F.desc("norm"), "id").limit(max(ENTRIES, k + 1)).collect()]
    asked = graph.join(queries.select("id").distinct(), "id", "left_semi")
    parts = asked.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    block = F.xxhash64("task", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")))
    first = F.array_distinct(F.concat("near", F.array(F.col("id")), F.array(*map(F.lit, entries)) if entries else F.expr("array()")))
    none = F.expr("cast(array() as array<long>)"), F.expr("cast(array() as array<float>)")
    state = durable(asked.join(parts, "task").select(block.alias("task"), F.col("id").alias("query"), F.col("v").alias("q"), none[0].alias("beam"), none[1].alias("scores"), none[0].alias("seen"), first.alias("want")))
    lists = graph.select("id", "v", "near")

    def step(t: pa.Table, got: pa.Table) -> pa.Table:
        own_ids, packed = got.column("id").to_numpy(), got.column("v").to_pylist()
        order = np.argsort(own_ids)
        ids, near = own_ids[order], got.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        flat, ends = near.flatten().to_numpy(), np.cumsum(near.value_lengths().to_numpy())
        starts = ends - near.value_lengths().to_numpy()
        lengths = np.array([len(b) for b in packed])
        by_length = {n: (own := np.flatnonzero(lengths == n), _matrix([packed[i] for i in own])) for n in set(lengths.tolist())}
        spot = np.zeros(len(packed), dtype=np.int64)
        for own, _ in by_length.values():
            spot[own] = np.arange(len(own))
        beams, scores, seens, wants = [], [], [], []
        (beam, n), (score, _), (seen, o), (want, m) = (_lists(t.column(c)) for c in ("beam", "scores", "seen", "want"))
        n, o, m = np.cumsum(n), np.cumsum(o), np.cumsum(m)
        want_rows = order[np.searchsorted(ids, want)] if len(want) else want
        for i, q in enumerate(t.column("q").to_pylist()):
            b, s = (x[n[i - 1] if i else 0 : n[i]] for x in (beam, score))
            rows = want_rows[m[i - 1] if i else 0 : m[i]]
            if not len(rows):  # this search is over
                beams.append(b)
                scores.append(s)
                seens.append(seen[:0])
                wants.append(rows)
                continue
            x = np.frombuffer(q, dtype=np.float32).copy()
            x[-1] = 0  # the inner product, not the distance of the nodes
            mine = by_length[len(q)][1]
            tried = np.zeros(len(ids), dtype=bool)
            every, score_, place = b, s, np.full(len(b), -1, dtype=np.int64)
            while len(rows):  # as far as the nodes at hand lead
                tried[rows] = True
                rows = rows[lengths[rows] == len(q)]
                entering = np.setdiff1d(rows, place)
                every, score_, place = np.concatenate([every, own_ids[entering]]), np.concatenate([score_, mine[spot[entering]] @ x]), np.concatenate([place, entering])
                every, one = np.unique(every, return_index=True)
                score_, place = score_[one], place[one]
                best = np.lexsort((every, -score_))[:width]
                every, score_, place = every[best], score_[best], place[best]
                out = _gather(flat, starts, ends, np.intersect1d(place, entering))
                at = np.minimum(np.searchsorted(ids, out), len(ids) - 1)
                rows = np.unique(order[at[ids[at] == out]])
                rows = rows[~tried[rows]]
            out = _gather(flat, starts, ends, place[place >= 0])
            at = np.minimum(np.searchsorted(ids, out), len(ids) - 1)
            beams.append(every)
            scores.append(score_)
            met = np.union1d(seen[o[i - 1] if i else 0 : o[i]], own_ids[tried])
            seens.append(met)
            wants.append(np.setdiff1d(out[ids[at] != out], met))  # what a beam refused once it refuses again
        cols = {"task": t.column("task"), "query": t.column("query"), "q": t.column("q")}
        for name, values, kind in (("beam", beams, np.int64), ("scores", scores, np.float32), ("seen", seens, np.int64), ("want", wants, np.int64)):
            cols[name] = _as_lists(np.array([len(x) for x in values], dtype=np.int64), np.concatenate(values).astype(kind) if values else np.empty(0, dtype=kind))
        return pa.table(cols)

    left = True
    while left:
        # the beams of searches that are over wait with an empty want
        wanted = state.select("task", F.explode("want").alias("id")).distinct().join(lists, "id")
        last, state = state, durable(_together(state, wanted.select("task", "id", "v", "near"), "task").applyInArrow(step, _STATE))
        discard(last)
        left = not state.filter(F.size("want") > 0).isEmpty()

    exact = state.select("task", F.explode(F.concat("beam", F.array("query"))).alias("id")).distinct().join(nodes.select("id", "x"), "id").select("task", "id", "x")

    def score(t: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids)
        xs = vectors.column("x").combine_chunks()
        xs = xs.chunk(0) if isinstance(xs, pa.ChunkedArray) else xs
        flat, n = xs.flatten().to_numpy(), xs.value_lengths().to_numpy()
        at = np.cumsum(n) - n
        out = {"query": [], "id": [], "score": []}
        for q, b in zip(t.column("query").to_pylist(), t.column("beam").to_pylist(), strict=True):
            i = order[np.searchsorted(ids[order], q)]
            rows = order[np.searchsorted(ids[order], b)]
            with np.errstate(over="ignore", invalid="ignore"):
                s = flat[at[rows][:, None] + np.arange(n[i])] @ flat[at[i] : at[i] + n[i]]
            out["query"] += [q] * len(b)
            out["id"] += b
            out["score"] += s.tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return _together(state.select("task", "query", "beam"), exact, "task").applyInArrow(score, "query long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k nearest found of each query: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    nodes, copies = nodes_of(vectors)
    copies = durable(copies)
    graph = build(nodes)
    queries = durable(copies.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("id").alias("id")))
    met = durable(search(graph, nodes, queries, k))
    few = copies.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    best = met.join(few, "id").groupBy("query", "vec_id").agg(F.max("score").alias("score"))

    def ranked(rows: DataFrame, key: str, most: int) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= most)

    best = ranked(best, "query", k + 1).drop("rank")
    wide = queries.select("query_id", F.col("id").alias("query")).join(best, "query").filter(F.col("vec_id") != F.col("query_id"))
    return ranked(wide, "query_id", k).select("query_id", "rank", "vec_id", "score")
