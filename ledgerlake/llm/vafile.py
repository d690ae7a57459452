"""Exact top-k search by vector-approximation files.

Method (Weber, Schek and Blott, 1998).  Vectors become whole numbers.  Each
candidate is also kept as an approximation: one of 256 cells per component on a
grid of its own.  Phase one scans approximations only, query blocks against
candidate blocks, and bounds each inner product from below and above; what can't
be among the k best of its block goes.  Over all blocks, a query's kth largest
lower bound then excludes more.  Phase two reads the exact vectors of what is
left, in the order of the bounds, and stops once no further bound reaches the
kth exact score.

Scale.  Both sides are cut into blocks of a fixed size, so a task's memory is
bounded; the work is queries times candidates, as an exact scan without further
structure must be.  Of equal vectors only the k + 1 smallest ids can be
results; the others go before any block is made, so that a group of copies, however
large, costs no more than a few rows.

Cases.  Vectors that are null, or hold null, NaN or infinity, take no part, nor
do rows without an id.  Rows with the query's id never answer it.  Vectors of
different length are not compared.  Of several vectors of a query's id the least
is asked.  Components and scores beyond a long's range become its ends.  Empty tables give empty results; only the
id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each vector: the low end of its grid, the width of a cell, a byte per component."""
    for batch in batches:
        low, width, cells = [], [], []
        for x in batch.column(1).to_pylist():
            v = np.array(x, dtype=np.float64)
            a, w = v.min(), (v.max() - v.min()) / 256
            low.append(a)
            width.append(w)
            cells.append(np.clip((v - a) / w if w else v * 0, 0, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(low), pa.array(width), pa.array(cells, pa.binary())], names=["vec_id", "dim", "low", "width", "cells"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, grid: float = 256.0) -> DataFrame:
    """The k candidates with the largest integer inner product for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on
    ``vec_id``.  Returns ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * grid).cast("long"))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    base = base.select("vec_id", whole.alias("x"), F.size("embedding").alias("dim"))
    queries = base.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    copies = Window.partitionBy("x").orderBy("vec_id")
    candidates = base.withColumn("copy", F.dense_rank().over(copies)).filter(F.col("copy") <= k + 1).drop("copy").dropDuplicates(["vec_id", "x"])
    n_queries, n_candidates = queries.count(), base.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_candidates // CANDIDATE_BLOCK))

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    every_c = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    left = queries.withColumn("qb", block(q_blocks)).withColumn("cb", every_c)
    cells = candidates.mapInArrow(_approximate, "vec_id long, dim int, low double, width double, cells binary")
    right = cells.withColumn("cb", block(c_blocks)).withColumn("qb", every_q)

    def bound(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "least": [], "most": []}
        if qs.num_rows and cs.num_rows:
            dim = qs.column("dim")[0].as_py()
            q = _matrix(qs.column("x"), dim, np.float64)
            code = np.frombuffer(b"".join(cs.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, dim)
            low, width = cs.column("low").to_numpy(), cs.column("width").to_numpy()
            ids, of = cs.column("vec_id").to_numpy(), qs.column("vec_id").to_numpy()
            middle = q @ (code.astype(np.float64) + 0.5).T * width + q.sum(1)[:, None] * low
            err = np.abs(q).sum(1)[:, None] * (width / 2) + np.abs(middle) * 1e-9 + 1e-6
            least, most = middle - err, middle + err
            least[of[:, None] == ids[None, :]] = most[of[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            kth = np.partition(least, len(ids) - n, axis=1)[:, len(ids) - n]
            r, c = np.nonzero((most >= kth[:, None]) & np.isfinite(most))
            out = {"query_id": of[r], "vec_id": ids[c], "least": least[r, c], "most": most[r, c]}
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("least", pa.float64()), ("most", pa.float64())]))

    keys = ["dim", "qb", "cb"]
    bounded = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(bound, "query_id long, vec_id long, least double, most double")
    best = Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id")
    kth = F.min(F.when(F.col("place") <= k, F.col("least"))).over(Window.partitionBy("query_id"))
    # fewer than k bounds in all: the least of them, which keeps everything
    kept = bounded.withColumn("place", F.row_number().over(best)).withColumn("kth", kth).filter(F.col("most") >= F.col("kth")).drop("place", "kth", "least")

    exact = kept.join(base.dropDuplicates(["vec_id", "x"]).select("vec_id", F.col("x").alias("cx")), "vec_id")
    exact = exact.join(queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx")), "query_id")

    def refine(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for query, own in part.groupby("query_id", sort=False):
            own = own.sort_values(["most", "vec_id"], ascending=[False, True])
            q, found = np.array(own["qx"].iloc[0], dtype=object), []
            for bound_, vec, x in zip(own["most"], own["vec_id"], own["cx"], strict=True):
                if len(found) >= k and bound_ < found[k - 1][0]:
                    break
                found.append((int(q @ np.array(x, dtype=object)), -int(vec)))
                found.sort(reverse=True)
            rows += [(query, i, -v, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, (s, v) in enumerate(found[:k], 1)]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "int64"})

    grouped = exact.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(max(64, n_queries // 64))))
    return grouped.groupBy("qb").applyInPandas(refine, "query_id long, rank int, vec_id long, score long")
