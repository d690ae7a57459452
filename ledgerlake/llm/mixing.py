"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Method.  Each source's rows are dealt by hash into about half as many blocks
as the square root of its rows, so that neither the list of blocks nor a single block
grows in proportion to the data.  A source's target is a number of whole passes
over its blocks and a part of one more pass: a permuted run of blocks, of
the last of which only rows that still fit are taken, the largest first.  That fixes an exact
quota of blocks per source.  The quotas are split over the output shards by a
binary tree: each inner node draws, from the multivariate hypergeometric
distribution, how many of its blocks of each source go left.  A node's draw
depends on its own seed only, so every shard finds its quotas by walking down
from the root, with no data exchanged.  Quotas of neighbouring shards are
consecutive runs of the source's permuted blocks, hence disjoint.  Rows are
shuffled inside their shard.

Scale.  The driver holds one row per source, never one per document.  Documents
are shuffled once by (source, block), whose groups have the size of a square
root, and once by shard; a source with a third of all rows spreads over as many
blocks as it needs.

Cases.  Null text has size 0.  A null source is a source of its own, last in
order.  A source without words gets target 0.  Repeated rows are taken each by
itself.  An empty table gives an empty result.  Extra columns are carried
along unchanged, whatever their names.  A run with the same seed draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import give_back

#: Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
SHARD_WORDS = 4_000_000
#: The table of sources (some 100 bytes a row) is broadcast up to so many rows, else shuffled.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, share: float = 1.0) -> list[float]:
    """Target of each source, in order: by weight, none above ``limit`` times its size, the excess reshared."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    rest, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weigh[i] for i in open_)
        over = [i for i in open_ if rest * weigh[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weigh[i] / total
            break
        for i in over:
            out[i] = limit * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _counts(total: int, shards: int, lo: int, hi: int) -> int:
    """Blocks that the shards from lo to hi hold together, as evenly as whole numbers allow."""
    return total * hi // shards - total * lo // shards


def shard_quotas(quotas: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each source for one shard."""
    start, own, total = np.zeros(len(quotas), dtype=np.int64), np.array(quotas, dtype=np.int64), int(sum(quotas))
    lo, hi, node = 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left = rng.multivariate_hypergeometric(own, _counts(total, shards, lo, mid), method="marginals")
        if shard < mid:
            hi, own, node = mid, left, 2 * node
        else:
            lo, start, own, node = mid, start + left, own - left, 2 * node + 1
    return start, own


def _fill(pool: pd.DataFrame) -> pd.DataFrame:
    """Of one cut block, the rows that fill what is left of the target: largest first, each that still fits."""
    left, cut = float(pool["rest"].iloc[0]), []
    for size, key in sorted(zip(pool["size"].tolist(), pool["mix_hash"].tolist(), strict=True), key=lambda x: (-x[0], x[1])):
        if size <= left:
            left -= size
            cut.append(key)
    return pd.DataFrame({"cut_no": [pool["no"].iloc[0]], "cut_block": [pool["block"].iloc[0]], "cut": [cut]})


def draws(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, share: float = 1.0, shard_words: int = SHARD_WORDS, seed: int = 20) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_draws``.

    ``mix_draws`` is an array of (epoch, shard), one entry for each time that
    the row is drawn.
    """
    spark = docs.sparkSession
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("mix_size"))
    found = sized.groupBy("source").agg(F.sum("mix_size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in found], weights, limit, share)
    table = []
    for i, (r, t) in enumerate(zip(found, wanted, strict=True)):
        whole = floor(t / r["words"] + 1e-12) if r["words"] else 0
        table.append((r["source"], i, r["words"], float(t), max(1, int(r["rows"] ** 0.5) // 2), whole, max(0.0, t - whole * r["words"])))
    sources = spark.createDataFrame(table, "mix_key string, mix_no int, mix_source_size long, mix_target double, blocks long, whole int, part double")
    if len(table) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    placed = (
        sized.join(sources, F.col("source").eqNullSafe(F.col("mix_key")), "left")
        .withColumn("mix_hash", F.xxhash64(F.lit(seed), "doc_id", "mix_size"))
        .withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_hash"), F.col("blocks")))
    )

    # what each block has, and the passes over it: the last one ends where the target is reached
    blocks = placed.groupBy("mix_no", "mix_block").agg(F.sum("mix_size").alias("words"), *[F.first(c).alias(c) for c in ("blocks", "whole", "part")])
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))).withColumn("order", F.xxhash64(F.lit(seed + 2), "mix_no", "epoch", "mix_block"))
    run = Window.partitionBy("mix_no", "epoch").orderBy("order", "mix_block")
    tickets = (
        blocks.withColumn("rank", F.row_number().over(run) - 1)
        .withColumn("before", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("left", F.when(F.col("epoch") == F.col("whole"), F.col("part") - F.col("before")).otherwise(F.col("words").cast("double")))
        .filter((F.col("epoch") < F.col("whole")) | (F.col("left") > 0))
    )
    counted = {r["mix_no"]: r["n"] for r in tickets.groupBy("mix_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [counted.get(i, 0) for i in range(len(table))]
    shards = max(1, min(round(sum(wanted) / shard_words), sum(quotas)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()  # before the large joins
        for batch in batches:
            for shard in batch["id"].tolist():
                start, own = shard_quotas(quotas, shards, shard, seed)
                yield pd.DataFrame({"shard": shard, "no": np.arange(len(own)), "start": start, "n": own})[own > 0]

    tree = spark.range(shards).mapInPandas(walk, "shard long, no int, start long, n long")
    tree = tree.select("shard", "no", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("ticket"))
    # a pass may skip empty hash blocks: tickets are numbered by what is there
    number = Window.partitionBy("mix_no").orderBy("epoch", "rank")
    numbered = tickets.withColumn("at", (F.row_number().over(number) - 1).cast("long"))
    held = numbered.join(tree, (F.col("mix_no") == F.col("no")) & (F.col("at") == F.col("ticket")))
    last = held.filter(F.col("epoch") == F.col("whole")).withColumn("rest", F.col("left")).filter(F.col("left") < F.col("words"))
    pool = placed.groupBy("mix_no", "mix_block", "mix_hash").agg(F.sum("mix_size").alias("size"))
    pool = pool.join(last.select("no", F.col("mix_block").alias("block"), "rest"), (F.col("mix_no") == F.col("no")) & (F.col("mix_block") == F.col("block")))
    cut = pool.select("no", "block", "rest", "mix_hash", "size").groupBy("no", "block").applyInPandas(_fill, "cut_no int, cut_block long, cut array<long>")
    held = held.groupBy(F.col("mix_no").alias("no"), F.col("mix_block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", (F.col("left") < F.col("words")).alias("partly")))).alias("passes"))
    held = held.join(cut, (F.col("no") == F.col("cut_no")) & (F.col("block") == F.col("cut_block")), "left")
    out = placed.join(held, (F.col("mix_no") == F.col("no")) & (F.col("mix_block") == F.col("block")), "left")
    drawn = F.filter("passes", lambda p: ~p["partly"] | F.array_contains(F.coalesce("cut", F.array().cast("array<bigint>")), F.col("mix_hash")))
    drawn = F.transform(drawn, lambda p: F.struct(p["epoch"].alias("epoch"), p["shard"].alias("shard")))
    empty = F.array().cast("array<struct<epoch:int,shard:bigint>>")
    return out.select("row", "mix_size", "mix_source_size", "mix_target", F.coalesce(drawn, empty).alias("mix_draws"), "mix_hash")


def mix(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """The mixed rows of ``docs``, same columns, shard by shard, shuffled inside each shard."""
    drawn = draws(docs, seed=seed, **how).withColumn("mix_draw", F.explode("mix_draws"))
    shuffled = F.xxhash64(F.lit(seed + 3), "mix_draw.epoch", "mix_hash")
    return drawn.repartition("mix_draw.shard").sortWithinPartitions("mix_draw.shard", shuffled).select("row.*")
