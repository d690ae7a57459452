"""Operators that are functions rather than SQL texts: codecs, parsers, folds, models, streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions import parsers
from ledgerlake.functions.codecs import CODECS, decoder, encoder
from ledgerlake.operators import learning, metrics, replay
from ledgerlake.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation as a DataFrame."""
    from ledgerlake.plans.dialect import spark_sql

    return spark_sql("select * from {%s} t" % name)(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def _codec(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"), F.col("text").cast("binary").alias("raw"))
        coded = docs.withColumn("coded", encoder(name)("raw")).withColumn("decoded", decoder(name)("coded"))
        return coded.select("slot", F.octet_length("raw").cast("bigint").alias("original"), (F.col("decoded") == F.col("raw")).alias("lossless"))

    return run


for _name in CODECS:
    query(_name, "select doc_id as slot, nbytes(text) as original, true as lossless from {documents} d")(_codec(_name))


@query("enc_ratio_report")
def codec_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in and out of the fast codecs over all documents."""
    docs = _table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("raw"))
    names = ("enc13_run_length", "enc15_lz77", "enc23_deflate")
    sums = [F.sum(F.octet_length(encoder(n)("raw"))).alias(n) for n in names]
    total = docs.agg(F.sum(F.octet_length("raw")).alias("original"), *sums)
    return total.select(*[F.round(F.col("original") / F.col(n), 6).alias(n) for n in names])


_BLOCKS = "select doc_id as slot, doc_id % 20 + 10 as n from {documents} d"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.plans.dialect import spark_sql

    return spark_sql(_BLOCKS)(spark, sf_dir)


@query("src12_synthetic_blocks", f"select slot, n, 63 + 80 * n + 43 * idiv(n + 3, 4) + 32 * idiv(n + 2, 4) + 44 * idiv(n + 1, 4) + 44 * idiv(n, 4) as size_bytes from ({_BLOCKS}) b")
def synthetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated blocks and their sizes."""

    @F.pandas_udf(T.BinaryType())
    def block(slot: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([parsers.synthetic_block(int(s), int(k)) for s, k in zip(slot, n, strict=True)], dtype=object)

    return _sized(spark, sf_dir).withColumn("raw", block("slot", "n")).select("slot", "n", F.octet_length("raw").cast("bigint").alias("size_bytes"))


@query("gen4_fixed_record_parse", f"select b.slot, i.i, i.i % 4 as program, big(case i.i % 3 when 0 then 1000000000 when 1 then 100000000 else 10000000 end) as amount from ({_BLOCKS}) b join series(0, 30, i) i on i.i < b.n")
def fixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of generated blocks, parsed back."""
    return _sized(spark, sf_dir).mapInPandas(parsers.block_rows, "slot long, i long, program long, amount long")


def _parsed(name: str, schema: str, parse):
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(",")]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(s, *r) for s, n in zip(b["slot"], b["n"], strict=True) for r in parse(parsers.synthetic_block(int(s), int(n)))], columns=columns)

        return _sized(spark, sf_dir).mapInPandas(rows, schema)


_parsed("gen1_split_transactions", "slot long, offset long, size long", parsers.split_transactions)
_parsed("gen2_parse_transactions", "slot long, accounts long, instructions long", lambda b: [parsers.analyse_transaction(b[a : a + n]) for a, n in parsers.split_transactions(b)])
_parsed("gen6_metadata_extraction", "slot long, offset long, size long, kind string", parsers.extract_metadata)
_parsed("prd_byte_heuristics", "slot long, pubkey boolean, program boolean, compressed boolean, blockhash boolean, address boolean, nonce boolean", lambda b: [
    (parsers.likely_pubkey(c), parsers.likely_program(c), parsers.pre_compressed(c), parsers.likely_blockhash(c, None), parsers.likely_address(c), parsers.likely_nonce(c)) for c in (b[:32], b[63:95], b[-32:])])


@query("gen8_base58")
def base58_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document hashes in base 58."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"), _base58(F.unhex(F.sha2("text", 256))).alias("address"))


@F.pandas_udf(T.StringType())
def _base58(s: pd.Series) -> pd.Series:
    return s.map(lambda x: parsers.base58(bytes(x)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(s: pd.Series) -> pd.Series:
    return s.map(lambda x: parsers.feature_vector(x.encode("utf-8") if isinstance(x, str) else bytes(x)))


@query("fea21_feature_vector")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All byte features of a block as one vector, by one Arrow pass."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"), _features("text").alias("features"))


# ordered folds: native in both engines
_CLAMPED = "select node_id, r6({fold}) as reputation from (select node_id, {rows} as xs from {{evidence}} e group by node_id) t"
_EMA = "select op, r6({fold}) as ema from (select op, {rows} as xs from {{latency}} l group by op) t"
_SORTED = ("transform(array_sort(collect_list(struct({o}, {x} as x))), y -> y.x)", "list({x} order by {o})")


def _fold(name: str, text: str, order: str, value: str, spark_fold: str, duck_fold: str) -> None:
    from_spark = text.replace("{fold}", spark_fold).replace("{rows}", _SORTED[0].format(o=order, x=value)).replace("{{", "{").replace("}}", "}")
    from_duck = text.replace("{fold}", duck_fold).replace("{rows}", _SORTED[1].format(o=order, x=value)).replace("{{", "{").replace("}}", "}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ledgerlake.plans.dialect import spark_sql

        return spark_sql(from_spark)(spark, sf_dir)

    query(name, from_duck)(run)


_fold("con5_reputation_fold", _CLAMPED, "ts, seq", "impact", "aggregate(xs, 1D, (s, x) -> least(2D, greatest(0D, s + x)))", "list_reduce(xs, lambda s, x: least(2e0, greatest(0e0, s + x)), 1e0)")
_fold("con6_gateway_health", _CLAMPED, "ts, seq", "impact", "aggregate(xs, 1D, (s, x) -> case when x > 0 then least(1D, 99e-2 * s + 1e-2) else 95e-2 * s end)", "list_reduce(xs, lambda s, x: case when x > 0 then least(1e0, 99e-2 * s + 1e-2) else 95e-2 * s end, 1e0)")
_fold("fea22_importance_ema", _EMA, "seq", "value_us", "aggregate(xs, 0D, (s, x) -> 99e-2 * s + 1e-2 * x)", "list_reduce(xs, lambda s, x: 99e-2 * s + 1e-2 * x, 0e0)")
_fold("ml4_accuracy_ema", _EMA, "seq", "value_us", "aggregate(xs, 0D, (s, x) -> 9e-1 * s + 1e-1 * least(1e0, x / 1e5))", "list_reduce(xs, lambda s, x: 9e-1 * s + 1e-1 * least(1e0, x / 1e5), 0e0)")

_XOR = """select slot, node_id, big(rank) as rank from (select slot, node_id, row_number() over (partition by slot order by distance, node_id) as rank from
    (select a.slot, n.node_id, {xor} as distance from (select distinct slot from {{access_log}} l) a cross join {{nodes}} n) d) t where rank <= 20"""
_H = ("hex_int(substr(sha(text_of(a.slot)), 1, 13))", "hex_int(substr(sha(text_of(n.node_id)), 1, 13))")
_BUCKET = "select node_id, bucket, in_bucket from (select node_id, bucket, big(row_number() over (partition by bucket order by node_id)) as in_bucket from (select node_id, big(length(h) - length(ltrim(h, '0'))) as bucket from (select node_id, sha(text_of(node_id)) as h from {nodes} n) x) y) z where in_bucket <= 20"


@query("top2_xor_closest", _XOR.replace("{xor}", f"xor({_H[0]}, {_H[1]})").replace("{{", "{").replace("}}", "}"))
def xor_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nodes nearest to each slot by the XOR of their hashes."""
    from ledgerlake.plans.dialect import spark_sql

    return spark_sql(_XOR.replace("{xor}", f"({_H[0]} ^ {_H[1]})").replace("{{", "{").replace("}}", "}"))(spark, sf_dir)


@query("top3_routing_buckets", _BUCKET)
def routing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the number of leading zeros of their hash, 20 at most in each."""
    from ledgerlake.plans.dialect import spark_sql

    return spark_sql(_BUCKET.replace("ltrim(h, '0')", "ltrim('0', h)"))(spark, sf_dir)


# the hash of a block is written as its XOR with the one before it from the same program; XORs of all up to it restore it
_DELTAS = "select slot, program, h, h ^ coalesce(lag(h) over (partition by program order by slot), 0) as delta from (select slot, program, hex_int(substr(block_hash, 1, 13)) as h from {blocks} b) t"


@query("sup7_delta_reconstruct", "select slot, hex_int(substr(block_hash, 1, 13)) as restored, true as lossless from {blocks} b")
def restored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes from their deltas."""
    from ledgerlake.plans.dialect import spark_sql

    deltas = spark_sql(_DELTAS)(spark, sf_dir)
    so_far = Window.partitionBy("program").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    restored = deltas.withColumn("restored", F.expr("bit_xor(delta)").over(so_far))
    return restored.select("slot", "restored", (F.col("restored") == F.col("h")).alias("lossless"))


@query("src9_json_cache", "select doc_id as slot, source, lang from {documents} d")
def json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through JSON and back."""
    docs = _table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("slot"), "source", "lang")).alias("body"))
    return docs.select(F.from_json("body", "slot long, source string, lang string").alias("r")).select("r.*")


def _replayed(name: str, source: str, key: str, order: list[str], step, schema: str) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return replay.replay(relation(spark, sf_dir, source), key, order, step, schema)


_replayed("sta1_tiered_cache", "access_log", "client_id", ["ts_s", "seq"], replay.tiered_cache, "client_id long, hits long, misses long, demoted long, expired long")
_replayed("sta2_sequential_access", "access_log", "client_id", ["ts_s", "seq"], replay.sequential_access, "client_id long, sequential long, accesses long")
_replayed("sta3_block_cache", "access_log", "client_id", ["ts_s", "seq"], replay.oldest_first_cache, "client_id long, hits long, evicted long, held long")
_replayed("sta4_response_cache", "access_log", "client_id", ["ts_s", "seq"], lambda r: replay.oldest_first_cache(r, 50, 300 * 86_400), "client_id long, hits long, evicted long, held long")
_replayed("sta5_clearing_cache", "access_log", "client_id", ["ts_s", "seq"], replay.clear_when_full, "client_id long, hits long, cleared long")
_replayed("prd19_wallet_limit", "payments", "client_id", ["ts_s", "payment_id"], replay.wallet, "client_id long, accepted long, rejected long, balance long")


@query("prg2_stake_accounts")
def stake_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stake, unbonding and slashing per account."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), "event_type", F.floor("value").alias("amount"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), "event_id")
    return replay.replay(rows, "node_id", ["ts_s", "event_id"], replay.stake_account, "node_id long, stake long, pending long, slashed long")


@query("met24_stake_summary")
def stake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL's row; where a bigint cannot hold the total, so that the SQL has no result, the same with a decimal(38,0) as ``total``."""
    from ledgerlake.plans.dialect import spark_sql

    found = relation(spark, sf_dir, "nodes").agg(F.count(F.lit(1)).alias("stakers"), F.sum(F.col("staked_amount").cast("decimal(38,0)")).alias("total"))
    total = found.first()["total"]
    if total is None or -(2**63) <= total < 2**63:
        return spark_sql(metrics.SQL["met24_stake_summary"])(spark, sf_dir)
    return found.select("stakers", "total", F.expr("total div stakers").alias("average"))


@query("ml5_boosted_trees")
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted ratio class of each block."""
    rows = learning.block_features(_table(spark, sf_dir, "documents"))
    return learning.boosted_trees(rows).transform(rows).select("slot", F.round("prediction", 6).alias("prediction"), F.least(F.lit(5), F.greatest(F.lit(0), F.round("prediction").cast("int"))).alias("class"))


@query("ml7_feature_importance")
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each input in the splits' gain."""
    model = learning.boosted_trees(learning.block_features(_table(spark, sf_dir, "documents")))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(learning.INPUTS, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


@query("ml1_perceptron")
def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each block by a small network."""
    rows = learning.block_features(_table(spark, sf_dir, "documents"))
    return learning.perceptron(rows).transform(rows).select("slot", F.col("prediction").cast("int").alias("class"))


def _streamed(name: str, stream, mode: str, oracle: str | None = None) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.drained(stream(windows.events(spark, sf_dir)), name, mode)


_streamed("eco5_streamed_settlement", windows.settlement, "complete", "select idiv(epoch_s(ts), 86400) * 86400 as start_s, event_type, count(*) as n, big(sum(floor(value))) as total from {events} e group by 1, 2")
_streamed("eco3_streamed_load", windows.sliding_load, "complete", "select start_s, count(*) as n from (select idiv(epoch_s(ts), 1800) * 1800 as start_s from {events} e union all select idiv(epoch_s(ts), 1800) * 1800 - 1800 from {events} e) t group by start_s")
_streamed("pat5_streamed_patterns", windows.patterns, "complete", "select event_type, count(*) as frequency, min(event_id) as first_seen, max(event_id) as last_seen from {events} e group by event_type")
_streamed("con5_streamed_reputation", windows.reputation, "update")
