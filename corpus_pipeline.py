"""A corpus pipeline: drop toxic documents, dedup lines, drop near duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from ledgerlake.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labels does not predict toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier one holds; those that lose every line go."""
    done = line_dedup.dedup(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at 0.8 by shingles of five words."""
    kept = ngram_join.join(docs, size=5, num=80, den=100).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    firsts = docs.join(kept, "doc_id", "left_semi").select(F.struct("*").alias("row"), "doc_id", "text").withColumn("copy", F.row_number().over(one))
    return firsts.filter("copy = 1").select("row.*").unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them, some several times, some not at all."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: Trained scores, searches and draws are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
