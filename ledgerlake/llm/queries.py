"""The registered queries of this subpackage, each a thin use of its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, html_text, line_dedup, mixing, ngram_join, nn_descent, preference, span_dedup, toxicity, vafile
from ledgerlake.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by the public ranks and decode the ids again."""
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place holds."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a machine trained on the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    drawn = mixing.draws(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_draws")).cast("long").alias("taken"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.85 by shingles of four words."""
    return ngram_join.join(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every 50th vector."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that a repeated span covers."""
    done = span_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_sentences", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and masked completions of all pairs of conversations."""
    return preference.formatted(preference.pairs(preference.conversations(table(spark, sf_dir, "conversations"))))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every 20th vector."""
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_ngram_join": op6_ngram_join,
    "op7_topk": op7_topk,
    "op8_span_dedup": op8_span_dedup,
    "op9_preference": op9_preference,
    "op10_nn_descent": op10_nn_descent,
}
ORACLE_SQL = {
    "op7_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) x from embeddings),
        s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(list_transform(q.x, lambda y: y::double), list_transform(c.x, lambda y: y::double)) as bigint) score
              from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
        select query_id, cast(rank as integer) rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
    """,
}
