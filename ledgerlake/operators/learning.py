"""Learning (ML) on pyspark.ml: trees and networks over block features."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.codecs import encoder

INPUTS = ["size_bytes", "transaction_count", "mean_word", "digits"]


def block_features(docs: DataFrame) -> DataFrame:
    """Size, counts and the class of the ratio that deflate achieves on each block, measured by the codec."""
    size, words = F.octet_length("text"), F.size(F.split("text", " "))
    ratio = size / F.octet_length(encoder("enc23_deflate")(F.col("text").cast("binary")))
    rows = docs.select(
        F.col("doc_id").alias("slot"), size.cast("double").alias("size_bytes"), words.cast("double").alias("transaction_count"), (size / words).alias("mean_word"),
        F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("digits"), F.least(F.lit(5.0), F.floor(ratio).cast("double")).alias("label"),
    )
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows.filter(F.col("label").isNotNull()))


def boosted_trees(rows: DataFrame, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 1):
    """Gradient-boosted regression trees (ML5)."""
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(rows)


def perceptron(rows: DataFrame, layers: tuple[int, ...] = (64, 32, 16), seed: int = 1):
    """Multilayer perceptron over six classes (ML1, ML3)."""
    return MultilayerPerceptronClassifier(layers=[len(INPUTS), *layers, 6], maxIter=20, seed=seed).fit(rows)
