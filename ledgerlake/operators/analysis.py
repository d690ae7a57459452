"""All named features of a block in a fixed order of groups (SUP23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import features, repetition
from ledgerlake.plans.dialect import duckdb_sql, spark_sql

#: Query and its columns that are scores; none: the query names its features in rows.
GROUPS = {
    "fea23_named_features": (),
    "fea1_moments": ("mean", "variance", "deviation"),
    "fea5_repetition": ("repetition", "sequential", "alternating"),
    "fea18_entropy": ("entropy", "normalised"),
    "fea24_domain_features": ("instruction_share", "transfer_share"),
    "fea25_multi_scale": (*(f"repetition{s}" for s in repetition.bw.SIZES), "periodicity", "near_duplicates"),
}


def _oracle(group: int, name: str, columns: tuple[str, ...]) -> str:
    text = repetition.ORACLE.get(name) or duckdb_sql(features.SQL[name])
    if not columns:
        return f"select slot, {group} as grp, feature, importance from ({text}) q"
    named = " union all ".join(f"select slot, {group} as grp, '{c}' as feature, {c}::double as importance from q" for c in columns)
    return f"select * from (with q as materialized ({text}) {named}) u"


def feature_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, group (from 1), feature and importance."""

    def group(i: int, name: str, columns: tuple[str, ...]) -> DataFrame:
        got = (repetition.QUERIES.get(name) or spark_sql(features.SQL[name]))(spark, sf_dir)
        if columns:
            got = got.unpivot("slot", [F.col(c).cast("double").alias(c) for c in columns], "feature", "importance")
        return got.select("slot", F.lit(i).alias("grp"), "feature", "importance")

    return reduce(DataFrame.unionByName, (group(i, *g) for i, g in enumerate(GROUPS.items(), 1)))


QUERIES = {"sup23_feature_analysis": feature_analysis}
ORACLE = {"sup23_feature_analysis": " union all ".join(_oracle(i, *g) for i, g in enumerate(GROUPS.items(), 1))}
