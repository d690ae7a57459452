"""Every relational query against its oracle in DuckDB, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlake.operators import learning
from ledgerlake.plans import registry
from ledgerlake.sources.relations import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple("null" if v is None or v != v else v for v in r) for r in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ml5_boosted_trees", "ml7_feature_importance"])
def test_boosted_trees_run_all_rounds(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def fit(self, rows):
        raise Seen(self.getMaxIter(), self.getMaxDepth())

    monkeypatch.setattr(learning.GBTRegressor, "fit", fit)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, SF)
    assert seen.value.args == (100, 6)


def test_stake_summary_beyond_a_bigint(spark, tmp_path):
    def summary(n):
        nodes = spark.range(n).selectExpr("4 * id + 3 as s_suppkey", "concat('s', id) as s_name", "cast(1 as int) as s_nationkey", "1e0 as s_acctbal")
        nodes.write.mode("overwrite").parquet(f"{tmp_path}/{n}/supplier.parquet")
        return registry.QUERIES["met24_stake_summary"](spark, f"{tmp_path}/{n}")

    each = 1_500_000 * 10**9
    fits, more = (2**63 - 1) // each, (2**63 - 1) // each + 1
    assert [tuple(r) for r in summary(fits).collect()] == [(fits, fits * each, each)]
    assert dict(summary(fits).dtypes)["total"] == "bigint"
    assert [tuple(r) for r in summary(more).collect()] == [(more, more * each, each)]
    assert [tuple(r) for r in summary(0).collect()] == [(0, None, None)]
