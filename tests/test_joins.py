"""Skew-proof joins and group statistics."""

import pytest
from pyspark.sql import functions as F

from fieldcal.operators import joins


@pytest.fixture
def skewed(spark):
    """20,000 rows, half of them copies of one key, some keys null."""
    return spark.range(20000).select(
        F.when(F.col("id") < 10000, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3000).cast("int").alias("k"),
        (F.col("id") % 11).cast("double").alias("v"),
    )


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_shuffled_join_equals_broadcast_join(spark, skewed, monkeypatch, how):
    unique = skewed.groupBy("k").agg(F.sum("v").alias("total")).filter("k is null or k % 2 = 1")
    broadcast = rows(joins.join_unique(skewed, unique, ["k"], how))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARES", 10)
    split = joins.join_unique(skewed, unique, ["k"], how)
    assert "Union" in split._jdf.queryExecution().executedPlan().toString()
    assert rows(split) == broadcast


def test_hot_keys_do_not_shuffle(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    stats = joins.with_group_stats(skewed, ["k"], mean=F.avg("v"))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


@pytest.mark.parametrize("limit", [0, 10**9])
def test_group_stats_equal_window(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    got = joins.with_group_stats(skewed, ["k"], mean=F.avg("v"), n=F.count("*"))
    want = joins.with_group_stats(skewed, ["k"], bounded=True, mean=F.avg("v"), n=F.count("*"))
    assert rows(got) == rows(want)


def test_leave_one_out_of_a_single_row_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 5.0)], "k int, v double")
    out = {(r.k, r.v): (r.a, r.m) for r in joins.leave_one_out(df, ["k"], {"a": "v"}, {"m": "v"}).collect()}
    assert out == {(1, 2.0): (None, None), (2, 3.0): (-2.0, 5.0), (2, 5.0): (2.0, 3.0)}


def test_expand_folds_is_no_join(spark):
    df = spark.createDataFrame([(y, float(y)) for y in (1, 2, 3, 3)], "year int, v double")
    out = joins.expand_folds(df)
    assert sorted((r.fold, r.year) for r in out.collect()) == [(1, 2), (1, 3), (1, 3), (2, 1), (2, 3), (2, 3), (3, 1), (3, 2)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_lead_time_rules(spark):
    obs = spark.sql("select 0.0D long, 50.0D lat, date'2001-01-02' date, 1.0D obs")
    fc = spark.sql("select 0.0D long, 50.0D lat, date'2000-12-30' start_date, date'2001-01-02' date, 2.0D fcst")
    assert joins.build_hindcast(obs, fc).first().lead_time == 3
    assert joins.build_hindcast(obs, fc, "yday").first().lead_time == 2 - 365
