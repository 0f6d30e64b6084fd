"""Reports and assembly on small tables by hand and with pandas; empty tables and nulls."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import assembly, reports

DAY = dt.date(2024, 1, 1)
RETURNS = "date date, portfolio double, benchmark double, active double, turnover double, rebalanced boolean"


def _days(n):
    g = np.random.default_rng(5)
    p, b = g.normal(0, 0.01, n), g.normal(0, 0.01, n)
    return pd.DataFrame({"date": [DAY + dt.timedelta(days=i) for i in range(n)], "portfolio": p, "benchmark": b, "active": p - b, "turnover": g.random(n), "rebalanced": g.random(n) > 0.8})


def test_periods_against_pandas(spark):
    pdf = _days(70)
    got = reports.performance_periods(spark.createDataFrame(pdf)).toPandas().set_index(["period_type", "period"])
    assert len(got) == 1 + 1 + 3  # 70 days: one year, one quarter, three months
    jan = pdf[:31]
    nav = (1 + jan.active).cumprod()
    row = got.loc[("month", "2024-01")]
    assert row.n_days == 31 and row.win_days == (jan.active > 0).sum()
    assert row.max_drawdown == pytest.approx((nav / nav.cummax() - 1).min())
    assert row.p05 == pytest.approx(jan.active.quantile(0.05))
    assert row.active_compound == pytest.approx((1 + jan.portfolio).prod() / (1 + jan.benchmark).prod() - 1)


def test_distribution_and_stability_against_pandas(spark):
    pdf = _days(90)
    frame = spark.createDataFrame(pdf)
    got = reports.distribution(frame, {"all": None, "later": "2024-02-01", "never": "2030-01-01"}).toPandas().set_index("window")
    later = pdf.active[31:]
    assert set(got.index) == {"all", "later"}
    assert got.loc["later", "skew"] == pytest.approx(later.skew()) and got.loc["later", "kurt"] == pytest.approx(later.kurt())
    roll = reports.rolling_stability(frame).toPandas().sort_values("date").reset_index(drop=True)
    assert np.allclose(roll.mean_60d, pdf.active.rolling(60, min_periods=30).mean(), equal_nan=True)
    assert np.allclose(roll.win_rate_20d, pdf.active.rolling(20, min_periods=10).apply(lambda s: (s > 0).mean()), equal_nan=True)


def test_stability_with_missing_days_against_pandas(spark):
    pdf = _days(60)
    pdf.loc[::3, "active"] = np.nan
    rows = [(d, None if np.isnan(a) else float(a)) for d, a in zip(pdf.date, pdf.active)]
    roll = reports.rolling_stability(spark.createDataFrame(rows, "date date, active double"), (20,)).toPandas().sort_values("date").reset_index(drop=True)
    r = pdf.active.rolling(20, min_periods=10)
    assert np.allclose(roll.win_rate_20d, r.apply(lambda s: (s > 0).mean()), equal_nan=True)
    assert np.allclose(roll.mean_20d, r.mean(), equal_nan=True) and np.allclose(roll.sum_20d, r.sum(), equal_nan=True)


def test_deciles_are_pandas_qcut_of_ranks(spark):
    g = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": [DAY] * 137, "code": range(137), "f": g.integers(0, 40, 137) / 4, "label": g.normal(0, 1, 137)})
    got = reports.decile_returns(spark.createDataFrame(pdf), ["f"]).toPandas().set_index("group")
    groups = pd.qcut(pdf.f.rank(method="first"), 10, labels=False) + 1
    want = pdf.groupby(groups).label.mean()
    assert list(got.index.sort_values()) == list(range(1, 11))
    assert np.allclose(got["mean"].sort_index(), want) and np.allclose(got.excess.sort_index(), want - pdf.label.mean())


def test_daily_stats_against_pandas(spark):
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": [DAY] * 60 + [DAY + dt.timedelta(days=1)] * 10, "f": g.normal(0, 1, 70), "flat": 1.0, "label": g.normal(0, 1, 70)})
    got = reports.daily_factor_stats(spark.createDataFrame(pdf), ["f", "flat"]).toPandas().set_index("factor")
    one = pdf[:60]
    bins = pd.qcut(one.f, 5, labels=False)
    assert len(got) == 2  # the second date has too few rows
    assert got.loc["f", "rank_ic"] == pytest.approx(one.f.rank().corr(one.label.rank()))
    assert got.loc["f", "long_short"] == pytest.approx(one.label[bins == 4].mean() - one.label[bins == 0].mean())
    assert pd.isna(got.loc["flat", "long_short"]) and pd.isna(got.loc["flat", "ic"])
    stats = reports.period_stats(reports.daily_factor_stats(spark.createDataFrame(pdf), ["f"])).toPandas()
    assert sorted(stats.period) == ["2024", "2024-01", "2024_YTD", "full"]


def test_analyst_windows_by_hand(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    keys = spark.createDataFrame([(1, d(400), 10.0), (2, d(400), 10.0)], "code long, date date, close double")
    # seen a day after: 400 - 180 is still recent, the day before belongs to the earlier window, 400 - 360 too
    rows = [(1, d(219), "a", 1.0, 20.0, 3.0), (1, d(218), "b", 0.0, 99.0, 1.0), (1, d(39), "b", 0.0, 99.0, 2.0), (1, d(38), "c", 0.0, 99.0, 50.0), (1, d(400), "z", 9.0, 9.0, 9.0), (1, None, "z", 9.0, 9.0, 9.0)]
    r = spark.createDataFrame(rows, "code long, report_date date, org string, rating double, target double, eps double")
    a, b = assembly.analyst_features(keys, r).orderBy("code").collect()
    assert (a.report_count_90, a.org_count_180, a.rating_180, a.target_upside_180, a.forward_eps_180) == (0, 1, 1.0, 1.0, 3.0)
    assert a.eps_revision_180 == pytest.approx(3 / 1.5 - 1)
    assert b.report_count_90 is None and b.org_count_180 is None and b.rating_180 is None


def test_statements_are_available_when_the_last_is(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    a = spark.createDataFrame([(1, d(0), d(30), 5.0), (1, d(0), d(20), 4.0), (2, d(0), None, 1.0)], "code long, end_date date, available date, x double")
    b = spark.createDataFrame([(1, d(0), d(25), 7.0), (3, d(0), d(9), 8.0)], "code long, end_date date, available date, y double")
    got = {r.code: (r.available, r.x, r.y) for r in assembly.merge_statements({"a": a, "b": b}).collect()}
    assert got == {1: (d(25), 4.0, 7.0), 3: (d(9), None, 8.0)}


def test_weights_and_groups(spark):
    p = spark.createDataFrame([(i, DAY, float(i - 2), "g" if i else None) for i in range(30)], "code long, date date, w double, grp string")
    got = assembly.clip_weights(p, "w").toPandas().sort_values("code").w.to_numpy()
    x = pd.Series(np.arange(-2.0, 28.0)).where(lambda s: s > 0)
    assert np.allclose(got, x.clip(x.quantile(0.01), x.quantile(0.99)), equal_nan=True)
    assert {r.grp for r in assembly.pool_rare(p, "grp", 5).collect()} == {"g", "other"}
    sizes = spark.createDataFrame([(4.0,), (-1.0,), (None,)], "v double").select(assembly.size_weights(F.col("v")).alias("w"))
    assert [r.w for r in sizes.collect()] == [2.0, 1.0, 1.0]


def test_statuses(spark):
    rows = [(-1, -1, "B"), (1, 1, "B"), (1, -1, "B"), (None, 1, "B"), (1, 1, "d")]
    f = spark.createDataFrame(rows, "v int, t int, q string")
    got = [tuple(r) for r in f.select(assembly.direction_status(F.col("v"), F.col("q")), assembly.appetite_status(F.col("v"), F.col("t"), F.col("q"))).collect()]
    assert got == [("strong", "strong"), ("weak", "weak"), ("weak", "mixed"), ("insufficient", "insufficient"), ("insufficient", "insufficient")]
    g = spark.createDataFrame([(True, True, True, True), (True, True, False, True), (True, False, False, True), (False, False, False, True)], "n boolean, p boolean, x boolean, v boolean")
    assert [r[0] for r in g.select(assembly.quality_grade(*map(F.col, "npxv"))).collect()] == ["C", "A", "B", "D"]


def test_external_signals_check_their_rows(spark):
    f = spark.createDataFrame([("2024-01-02", 1, "x"), ("2024-01-03", 2, "1.5")], "date string, code long, s string")
    got = {r.code: r.value for r in assembly.external_signals(f, ["s"], "own", "v1").collect()}
    assert got == {1: None, 2: 1.5}
    with pytest.raises(ValueError, match="missing"):
        assembly.external_signals(f, ["none"], "own", "v1")
    with pytest.raises(Exception, match="unreadable"):
        assembly.external_signals(f.withColumn("date", F.lit("soon")), ["s"], "own", "v1").collect()


def test_empty_tables(spark):
    r = spark.createDataFrame([], RETURNS)
    assert reports.performance_periods(r).count() == reports.distribution(r, {"all": None}).count() == reports.rolling_stability(r).count() == 0
    p = spark.createDataFrame([], "date date, code long, industry long, f double, label double")
    assert reports.decile_returns(p, ["f"]).count() == reports.daily_factor_stats(p, ["f"]).count() == reports.industry_rank_ic(p, ["f"], 2024).count() == 0
    assert reports.latest_industry_exposure(p, "f", "label").count() == reports.code_exposure(p, "f", 2024).count() == 0
