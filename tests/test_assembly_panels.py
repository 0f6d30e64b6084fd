"""Range caches and panel assembly against pandas and by hand; pruning in the plan; nulls and empty tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import assembly, panels
from tidewell.sources import ranges

D = dt.date
DAILY = "code int, date date, open double, high double, low double, close double, volume double, amount double"


def _days(n, first=D(2020, 1, 30)):
    return [first + dt.timedelta(days=i) for i in range(n)]


def _daily(spark, rows):
    return spark.createDataFrame([(c, d, p, p, p, p, 10.0, 20.0) for c, d, p in rows], DAILY)


def test_which_caches_meet_a_range():
    names = ["daily.parquet", "daily_20200101_20201231.parquet", "daily_20210101_20210630.parquet", "daily_basic_20200101_20211231.parquet", "daily_20190101_20191231.parquet"]
    got = ranges.overlapping(names, "daily", D(2020, 6, 1), D(2021, 1, 1))
    assert got == ["daily.parquet", "daily_20200101_20201231.parquet", "daily_20210101_20210630.parquet"]
    assert ranges.overlapping(names, "daily_basic", D(2022, 1, 1), D(2022, 1, 2)) == []


def test_scan_merges_prunes_and_fills(spark, tmp_path):
    root = str(tmp_path / "raw")
    days = _days(60)
    a = _daily(spark, [(c, d, 1.0 + c) for c in (1, 2, 3) for d in days[:40]]).withColumnRenamed("volume", "vol")
    b = _daily(spark, [(c, d, 5.0 + c) for c in (1, 2) for d in days[30:]]).withColumn("extra", F.lit(7.0))
    for df, lo, hi in ((a, days[0], days[39]), (b, days[30], days[59])):
        ranges.write_cache(df, root, "daily", lo, hi)
    spark.createDataFrame([(202002,), (202003,), (201901,)], "month int").write.parquet(str(tmp_path / "months"))
    months = spark.read.parquet(str(tmp_path / "months")).where("month > 202000")
    codes = spark.createDataFrame([(1,), (3,), (9,)], "code int")
    got = ranges.scan(spark, root, ["daily"], days[1], days[50], ["close", "volume", "extra", "none"], codes, months)
    rows = {(r.code, r.date): r for r in got.collect()}
    wanted = {(c, d) for c, last in ((1, 50), (3, 39)) for d in days[1 : last + 1] if d >= D(2020, 2, 1)}
    assert set(rows) == wanted and got.count() == len(wanted)
    assert rows[1, days[30]].close == 6.0 and rows[1, days[30]].extra == 7.0  # the later cache
    assert rows[3, days[35]].close == 4.0 and rows[3, days[35]].volume == 10.0 and rows[3, days[35]].extra is None
    assert all(r.none is None for r in rows.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 2 and "PushedFilters: [IsNotNull(date)" in plan
    assert all("high" not in line for line in plan.splitlines() if "ReadSchema" in line)
    assert ranges.scan(spark, root, ["weekly"], days[0], days[1]) is None and ranges.scan(spark, str(tmp_path / "no"), ["daily"], days[0], days[1]) is None


def test_later_part_wins_and_repeats_are_one_row(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 1, 6.0), (2, 1, 1.0), (None, 1, 1.0)], "code int, date int, v double")
    b = spark.createDataFrame([(2, 1, None, 3.0)], "code int, date int, v double, vol double")
    got = sorted(((r.code, r.v, r.volume) for r in ranges.latest([a, b], ["code", "date"]).collect()), key=str)
    assert got == [(1, 6.0, None), (2, None, 3.0), (None, 1.0, None)]
    with pytest.raises(ValueError):
        ranges.latest([], ["code"])


def _index(spark, members_only=True, rows=None, weights=None):
    days = _days(5)
    prices = rows if rows is not None else [(1, d, 10.0 + i) for i, d in enumerate(days)] + [(2, d, 20.0 + 2 * i) for i, d in enumerate(days) if i != 2] + [(3, d, 1.0) for d in days]
    factors = spark.createDataFrame([(c, d, 2.0) for c in (1, 2) for d in days], "code int, date date, adj_factor double")
    w = weights if weights is not None else [(1, days[0], 1.0), (2, days[0], 3.0), (1, days[3], 1.0), (2, days[4], 4.0)]
    weights_ = spark.createDataFrame(w, "code int, date date, weight double")
    st = spark.createDataFrame([(1, days[1], 7.0)], "code int, available date, eps double")
    return panels.index_panel(_daily(spark, prices), factors, None, None, None, weights_, st, members_only), days


def test_index_panel_keeps_returns_over_membership_gaps(spark):
    got, days = _index(spark, members_only=False)
    rows = {(r.code, r.date): r for r in got.collect()}
    assert {c for c, _ in rows} == {1, 2}  # 3 was never in the index
    assert rows[2, days[3]].index_weight == 0.0 and not rows[2, days[3]].member  # the snapshot of that day lacks it
    assert rows[2, days[4]].member and rows[2, days[4]].returns_1d == pytest.approx(28 / 26 - 1)
    assert rows[2, days[3]].returns_1d is None and rows[2, days[1]].fwd_1d_return is None  # day 2 is missing
    assert rows[1, days[1]].benchmark_return == pytest.approx((1 * 0.1 + 3 * 0.1) / 4)
    assert rows[1, days[0]].benchmark_return is None
    assert rows[1, days[0]].eps is None and rows[1, days[1]].eps == 7.0 and rows[1, days[0]].industry == "unknown"
    members, _ = _index(spark)
    assert {(r.code, r.date) for r in members.collect()} == {k for k, r in rows.items() if r.member}


def test_index_panel_of_nothing(spark):
    got, _ = _index(spark, rows=[], weights=[])
    assert got.count() == 0 and "benchmark_return" in got.columns


def test_base_table_carries_a_codes_own_weight(spark):
    days = _days(4)
    daily = _daily(spark, [(c, d, 3.0) for c in (1, 2) for d in days])
    factors = spark.createDataFrame([(1, days[0], 2.0)], "code int, date date, adj_factor double")
    company = spark.createDataFrame([(1, "x"), (1, "x")], "code int, industry string")
    w = spark.createDataFrame([(1, days[1], 5.0), (2, days[2], 6.0)], "code int, date date, weight double")
    got = {(r.code, r.date): r for r in panels.base_table(daily, spark.createDataFrame([], "code int, date date, pe double"), factors, company, w).collect()}
    assert len(got) == 8 and [got[1, d].index_weight for d in days] == [0, 5, 5, 5] and [got[2, d].index_weight for d in days] == [0, 0, 6, 6]
    assert got[1, days[0]].close_adj == 6.0 and got[1, days[1]].close_adj is None and got[2, days[0]].industry is None


def test_flows_against_pandas(spark):
    g = np.random.default_rng(1)
    n = 30
    pdf = pd.DataFrame({"code": 1, "date": _days(n), **{c: g.random(n) for c in panels.FLOWS}})
    pdf.loc[g.random(n) < 0.2, "buy_lg_amount"] = np.nan
    pdf.loc[g.random(n) < 0.5, "net_mf_amount"] = np.nan
    frame = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "code int, date date, " + ", ".join(f"{c} double" for c in panels.FLOWS))
    got = panels.flow_features(frame).toPandas().sort_values("date").reset_index(drop=True)
    extra = pdf.buy_elg_amount - pdf.sell_elg_amount
    main = pdf.buy_lg_amount - pdf.sell_lg_amount + extra
    assert np.allclose(got.main_flow_20, main.rolling(20, min_periods=10).sum(), equal_nan=True)
    assert np.allclose(got.flow_days_10, (main > 0).astype(float).rolling(10, min_periods=5).sum(), equal_nan=True)
    assert np.allclose(got.con_days_10, (extra > 0).astype(float).rolling(10, min_periods=5).sum(), equal_nan=True)
    assert np.allclose(got.net_flow, pdf.net_mf_amount.fillna(main), equal_nan=True)
    none = panels.flow_features(frame.select("code", "date")).toPandas()
    assert none.main_flow.isna().all() and none.flow_days_10.max() == 0


def test_equity_flags(spark):
    days = _days(200)
    daily = _daily(spark, [(c, d, 1.0 + i) for c in (1, 2) for i, d in enumerate(days)])
    factors = daily.select("code", "date", F.lit(1.0).alias("adj_factor"))
    names = spark.createDataFrame([(1, "*St Oak", "mill", days[0])], "code int, name string, industry string, list_date date")
    got = {(r.code, r.date): r for r in panels.equity_panel(daily, factors, names, spark.createDataFrame([("mill", "g")], "industry string, grp string")).collect()}
    assert got[1, days[182]].young and not got[1, days[183]].young and got[1, days[0]].special and got[1, days[0]].grp == "g"
    assert not got[2, days[0]].young and not got[2, days[0]].special and got[2, days[0]].grp == "unknown"
    assert got[2, days[1]].ret == 1.0 and got[2, days[1]].volume_price == 10.0 and got[2, days[0]].ret is None


@pytest.mark.parametrize("values, percent", [([1.0, 3.1], True), ([1.0, 3.0], False), ([2.0, -2.5, 9.0], True), ([2.0, 2.0, 9.0], False), ([None], False), ([], False)])
def test_percent_by_the_median(spark, values, percent):
    assert assembly.in_percent(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().percent is percent


def test_growth_against_pandas(spark):
    g = np.random.default_rng(2)
    cols = ["total_assets", "equity", "eps", "capex_ttm", "inventories", "total_cur_assets", "total_cur_liab", "fin_exp_ttm", "operate_profit_ttm", "revenue_ttm", "roa", "roe_ttm"]
    pdf = pd.DataFrame({"code": 1, "end_date": _days(14), **{c: g.random(14) + (5 if c == "roa" else 0) for c in cols}})
    got = assembly.statement_growth(spark.createDataFrame(pdf)).toPandas().sort_values("end_date").reset_index(drop=True)
    wc = pdf.total_cur_assets - pdf.total_cur_liab
    assert np.allclose(got.earnings_stability, -(pdf.roa / 100).rolling(8, min_periods=8).std(), equal_nan=True)
    assert np.allclose(got.working_capital_growth, wc / wc.shift(4) - 1, equal_nan=True)
    assert np.allclose(got.roe_growth, pdf.roe_ttm.diff(4), equal_nan=True)
    assert set(got.columns) >= {"book_leverage", "inverse_interest_coverage", "operating_margin_ttm"}
