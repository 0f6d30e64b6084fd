"""Panel expressions, joins, evaluation, risk, portfolio, monitoring, sources and streams."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import covariance, evaluate, joins, monitor, portfolio, risk
from tidewell.plans import catalog, model, queries
from tidewell.plans.expr import plan
from tidewell.sources import files

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=k) for k in range(n)]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    rows = []
    for c in range(8):
        for k, d in enumerate(days(40)):
            x = round(float(10 + c + rng.normal()), 3)
            rows.append((f"c{c}", d, "AB"[c % 2] if c < 7 else None, x if rng.random() > 0.1 else None, round(float(rng.normal()), 1)))
    return pd.DataFrame(rows, columns=["code", "date", "industry", "x", "y"])


@pytest.fixture(scope="module")
def panel(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "code string, date date, industry string, x double, y double").repartition(3)


def value(panel, pdf, expression):
    out = plan({"v": expression}).spark(panel).toPandas()
    key = pdf[["code", "date"]].merge(out, on=["code", "date"])
    return key["v"].astype(float).to_numpy()


def check(got, want):
    assert np.allclose(got, np.asarray(want, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def rolling(pdf, f, n, mp):
    return pdf.groupby("code")["x"].transform(lambda s: f(s.rolling(n, min_periods=mp)))


@pytest.mark.parametrize(
    "expression,pandas",
    [
        ("ts_mean(x, 5, 3)", lambda r: r.mean()), ("ts_std(x, 5, 3)", lambda r: r.std()), ("ts_median(x, 5, 3)", lambda r: r.median()),
        ("ts_quantile(x, 5, 0.25, 3)", lambda r: r.quantile(0.25)), ("ts_skew(x, 5, 3)", lambda r: r.skew()), ("ts_kurt(x, 5, 4)", lambda r: r.kurt()),
        ("ts_min(x, 5, 3)", lambda r: r.min()), ("ts_sum(x, 5, 3)", lambda r: r.sum()),
        ("ts_decay_linear(x, 5, 3)", lambda r: r.apply(lambda v: np.average(v[~np.isnan(v)], weights=np.arange(1, (~np.isnan(v)).sum() + 1)), raw=True)),
        ("ts_rank(x, 5, 3)", lambda r: r.apply(lambda v: np.nan if np.isnan(v[-1]) else (v[~np.isnan(v)] <= v[-1]).mean(), raw=True)),
    ],
)
def test_rolling(panel, pdf, expression, pandas):
    n, mp = 5, 4 if "kurt" in expression else 3
    check(value(panel, pdf, expression), rolling(pdf, pandas, n, mp))


def test_cross_section(panel, pdf):
    g = pdf.groupby("date")["x"]
    check(value(panel, pdf, "cs_rank(x)"), g.rank(pct=True))
    check(value(panel, pdf, "cs_rank(y)"), pdf.groupby("date")["y"].rank(pct=True))
    check(value(panel, pdf, "cs_zscore(x)"), (pdf.x - g.transform("mean")) / g.transform("std"))
    check(value(panel, pdf, "cs_winsorize(x, 0.1, 0.9)"), pdf.x.clip(g.transform(lambda s: s.quantile(0.1)), g.transform(lambda s: s.quantile(0.9))))
    check(value(panel, pdf, "industry_neutralize(x)"), pdf.x - pdf.groupby(["date", "industry"])["x"].transform("mean"))
    check(value(panel, pdf, "group_rank(x)"), pdf.groupby(["date", "industry"])["x"].rank(pct=True))


def test_goldens(spark):
    rows = [("a", d, None, v, 0.0) for d, v in zip(days(5), [1.0, 2.0, 4.0, 3.0, 5.0])]
    p = spark.createDataFrame(rows, "code string, date date, industry string, x double, y double")
    get = lambda e: [r["v"] for r in plan({"v": e}).spark(p).orderBy("date").collect()]
    assert get("ts_delta(x, 2)")[2] == 3
    assert get("ts_rank(x, 3)")[1:3] == [None, 1.0]
    assert math.isclose(get("ts_decay_linear(x, 3)")[2], 17 / 6) and math.isclose(get("ts_wma(x, 3)")[2], 17 / 6)
    assert math.isclose(get("ts_argmax(x, 3)")[3], 2 / 3) and get("ts_median(x, 3)")[2] == 2 and get("ts_max_drawdown(x, 3)")[3] < 0
    assert get("x / y") == [None] * 5 and get("x / x") == [1.0] * 5
    y = pd.Series([1.0, 2, 4, 3, 5]).ewm(span=3, adjust=False).mean()
    assert np.allclose(get("ewm(x, 3)"), y)


def test_finite_ewm_skips_nulls(spark):
    p = spark.createDataFrame([("a", d, None, v, 0.0) for d, v in zip(days(5), [1.0, 2.0, None, 4.0, 8.0])], "code string, date date, industry string, x double, y double")
    got = plan({"m": "fewm_mean(x, 3, 2, 2)", "s": "fewm_var(x, 3, 2, 2)"}).spark(p).orderBy("date").collect()[-1]
    w = np.array([2**-0.5, 1.0])
    m = np.average([4, 8], weights=w)
    assert math.isclose(got["m"], m) and math.isclose(got["s"], np.average((np.array([4, 8]) - m) ** 2, weights=w))


def test_future_rows_change_nothing(panel, pdf):
    ts = {k: v for k, v in catalog.OPERATORS.items() if k.startswith("ts_")}
    ex = {k: v.replace("close", "x").replace("volume", "y").replace("disc", "y").replace("tax", "y") for k, v in ts.items()}
    cut = DAY + dt.timedelta(days=25)
    a = plan(ex).spark(panel).where(F.col("date") <= F.lit(cut)).toPandas()
    b = plan(ex).spark(panel.where(F.col("date") <= F.lit(cut))).toPandas()
    k = ["code", "date"]
    pd.testing.assert_frame_equal(a.sort_values(k, ignore_index=True), b.sort_values(k, ignore_index=True))


def test_catalogue_sizes():
    assert len(catalog.daily()) == 31 and len(catalog.statement()) == 44 and len(catalog.ATOMS) == 57
    assert len(catalog.mining_universe()) == 374 and len(catalog.PUBLIC) == 65
    assert len(catalog.DESCRIPTORS) == 34 and len(catalog.DESCRIPTORS_V2) == 49
    weights = {}
    for style, w, _, _ in catalog.DESCRIPTORS_V2.values():
        weights[style] = weights.get(style, 0) + w
    assert len(weights) == 15 and all(math.isclose(w, 1) for w in weights.values())


def test_shared_windows_are_planned_once():
    p = plan({"a": "x / ts_mean(x, 5)", "b": "cs_rank(ts_mean(x, 5))", "c": "ts_mean(x, 5) - x"})
    assert [len(s) for s in p.stages] == [1, 1]
    with pytest.raises(ValueError):
        plan({"a": "no_such(x)"}).duckdb("select 1 as x")


# ---------------------------------------------------------------- joins


def test_asof(spark):
    left = spark.createDataFrame([("a", d) for d in days(6)] + [("b", DAY), (None, DAY)], "code string, date date")
    right = spark.createDataFrame([("a", DAY + dt.timedelta(days=2), 1.0), ("a", DAY + dt.timedelta(days=4), None), ("b", DAY + dt.timedelta(days=1), 9.0)], "code string, at date, v double")
    got = {(r["code"], r["date"]): r["v"] for r in joins.asof_join(left, right, "code", "date", "at").collect()}
    d = days(6)
    assert [got["a", x] for x in d] == [None, None, 1.0, 1.0, None, None] and got["b", DAY] is None and (None, DAY) in got
    strict = {(r["code"], r["date"]): r["v"] for r in joins.asof_join(left, right, "code", "date", "at", strict=True).collect()}
    assert [strict["a", x] for x in d[:4]] == [None, None, None, 1.0]


def test_interval_and_snapshot(spark):
    left = spark.createDataFrame([("a", d) for d in days(4)], "code string, date date")
    spans = spark.createDataFrame([("a", DAY, DAY + dt.timedelta(days=2), "x"), ("a", DAY + dt.timedelta(days=2), None, "y")], "code string, since date, until date, cls string")
    got = joins.interval_join(left, spans, "code", "date", "since", "until").orderBy("date").collect()
    assert [r["cls"] for r in got] == ["x", "x", "y", "y"]
    snap = spark.createDataFrame([("a", DAY, 0.5), ("b", DAY + dt.timedelta(days=2), 1.0)], "code string, date date, w double")
    got = joins.snapshot_join(left, snap, "code", "date", "w").orderBy("date").collect()
    assert [r["w"] for r in got] == [0.5, 0.5, 0.0, 0.0]


def test_gap_aware_returns(spark):
    d = days(3)
    p = spark.createDataFrame([("A", d[0], 1.0), ("A", d[2], 2.0), ("B", d[0], 1.0), ("B", d[1], 1.05), ("B", d[2], 1.1025)], "code string, date date, p double")
    got = {(r["code"], r["date"]): (r["returns_1d"], r["fwd_1d_return"]) for r in joins.gap_aware_returns(p, "code", "date", "p").collect()}
    assert got["A", d[0]] == got["A", d[2]] == (None, None)
    assert math.isclose(got["B", d[1]][0], 0.05) and math.isclose(got["B", d[1]][1], 0.05)


def test_quarters(spark):
    ends = [dt.date(2023, m, 28) for m in (3, 6, 9, 12)] + [dt.date(2024, m, 28) for m in (3, 6, 9, 12)]
    cum = [10, 20, 30, 40, 12, 24, 36, 48]
    s = spark.createDataFrame([("a", e, float(v)) for e, v in zip(ends, cum)], "code string, end_date date, rev double")
    r = joins.quarterly_features(s, ["rev"]).orderBy("end_date").collect()
    assert [x["rev_q"] for x in r] == [10] * 4 + [12] * 4 and r[7]["rev_ttm"] == 48 and r[2]["rev_ttm"] is None and math.isclose(r[7]["rev_yoy"], 0.2)


# ---------------------------------------------------------------- evaluation


def test_daily_ic(panel, pdf):
    got = evaluate.daily_ic(panel, ["x"], "y").toPandas().set_index("date")
    for d, g in pdf.dropna(subset=["x", "y"]).groupby("date"):
        if len(g) >= 3:
            assert math.isclose(got.ic[d], g.x.corr(g.y), abs_tol=1e-9)
            assert math.isclose(got.rank_ic[d], g.x.rank().corr(g.y.rank()), abs_tol=1e-9)


def test_selection():
    assert evaluate.greedy_select({"a": 3, "b": 2, "c": 1}, {("a", "b"): 0.9, ("a", "c"): 0.1, ("c", "b"): 0.2}) == ["a", "c"]


# ---------------------------------------------------------------- risk


def test_planted_regression(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in days(3):
        for g, eff in (("A", 0.006), ("B", -0.002), ("C", -0.004)):
            for k in range(30):
                rows.append((f"{g}{k}", d, g, float(rng.normal()), 1.0, eff))
    df = pd.DataFrame(rows, columns=["code", "date", "g", "s", "mv", "eff"])
    z = df.groupby("date")["s"].transform(lambda s: (s - s.mean()) / s.std())
    df["y"] = 0.01 + 0.02 * z + df.eff
    out = risk.factor_regression(spark.createDataFrame(df), "y", ["s"], "g", "mv", constrained=True).toPandas()
    day = out[(out.date == DAY) & (out.kind == "factor")].set_index("name").value
    assert np.allclose([day["country"], day["s"], day["g_A"], day["g_B"], day["g_C"]], [0.01, 0.02, 0.006, -0.002, -0.004], atol=1e-10)
    assert out[out.kind == "residual"].value.abs().max() < 1e-10
    few = risk.factor_regression(spark.createDataFrame(df.head(10)), "y", ["s"], "g", "mv").toPandas()
    assert few.name.tolist() == ["failed_too_few_rows"]


def test_regression_residual(panel, pdf):
    got = risk.regression_residual(panel, "x", ["y"]).toPandas()
    e = pdf[["code", "date"]].merge(got, on=["code", "date"])["resid"].astype(float).to_numpy()
    check(e, value(panel, pdf, "cs_regression_resid(x, y)"))


def test_covariances():
    x = np.random.default_rng(0).standard_normal((300, 4)) @ np.diag([1, 2, 3, 4])
    c, k = risk.ledoit_wolf(x)
    assert np.allclose(c, c.T) and 0 <= k <= 1 and np.allclose(np.diag(c), [1, 4, 9, 16], rtol=0.4)
    m = risk.ewma_newey_west(x)
    assert np.allclose(m, m.T) and np.linalg.eigvalsh(m).min() > -1e-12
    a, b = (risk.eigenfactor_adjust(m, 120, 5, seed=1) for _ in range(2))
    assert np.array_equal(a, b) and np.linalg.eigvalsh(a).min() > -1e-12


def test_rolling_covariance(spark):
    rng = np.random.default_rng(2)
    r = pd.DataFrame([(d, f, float(rng.normal())) for d in days(70) for f in "pq"], columns=["date", "factor", "ret"])
    out = covariance.rolling(spark.createDataFrame(r), ["p", "q"], (60,), "sample").toPandas()
    last = out[out.date == days(70)[-1]].set_index(["factor_i", "factor_j"]).covariance
    want = np.cov(r.pivot(index="date", columns="factor", values="ret").tail(60).to_numpy(), rowvar=False)
    assert np.allclose([last["p", "p"], last["p", "q"], last["q", "q"]], [want[0, 0], want[0, 1], want[1, 1]])
    e = spark.createDataFrame([(days(70)[-1], "p", 2.0), (days(70)[-1], "q", -1.0)], "date date, factor string, x double")
    v = risk.variance_of(e, spark.createDataFrame(out)).first()["variance"]
    assert math.isclose(v, np.array([2, -1]) @ want @ np.array([2, -1]))


def test_style_blend(spark):
    df = spark.createDataFrame([(1.0, None), (None, 1.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(risk.blend({"a": 0.6, "b": 0.4})).collect()]
    assert got[0] == 1.0 and got[1] is None and math.isclose(got[2], 1.4)


# ---------------------------------------------------------------- portfolio


def test_cap():
    w = portfolio.cap_and_normalise(np.array([0.9, 0.05, 0.05]), 0.6)
    assert math.isclose(w.sum(), 1) and w.max() <= 0.6 + 1e-12


def test_backtest_matches_a_daily_loop(spark):
    rng = np.random.default_rng(3)
    d, codes = days(12), ["a", "b", "c"]
    ret = {(c, x): float(rng.normal(0, 0.02)) for c in codes for x in d}
    w = {d[0]: {"a": 0.5, "b": 0.5}, d[5]: {"b": 0.2, "c": 0.8}}
    got = portfolio.backtest(spark.createDataFrame([(c, x, v) for x, m in w.items() for c, v in m.items()], "code string, date date, w double"), spark.createDataFrame([(c, x, r) for (c, x), r in ret.items()], "code string, date date, ret double")).orderBy("date").collect()
    now, want = {}, []
    for x in d:
        turn = 0.0
        if x in w:
            turn = sum(abs(w[x].get(c, 0) - now.get(c, 0)) for c in codes) / 2
            now = dict(w[x])
        g = sum(v * ret[c, x] for c, v in now.items())
        want.append((g, turn))
        now = {c: v * (1 + ret[c, x]) / (1 + g) for c, v in now.items()}
    assert np.allclose([(r["gross"], r["turnover"]) for r in got], want)


def test_optimiser_keeps_limits(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{k}", DAY, float(rng.normal()), 1 / 60, "gh"[k % 2], float(rng.normal())) for k in range(60)]
    out = portfolio.optimise(spark.createDataFrame(rows, "code string, date date, alpha double, b double, g string, s double"), "alpha", "b", "g", ["s"]).toPandas().merge(pd.DataFrame(rows, columns=["code", "date", "alpha", "b", "g", "s"]), on="code")
    a = out.w - out.b
    assert abs(a.sum()) < 1e-9 and out.w.min() >= -1e-12 and a.abs().max() <= 0.01 + 1e-12 and a.abs().sum() / 2 <= 0.2
    assert a.groupby(out.g).sum().abs().max() <= 0.02 and (a * out.alpha).sum() > 0


# ---------------------------------------------------------------- monitoring, sources, streams


def test_expanding_percentile(spark):
    rows = [("a", d, v) for d, v in zip(days(5), [3.0, 1.0, 3.0, None, 2.0])]
    got = monitor.expanding_percentile(spark.createDataFrame(rows, "code string, date date, v double"), "v", "code", "date").orderBy("date").collect()
    assert [r["percentile"] for r in got] == [100.0, 50.0, pytest.approx(250 / 3), None, 50.0]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, float("nan")), ("b", DAY + dt.timedelta(days=4), float("inf"))], "code string, date date, v double")
    m = files.write(df, str(tmp_path / "t"), parameters={"k": 1})
    got = files.read(spark, m["path"], columns=["code", "v", "missing"])
    assert got.columns == ["code", "v", "missing"] and sorted(r["v"] is None for r in got.collect()) == [False, True, True]
    a = files.audit(df, "t", ["code", "date"], as_of="2024-01-02").first()
    assert (a["rows"], a["duplicates"], a["future"]) == (3, 1, 1) and math.isclose(a["coverage"], 2 / 5)
    with pytest.raises(ValueError):
        files.no_future_rows(df, "date", "2024-01-02")
    old, new = (spark.createDataFrame([("a", v)], "code string, v double") for v in (1.0, 2.0))
    y = dt.date
    merged = files.merge_ranges([(y(2023, 1, 1), y(2023, 12, 31), old), (y(2024, 1, 1), y(2024, 5, 1), new)], ["code"])
    assert [r["v"] for r in merged.collect()] == [2.0]
    with pytest.raises(ValueError):
        files.merge_ranges([(y(2022, 1, 1), y(2022, 12, 31), old), (y(2024, 1, 1), y(2024, 5, 1), new)], ["code"])
    assert files.annual_ranges(y(2023, 6, 1), y(2024, 2, 1)) == [(y(2023, 6, 1), y(2023, 12, 31)), (y(2024, 1, 1), y(2024, 2, 1))]
    assert files.covering(["d_20200101_20211231.parquet", "d_20190101_20221231.parquet"], "20200601", "20210101") == "d_20190101_20221231.parquet"


def test_held_signal_stream(spark, tmp_path):
    from tidewell.streaming import signals

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, None), ("b", 1, -1)], "grp string, t int, s int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("grp string, t int, s int").parquet(src)
    q = signals.held_signal(stream, "grp", "t", "s").writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("held").collect())) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, -1)]


def test_entry_and_oracles(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("lineitem", "supplier", "events"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("evaluate_ic_summary", "panel_ts_wma", "join_snapshot"):
        want, got = c.sql(o[name]).df(), q[name](spark, d).toPandas()
        k = sorted(want.columns)
        assert sorted(got.columns) == k and len(got) == len(want)
        keys = [x for x in k if want[x].dtype != float] or k
        a, b = got[k].sort_values(keys, ignore_index=True), want[k].sort_values(keys, ignore_index=True)
        for x in k:
            if want[x].dtype == float:
                assert np.allclose(a[x].astype(float), b[x], atol=2e-4, equal_nan=True), (name, x)
    assert e.entry(spark).columns == ["date", "factor", "n", "ic", "rank_ic"]


def test_co_momentum(spark):
    from tidewell.operators import extremes

    rng = np.random.default_rng(5)
    rows = [("a", d, float(rng.normal()), float(rng.integers(0, 6)), float(rng.normal()), float(rng.normal())) for d in days(30)]
    got = extremes.co_momentum(spark.createDataFrame(rows, "code string, date date, ret double, turnover_key double, group_ret double, market_ret double")).orderBy("date").collect()
    assert got[18]["icm"] is None

    def extreme(win, key, value, n, sign):
        best = sorted(win, key=lambda r: (-sign * r[key], r[1]))[:n]
        return sum(r[value] * 2 ** (-i / n) for i, r in enumerate(best))

    for k in (19, 29):
        win = rows[k - 19 : k + 1]
        assert math.isclose(got[k]["icm"], extreme(win, 2, 4, 5, 1)) and math.isclose(got[k]["vicr"], extreme(win, 3, 4, 15, -1))
        assert math.isclose(got[k]["mcmc"], extreme(win, 3, 5, 5, 1) - extreme(win, 3, 5, 15, -1)) and math.isclose(got[k]["imax20"], extreme(win, 2, 4, 1, 1))


def test_rolling_poly_resid(spark, panel, pdf):
    from tidewell.operators import extremes

    got = extremes.rolling_poly_resid(panel, "x", "y", 12, 2, 6).toPandas()
    e = pdf[["code", "date"]].merge(got, on=["code", "date"])["resid"].astype(float).to_numpy()
    g = pdf[pdf.code == "c0"].reset_index(drop=True)
    for k in (15, 30):
        d = g.iloc[k - 11 : k + 1].dropna(subset=["x", "y"])
        want = g.x[k] - np.polyval(np.polyfit(d.y, d.x, 2), g.y[k]) if len(d) >= 6 and not np.isnan(g.x[k]) else np.nan
        assert np.isclose(e[k], want, equal_nan=True)


def test_tree_model(spark):
    from tidewell.operators import models

    rng = np.random.default_rng(6)
    rows = [(d, float(a), float(b), None, float(2 * a)) for d in days(20) for a, b in rng.normal(size=(20, 2))]
    p = spark.createDataFrame(rows, "date date, a double, b double, c double, label double")
    out, importance = models.train_and_predict(p, ["a", "b", "c"], "label", "2024-01-15", trees=5)
    assert importance["a"] > 0.8 and out.where("prediction_rank is null").count() == 0
    assert out.stat.corr("prediction", "label") > 0.8


def test_tree_model_has_300_trees_unless_told():
    import inspect

    from tidewell.operators import models

    assert inspect.signature(models.train_and_predict).parameters["trees"].default == 300


def test_linear_weights_are_optimal():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(20):
        score, group, bench = rng.normal(size=6), np.array(list("aabbcc")), rng.random(6)
        w = portfolio.linear_weights(score, group, bench, 0.3, 0.1)
        b = bench / bench.sum()
        t = {g: b[group == g].sum() for g in "abc"}
        ok = lambda v: all(abs(v[group == g].sum() - t[g]) <= 0.1 + 1e-6 for g in "abc")
        if w is None:
            continue
        assert math.isclose(w.sum(), 1) and w.max() <= 0.3 + 1e-9 and w.min() >= 0 and ok(w)
        for i, j in itertools.permutations(range(6), 2):  # no shift between two codes is better
            v = w.copy()
            e = min(1e-3, v[i], 0.3 - v[j])
            v[i] -= e
            v[j] += e
            assert e <= 1e-12 or not ok(v) or score @ v <= score @ w + 1e-12


# ---------------------------------------------------------------- registered queries over whole tables


def tables(spark, path, weeks):
    """Line items of 75 suppliers in 25 nations, one a week each."""
    rng = np.random.default_rng(3)
    items = [(k, DAY + dt.timedelta(days=7 * w), float(rng.uniform(900, 1100)), float(rng.integers(1, 5)), 0.05, 0.02, "N") for w in range(weeks) for k in range(75)]
    spark.createDataFrame(items, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 25) for k in range(75)], "s_suppkey long, s_nationkey long").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_basis_and_pairs_of_all_products(spark, tmp_path):
    sf = tables(spark, tmp_path, 3)
    p = [r.asDict() for r in queries.base_panel(spark, sf).collect()]
    basis = {}
    for date in {r["date"] for r in p}:
        for product in range(25):
            rows = [r for r in p if r["date"] == date and r["industry"] == product]
            index = np.mean([r["open"] for r in rows])
            for tenor, days_ in enumerate(sorted(28 * (r["code"] % 3 + 1) for r in rows), 1):
                price = next(r["close"] for r in rows if 28 * (r["code"] % 3 + 1) == days_)
                basis[date, product, tenor] = (price - index) / index * 365 / days_
    got = {(r["date"], r["product"], r["tenor"]): r["annualised"] for r in queries.QUERIES["monitor_basis"](spark, sf).collect()}
    assert len(got) == 3 * 25 * 3 and got.keys() == basis.keys()
    assert all(math.isclose(got[k], basis[k], abs_tol=1e-4) for k in got)
    pairs = {(r["date"], r["tenor"], r["long_product"], r["short_product"]): r["spread"] for r in queries.QUERIES["monitor_pairs"](spark, sf).collect()}
    want = {(d, t, a, b): None if t == 3 else basis[d, a, t] - basis[d, b, t] for d, a, t in basis for b in range(25) if a != b}
    assert len(pairs) == 3 * 3 * 600 and pairs.keys() == want.keys()
    assert all(v is None if want[k] is None else math.isclose(v, want[k], abs_tol=1e-4) for k, v in pairs.items())


def test_covariance_of_all_groups_windows_and_dates(spark, tmp_path):
    sf = tables(spark, tmp_path, 130)
    p = queries.base_panel(spark, sf).toPandas().groupby(["date", "industry"])["close"].mean().unstack()
    p = p[sorted(p.columns, key=lambda k: f"g{k}")]
    got = model.QUERIES["risk_rolling_covariance"](spark, sf).toPandas()
    ends = {w: list(p.index[max(20, w // 2) - 1 :]) for w in (60, 120, 252)}
    assert {w: sorted(set(g.date)) for w, g in got.groupby("window")} == ends
    assert (got.groupby(["date", "window"]).size() == 325).all()
    for w in ends:
        last = got[(got.window == w) & (got.date == p.index[-1])].set_index(["factor_i", "factor_j"]).covariance
        want, _ = risk.ledoit_wolf(p.to_numpy()[-w:])
        names = [f"g{k}" for k in p.columns]
        assert np.allclose([last[a, b] for i, a in enumerate(names) for b in names[i:]], [want[i, j] for i in range(25) for j in range(i, 25)], rtol=1e-6, atol=1e-4)


# ---------------------------------------------------------------- numbers that were wrong before


def test_ewm_weights_fall_over_gaps(spark):
    from tidewell.plans.expr import plan

    rows = [("a", f"2024-01-{k + 1:02d}", v) for k, v in enumerate([None, 1.0, None, 3.0, None, None, 5.0])] + [("b", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "code string, date string, x double").selectExpr("code", "cast(date as date) as date", "x", "1 as industry")
    p = plan({"y": "ewm(x, 3)"})
    got = {(r["code"], r["date"].day): r["y"] for r in p.spark(df).collect()}
    want = pd.Series([np.nan, 1.0, np.nan, 3.0, np.nan, np.nan, 5.0]).ewm(span=3, adjust=False).mean()
    assert got[("a", 4)] == pytest.approx(2.33333333)
    for k in range(1, 7):
        assert got[("a", k + 1)] == pytest.approx(want[k])
    con = duckdb.connect()
    panel = df.toPandas()  # noqa: F841  read by the SQL
    sql = p.duckdb("select * from panel", ("code", "date"))
    assert {r[0]: r[2] for r in con.sql(f"select code, day(date), y from ({sql}) where code = 'a' and day(date) = 7").fetchall()}["a"] == pytest.approx(want[6])


def test_ranks_of_small_values(spark):
    from tidewell.plans.expr import plan

    df = spark.createDataFrame([(str(k), k * 1e-11) for k in range(1, 7)], "code string, x double").selectExpr("code", "date'2024-01-01' as date", "x", "1 as industry")
    assert sorted(r["y"] for r in plan({"y": "cs_rank(x)"}).spark(df).collect()) == pytest.approx([k / 6 for k in range(1, 7)])


def test_evidence_grades(spark):
    rows = [(True, True, True, 1.0, True, True, "C"), (True, True, False, 0.95, True, True, "A"), (True, True, False, 0.9, True, True, "B"), (True, False, False, 0.99, False, False, "B"), (True, False, False, None, True, True, "D"), (False, True, False, 1.0, True, True, "D"), (False, False, True, None, False, False, "C")]
    df = spark.createDataFrame(rows, "n boolean, p boolean, x boolean, c double, o boolean, k boolean, want string")
    from pyspark.sql import functions as F

    out = df.withColumn("got", monitor.evidence_grade(*[F.col(c) for c in ("n", "p", "x", "c", "o", "k")]))
    assert [r["got"] for r in out.collect()] == [r[-1] for r in rows]


def test_pair_without_a_grade_has_no_spread(spark):
    df = spark.createDataFrame([(1, "d", 1, "2024-02-01", 0.1, "B"), (2, "d", 1, "2024-02-02", 0.2, None)], "product int, date string, tenor int, expiry string, annualised double, quality string").selectExpr("product", "date'2024-01-01' as date", "tenor", "cast(expiry as date) as expiry", "annualised", "quality")
    assert {(r["quality"], r["spread"]) for r in joins.pair_legs(df).collect()} == {("D", None)}


def test_newey_west_and_eigenfactor_by_hand():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 3)).cumsum(axis=0)
    w = 0.5 ** (np.arange(80)[::-1] / 20)
    w = w / w.sum()
    c = x - (x * w[:, None]).sum(axis=0)
    want = sum(w[t] * np.outer(c[t], c[t]) for t in range(80))
    for lag, part in ((1, 2 / 3), (2, 1 / 3)):
        g = sum(w[t] * np.outer(c[t], c[t - lag]) for t in range(lag, 80)) / w[lag:].sum()
        want = want + part * (g + g.T)
    assert np.allclose(risk.ewma_newey_west(x, 20, 2), risk.psd(want))
    base = np.diag([4.0, 1.0, 0.25])
    before, after = np.linalg.eigvalsh(base), np.linalg.eigvalsh(risk.eigenfactor_adjust(base, 60, 20))
    assert (after / before >= 0.5 - 1e-12).all() and (after / before <= 2 + 1e-12).all() and not np.allclose(after, before)


def test_optimiser_keeps_to_the_largest_weight(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{k}", pd.Timestamp("2024-01-01").date(), float(rng.standard_normal()), 0.019 if k < 5 else 0.9 / 95, str(k % 4)) for k in range(100)]
    df = spark.createDataFrame(rows, "code string, date date, alpha double, b double, g string")
    w = portfolio.optimise(df, "alpha", "b", "g", []).toPandas()
    assert abs(w["w"].sum() - 1) < 1e-9 and w["w"].max() <= 0.02 * 1.01 and w["w"].min() >= 0


def test_percentiles_so_far():
    x = np.round(np.random.default_rng(2).standard_normal(1500), 1)
    want = [pd.Series(x[: k + 1]).rank().iloc[-1] / (k + 1) * 100 for k in range(len(x))]
    assert np.allclose(monitor._percentiles_so_far(x, 64), want)


def test_rsi_without_losses_is_100(spark):
    p = spark.createDataFrame([(c, d, "a", float(k if c == "up" else 1)) for c in ("up", "flat") for k, d in enumerate(days(6), 1)], "code string, date date, industry string, x double")
    got = plan({"v": "rsi(x, 3)"}).spark(p).where(F.col("date") == days(6)[-1]).collect()
    assert {r.code: r.v for r in got} == {"up": 100.0, "flat": None}


def test_panel_oracles_do_not_come_from_the_planner():
    for k, e in catalog.OPERATORS.items():
        assert queries.ORACLES[f"panel_{k}"] != plan({"value": e}).duckdb(queries.BASE, decimals=queries.DECIMALS)
