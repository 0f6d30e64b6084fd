"""The later parts of the risk model against pandas and NumPy at nine digits, with gaps and nulls."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import attribution, covariance, dividends, evaluate, exposures, extremes, joins, moments, risk, specific, weightings
from tidewell.functions.ranks import share_ranks
from tidewell.plans import expr, model
from tidewell.plans.expr import plan

DAY = dt.date(2020, 1, 1)


def ewm(values, window, half_life, least):
    """(mean, variance, count) by definition, one window at a time."""
    out = []
    for i in range(len(values)):
        v = np.array(values[max(0, i - window + 1) : i + 1], float)
        w = 0.5 ** (np.arange(len(v))[::-1] / half_life)
        ok = np.isfinite(v)
        if ok.sum() < least or not ok.any():
            out.append((np.nan, np.nan, ok.sum()))
            continue
        m = np.average(v[ok], weights=w[ok])
        out.append((m, np.average((v[ok] - m) ** 2, weights=w[ok]), ok.sum()))
    return np.array(out)


def holes(n, seed, share=0.3):
    g = np.random.default_rng(seed)
    return [None if g.random() < share else float(x) for x in g.normal(0.001, 0.02, n)]


def test_moving_moments_at_nine_digits(spark):
    rows = [(code, DAY + dt.timedelta(days=2 * i), v) for code, n in (("a", 700), ("b", 40), ("c", 1)) for i, v in enumerate(holes(n, len(code) + n))]
    rows[5] = (*rows[5][:2], float("nan"))
    rows[6] = (*rows[6][:2], float("inf"))
    df = spark.createDataFrame(rows, "code string, date date, x double").repartition(3)
    plans = {"long": (252, 63, 126), "mid": (60, 42, 1), "fast": (20, 2, 5)}
    out = moments.ewm_moments(df, {k: moments.Ewm(F.col("x"), *p) for k, p in plans.items()}, ["code"], "date")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "Python" not in text
    got = out.toPandas().sort_values(["code", "date"])
    for code, own in got.groupby("code"):
        values = [np.nan if v is None else v for c, _, v in rows if c == code]
        for k, p in plans.items():
            want = ewm(values, *p)
            assert np.allclose(own[f"{k}_mean"], want[:, 0], rtol=1e-9, atol=0, equal_nan=True), (code, k)
            assert np.allclose(own[f"{k}_variance"], want[:, 1], rtol=1e-9, atol=1e-18, equal_nan=True), (code, k)
            assert (own[f"{k}_count"] == want[:, 2]).all()


def test_moving_sums_of_a_long_history_keep_their_digits(spark):
    """Weights of row 3,000 with a half-life of two rows would be beyond the range of doubles in one running sum."""
    values = [1e9] * 100 + [float(1 + i % 7) / 8 for i in range(3000)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, x double")
    got = moments.moving_sums(df, {"plain": moments.Moving(F.col("x"), 50), "aged": moments.Moving(F.col("x"), 50, 2.0)}, ["k"], "i").toPandas().sort_values("i")
    s = pd.Series(values)
    assert np.allclose(got.plain, s.rolling(50, min_periods=1).sum(), rtol=1e-12)
    w = 0.5 ** (np.arange(50)[::-1] / 2.0)
    assert np.allclose(got.aged[200:], [np.dot(w, values[i - 49 : i + 1]) for i in range(200, len(values))], rtol=1e-12)


def test_moving_sums_refuse_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "k int, i int, x double")
    with pytest.raises(Exception, match="two rows of one"):
        moments.moving_sums(df, {"s": moments.Moving(F.col("x"), 5)}, ["k"], "i").collect()


def test_periods_are_complete_and_exclude_the_last(spark):
    days = pd.bdate_range("2024-01-01", "2024-03-15")
    df = spark.createDataFrame([(c, d.date(), None if c == "b" and d.month == 2 and d.day > 5 else 0.001) for c in "ab" for d in days], "code string, date date, r double")
    got = specific.period_sums(df, "r", "month", 0.6).toPandas().sort_values(["code", "period"])
    assert list(zip(got.code, got.period.astype(str))) == [("a", "2024-01-01"), ("a", "2024-02-01"), ("b", "2024-01-01")]
    assert np.allclose(got.total, got.n * 0.001) and list(got.period_end.astype(str).unique()) == ["2024-01-31", "2024-02-29"]


def test_blend_renormalises(spark):
    v, shares = specific.blend({"d": 0.5, "m": 0.3, "q": 0.2})
    rows = spark.createDataFrame([(4.0, 9.0, None), (None, 9.0, 16.0), (None, None, None)], "d double, m double, q double").select(v.alias("v"), *shares).collect()
    assert rows[0].v == pytest.approx((0.5 * 4 + 0.3 * 9) / 0.8) and rows[0].d_weight == pytest.approx(0.625)
    assert rows[1].v == pytest.approx((0.3 * 9 + 0.2 * 16) / 0.5) and rows[1].d_weight == 0
    assert rows[2].v is None and rows[2].q_weight == 0


def test_priors_by_group_then_industry_then_market(spark):
    rows = list(zip("ABCDEF", [DAY] * 6, ["I1", "I1", "I1", "I2", "I2", "I3"], [10.0, 11.0, 12.0, 100.0, 110.0, 1000.0], [1.0, 2.0, 3.0, 8.0, 10.0, None], [252, 126, 63, 252, 126, 0]))
    df = spark.createDataFrame(rows, "code string, date date, grp string, size double, v double, obs long")
    got = {r.code: r for r in specific.structural_shrinkage(df, "v", "obs", "grp", "size", specific.SpecificRisk(members=3, buckets=1)).collect()}
    assert got["A"].prior_level == "industry_size" and got["D"].prior_level == got["F"].prior_level == "market"
    assert got["F"].reliability == 0 and got["F"].variance_daily == 3.0 and got["C"].variance_daily == pytest.approx(0.25 * 3 + 0.75 * 2)


@pytest.mark.parametrize("n,same", [(1, False), (7, False), (23, False), (23, True)])
def test_quantile_buckets_are_pandas_qcut(spark, n, same):
    g = np.random.default_rng(n)
    x = np.full(n, 2.0) if same else g.integers(0, 12, n) / 4.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(1, n, None)], "d int, i int, x double")
    got = df.select("i", specific.quantile_bucket("x", 5, "d").alias("b")).toPandas().sort_values("i").b[:n]
    want = pd.qcut(pd.Series(x), 5, labels=False, duplicates="drop")
    assert np.allclose(got.astype(float), want.astype(float), equal_nan=True)


SMALL = specific.SpecificRisk(specific.Frequency(20, 5, 10, 0.5), specific.Frequency(6, 3, 3, 0.3), specific.Frequency(4, 2, 2, 0.2), members=3, target=20)


def residuals(end):
    days = pd.bdate_range("2023-01-02", end)
    return [(c, d.date(), float(np.sin(i / (7.0 + k)) * (0.005 + k * 0.0002)), "I1" if k < 3 else "I2", 10.0 * (k + 1)) for k, c in enumerate("ABCDEF") for i, d in enumerate(days)]


def _specific(spark, rows):
    df = spark.createDataFrame(rows, "code string, date date, r double, grp string, size double")
    return specific.specific_risk(df.select("code", "date", "r"), df.drop("r"), "r", "grp", "size", SMALL)


def test_specific_risk_has_all_components_and_no_look_ahead(spark):
    rows = residuals("2024-11-29")
    got = _specific(spark, rows).toPandas()
    last = got[got.date == got.date.max()]
    assert last[["day", "month", "quarter"]].notna().all().all() and np.allclose(last[["day_weight", "month_weight", "quarter_weight"]].sum(axis=1), 1)
    assert np.allclose(last.risk_annual, np.sqrt(last.variance_daily * 252))
    month = pd.DataFrame(rows, columns=["code", "date", "r", "g", "s"]).assign(p=lambda d: pd.to_datetime(d.date).dt.to_period("M"))
    a = month[(month.code == "A") & (month.p < "2024-11")].groupby("p").r.agg(["sum", "count"])
    assert last[last.code == "A"].month.iloc[0] == pytest.approx(ewm(a["sum"].to_numpy(), 6, 3, 3)[-1, 1] / ewm(a["count"].to_numpy(float), 6, 3, 3)[-1, 0], rel=1e-9)
    later = [(c, dt.date(2024, 12, 2), 0.5, "I1" if c < "D" else "I2", 10.0) for c in "ABCDEF"]
    again = _specific(spark, rows + later).toPandas()
    a, b = (x[x.date == dt.date(2024, 11, 29)].sort_values("code")[["variance_daily", "month", "quarter", "day"]].to_numpy() for x in (got, again))
    assert np.allclose(a, b, rtol=1e-12)


def test_specific_risk_refuses_repeated_rows(spark):
    rows = residuals("2023-02-10")
    with pytest.raises(Exception, match="two (rows|exposures) of one"):
        _specific(spark, rows + rows[:1]).collect()
    assert _specific(spark, []).collect() == []


# ---------------------------------------------------------------- exposures of the second model


def _z(x, w):
    """One cross-section by definition."""
    ok = x.notna() & (w > 0)
    s = x[ok]
    out = pd.Series(np.nan, x.index)
    if ok.sum() < 2:
        return out
    mad = (s - s.median()).abs().median()
    c = s.clip(s.median() - 5 * mad, s.median() + 5 * mad) if mad > 0 else s.clip(*s.quantile([0.01, 0.99]))
    out[ok] = 0.0 if c.std() <= 1e-12 else (c - np.average(c, weights=w[ok])) / c.std()
    return out


def _resid(d, y, xs, w):
    ok = d[[y, *xs]].notna().all(axis=1) & (d[w] > 0)
    out = pd.Series(np.nan, d.index)
    if ok.sum() >= len(xs) + 2:
        x = np.column_stack([np.ones(ok.sum()), d.loc[ok, xs]])
        r = np.sqrt(d.loc[ok, w].to_numpy())
        beta = np.linalg.lstsq(x * r[:, None], d.loc[ok, y].to_numpy() * r, rcond=None)[0]
        out[ok] = d.loc[ok, y] - x @ beta
    return out


def cross_sections(seed=4, dates=6):
    g = np.random.default_rng(seed)
    rows = []
    for t in range(dates):
        for c in range(25 if t else 1):
            x = g.normal(0, 1) * (50 if g.random() < 0.05 else 1)
            rows.append((c, DAY + dt.timedelta(days=t), None if g.random() < 0.15 else x, g.normal(2, 1), 3.0, float(g.integers(0, 2)), None if g.random() < 0.1 else float(g.integers(0, 9))))
    return pd.DataFrame(rows, columns=["code", "date", "a", "b", "flat", "two", "w"])


def _frame(spark, pdf, kind="code long, date date, a double, b double, flat double, two double, w double"):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)], kind).repartition(3)


def test_standardised_and_orthogonal_cross_sections(spark):
    pdf = cross_sections()
    got = exposures.standardise(_frame(spark, pdf), ["a", "b", "flat", "two"], "w").toPandas().sort_values(["date", "code"]).reset_index(drop=True)
    for c in ("a", "b", "flat", "two"):
        want = pd.concat([_z(d[c], d.w) for _, d in pdf.groupby("date")])
        assert np.allclose(got[c].astype(float), want, rtol=1e-9, atol=1e-12, equal_nan=True), c
    for xs in (["a"], ["a", "b"], ["flat", "b"], ["b", "flat", "two"]):
        d = pdf.rename(columns={"w": "weight"}).assign(y=pdf.a.fillna(1) ** 2 + pdf.b)
        df = _frame(spark, d, "code long, date date, a double, b double, flat double, two double, weight double, y double")
        got = exposures.residualise(df, "y", xs, "weight").toPandas().sort_values(["date", "code"]).reset_index(drop=True)
        want = pd.concat([_resid(x, "y", xs, "weight") for _, x in d.groupby("date")])
        assert np.allclose(got.y.astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True), xs


def test_admission_looks_back_only(spark):
    g = np.random.default_rng(9)
    rows = [(c, DAY + dt.timedelta(days=t), 1.0 if g.random() < 0.4 + 0.01 * t else None, 1.0 if t % 2 else None) for t in range(60) for c in range(12)]
    df = lambda r: spark.createDataFrame(r, "code long, date date, a double, b double")
    got = exposures.admission(df(rows), ["a", "b"], 20, 10).toPandas().sort_values("date").reset_index(drop=True)
    daily = pd.DataFrame(rows, columns=["code", "date", "a", "b"]).groupby("date")[["a", "b"]].agg(lambda s: s.notna().mean())
    want = daily.shift(1).rolling(20, min_periods=10).mean() >= 0.7
    assert (got[["a", "b"]].to_numpy() == want.to_numpy()).all() and got.a.any() and not got.b.any()
    more = exposures.admission(df(rows + [(c, DAY + dt.timedelta(days=60), 1.0, 1.0) for c in range(12)]), ["a", "b"], 20, 10).toPandas().sort_values("date")
    assert (more[["a", "b"]].to_numpy()[:-1] == want.to_numpy()).all()


def test_styles_need_their_weight(spark):
    d = [exposures.Descriptor("large", "demo", 0.6), exposures.Descriptor("small", "demo", 0.4)]
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 2.0)], "large double, small double")
    rows = df.select(*[v.alias(k) for k, v in exposures.combine(df, d).items()]).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.6, 1), (None, 0.4, 1), (pytest.approx(1.4), pytest.approx(1.0), 2)]
    totals = {}
    for x in model.DESCRIPTORS:
        totals[x.style] = totals.get(x.style, 0) + x.weight
    assert len(model.DESCRIPTORS) == 49 and len(totals) == 15 and all(abs(v - 1) < 1e-12 for v in totals.values())


# ---------------------------------------------------------------- many weightings


def _fit(d, name, rule, risk, styles):
    """One date and strategy by definition: weights, dummies, least squares; (statistics by evaluation) or the status."""
    d = d[d.y.notna() & d.grp.notna()].copy()
    if d.empty:
        return "failed_empty"
    mv = np.sqrt(d["size"]).where(d["size"] > 0, 1.0)
    s = d[risk].where(d[risk] > 0) if risk else None
    w = {"size": lambda: mv, "equal": lambda: mv * 0 + 1, "inverse_variance": lambda: 1 / s**2, "inverse": lambda: 1 / s, "size_by_risk": lambda: mv / s, "size_by_rank": lambda: mv * (0.75 + 0.5 * s.rank(pct=True, ascending=False))}[rule]()
    if rule in ("inverse_variance", "inverse", "size_by_risk") and w.notna().sum() >= 20:
        w = w.clip(w.quantile(0.01), w.quantile(0.99))
    d, mv, w = d[w.notna()], mv[w.notna()], w[w.notna()]
    if d.empty:
        return "failed_no_fit_weight"
    z = [((d[c] - d[c].mean()) / (d[c].std() if d[c].std() > 1e-12 else np.inf)).fillna(0) for c in styles if d[c].notna().mean() >= 0.5]
    x = np.column_stack([np.ones(len(d)), *z, pd.get_dummies(d.grp, dtype=float).to_numpy()[:, 1:]])
    n, p = x.shape
    if n < max(30, p + 5) or d.grp.nunique() < 2:
        return "failed_insufficient_sample"
    r = np.sqrt(w / w.mean()).to_numpy()
    beta = np.linalg.lstsq(x * r[:, None], d.y * r, rcond=None)[0]
    e = d.y - x @ beta
    out = {}
    for k, v in (("own", w), ("sqrt_mv", mv), ("equal", mv * 0 + 1)):
        r2 = 1 - (v * e**2).sum() / (v * (d.y - np.average(d.y, weights=v)) ** 2).sum()
        out[k] = (n, p, r2, 1 - (1 - r2) * (n - 1) / (n - p), np.sqrt(np.average(e**2, weights=v)), np.linalg.cond(x * r[:, None]), w.sum() ** 2 / (w**2).sum(), w.max() / w.sum(), np.percentile(w, 99) / np.percentile(w, 50), w.std(ddof=0) / w.mean())
    return out


def test_all_weightings_against_least_squares(spark):
    g = np.random.default_rng(12)
    rows = []
    for t in range(5):
        for c in range((90, 90, 25, 60, 40)[t]):
            y = None if t == 4 or g.random() < 0.05 else g.normal(0, 0.02)
            risk = [None if g.random() < 0.1 or t == 3 else abs(g.normal(0.02, 0.01)) for _ in range(3)]
            rows.append((c, DAY + dt.timedelta(days=t), y, None if g.random() < 0.05 else f"g{g.integers(0, 5)}", None if g.random() < 0.1 else g.lognormal(3, 1) - 2, 100 + g.normal(0, 1), None if g.random() < 0.2 else g.normal(0, 3), None if g.random() < 0.7 else 1.0, *risk))
    pdf = pd.DataFrame(rows, columns=["code", "date", "y", "grp", "size", "a", "b", "rare", "r60", "r120", "r252"])
    risks = {60: "r60", 120: "r120", 252: "r252"}
    df = spark.createDataFrame(rows, "code long, date date, y double, grp string, size double, a double, b double, rare double, r60 double, r120 double, r252 double").repartition(3)
    out = weightings.weighted_regressions(df, "y", ["a", "b", "rare"], "grp", "size", risks)
    got = {(r.date, r.strategy, r.evaluation): r for r in out.collect()}
    seen = set()
    for day, d in pdf.groupby("date"):
        for name, rule, w in weightings.STRATEGIES:
            want = _fit(d, name, rule, risks.get(w), ["a", "b", "rare"])
            if isinstance(want, str):
                assert got.pop((day, name, "own")).status == want
                seen.add(want)
                continue
            for e, figures in want.items():
                r = got.pop((day, name, e))
                have = (r.n_obs, r.n_columns, r.r2, r.adj_r2, r.resid_std, r.condition, r.effective_size, r.max_share, r.p99_p50, r.weight_cv)
                assert np.allclose(have, figures, rtol=1e-8), (day, name, e)
    assert not got and seen == {"failed_empty", "failed_no_fit_weight", "failed_insufficient_sample"}
    total = weightings.summarise(out, comparable=10).toPandas()
    assert (total.dates == 2).all() and len(total) == 30  # two dates that all strategies could fit
    assert weightings.weighted_regressions(df.limit(0), "y", ["a"], "grp", "size", risks).collect() == []


def test_many_weightings_share_one_exchange_by_date(spark):
    df = spark.range(0, 1000, 1, 3).selectExpr("id as code", "date_add(date'2020-01-01', cast(id % 5 as int)) as date", "1D as y", "'a' as grp", "1D as size", "1D as a", "1D as r60", "1D as r120", "1D as r252")
    plan = weightings.weighted_regressions(df, "y", ["a"], "grp", "size", {60: "r60", 120: "r120", 252: "r252"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- covariances


def _returns(n, names, seed=3, missing=0.1):
    g = np.random.default_rng(seed)
    mix = g.normal(0, 1, (len(names), len(names)))
    x = g.normal(0, 0.01, (n, len(names))) @ mix + 0.05
    x[g.random(x.shape) < missing] = np.nan
    days = [d.date() for d in pd.bdate_range("2022-01-03", periods=n)]
    return days, x, [(days[t], f, float(x[t, k])) for t in range(n) for k, f in enumerate(names) if np.isfinite(x[t, k])]


def _matrix(rows, names):
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r.factor_i), names.index(r.factor_j)] = m[names.index(r.factor_j), names.index(r.factor_i)] = r.covariance
    return m


@pytest.mark.parametrize("method", ["ledoit_wolf", "sample", "ewma"])
def test_windows_from_co_moments_equal_windows_by_themselves(spark, method):
    names = list("pqrs")
    days, x, rows = _returns(150, names)
    df = spark.createDataFrame(rows, "date date, factor string, ret double").repartition(3)
    out = covariance.rolling(df, names, (25, 40), method, block=40)
    got = {}
    for r in out.collect():
        got.setdefault((r.date, r.window), []).append(r)
    assert len(got) == (150 - 19) + (150 - 19)
    for t in range(19, 150, 7):
        for w in (25, 40):
            own = x[max(0, t + 1 - w) : t + 1]
            if method == "ledoit_wolf":
                want, k = risk.ledoit_wolf(own)
            elif method == "sample":
                want, k = np.cov(np.nan_to_num(own), rowvar=False), 0.0
            else:
                want, k = risk.ewma_newey_west(own[~np.isnan(own).any(axis=1)]), 0.0
            mine = got[days[t], w]
            assert np.allclose(_matrix(mine, names), want, rtol=1e-9, atol=1e-15) and mine[0].shrinkage == pytest.approx(k, rel=1e-9)
    month = covariance.rolling(df, names, (25, 40), method, step="month").select("date").distinct().collect()
    ends = {max(d for d in days if (d.year, d.month) == m) for m in {(d.year, d.month) for d in days}}
    assert {r.date for r in month} == {d for d in ends if days.index(d) >= 19}


def test_a_date_goes_to_two_blocks_at_most(spark):
    names = list("pq")
    _, _, rows = _returns(300, names, missing=0.0)
    df = spark.createDataFrame(rows, "date date, factor string, ret double")
    seen = covariance._vectors(df, names).withColumn("own", F.floor((F.col("n") - 1) / 60)).withColumn("reach", F.floor((F.col("n") + 58) / 60))
    assert seen.agg(F.max(F.col("reach") - F.col("own"))).first()[0] == 1


def test_basis_round_trip():
    names = ["country", "style_size", "industry_B", "industry_A", "industry_C"]
    b = covariance.independent_basis(names, {"industry_A": 2.0, "industry_B": 1.0, "industry_C": 1.0})
    assert b.reference == "industry_C" and b.independent == ("country_reference", "style_size", "contrast_A", "contrast_B")
    assert np.allclose(b.forward @ b.restore, np.eye(4))
    x = np.array([[0.01, 0.003, -0.002, 0.004, -0.006]])  # 2 * 0.004 - 0.002 - 0.006 = 0
    assert np.allclose(x @ b.forward.T @ b.restore.T, x, atol=1e-15)
    for bad in ({"industry_A": -1.0}, {"industry_A": 0.0}, {"industry_A": float("nan")}):
        with pytest.raises(ValueError, match="weights"):
            covariance.independent_basis(names, bad)
    with pytest.raises(ValueError, match="two groups"):
        covariance.independent_basis(["country", "industry_A"])
    with pytest.raises(ValueError, match="country"):
        covariance.independent_basis(names[1:])


def test_estimates_say_why_they_fall_back(spark):
    names = ["country", "s", "industry_A", "industry_B", "industry_C"]
    days, x, rows = _returns(140, names, 7, 0.01)
    df = spark.createDataFrame(rows, "date date, factor string, ret double").repartition(3)
    got = {}
    for r in covariance.estimates(df, names, 60, 50, 20.0, 2).collect():
        got.setdefault(r.date, []).append(r)
    b = covariance.independent_basis(names)
    seen = set()
    for t in range(139):
        if days[t].month == days[t + 1].month:
            assert days[t + 1] not in got
            continue
        whole = (x[max(0, t - 59) : t + 1] @ b.forward.T)[~np.isnan(x[max(0, t - 59) : t + 1]).any(axis=1)]
        mine = got.pop(days[t + 1])
        seen.add(mine[0].method)
        independent = risk.ewma_newey_west(whole, 20.0, 2) if len(whole) >= 50 else risk.ledoit_wolf(whole)[0]
        assert mine[0].observations == len(whole) and ("insufficient" in mine[0].reason) == (len(whole) < 50)
        m = _matrix(mine, names)
        assert np.allclose(m, b.restore @ independent @ b.restore.T, rtol=1e-9, atol=1e-15) and np.linalg.eigvalsh(m).min() > -1e-15
        assert np.abs(m[2:, :].sum(axis=0)).max() < 1e-14  # groups of equal weight sum to zero
    assert not got and seen == {"ewma_newey_west", "ledoit_wolf_fallback"}
    assert covariance.estimates(df.limit(0), names).collect() == [] == covariance.rolling(df.limit(0), names).collect()


# ---------------------------------------------------------------- intervals and sums of what was known


def _d(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("closed", [False, True])
def test_sweep_finds_what_is_valid(spark, closed):
    g = np.random.default_rng(21)
    spans, rows = [], [("none", _d(3), 1), (None, _d(3), 2), ("k0", None, 3)]
    for k in range(8):
        at = 0
        for i in range(6):
            start = at + int(g.integers(1, 6))
            end = start + int(g.integers(1, 9))
            spans.append((f"k{k}", None if i == 0 and k == 3 else _d(start), None if i == 5 and k % 2 else _d(end), f"{k}-{i}"))
            at = end + closed
        rows += [(f"k{k}", _d(int(n)), 10) for n in g.integers(0, 60, 40)]
    spans += [("k1", _d(500), _d(499), "empty"), (None, _d(1), _d(90), "no key")]
    left = spark.createDataFrame(rows, "code string, date date, v int").repartition(3)
    right = spark.createDataFrame(spans, "code string, since date, until date, cls string").repartition(2)
    got = joins.interval_join(left, right, "code", "date", "since", "until", closed=closed)
    assert got.columns == ["code", "date", "v", "since", "until", "cls"]

    def valid(c, d):
        return [s[3] for s in spans if c and d and s[0] == c and (s[1] is None or s[1] <= d) and (s[2] is None or (d <= s[2] if closed else d < s[2]))]

    want = [(c, d, v, (valid(c, d) or [None])[0]) for c, d, v in rows]
    assert sorted(map(str, ((r.code, r.date, r.v, r.cls) for r in got.collect()))) == sorted(map(str, want))
    inner = joins.interval_join(left, right, "code", "date", "since", "until", closed=closed, how="inner")
    assert inner.count() == sum(w[3] is not None for w in want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spans,closed", [([(0, 5), (4, 9)], False), ([(0, None), (4, 9)], False), ([(0, 5), (5, 9)], True), ([(None, 5), (None, 3)], False), ([(2, 5), (2, 5)], False)])
def test_overlaps_are_refused(spark, spans, closed):
    at = lambda n: None if n is None else _d(n)
    right = spark.createDataFrame([("a", at(s), at(e)) for s, e in spans] + [("b", _d(0), _d(5)), ("b", _d(6), None)], "code string, since date, until date")
    left = spark.createDataFrame([("a", _d(1)), ("b", _d(1))], "code string, date date")
    with pytest.raises(Exception, match="intervals of code a overlap"):
        joins.interval_join(left, right, "code", "date", "since", "until", closed=closed).collect()
    assert joins.interval_join(left.where("code = 'b'"), right, "code", "date", "since", "until", closed=closed).collect()[0].until == _d(5)


def test_groups_need_their_coverage(spark):
    left = spark.createDataFrame([("a", _d(1)), ("z", _d(1))], "code string, date date")
    members = spark.createDataFrame([("a", "g", _d(0), None)], "code string, grp string, in_date date, out_date date")
    got = {r.code: (r.grp, r.grp_source) for r in joins.attach_groups(left, members, "own", coverage=0.5).collect()}
    assert got == {"a": ("g", "own"), "z": (None, None)}
    with pytest.raises(ValueError, match="1 of 2"):
        joins.attach_groups(left, members, "own", coverage=0.6)


def test_classes_by_day(spark):
    left = spark.createDataFrame([(c, _d(n)) for c in "abz" for n in (0, 5, 9)], "code string, date date")
    rated = spark.createDataFrame([("a", None, _d(5), "cash", "low_risk", True), ("a", _d(6), None, "x", None, True), ("b", None, None, "y", "risk", None)], "code string, since date, until date, category string, risk_bucket string, reviewed boolean")
    assert {(r.code, r.date) for r in joins.apply_classes(left, rated).collect()} == {("a", _d(0)), ("a", _d(5))}
    got = {(r.code, r.date): (r.risk_bucket, r.reviewed) for r in joins.apply_classes(left, rated, unreviewed=True).collect()}
    assert len(got) == 9 and got["a", _d(9)] == ("unclassified", True) and got["b", _d(0)] == ("risk", False) and got["z", _d(0)] == ("unclassified", False)


def test_known_sums_against_brute_force(spark):
    g = np.random.default_rng(31)
    events = [(f"k{g.integers(0, 3)}", None if g.random() < 0.1 else _d(int(g.integers(0, 90))), None if g.random() < 0.1 else _d(int(g.integers(0, 120))), None if g.random() < 0.1 else float(g.normal())) for _ in range(300)]
    asked = [(f"k{g.integers(0, 4)}", _d(int(a := g.integers(0, 90))), _d(int(a + g.integers(-3, 3))), _d(int(a + g.integers(-5, 40)))) for _ in range(200)] + [("k0", None, _d(1), _d(2)), ("k0", _d(50), _d(10), _d(90))] * 2
    q = spark.createDataFrame(asked, "k string, w date, a date, u date").repartition(3)
    e = spark.createDataFrame(events, "k string, known date, at date, v double").repartition(3)
    out = joins.known_sums(q, e, "k", "known", "at", "v", "w", "a", "u", "total")
    want = lambda k, w, a, u: None if None in (w, a, u) else sum(v for kk, t, x, v in events if kk == k and None not in (t, x, v) and t <= w and a < x <= u)
    got = sorted(((r.k, r.w, r.a, r.u, r.total) for r in out.collect()), key=str)
    assert len(got) == len(asked) and sorted([g_[:4] for g_ in got], key=str) == sorted(asked, key=str)
    assert all(t is None and want(*x) is None or t == pytest.approx(want(*x), abs=1e-12) for *x, t in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dividend_points_take_what_was_known(spark):
    contracts = spark.createDataFrame([("p", _d(10), _d(40), 1000.0), ("p", _d(30), _d(40), 2000.0), ("none", _d(10), _d(40), 1.0)], "product string, date date, expiry date, index_close double")
    events = spark.createDataFrame([("a", _d(5), _d(20), 1.0), ("a", _d(15), _d(35), 2.0), ("b", _d(1), _d(41), 9.0), ("b", _d(1), _d(40), 0.5), ("c", _d(1), _d(20), 5.0), ("a", _d(1), None, 7.0), ("a", _d(1), _d(12), -3.0)], "code string, announced date, ex_date date, cash double")
    weights = spark.createDataFrame([("p", _d(0), "a", 50.0), ("p", _d(0), "b", 10.0), ("p", _d(0), "c", 40.0), ("p", _d(20), "a", 20.0), ("p", _d(20), "b", 0.0)], "product string, date date, code string, weight double")
    prices = spark.createDataFrame([("a", _d(0), 10.0), ("a", _d(9), 20.0), ("a", _d(25), None), ("b", _d(0), 5.0), ("c", _d(11), 1.0)], "code string, date date, close double")
    got = {(r["product"], r.date): (r.points, r.n_codes) for r in dividends.contract_dividend_points(contracts, events, weights, prices).collect()}
    assert got["p", _d(10)] == (pytest.approx((1.0 / 20 * 0.5 + 0.5 / 5 * 0.1) * 1000), 2)  # c has no price yet
    assert got["p", _d(30)] == (pytest.approx(2.0 / 20 * 0.2 * 2000), 1) and got["none", _d(10)] == (0.0, 0)


# ---------------------------------------------------------------- correlation of many signals


def _signals(n_dates=9, n_codes=40, k=23, seed=8):
    g = np.random.default_rng(seed)
    base = g.normal(0, 1, (n_dates * n_codes, k)) + g.normal(0, 1, (n_dates * n_codes, 1))
    base[:, 1] = np.round(base[:, 0])
    base[:, 2] = 1.0
    base[g.random(base.shape) < 0.2] = np.nan
    base[: n_codes, 3] = np.nan
    names = [f"s{i}" for i in range(k)]
    pdf = pd.DataFrame(base, columns=names)
    pdf.insert(0, "date", [_d(t) for t in range(n_dates) for _ in range(n_codes)])
    pdf.insert(0, "code", list(range(n_codes)) * n_dates)
    return pdf, names


@pytest.mark.parametrize("block", [512, 7])
def test_rank_correlations_of_all_pairs(spark, block):
    pdf, names = _signals()
    kind = "code long, date date, " + ", ".join(f"{n} double" for n in names)
    df = _frame(spark, pdf, kind)
    ranks = pdf.groupby("date")[names].rank(pct=True)
    got = {(r.left, r.right): r.mean_abs for r in evaluate.rank_correlation(df, names, block=block).collect()}
    assert len(got) == 23 * 22 // 2
    daily = [ranks[pdf.date == d].corr(min_periods=20).abs() for d in pdf.date.unique()]
    for (a, b), v in got.items():
        want = np.nanmean([c.loc[a, b] for c in daily]) if "s2" not in (a, b) else None
        assert v is None if want is None else v == pytest.approx(want, rel=1e-9), (a, b)
    pooled = {(r.left, r.right): r.correlation for r in evaluate.rank_correlation(df, names, pooled=True, block=block).collect()}
    want = ranks.corr(min_periods=20)
    assert all(v == pytest.approx(want.loc[a, b], rel=1e-8) for (a, b), v in pooled.items() if "s2" not in (a, b))


def test_selection_drops_what_is_redundant(spark):
    pdf, names = _signals()
    df = _frame(spark, pdf, "code long, date date, " + ", ".join(f"{n} double" for n in names))
    g = np.random.default_rng(1)
    scores = [(n, bool(g.random() < 0.8), float(np.round(g.random(), 1)), float(g.random())) for n in names] + [("absent", True, 2.0, 2.0)]
    got = evaluate.select_signals(spark.createDataFrame(scores, "factor string, passed boolean, test double, valid double"), df, 0.5)
    corr = pdf.groupby("date")[names].rank(pct=True).corr(min_periods=20)
    kept = []
    for n, ok, *_ in sorted(scores[:-1], key=lambda s: (-s[2], -s[3], s[0])):
        if ok and all(not abs(corr.loc[n, k]) > 0.5 for k in kept):
            kept.append(n)
    assert got == kept and 1 < len(kept) < 18


def test_polynomial_residuals_against_least_squares(spark):
    g = np.random.default_rng(14)
    n = 90
    x, y = np.cumsum(g.normal(0, 1, n)) + 1000, g.normal(0, 1, n)
    x[g.random(n) < 0.15] = np.nan
    y[g.random(n) < 0.1] = np.nan
    x[60:75] = 7.0  # windows without any spread
    df = _frame(spark, pd.DataFrame({"code": [1] * n, "date": [_d(i) for i in range(n)], "x": x, "y": y}), "code long, date date, x double, y double")
    got = extremes.rolling_poly_resid(df, "y", "x", 12, 2, 6).toPandas().sort_values("date").resid.to_numpy(float)
    for i in range(n):
        m = slice(max(0, i - 11), i + 1)
        ok = np.isfinite(x[m]) & np.isfinite(y[m])
        if not (ok[-1] and ok.sum() >= 6):
            assert np.isnan(got[i])
            continue
        u, v = x[m][ok], y[m][ok]
        b = np.vander((u - u.mean()) / (u.std() or 1.0), 3)
        assert got[i] == pytest.approx(float((v - b @ np.linalg.lstsq(b, v, rcond=None)[0])[-1]), rel=1e-7, abs=1e-9), i


# ---------------------------------------------------------------- attribution


def test_attribution_adds_up(spark):
    g = np.random.default_rng(41)
    names = ["style_a", "style_b", "industry_x", "industry_y", "industry_unknown"]
    panel, weights, cov, spec = [], [], {}, []
    for t in range(0, 30, 10):
        m = g.normal(0, 0.01, (20, 5))
        c = m.T @ m / 20
        cov[_d(t)] = c
        for k in range(30):
            panel.append((k, _d(t), None if g.random() < 0.2 else float(g.lognormal()), float(g.normal()), None if g.random() < 0.2 else float(g.normal()), [None, "x", "y"][int(g.integers(0, 3))]))
        weights += [(s, _d(t), k, float(g.normal(0.5, 1))) for s in ("p", "q") for k in range(0 if s == "p" else 10, 35)]
        spec += [(_d(t - 3), k, float(g.random() / 1000)) for k in range(0, 30, 2)]
    weights.append(("p", _d(77), 1, 1.0))  # no panel at that date
    upper = [(d, names[i], names[j], float(c[i, j])) for d, c in cov.items() for i in range(4) for j in range(i, 4)]  # nothing known of the fifth
    frames = (spark.createDataFrame(weights, "scenario string, date date, code int, weight double"), spark.createDataFrame(panel, "code int, date date, bench double, style_a double, style_b double, grp string"), spark.createDataFrame(upper, "date date, factor_i string, factor_j string, covariance double"), spark.createDataFrame(spec, "date date, code int, variance double"))
    x, parts, risk = attribution.attribution(*frames, ["style_a", "style_b"], "grp", "bench")
    x, parts, risk = x.toPandas(), parts.toPandas(), risk.toPandas()
    assert len(risk) == 6
    p, w, s = (pd.DataFrame(r, columns=c) for r, c in ((panel, ["code", "date", "bench", "style_a", "style_b", "grp"]), (weights, ["scenario", "date", "code", "weight"]), (spec, ["date", "code", "variance"])))
    for r in risk.itertuples():
        own = p[p.date == r.date].merge(w[(w.date == r.date) & (w.scenario == r.scenario)][["code", "weight"]], on="code", how="outer")
        port, bench = (own[c].clip(lower=0).fillna(0) / own[c].clip(lower=0).sum() for c in ("weight", "bench"))
        act, inside = port - bench, own.bench.notna()
        want = {c: (act * own[c].fillna(0))[inside].sum() for c in ("style_a", "style_b")} | {f"industry_{k}": v for k, v in act[inside].groupby(own.grp.fillna("unknown")).sum().items()}
        mine = x[(x.date == r.date) & (x.scenario == r.scenario)].set_index("factor").exposure
        assert all(mine[k] == pytest.approx(v) for k, v in want.items()) and mine["outside_model_universe"] == pytest.approx(port[~inside].sum())
        c = np.zeros((5, 5))
        c[:4, :4] = cov[r.date][:4, :4]
        v = np.array([want.get(n, 0.0) for n in names])
        known = own.code.map(s[s.date == r.date - dt.timedelta(days=3)].set_index("code").variance)
        specific = (act**2 * known.fillna(known.median())).sum()
        assert r.factor_variance == pytest.approx(v @ c @ v) and r.specific_variance == pytest.approx(specific)
        assert r.style_variance == pytest.approx(v[:2] @ c[:2, :2] @ v[:2]) and r.industry_variance == pytest.approx(v[2:] @ c[2:, 2:] @ v[2:])
        assert r.active_share == pytest.approx(act.abs().sum() / 2) and r.n_names == (port > 1e-10).sum() and r.outside_weight == pytest.approx(port[~inside].sum())
        assert parts[(parts.date == r.date) & (parts.scenario == r.scenario)].part.sum() == pytest.approx(r.factor_variance + r.specific_variance)
    total = attribution.summarise(spark.createDataFrame(risk)).toPandas().set_index("scenario")
    one = risk[risk.scenario == "p"]
    assert total.dates["p"] == 3 and total.specific_share["p"] == pytest.approx(one.specific_variance.sum() / one.total_variance.sum()) and total.predicted_last["p"] == pytest.approx(one.sort_values("date").predicted_error.iloc[-1])


def test_calibration_takes_what_was_available(spark):
    g = np.random.default_rng(43)
    n = 60
    b = pd.DataFrame({"block": "s", "date": [_d(i) for i in range(n)], "asof": [_d(i - 3) for i in range(n)], "available": [_d(i + 1) for i in range(n)], "predicted": g.lognormal(0, 1, n), "realised": g.lognormal(0, 2, n), "n_items": 1})
    b["ratio"] = b.realised / b.predicted
    got = attribution.calibrated(spark.createDataFrame(b), (20,)).toPandas()
    assert (got[got.window == 0].multiplier == 1).all() and (got.window == 0).sum() == n
    real = b.predicted * b.ratio.clip(0.05, 20)
    m = (real.rolling(20, min_periods=5).sum() / b.predicted.rolling(20, min_periods=5).sum()).clip(0.25, 4)
    for r in got[got.window == 20].itertuples():
        seen = m[pd.Series(b.available) <= r.asof].dropna()
        assert r.multiplier == pytest.approx(seen.iloc[-1]) and r.corrected == pytest.approx(r.predicted * seen.iloc[-1])
    assert (got.window == 20).sum() == n - 8  # five values, the last of them known a day later and three before
    best = attribution.best_windows(spark.createDataFrame([("a", 0, 0.1), ("a", 20, 0.4), ("a", 40, 0.3), ("b", 20, 0.2), ("b", 40, 0.2)], "block string, window int, corrected_error double")).collect()
    assert {(r.block, r.window) for r in best} == {("a", 40), ("b", 20)}


def test_ranks_of_many_columns_are_those_of_windows(spark, monkeypatch):
    monkeypatch.setattr(expr, "MANY_RANKS", 4)
    g = np.random.default_rng(77)
    x = g.integers(0, 9, (50, 6)).astype(float)
    x[g.random(x.shape) < 0.3] = np.nan
    x[:, 5] = np.nan
    want = pd.DataFrame(x).rank(pct=True).to_numpy()
    assert np.allclose(share_ranks(x), want, equal_nan=True) and share_ranks(np.empty((0, 2))).shape == (0, 2)
    pdf = pd.DataFrame(x[:, :4], columns=["close", "open", "high", "low"]).assign(code=range(50), date=[_d(i % 2) for i in range(50)])
    df = _frame(spark, pdf, "close double, open double, high double, low double, code long, date date")
    few, many = {"a": "cs_rank(close)", "b": "cs_rank(open)"}, {"c": "cs_rank(high)", "d": "cs_rank(low)", "e": "cs_rank(close + open)"}
    one = plan(few | many).spark(df).toPandas().sort_values("code")
    two = plan(few).spark(df).toPandas().sort_values("code")
    assert "FlatMapGroupsInArrow" in plan(few | many).spark(df)._jdf.queryExecution().toString()
    assert np.allclose(one[["a", "b"]].astype(float), two[["a", "b"]].astype(float), equal_nan=True)
    assert np.allclose(one["e"].astype(float), (pdf.close + pdf.open).groupby(pdf.date).rank(pct=True), equal_nan=True)
