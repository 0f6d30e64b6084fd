"""Risk model: style blends, per-date regressions, covariances, specific risk, attribution, calibration.

Regressions and covariances are small dense problems of one date or window, so they run as
grouped Arrow kernels; everything around them is projections, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blend(descriptors: dict[str, float], least: float = 0.6) -> Column:
    """Weighted mean over the descriptors that a row has, null below ``least`` of the weight."""
    have = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in descriptors.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in descriptors.items()), F.lit(0.0))
    return F.when(have >= least * sum(descriptors.values()) - 1e-12, total / have)


def weighted_standardise(x: str, weight: str, date: str = "date") -> list[tuple[str, str]]:
    """Stages (name, SQL) of: clip at five median deviations (1 % and 99 % if none), weighted mean, plain deviation."""
    d = f"partition by {date}"
    return [
        ("_med", f"percentile({x}, 0.5) over ({d})"),
        ("_mad", f"percentile(abs({x} - _med), 0.5) over ({d})"),
        ("_q", f"percentile({x}, array(0.01, 0.99)) over ({d})"),
        ("_lo", "case when _mad > 0 then _med - 5 * 1.4826 * _mad else _q[0] end"),
        ("_hi", "case when _mad > 0 then _med + 5 * 1.4826 * _mad else _q[1] end"),
        ("_c", f"case when {x} is not null then least(greatest({x}, _lo), _hi) end"),
        ("_wm", f"sum(case when _c is not null then {weight} * _c end) over ({d}) / nullif(sum(case when _c is not null then {weight} end) over ({d}), 0)"),
        ("_sd", f"stddev_samp(_c) over ({d})"),
        (f"{x}_z", "case when _c is not null then case when _sd > 1e-12 then (_c - _wm) / _sd else 0e0 end end"),
    ]


def apply_stages(frame: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    keep = frame.columns
    for name, sql in stages:
        frame = frame.withColumn(name, F.expr(sql))
    return frame.select(*keep, stages[-1][0])


# ---------------------------------------------------------------- regressions

RESULT = "date date, kind string, name string, value double"


def _solve(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weighted least squares: coefficients, weighted R squared, condition number."""
    root = np.sqrt(w / w.mean())
    xw = x * root[:, None]
    beta = np.linalg.lstsq(xw, y * root, rcond=None)[0]
    error, centre = y - x @ beta, np.average(y, weights=w)
    total = float((w * (y - centre) ** 2).sum())
    return beta, 1 - float((w * error**2).sum()) / total if total > 0 else np.nan, float(np.linalg.cond(xw))


def _huber(y: np.ndarray, x: np.ndarray, w: np.ndarray, k: float = 1.345, rounds: int = 4) -> tuple[np.ndarray, float, float]:
    now = w
    for _ in range(rounds):
        beta, _, cond = _solve(y, x, now)
        e = y - x @ beta
        scale = 1.4826 * np.median(np.abs(e - np.median(e)))
        if scale <= 1e-12:
            break
        now = w * np.minimum(1.0, k * scale / np.maximum(np.abs(e), 1e-300))
    e, centre = y - x @ beta, np.average(y, weights=w)
    total = float((w * (y - centre) ** 2).sum())
    return beta, 1 - float((w * e**2).sum()) / total if total > 0 else np.nan, cond


def factor_regression(panel: DataFrame, y: str, styles: Sequence[str], group: str, weight: str, code: str = "code", date: str = "date", least: int = 30, method: str = "wls", constrained: bool = False, root: bool = True) -> DataFrame:
    """Per date: y on a country term, styles and groups; long rows (date, kind, name, value).

    kind: factor (returns), residual (by code), stat (r2, condition, n, status by name).
    Plain: groups as dummies, the first left out.  Constrained: all groups, with their
    weighted returns summing to zero, solved in the null space of that constraint.  Styles are
    standardised by date and dropped where less than half of all the date's rows have them,
    missing values count as zero.  Rows are weighted by the square root of ``weight`` (root),
    by 1 where that is missing or not positive; in the constraint groups weigh by the sum of
    ``weight`` itself, over rows where it is positive.
    Dates with too few rows give a status only.
    """
    if method not in ("wls", "huber"):
        raise ValueError("method is wls or huber")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        day, out = key[0], []
        put = lambda kind, name, value: out.append((day, kind, str(name), float(value)))
        d = pdf.dropna(subset=[y, group])
        d = d[np.isfinite(d[y]) & ((d[weight] > 0) if constrained else True)].sort_values(code)
        used = [s for s in styles if len(d) and pdf[s].notna().mean() >= 0.5]
        groups = sorted(d[group].unique())
        if len(d) < max(least, len(used) + len(groups) + 5):
            put("stat", "failed_too_few_rows", len(d))
            return pd.DataFrame(out, columns=["date", "kind", "name", "value"])
        z = np.column_stack([((s := d[c].astype(float)) - s.mean()).fillna(0) / (s.std() if s.std() > 1e-12 else 1.0) for c in used]) if used else np.empty((len(d), 0))
        dummies = (d[group].to_numpy()[:, None] == np.array(groups)[None, :]).astype(float)
        size, target = np.nan_to_num(d[weight].to_numpy(float, na_value=np.nan)), d[y].to_numpy(float)
        w = np.sqrt(np.maximum(size, 0.0)) if root else size
        w = np.where(np.isfinite(w) & (w > 0), w, 1.0)
        solve = _huber if method == "huber" else _solve
        ones = np.ones((len(d), 1))
        if constrained:
            x = np.hstack([ones, z, dummies])
            rule = np.concatenate([np.zeros(1 + z.shape[1]), size @ dummies / size.sum()])
            basis = np.linalg.svd(rule[None, :])[2][1:].T
            gamma, r2, cond = solve(target, x @ basis, w)
            beta, names = basis @ gamma, ["country", *used, *(f"{group}_{g}" for g in groups)]
        else:
            x = np.hstack([ones, z, dummies[:, 1:]])
            beta, r2, cond = solve(target, x, w)
            names = ["country", *used, *(f"{group}_{g}" for g in groups[1:])]
        for name, b in zip(names, beta):
            put("factor", name, b)
        for c, e in zip(d[code], target - x @ beta):
            put("residual", c, e)
        put("stat", "r2", r2)
        put("stat", "condition", cond)
        put("stat", "n", len(d))
        return pd.DataFrame(out, columns=["date", "kind", "name", "value"])

    cols = [date, code, y, group, weight, *styles]
    return panel.select(F.col(date).alias("date"), *[c for c in cols if c != date]).groupBy("date").applyInPandas(run, RESULT)


def regression_residual(panel: DataFrame, y: str, xs: Sequence[str], weight: str | None = None, date: str = "date", code: str = "code", name: str = "resid") -> DataFrame:
    """(code, date, name): residual of y on xs with an intercept per date, null where a column is; more rows than columns are needed."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[[y, *xs]].notna().all(axis=1) & ((pdf[weight] > 0) if weight else True)
        e = pd.Series(np.nan, index=pdf.index)
        if ok.sum() > len(xs) + 1:
            d = pdf[ok]
            x = np.column_stack([np.ones(len(d)), *[d[c].to_numpy(float) for c in xs]])
            root = np.sqrt(d[weight].to_numpy(float)) if weight else np.ones(len(d))
            beta = np.linalg.lstsq(x * root[:, None], d[y].to_numpy(float) * root, rcond=None)[0]
            e[ok] = d[y].to_numpy(float) - x @ beta
        return pd.DataFrame({"code": pdf[code], "date": pdf["date"], name: e.astype(object).where(e.notna(), None)})

    kind = panel.schema[code].dataType.simpleString()
    cols = dict.fromkeys([code, y, *xs, *([weight] if weight else [])])
    return panel.select(F.col(date).alias("date"), *cols).groupBy("date").applyInPandas(run, f"code {kind}, date date, {name} double")


# ---------------------------------------------------------------- covariances


def psd(m: np.ndarray, least: float = 0.0) -> np.ndarray:
    v, u = np.linalg.eigh((m + m.T) / 2)
    return (u * np.maximum(v, least)) @ u.T


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to its mean variance, and the shrinkage (Ledoit and Wolf 2004)."""
    x = np.nan_to_num(x) - np.nan_to_num(x).mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, ((x**2).T @ (x**2) / n - s**2).sum() / (n * p))
    k = 0.0 if delta <= 0 else beta / delta
    return (1 - k) * s + k * mu * np.eye(p), float(k)


def ewma_newey_west(x: np.ndarray, half_life: float = 90, lags: int = 2) -> np.ndarray:
    """Exponentially weighted covariance with Bartlett-weighted lags, projected to be positive semi-definite."""
    n = len(x)
    w = 0.5 ** (np.arange(n)[::-1] / half_life)
    w /= w.sum()
    c = x - w @ x
    out = (c * w[:, None]).T @ c
    for k in range(1, lags + 1):
        g = (c[k:] * (w[k:] / w[k:].sum())[:, None]).T @ c[:-k]
        out += (1 - k / (lags + 1)) * (g + g.T)
    return psd(out)


def eigenfactor_adjust(base: np.ndarray, history: int, simulations: int = 500, half_life: float = 90, lags: int = 2, seed: int = 729) -> np.ndarray:
    """Scales eigenvalues by the mean, clipped to [0.5, 2], of what simulated eigenportfolios really vary over what they seem to."""
    base = psd(base)
    v, u = (x[..., ::-1] for x in np.linalg.eigh(base))  # largest first
    mix = u * np.sqrt(np.maximum(v, 0.0))
    rng, bias = np.random.default_rng(seed), np.zeros(len(v))
    for _ in range(simulations):
        seen, axes = (x[..., ::-1] for x in np.linalg.eigh(ewma_newey_west(rng.standard_normal((history, len(v))) @ mix.T, half_life, lags)))
        real = np.einsum("ij,ik,kj->j", axes, base, axes)
        bias += np.divide(real, seen, out=np.ones(len(v)), where=seen > 1e-20)
    scale = np.clip(bias / max(simulations, 1), 0.5, 2.0)
    return psd((u * np.maximum(v * scale, 0.0)) @ u.T)


def variance_of(exposures: DataFrame, covariance: DataFrame) -> DataFrame:
    """(date, variance): the quadratic form of (date, factor, x) with an upper triangle of one window."""
    a, b = (exposures.select("date", F.col("factor").alias(f"factor_{k}"), F.col("x").alias(f"x_{k}")) for k in "ij")
    both = covariance.join(a, ["date", "factor_i"]).join(b, ["date", "factor_j"])
    term = F.col("x_i") * F.col("x_j") * F.col("covariance") * F.when(F.col("factor_i") == F.col("factor_j"), 1.0).otherwise(2.0)
    return both.groupBy("date").agg(F.sum(term).alias("variance"))


# ---------------------------------------------------------------- specific risk and calibration


def frequency_blend(daily: str, monthly: str, quarterly: str, weights: Sequence[float] = (0.5, 0.3, 0.2)) -> Column:
    """Mean of the variances that a row has, by weight."""
    return blend(dict(zip((daily, monthly, quarterly), weights)), 0.0)


def complete_periods(returns: DataFrame, value: str, period: str = "month", least: float = 0.6, code: str = "code", date: str = "date") -> DataFrame:
    """Sum and count of ``value`` by code and period with enough of the market's dates; the last period is left out as it may go on."""
    p = returns.withColumn("period", F.date_trunc(period, date).cast("date"))
    days = p.groupBy("period").agg(F.countDistinct(date).alias("days"))
    last = p.agg(F.max("period").alias("_last"))
    out = p.groupBy(code, "period").agg(F.sum(value).alias("total"), F.count(value).alias("n")).join(days, "period")
    out = out.join(F.broadcast(last), F.col("period") < F.col("_last"))  # one row
    return out.withColumn("completeness", F.col("n") / F.col("days")).where(F.col("completeness") >= least).drop("_last")


def shrink(frame: DataFrame, variance: str, group: str, size: str, history: str, target: float = 252, least: float = 0.2, members: int = 5, buckets: int = 5, date: str = "date") -> DataFrame:
    """Adds shrunk: variance blended with the median of its (group, size bucket), else group, else market, by length of history."""
    f = frame.withColumn("_b", F.when(F.col(size).isNotNull(), F.ntile(buckets).over(Window.partitionBy(date).orderBy(size, history))))

    def prior(*by: str) -> Column:
        w = ", ".join(by)
        return F.expr(f"case when count({variance}) over (partition by {w}) >= {members} then percentile({variance}, 0.5) over (partition by {w}) end")

    market = F.expr(f"percentile({variance}, 0.5) over (partition by {date})")
    f = f.withColumn("_p", F.coalesce(prior(date, group, "_b"), prior(date, group), market))
    r = F.greatest(F.lit(least), F.least(F.lit(1.0), F.col(history) / target))
    return f.withColumn("shrunk", F.when(F.col(variance).isNotNull(), r * F.col(variance) + (1 - r) * F.col("_p")).otherwise(F.col("_p"))).drop("_b", "_p")


def calibration(frame: DataFrame, realised: str, predicted: str, by: list[str], eps: float = 1e-12) -> DataFrame:
    """Bias ratio, mean absolute log error and quasi-likelihood of variances by group."""
    a, p = F.greatest(F.col(realised), F.lit(eps)), F.greatest(F.col(predicted), F.lit(eps))
    r = a / p
    ok = frame.where(F.col(realised).isNotNull() & F.col(predicted).isNotNull())
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(realised) / F.greatest(F.sum(predicted), F.lit(eps))).alias("bias"), F.avg(F.abs(F.log(r))).alias("abs_log_error"), F.avg(r - F.log(r) - 1).alias("qlike"))


def rolling_multiplier(frame: DataFrame, realised: str, predicted: str, by: str, date: str, window: int, lo: float = 0.25, hi: float = 4.0) -> DataFrame:
    """Adds multiplier: realised over predicted sums of the last ``window`` rows, clipped."""
    w = Window.partitionBy(by).orderBy(date).rowsBetween(-(window - 1), 0)
    mp = min(window, max(5, window // 4))
    ratio = F.sum(realised).over(w) / F.when(F.sum(predicted).over(w) > 1e-12, F.sum(predicted).over(w))
    return frame.withColumn("multiplier", F.when(F.count(realised).over(w) >= mp, F.greatest(F.lit(lo), F.least(F.lit(hi), ratio))))


def effective_sample_size(w: str) -> Column:
    return F.pow(F.sum(w), 2) / F.sum(F.col(w) * F.col(w))


def weighted_r2(y: str, fitted: str, w: str) -> Column:
    """1 - weighted error over weighted variance, as an aggregate of sums."""
    sw, sy, syy = F.sum(w), F.sum(F.col(w) * F.col(y)), F.sum(F.col(w) * F.col(y) * F.col(y))
    total = syy - sy * sy / sw
    return F.when(total > 1e-14, 1 - F.sum(F.col(w) * F.pow(F.col(y) - F.col(fitted), 2)) / total)
