"""Weights and backtests: capping, score tilts, the constrained optimiser, closed-form paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap_and_normalise(w: np.ndarray, cap: float | None) -> np.ndarray:
    """Non-negative weights of sum one, none above ``cap`` where that is possible; the excess goes to the rest in proportion."""
    w = np.clip(np.nan_to_num(np.asarray(w, float)), 0, None)
    w = np.full(len(w), 1 / len(w)) if w.sum() <= 0 else w / w.sum()
    if cap is None or cap * len(w) < 1:
        return w
    fixed = np.zeros(len(w), bool)
    while True:
        over = ~fixed & (w > cap + 1e-15)
        if not over.any():
            return w
        fixed |= over
        w[fixed] = cap
        free = w[~fixed].sum()
        if free <= 0:
            w[~fixed] = (1 - cap * fixed.sum()) / max(1, (~fixed).sum())
            return w
        w[~fixed] *= (1 - cap * fixed.sum()) / free


def score_tilt(panel: DataFrame, score: str, base: str, strength: float = 0.5, cap: float = 0.02, date: str = "date", code: str = "code") -> DataFrame:
    """(code, date, w): base weights times exp(strength * z of score, clipped at 4), capped, by date."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf[score].astype(float)
        sd = s.std(ddof=0)
        z = ((s - s.mean()) / sd if sd and sd > 1e-12 else s * 0).fillna(0).clip(-4, 4)
        return pd.DataFrame({"code": pdf[code], "date": pdf["date"], "w": cap_and_normalise(pdf[base].fillna(0).to_numpy(float) * np.exp(strength * z.to_numpy(float)), cap)})

    kind = panel.schema[code].dataType.simpleString()
    return panel.select(code, F.col(date).alias("date"), score, base).groupBy("date").applyInPandas(run, f"code {kind}, date date, w double")


@dataclass(frozen=True)
class Limits:
    max_weight: float = 0.02
    max_active: float = 0.008
    active_share: float = 0.2
    group_active: float = 0.015
    style_active: float = 0.2


def project(active: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A point with sum zero inside the box: what is over or missing is spread in proportion to the room of each."""
    x = np.clip(active, lower, upper)
    for _ in range(rounds):
        over = x.sum()
        room = np.maximum(x - lower if over > 0 else upper - x, 0.0)
        if abs(over) < 1e-12 or room.sum() <= 1e-12:
            break
        x = np.clip(x - np.sign(over) * min(abs(over), room.sum()) * room / room.sum(), lower, upper)
    return x


def standard(x: np.ndarray) -> np.ndarray:
    """Mean zero and deviation one (only the mean where all are equal); what isn't finite counts as the median."""
    x = np.where(np.isfinite(x), x, np.nan)
    x = np.where(np.isnan(x), np.nanmedian(x) if not np.isnan(x).all() else 0.0, x)
    deviation = x.std()
    return (x - x.mean()) / (deviation if deviation > 1e-12 else 1.0)


def optimise(panel: DataFrame, alpha: str, bench: str, group: str, styles: Sequence[str], limits: Limits = Limits(), date: str = "date", code: str = "code") -> DataFrame:
    """(code, date, w): benchmark plus an active tilt to alpha, per date.

    alpha is standardised and freed of groups and styles, scaled to the active share, projected
    on sum zero inside each code's bounds, then shrunk as a whole until active share, groups
    and styles are in their limits; projection and shrinking run twice.  Weights are cut to
    0 and the largest weight allowed, and sum to one.  A null alpha counts as zero, a null
    group as a group.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(code)
        b = np.clip(np.nan_to_num(d[bench].to_numpy(float)), 0, None)
        b = b / b.sum() if b.sum() > 0 else np.full(len(d), 1 / len(d))
        a = d[alpha].to_numpy(float, na_value=np.nan)
        a = standard(np.where(np.isfinite(a), a, 0.0))
        names = d[group].astype(object).where(d[group].notna(), "unknown").astype(str).to_numpy()
        g = (names[:, None] == np.unique(names)[None, :]).astype(float)
        raw = d[list(styles)].to_numpy(float, na_value=np.nan) if styles else np.empty((len(d), 0))
        x = np.hstack([np.ones((len(d), 1)), g[:, 1:], *(standard(c)[:, None] for c in raw.T)])
        a = standard(a - x @ np.linalg.lstsq(x, a, rcond=None)[0])
        s = np.where(np.isfinite(raw), raw, 0.0)
        lower = np.maximum(-b, -limits.max_active)
        upper = np.maximum(np.minimum(limits.max_active, limits.max_weight - b), lower)
        x0 = a * 2 * limits.active_share / np.abs(a).sum() if a.std() > 1e-12 else np.zeros(len(a))
        for _ in range(2):
            x0 = project(x0, lower, upper)
            use = [(np.abs(x0).sum() / 2, limits.active_share), *((abs(v), limits.group_active) for v in x0 @ g), *((abs(v), limits.style_active) for v in x0 @ s)]
            k = min([1.0, *(0.995 * m / v for v, m in use if v > m)])
            x0 = x0 * k
        w = np.clip(b + x0, 0.0, limits.max_weight)
        return pd.DataFrame({"code": d[code], "date": d["date"], "w": w / w.sum()})

    kind = panel.schema[code].dataType.simpleString()
    cols = dict.fromkeys([code, alpha, bench, group, *styles])
    return panel.select(F.col(date).alias("date"), *cols).groupBy("date").applyInPandas(run, f"code {kind}, date date, w double")


def linear_weights(score: np.ndarray, group: np.ndarray, bench: np.ndarray, cap: float = 0.02, deviation: float = 0.03) -> np.ndarray | None:
    """The weights of largest score: sum one, each from 0 to ``cap``, each group within ``deviation`` of its benchmark; None if there are none.

    Boxes, group bounds and the sum are nested sets, so the greedy order is optimal: groups
    are filled to their lower bounds by their best scores, then the rest by score.
    """
    b = np.clip(np.nan_to_num(bench.astype(float)), 0, None)
    b = b / b.sum() if b.sum() > 0 else np.full(len(b), 1 / max(1, len(b)))
    names, at = np.unique(group.astype(str), return_inverse=True)
    target = np.bincount(at, b, len(names))
    low, high = np.maximum(target - deviation, 0), np.minimum(target + deviation, 1)
    order = np.lexsort((np.arange(len(score)), -np.nan_to_num(score.astype(float), nan=-np.inf)))
    w, used = np.zeros(len(score)), np.zeros(len(names))
    for k in order:
        give = min(cap, low[at[k]] - used[at[k]])
        if give > 0:
            w[k] = give
            used[at[k]] += give
    if (used < low - 1e-12).any() or used.sum() > 1 + 1e-12:
        return None
    left = 1 - used.sum()
    for k in order:
        give = min(cap - w[k], high[at[k]] - used[at[k]], left)
        if give > 0:
            w[k] += give
            used[at[k]] += give
            left -= give
    return w if left <= 1e-9 else None


def optimise_linear(panel: DataFrame, score: str, bench: str, group: str, cap: float = 0.02, deviation: float = 0.03, date: str = "date", code: str = "code") -> DataFrame:
    """(code, date, w) of linear_weights by date; dates without a solution give null weights."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(code)
        w = linear_weights(d[score].to_numpy(float), d[group].to_numpy(), d[bench].to_numpy(float), cap, deviation)
        return pd.DataFrame({"code": d[code], "date": d["date"], "w": [None] * len(d) if w is None else w})

    kind = panel.schema[code].dataType.simpleString()
    return panel.select(F.col(date).alias("date"), *dict.fromkeys([code, score, bench, group])).groupBy("date").applyInPandas(run, f"code {kind}, date date, w double")


def active_exposure(panel: DataFrame, weight: str, bench: str, styles: Sequence[str], date: str = "date") -> DataFrame:
    """Per date, sums of (weight less normalised benchmark) times each style; missing styles count as zero."""
    b = F.greatest(F.coalesce(bench, F.lit(0.0)), F.lit(0.0))
    total = F.sum(b).over(Window.partitionBy(date))
    p = panel.withColumn("_a", F.coalesce(weight, F.lit(0.0)) - F.when(total > 0, b / total).otherwise(b))
    return p.groupBy(date).agg(*[F.sum(F.col("_a") * F.coalesce(s, F.lit(0.0))).alias(s) for s in styles])


def rebalance_dates(dates: DataFrame, frequency: str = "month", date: str = "date") -> DataFrame:
    """The last date of each period."""
    return dates.groupBy(F.date_trunc(frequency, date).alias("_p")).agg(F.max(date).alias(date)).drop("_p")


def backtest(weights: DataFrame, returns: DataFrame, cost: float = 0.0005, date: str = "date", code: str = "code") -> DataFrame:
    """(date, gross, turnover, net) of weights set on some dates and drifting between them, without a daily loop.

    ``returns`` has (code, date, ret) with ret earned after the date.  A position's value is
    its weight times its growth since the rebalance; a date's return is the change of the
    sum.  Turnover at a rebalance compares with the drifted weights of the one before.
    """
    book = weights.select(F.col(date).alias("set")).distinct().withColumn("until", F.lead("set").over(Window.orderBy("set")))
    # each date's rebalance comes from the calendar, one row per date, so positions meet their own dates only
    days = returns.select(date, F.lit(None).cast("date").alias("set")).distinct().unionByName(weights.select(date, F.col(date).cast("date").alias("set")).distinct())
    days = days.groupBy(date).agg(F.max("set").alias("set")).withColumn("set", F.last("set", ignorenulls=True).over(Window.orderBy(date))).where("set is not null")
    r = returns.join(days, date).select("set", code, date, F.coalesce("ret", F.lit(0.0)).alias("ret"))
    held = weights.select(F.col(date).cast("date").alias("set"), code, "w").join(r, ["set", code])
    path = Window.partitionBy("set", code).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("v", F.col("w") * F.exp(F.coalesce(F.sum(F.log1p("ret")).over(path), F.lit(0.0))))
    daily = held.groupBy(date, "set").agg((F.sum(F.col("v") * F.col("ret")) / F.sum("v")).alias("gross"))
    last = held.groupBy("set", code).agg((F.first("w") * F.exp(F.sum(F.log1p("ret")))).alias("v")).join(book, "set")
    drifted = last.withColumn("d", F.col("v") / F.sum("v").over(Window.partitionBy("set"))).where("until is not null").select(F.col("until").alias(date), code, "d")
    change = weights.select(date, code, "w").join(drifted, [date, code], "full").groupBy(date).agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)))) / 2).alias("turnover"))
    out = daily.join(change, date, "left").withColumn("turnover", F.when(F.col("set") == F.col(date), F.col("turnover")).otherwise(0.0))
    return out.select(date, "gross", "turnover", (F.col("gross") - cost * F.col("turnover")).alias("net"))


def weight_diagnostics(weights: DataFrame, bench: str, group: str, date: str = "date") -> DataFrame:
    """Active share, largest active weight and largest group active weight by date."""
    a = weights.withColumn("a", F.col("w") - F.coalesce(bench, F.lit(0.0)))
    g = a.groupBy(date, group).agg(F.sum("a").alias("g")).groupBy(date).agg(F.max(F.abs("g")).alias("max_group_active"))
    s = a.groupBy(date).agg((F.sum(F.abs("a")) / 2).alias("active_share"), F.max(F.abs("a")).alias("max_active"))
    return s.join(g, date)
