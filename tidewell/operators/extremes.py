"""Signals from the extremes of a window, and rolling fits that have no native frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_extreme(pairs: str, n: int, largest: bool) -> str:
    """SQL: sum of the values of the n pairs with the largest (or smallest) keys, weighted 2 ** (-i / n); null with fewer than n.

    pairs: an array of (key, date, value) without nulls; equal keys go by date.
    """
    sign = "case when a.k > b.k then -1 when a.k < b.k then 1" if largest else "case when a.k < b.k then -1 when a.k > b.k then 1"
    ordered = f"slice(array_sort({pairs}, (a, b) -> {sign} when a.d < b.d then -1 when a.d > b.d then 1 else 0 end), 1, {n})"
    return f"case when size({pairs}) >= {n} then aggregate(transform({ordered}, (e, i) -> pow(2e0, -i / cast({n} as double)) * e.v), 0e0, (s, x) -> s + x) end"


def co_momentum(panel: DataFrame, window: int = 20, momentum: int = 5, reversal: int = 15, code: str = "code", date: str = "date") -> DataFrame:
    """Seven signals of (ret, turnover_key, group_ret, market_ret) over full windows of rows.

    Group and market returns on the days of the stock's extreme returns or turnover.
    """
    w = f"over (partition by {code} order by {date} rows between {window - 1} preceding and current row)"

    def pairs(key: str, value: str) -> str:
        return f"filter(collect_list(named_struct('k', {key}, 'd', {date}, 'v', {value})) {w}, p -> p.k is not null and p.v is not null)"

    lists = {"gr": pairs("ret", "group_ret"), "gt": pairs("turnover_key", "group_ret"), "mt": pairs("turnover_key", "market_ret")}
    p = panel.select("*", F.expr(f"count(1) {w}").alias("_n"), *[F.expr(v).alias(f"_{k}") for k, v in lists.items()])
    e = lambda k, n, largest: F.expr(f"case when _n >= {window} then {weighted_extreme('_' + k, n, largest)} end")
    out = p.select(code, date, e("gr", 1, True).alias(f"imax{window}"), e("gr", momentum, True).alias("icm"), e("gt", momentum, True).alias("vicm"), e("gr", reversal, False).alias("icr"), e("gt", reversal, False).alias("vicr"), (e("mt", momentum, True) - e("mt", reversal, False)).alias("mcmc"))
    return out.withColumn("cmc", F.col("vicm") - F.col("vicr"))


def rolling_poly_resid(panel: DataFrame, y: str, x: str, window: int, degree: int = 2, least: int | None = None, code: str = "code", date: str = "date", name: str = "resid") -> DataFrame:
    """(code, date, name): the last point's residual of a polynomial fit over the window's valid pairs; null with too few or at a null point."""
    need = max(least or window, degree + 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        a, b = (np.concatenate([np.full(window - 1, np.nan), pdf[c].to_numpy(float, na_value=np.nan)]) for c in (x, y))
        out = np.full(len(pdf), np.nan)
        ok = np.isfinite(a) & np.isfinite(b)
        there = np.lib.stride_tricks.sliding_window_view(ok, window)
        at = np.flatnonzero(there[:, -1] & (there.sum(axis=1) >= need))
        u, v = (np.lib.stride_tricks.sliding_window_view(np.where(ok, c, 0.0), window) for c in (a, b))
        for part in np.array_split(at, max(1, len(at) * window // (1 << 20))):  # all windows of a part at once
            m, n = there[part].astype(float), there[part].sum(axis=1)[:, None]
            c = (u[part] * m).sum(axis=1, keepdims=True) / n
            s = np.sqrt((m * (u[part] - c) ** 2).sum(axis=1, keepdims=True) / n)
            basis = ((u[part] - c) / np.where(s > 0, s, 1.0))[:, :, None] ** np.arange(degree + 1) * m[:, :, None]  # centred for well-posed equations
            mean = (v[part] * m).sum(axis=1, keepdims=True) / n
            right = np.einsum("nwi,nw->ni", basis, (v[part] - mean) * m)
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(np.einsum("nwi,nwj->nij", basis, basis), rcond=1e-12, hermitian=True), right)
            out[part] = v[part][:, -1] - mean[:, 0] - np.einsum("ni,ni->n", basis[:, -1], beta)
        return pd.DataFrame({"code": pdf[code], "date": pdf[date], name: pd.Series(out, pdf.index).astype(object).where(~np.isnan(out), None)})

    kind = panel.schema[code].dataType.simpleString()
    return panel.select(code, date, x, y).groupBy(code).applyInPandas(run, f"code {kind}, date date, {name} double")


def drift_weights(snapshots: DataFrame, prices: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, weight): snapshot weights moved by price since the snapshot, summing to 100 on each date of ``prices`` until the next snapshot.

    A missing price keeps the last one; a code without a price since the snapshot is left out.
    """
    from pyspark.sql import Window

    spans = snapshots.select(F.col(date).alias("since")).distinct().withColumn("until", F.lead("since").over(Window.orderBy("since")))
    days = prices.select(date).distinct().join(F.broadcast(spans), (F.col(date) >= F.col("since")) & (F.col("until").isNull() | (F.col(date) < F.col("until"))))  # snapshots are a small dimension
    grid = days.join(snapshots.select(F.col(date).alias("since"), code, F.col("weight").alias("base")), "since")
    x = grid.join(prices.select(code, date, "close"), [code, date], "left")
    w = Window.partitionBy("since", code).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_p", F.last("close", ignorenulls=True).over(w)).withColumn("_b", F.first("close", ignorenulls=True).over(w)).where("_p is not null and _b > 0")
    x = x.withColumn("_w", F.col("base") * F.col("_p") / F.col("_b"))
    return x.select(code, date, (F.col("_w") / F.sum("_w").over(Window.partitionBy(date)) * 100).alias("weight"))
