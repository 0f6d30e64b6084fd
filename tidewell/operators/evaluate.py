"""Evaluation of signals: information coefficients, groups, turnover, correlation, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.ranks import share_ranks


def pct_rank(x: Column, *by: str) -> Column:
    """Average rank by count of values, null where x is null."""
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*by)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson of pairs as an aggregate, null where a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sd = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(sd > 1e-14, F.covar_samp(x, y) / sd)


def daily_ic(panel: DataFrame, signals: list[str], label: str = "label", date: str = "date", least: int = 3) -> DataFrame:
    """(date, factor, n, ic, rank_ic) of all signals in one job: unpivoted, ranked over each factor's own pairs."""
    long = panel.where(F.col(label).isNotNull()).unpivot([date, label], signals, "factor", "x").where("x is not null")
    ranked = long.select(date, "factor", "x", F.col(label).alias("y"), pct_rank(F.col("x"), date, "factor").alias("rx"), pct_rank(F.col(label), date, "factor").alias("ry"))
    out = ranked.groupBy(date, "factor").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("ic"), correlation(F.col("rx"), F.col("ry")).alias("rank_ic"))
    return out.where(F.col("n") >= least)


def ic_summary(ic: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, deviation, ratio and share of positive days of ic and rank_ic."""
    cols = []
    for c in ("ic", "rank_ic"):
        mean, std = F.avg(c), F.stddev_samp(c)
        cols += [mean.alias(f"{c}_mean"), std.alias(f"{c}_std"), (mean / (std + 1e-9)).alias(f"{c}_ir"), F.avg((F.round(c, 12) > 0).cast("double")).alias(f"{c}_positive")]
    return ic.groupBy(*(by or ["factor"])).agg(F.count(F.lit(1)).alias("days"), *cols)


def group_returns(panel: DataFrame, factor: str, label: str = "label", groups: int = 5, date: str = "date", code: str = "code") -> DataFrame:
    """Mean label of equal groups by factor, per date with at least five rows a group; rank ties go by code.  Adds top minus bottom."""
    p = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    w, all_ = Window.partitionBy(date).orderBy(factor, code), Window.partitionBy(date)
    p = p.withColumn("_n", F.count(F.lit(1)).over(all_)).where(F.col("_n") >= 5 * groups)
    p = p.withColumn("g", F.least(F.floor(F.row_number().over(w) / F.col("_n") * groups), F.lit(groups - 1)).cast("int"))
    out = p.groupBy(date).pivot("g", list(range(groups))).agg(F.avg(label))
    out = out.select(date, *[F.col(str(k)).alias(f"g{k}") for k in range(groups)])
    return out.withColumn("long_short", F.col(f"g{groups - 1}") - F.col("g0"))


def quantile_groups(panel: DataFrame, factor: str, groups: int = 5, date: str = "date") -> DataFrame:
    """Adds the right-closed quantile bin of each value; equal edges are one."""
    qs = ", ".join(str(k / groups) for k in range(groups + 1))
    p = panel.withColumn("_e", F.array_distinct(F.expr(f"percentile({factor}, array({qs})) over (partition by {date})")))
    return p.withColumn("bin", F.expr(f"case when {factor} is not null then greatest(size(filter(_e, e -> e < {factor})) - 1, 0) end")).drop("_e")


def turnover(weights: DataFrame, code: str = "code", date: str = "date", weight: str = "w") -> DataFrame:
    """Half the sum of absolute changes from one date's weights to the next one's, over the codes of either."""
    days = weights.select(date).distinct().select(date, F.row_number().over(Window.orderBy(date)).alias("_n"))
    x = weights.join(days, date).select("_n", F.col(code).alias("_c"), F.col(weight).alias("_w"))
    before = x.select((F.col("_n") + 1).alias("_n"), "_c", F.col("_w").alias("_b"))
    both = x.join(before, ["_n", "_c"], "full").groupBy("_n").agg((F.sum(F.abs(F.coalesce("_w", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("turnover"))
    return both.where("_n > 1").join(days, "_n").select(date, "turnover")


PAIRS = "i int, j int, total double, n long, sums array<double>"


def _gram(r: np.ndarray, m: np.ndarray, left: slice, right: slice) -> np.ndarray:
    """Over rows where both columns have values, for each pair: their number, both sums, both sums of squares, the sum of products."""
    a, b, ma, mb = r[:, left], r[:, right], m[:, left], m[:, right]
    return np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])


def _pearson(g: np.ndarray, least: int) -> np.ndarray:
    """Correlations from sums, nan with fewer than ``least`` rows or without spread."""
    n = np.where(g[0] > 0, g[0], np.nan)
    va, vb, c = g[3] - g[1] ** 2 / n, g[4] - g[2] ** 2 / n, g[5] - g[1] * g[2] / n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((g[0] >= least) & (va > 1e-12) & (vb > 1e-12), c / np.sqrt(va * vb), np.nan)


def rank_correlation(panel: DataFrame, signals: list[str], date: str = "date", code: str = "code", least: int = 20, pooled: bool = False, block: int = 512) -> DataFrame:
    """(left, right, mean_abs or correlation): Spearman correlations of all pairs of signals.

    Each date's signals are ranked over its values.  By date: the mean over dates of the
    absolute correlation over rows that have both, where those are ``least`` or more.
    ``pooled``: one Pearson correlation of the ranks of all dates.

    Values that agree in 40 bits tie.  A row's signals are one array.  A task takes whole dates, ranks a date once and adds up Gram
    matrices of blocks of signals, so what it sends on has one row a pair, whatever the rows;
    beyond ``block`` signals, pairs of blocks are dealt to tasks of their own.
    """
    k = len(signals)
    cuts = [slice(lo, min(lo + block, k)) for lo in range(0, k, block)]
    todo = [(p, q) for p in range(len(cuts)) for q in range(p, len(cuts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        day, part, rows = None, None, []

        def close() -> None:
            if not rows:
                return
            p, q = todo[part]
            x = np.array(rows, float)
            g = _gram(np.nan_to_num(share_ranks(x) - 0.5), (~np.isnan(x)).astype(float), slice(0, cuts[p].stop - cuts[p].start), slice(0 if p == q else cuts[p].stop - cuts[p].start, x.shape[1]))
            if pooled:
                held[part] = [held[part][0] + g] if part in held else [g]
            else:
                c = np.abs(_pearson(g, least))
                sums = held.setdefault(part, [np.zeros(c.shape), np.zeros(c.shape, np.int64)])
                sums[0] += np.nan_to_num(c)
                sums[1] += ~np.isnan(c)
            rows.clear()

        for b in batches:
            for d, t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (d, t) != (day, part):
                    close()
                    day, part = d, t
                rows.append(v)
        close()
        for t, sums in held.items():
            p, q = todo[t]
            i, j = np.indices(sums[0].shape[-2:]).reshape(2, -1)
            up = (p < q) | (i < j)
            i, j = i[up], j[up]
            total, n, g = (np.zeros(len(i)), np.zeros(len(i), np.int64), sums[0][:, i, j].T) if pooled else (sums[0][i, j], sums[1][i, j], np.zeros((len(i), 0)))
            yield pa.record_batch([pa.array((i + cuts[p].start).astype(np.int32)), pa.array((j + cuts[q].start).astype(np.int32)), pa.array(total), pa.array(n), pa.array(list(g), pa.list_(pa.float64()))], ["i", "j", "total", "n", "sums"])

    block_of = lambda c: F.array(*[F.col(f).cast("double") for f in signals[c]])
    parts = F.array(*[F.struct(F.lit(t).alias("part"), (block_of(cuts[p]) if p == q else F.concat(block_of(cuts[p]), block_of(cuts[q]))).alias("v")) for t, (p, q) in enumerate(todo)])
    rows = panel.select(F.col(date).alias("date"), F.explode(parts).alias("x")).select("date", "x.part", "x.v")
    sums = rows.repartition("date", "part").sortWithinPartitions("part", "date").mapInArrow(run, PAIRS)
    name = F.create_map(*[x for i, s in enumerate(signals) for x in (F.lit(i), F.lit(s))])
    left, right = name[F.col("i")].alias("left"), name[F.col("j")].alias("right")
    if not pooled:
        by = sums.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        return by.select(left, right, F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean_abs"))
    by = sums.groupBy("i", "j").agg(*[F.sum(F.col("sums")[m]).alias(c) for m, c in enumerate(("n", "a", "b", "aa", "bb", "ab"))])
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    c = F.when((F.col("n") >= least) & (va > 1e-12) & (vb > 1e-12), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb))
    return by.select(left, right, c.alias("correlation"))


def select_signals(scores: DataFrame, panel: DataFrame, limit: float = 0.9, least: int = 20, date: str = "date") -> list[str]:
    """Names of scores (factor, passed, and what to sort by, falling), each kept if no kept one's pooled rank correlation is beyond ``limit``.

    An unknown correlation is none.  Only names and correlations reach the driver.
    """
    order = [c for c in scores.columns if c not in ("factor", "passed")]
    names = [r["factor"] for r in scores.where("passed").orderBy(*[F.desc_nulls_last(c) for c in order], "factor").collect() if r["factor"] in panel.columns]
    if len(names) < 2:
        return names
    known = {frozenset((r["left"], r["right"])): r["correlation"] for r in rank_correlation(panel, names, date, least=least, pooled=True).collect()}
    kept: list[str] = []
    for name in names:
        if all(abs(known[frozenset((name, k))] or 0.0) <= limit for k in kept):
            kept.append(name)
    return kept


def greedy_select(scores: dict[str, float], correlation_of: dict[tuple[str, str], float], limit: float = 0.85) -> list[str]:
    """Names by score, each kept if it correlates below ``limit`` with all kept; a few hundred names, on the driver."""
    kept: list[str] = []
    for name in sorted(scores, key=lambda k: (-scores[k], k)):
        if all(abs(correlation_of.get((name, k), correlation_of.get((k, name), 0.0))) < limit for k in kept):
            kept.append(name)
    return kept


def validate(ic: DataFrame, splits: dict[str, tuple[str, str]], least: float = 0.0) -> DataFrame:
    """(factor, rank_ic by split, direction by the first split, least adjusted rank_ic, passed)."""
    names = list(splits)
    parts = [F.avg(F.when((F.col("date") >= F.lit(a).cast("date")) & (F.col("date") < F.lit(b).cast("date")), F.col("rank_ic"))).alias(k) for k, (a, b) in splits.items()]
    out = ic.groupBy("factor").agg(*parts).withColumn("direction", F.signum(names[0]))
    low = F.least(*[F.col(k) * F.col("direction") for k in names]) if len(names) > 1 else F.col(names[0]) * F.col("direction")
    return out.withColumn("min_adjusted", low).withColumn("passed", F.coalesce(low > least, F.lit(False)))


def composite_score(panel: DataFrame, signals: list[str], date: str = "date", name: str = "score") -> DataFrame:
    """Mean of the signals' ranks less one half, over those that a row has."""
    ranks = panel.select("*", *[(pct_rank(F.col(f), date) - 0.5).alias(f"_r{i}") for i, f in enumerate(signals)])
    cols = [F.col(f"_r{i}") for i in range(len(signals))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return ranks.withColumn(name, F.when(n > 0, total / n)).drop(*[f"_r{i}" for i in range(len(signals))])


def performance(returns: DataFrame, value: str, by: list[str], per_year: int = 252) -> DataFrame:
    """Total and annual return, deviation, information ratio, win rate, skew (of samples, from three values on) and quantiles by group."""
    n, mean, std = F.count(value), F.avg(value), F.stddev_samp(value)
    growth = F.exp(F.sum(F.log1p(value)))
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return returns.where(F.col(value).isNotNull()).groupBy(*by).agg(n.alias("n"), (growth - 1).alias("total"), (F.pow(growth, per_year / n) - 1).alias("annual"), (std * per_year**0.5).alias("deviation"), F.when(std > 1e-12, mean / std * per_year**0.5).alias("ratio"), F.when((n >= 3) & (std > 1e-12), F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def drawdown(returns: DataFrame, value: str, date: str, by: list[str]) -> DataFrame:
    """The deepest fall of compounded value from its peak, by group."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    nav = returns.withColumn("_nav", F.exp(F.sum(F.log1p(F.coalesce(value, F.lit(0.0)))).over(w)))
    nav = nav.withColumn("_dd", F.col("_nav") / F.greatest(F.max("_nav").over(w), F.lit(1.0)) - 1)
    return nav.groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))
