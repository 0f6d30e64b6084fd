"""Reports over daily results: periods, distributions, stability, deciles, exposure, coverage and audits.

Inputs with a row for each date and code are reduced by date first; what is then compared
across dates (expanding sums, drawdowns) has a row for each date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.evaluate import correlation, pct_rank, quantile_groups

YEAR = 252
EPS = 1e-12


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _q(value: str, p: float) -> Column:
    return F.expr(f"percentile({value}, {p})")


def daily_factor_stats(panel: DataFrame, signals: list[str], label: str = "label", date: str = "date", groups: int = 5) -> DataFrame:
    """(date, factor, n, ic, rank_ic, top, bottom, long_short) of dates with 20 pairs or more.

    top and bottom are mean labels of the outer quantile bins; null where all values share one bin.
    All signals go through one job.  Rows with a null label or signal count for nothing.
    """
    long = panel.where(F.col(label).isNotNull()).select(date, F.col(label).alias("y"), *signals).unpivot([date, "y"], signals, "factor", "x").where("x is not null")
    by = Window.partitionBy(date, "factor")
    ranked = long.select(date, "factor", "x", "y", pct_rank(F.col("x"), date, "factor").alias("rx"), pct_rank(F.col("y"), date, "factor").alias("ry"))
    binned = quantile_groups(ranked.withColumn("_key", F.struct(date, "factor")), "x", groups, "_key")
    binned = binned.withColumn("_hi", F.max("bin").over(by)).withColumn("_lo", F.min("bin").over(by))
    split = F.col("_hi") > F.col("_lo")
    out = binned.groupBy(date, "factor").agg(
        F.count(F.lit(1)).alias("n"),
        correlation(F.col("x"), F.col("y")).alias("ic"),
        correlation(F.col("rx"), F.col("ry")).alias("rank_ic"),
        F.avg(F.when(split & (F.col("bin") == F.col("_hi")), F.col("y"))).alias("top"),
        F.avg(F.when(split & (F.col("bin") == F.col("_lo")), F.col("y"))).alias("bottom"),
    )
    return out.where(F.col("n") >= max(20, groups)).withColumn("long_short", F.col("top") - F.col("bottom"))


def period_stats(daily: DataFrame, horizon: int = 10, date: str = "date") -> DataFrame:
    """Rows of ``daily_factor_stats`` over the full span, each year, each month and the last year to date.

    One pass with grouping sets; period_type is full, year, month or ytd.  The ytd row is
    that of the last year of the whole input, under its own name.
    """
    last = daily.agg(F.year(F.max(date)).alias("_last"))  # one row
    d = daily.crossJoin(F.broadcast(last)).withColumn("_year", F.date_format(date, "yyyy")).withColumn("_month", F.date_format(date, "yyyy-MM"))
    d = d.withColumn("_ytd", F.when(F.year(date) == F.col("_last"), F.concat("_year", F.lit("_YTD"))))
    cols = [F.col(c) for c in ("_year", "_month", "_ytd")]
    sets = [[F.col("factor")], *[[F.col("factor"), c] for c in cols]]
    kind = F.when(F.grouping("_year") == 0, "year").when(F.grouping("_month") == 0, "month").when(F.grouping("_ytd") == 0, "ytd").otherwise("full")
    ic, rank, ls = F.col("ic"), F.col("rank_ic"), F.col("long_short")
    out = d.groupingSets(sets, F.col("factor"), *cols).agg(
        kind.alias("period_type"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.countDistinct(date).alias("n_dates"),
        F.avg("n").alias("n_avg"),
        F.avg(ic).alias("ic_mean"),
        (F.avg(ic) / (F.stddev_samp(ic) + 1e-9)).alias("ic_ir"),
        _share(ic > 0).alias("ic_positive"),
        F.avg(rank).alias("rank_ic_mean"),
        (F.avg(rank) / (F.stddev_samp(rank) + 1e-9)).alias("rank_ic_ir"),
        _share(rank > 0).alias("rank_ic_positive"),
        F.avg("top").alias("top_mean"),
        F.avg("bottom").alias("bottom_mean"),
        F.avg(ls).alias("long_short_mean"),
        F.sum(ls).alias("long_short_sum"),
        _share(ls > 0).alias("long_short_win_rate"),
    )
    out = out.withColumn("period", F.coalesce("_year", "_month", "_ytd", F.lit("full"))).where("period_type = 'full' or coalesce(_year, _month, _ytd) is not null")
    return out.drop("_year", "_month", "_ytd").withColumn("label_horizon", F.lit(horizon).cast("long"))


def performance_periods(returns: DataFrame, date: str = "date") -> DataFrame:
    """Statistics of active returns by year, quarter and month.

    ``returns`` has (date, portfolio, benchmark, active, turnover, rebalanced), one row per date.
    Each date goes to its three periods; drawdowns start anew in each period.  active_compound
    is the portfolio's growth over the benchmark's.  Null active returns count as days only.
    """
    month = F.date_format(date, "yyyy-MM")
    quarter = F.concat(F.date_format(date, "yyyy"), F.lit("Q"), F.quarter(date).cast("string"))
    keys = F.array(*[F.struct(F.lit(k).alias("period_type"), v.alias("period")) for k, v in (("year", F.date_format(date, "yyyy")), ("quarter", quarter), ("month", month))])
    d = returns.withColumn("_p", F.explode(keys)).select("_p.*", *[c for c in returns.columns])
    run = Window.partitionBy("period_type", "period").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_nav", F.when(F.col("active").isNotNull(), F.exp(F.sum(F.log1p("active")).over(run))))
    d = d.withColumn("_fall", F.col("_nav") / F.max("_nav").over(run) - 1)
    a, std = F.col("active"), F.stddev_samp("active")
    return d.groupBy("period_type", "period").agg(
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.count(F.lit(1)).alias("n_days"),
        F.count(F.when(a > 0, 1)).alias("win_days"),
        F.count(F.when(a == 0, 1)).alias("flat_days"),
        F.count(F.when(a < 0, 1)).alias("loss_days"),
        _share(a > 0).alias("win_rate"),
        F.avg(a).alias("active_mean"),
        _q("active", 0.5).alias("active_median"),
        std.alias("active_std"),
        F.sum(a).alias("active_sum"),
        (F.exp(F.sum(F.log1p("portfolio")) - F.sum(F.log1p("benchmark"))) - 1).alias("active_compound"),
        (std * YEAR**0.5).alias("tracking_error"),
        (F.avg(a) * YEAR / (std * YEAR**0.5 + EPS)).alias("information_ratio"),
        F.min("_fall").alias("max_drawdown"),
        *[_q("active", p / 100).alias(f"p{p:02d}") for p in (5, 25, 75, 95)],
        F.sum("turnover").alias("turnover_sum"),
        F.sum(F.col("rebalanced").cast("long")).alias("rebalance_count"),
    )


def distribution(returns: DataFrame, windows: dict[str, str | None], date: str = "date", value: str = "active") -> DataFrame:
    """Moments and quantiles of ``value`` over windows that begin at a date (None: all); windows may overlap.

    Skew and kurtosis are those of samples; both are null below three and four values.
    """
    member = F.array_compact(F.array(*[F.when(F.lit(True) if start is None else F.col(date) >= F.lit(start).cast("date"), F.lit(name)) for name, start in windows.items()]))
    d = returns.where(F.col(value).isNotNull()).select(F.explode(member).alias("window"), F.col(date).alias("_d"), F.col(value).alias("v"))
    n, v = F.count("v").cast("double"), F.col("v")
    spread = F.stddev_samp(v) > EPS
    up, down = F.avg(F.when(v > 0, v)), F.avg(F.when(v < 0, v))
    return d.groupBy("window").agg(
        F.min("_d").alias("start_date"),
        F.max("_d").alias("end_date"),
        F.count("v").alias("n_days"),
        _share(v > 0).alias("win_rate"),
        F.avg(v).alias("mean"),
        _q("v", 0.5).alias("median"),
        F.stddev_samp(v).alias("std"),
        F.when((n >= 3) & spread, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when((n >= 4) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)).alias("kurt"),
        F.min(v).alias("least"),
        *[_q("v", p / 100).alias(f"p{p:02d}") for p in (1, 5, 25, 75, 95, 99)],
        F.max(v).alias("most"),
        up.alias("positive_mean"),
        down.alias("negative_mean"),
        (up / F.abs(down)).alias("gain_loss_ratio"),
    )


def rolling_stability(returns: DataFrame, windows: tuple[int, ...] = (20, 60, 120), date: str = "date", value: str = "active") -> DataFrame:
    """Win rate, mean, tracking error, ratio and sum over rolling days (half of them, at least five, must have values), and drawdown.

    A day without a value is no win, but counts among the days.
    One row per date: a single ordered window over the dates.
    """
    order, v = Window.orderBy(date), F.col("v")
    out = returns.select(F.col(date), F.col(value).alias("v"))
    cols = [F.col(date), v.alias(value)]
    for k in windows:
        w = order.rowsBetween(1 - k, 0)
        ok = lambda x: F.when(F.count("v").over(w) >= max(5, k // 2), x)  # noqa: E731, B023
        te = F.stddev_samp("v").over(w) * YEAR**0.5
        cols += [ok(F.count(F.when(v > 0, 1)).over(w) / F.count(F.lit(1)).over(w)).alias(f"win_rate_{k}d"), ok(F.avg("v").over(w)).alias(f"mean_{k}d"), ok(te).alias(f"te_{k}d")]
        cols += [ok(F.avg("v").over(w) * YEAR / (te + EPS)).alias(f"ir_{k}d"), ok(F.sum("v").over(w)).alias(f"sum_{k}d")]
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.select(*cols, F.when(v.isNotNull(), F.exp(F.sum(F.log1p("v")).over(run))).alias("nav"))
    return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(run) - 1)


def decile_returns(panel: DataFrame, signals: list[str], label: str = "label", groups: int = 10, date: str = "date", code: str = "code") -> DataFrame:
    """(factor, date, group, mean, excess): mean label of equal groups over the date's own mean, on dates with ten rows a group.

    Groups cut ranks at quantiles, ties going by code; group 1 has the least values.
    """
    long = panel.where(F.col(label).isNotNull()).select(date, code, F.col(label).alias("y"), *signals).unpivot([date, code, "y"], signals, "factor", "x").where("x is not null")
    by = Window.partitionBy("factor", date)
    n = F.col("n")
    long = long.withColumn("n", F.count(F.lit(1)).over(by)).where(n >= groups * 10).withColumn("all", F.avg("y").over(by))
    rank = F.row_number().over(by.orderBy("x", code))
    # rank r lies in the right-closed bin g with 1 + (g-1)(n-1)/groups < r <= 1 + g(n-1)/groups, in whole numbers
    group = F.greatest(F.expr("div((rank - 1) * %d + n - 2, n - 1)" % groups), F.lit(1))
    long = long.withColumn("rank", rank).withColumn("group", group.cast("long"))
    return long.groupBy("factor", date, "group").agg(F.avg("y").alias("mean"), (F.avg("y") - F.max("all")).alias("excess"))


def factor_summary(ic: DataFrame, deciles: DataFrame, per_year: int = 12, groups: int = 10) -> DataFrame:
    """Per factor: mean, deviation, annual ratio and positive share of rank_ic, its direction, and the outer groups' excess by direction."""
    m, s = F.avg("rank_ic"), F.stddev_samp("rank_ic")
    a = ic.where("rank_ic is not null").groupBy("factor").agg(m.alias("rank_ic_mean"), s.alias("rank_ic_std"), (m / (s + EPS) * per_year**0.5).alias("icir_annual"), _share(F.col("rank_ic") > 0).alias("positive_share"), F.count(F.lit(1)).alias("n_periods"), F.when(m >= 0, 1.0).otherwise(-1.0).alias("direction"))
    d = deciles.groupBy("factor").agg(F.avg(F.when(F.col("group") == groups, F.col("excess"))).alias("_hi"), F.avg(F.when(F.col("group") == 1, F.col("excess"))).alias("_lo"))
    up = F.col("direction") > 0
    out = a.join(d, "factor", "left").withColumn("top_excess", F.when(up, F.col("_hi")).otherwise(F.col("_lo"))).withColumn("bottom_excess", F.when(up, F.col("_lo")).otherwise(F.col("_hi")))
    return out.withColumn("long_short_excess", F.col("top_excess") - F.col("bottom_excess")).drop("_hi", "_lo")


def industry_rank_ic(panel: DataFrame, signals: list[str], year: int, least: int = 10, label: str = "label", date: str = "date", industry: str = "industry") -> DataFrame:
    """Mean, ratio and positive share of the rank correlations within (date, industry) of one year, by factor and industry."""
    p = panel.where((F.year(date) == year) & F.col(label).isNotNull() & F.col(industry).isNotNull())
    long = p.select(date, industry, F.col(label).alias("y"), *signals).unpivot([date, industry, "y"], signals, "factor", "x").where("x is not null")
    by = (date, industry, "factor")
    daily = long.select(*by, pct_rank(F.col("x"), *by).alias("rx"), pct_rank(F.col("y"), *by).alias("ry")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("r")).where(F.col("n") >= least)
    m = F.avg("r")
    return daily.groupBy("factor", industry).agg(m.alias("rank_ic_mean"), (m / (F.stddev_samp("r") + 1e-9)).alias("rank_ic_ir"), _share(F.coalesce(F.round("r", 12) > 0, F.lit(False))).alias("positive_share"), F.countDistinct(date).alias("n_dates"), F.avg("n").alias("n_avg"))


def _scored(panel: DataFrame, score: str, date: str) -> DataFrame:
    p = panel.withColumn("rank_pct", pct_rank(F.col(score), date))
    return p.withColumn("is_top", F.coalesce(F.col("rank_pct") >= 0.9, F.lit(False))).withColumn("is_bottom", F.coalesce(F.col("rank_pct") <= 0.1, F.lit(False)))


def _last_date(panel: DataFrame, date: str) -> DataFrame:
    last = panel.agg(F.max(date).alias("_last"))  # one row
    return panel.join(F.broadcast(last), F.col(date) == F.col("_last"), "left_semi")


def latest_industry_exposure(panel: DataFrame, score: str, value: str, date: str = "date", industry: str = "industry") -> DataFrame:
    """Industries of the last date: size, scores, and their shares of the universe and of the outer tenths by score."""
    p = _scored(_last_date(panel, date), score, date)
    g = p.groupBy(industry).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"), _q(score, 0.5).alias("median_score"), F.avg("rank_pct").alias("avg_rank_pct"), F.sum(F.col("is_top").cast("long")).alias("top_count"), F.sum(F.col("is_bottom").cast("long")).alias("bottom_count"), F.sum(value).alias("value_sum"))
    total = g.agg(F.sum("n").alias("_n"), F.greatest(F.sum("top_count"), F.lit(1)).alias("_t"), F.greatest(F.sum("bottom_count"), F.lit(1)).alias("_b"))  # one row
    out = g.crossJoin(F.broadcast(total))
    out = out.withColumn("universe_share", F.col("n") / F.col("_n")).withColumn("top_share", F.col("top_count") / F.col("_t")).withColumn("bottom_share", F.col("bottom_count") / F.col("_b"))
    return out.withColumn("top_minus_universe", F.col("top_share") - F.col("universe_share")).drop("_n", "_t", "_b")


def code_exposure(panel: DataFrame, score: str, year: int, label: str = "label", date: str = "date", code: str = "code") -> DataFrame:
    """Scores, ranks and top-tenth days of each code over a year."""
    p = _scored(panel.where(F.year(date) == year), score, date)
    return p.groupBy(code).agg(F.avg(score).alias("avg_score"), _q(score, 0.5).alias("median_score"), F.avg("rank_pct").alias("avg_rank_pct"), F.sum(F.col("is_top").cast("long")).alias("top_days"), F.countDistinct(date).alias("days"), F.avg(label).alias("label_mean"))


def industry_exposure(panel: DataFrame, score: str, year: int, date: str = "date", industry: str = "industry") -> DataFrame:
    """Means over a year's dates of each industry's mean and median score, top-tenth share and size."""
    p = _scored(panel.where(F.year(date) == year), score, date)
    day = p.groupBy(date, industry).agg(F.avg(score).alias("a"), _q(score, 0.5).alias("m"), _share(F.col("is_top")).alias("t"), F.count(F.lit(1)).alias("n"))
    return day.groupBy(industry).agg(F.avg("a").alias("avg_score"), F.avg("m").alias("median_score"), F.avg("t").alias("top_share"), F.avg("n").alias("n_avg"), F.count(F.lit(1)).alias("days"))


def running_groups(groups: DataFrame, n: int = 5, date: str = "date") -> DataFrame:
    """Adds running sums of the group columns g0 .. and of top minus bottom; a null adds nothing.  One row per date."""
    run = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    cum = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(run).alias(f"{c}_cum")
    return groups.select("*", *[cum(f"g{k}") for k in range(n)], cum("long_short"))


def long_short_stats(running: DataFrame) -> DataFrame:
    """One row: annual mean, deviation and ratio, deepest fall of the running sum and win rate of long_short; empty input gives nulls."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = running.withColumn("_fall", F.col("long_short_cum") - F.max("long_short_cum").over(run))
    m, s = F.avg("long_short") * YEAR, F.stddev_samp("long_short") * YEAR**0.5
    return d.agg(m.alias("annual_return"), s.alias("annual_deviation"), (m / (s + 1e-9)).alias("ratio"), F.min("_fall").alias("max_drawdown"), _share(F.col("long_short") > 0).alias("win_rate"))


def regression_summary(daily: DataFrame, by: list[str], name: str = "r2") -> DataFrame:
    """Count, mean, median and share from one half on of a fit measure by group; null measures count for nothing."""
    v = F.col(name)
    return daily.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("dates"), F.avg(v).alias(f"{name}_mean"), _q(name, 0.5).alias(f"{name}_median"), _share(v >= 0.5).alias(f"{name}_from_half"))


def comparable(daily: DataFrame, variant: str, variants: int, by: list[str], date: str = "date") -> DataFrame:
    """Rows of the dates on which all ``variants`` variants of a group have a row."""
    full = daily.groupBy(*by, date).agg(F.countDistinct(variant).alias("_k")).where(F.col("_k") == variants).drop("_k")
    return daily.join(full, [*by, date], "left_semi")


def covariance_audit(covariance: DataFrame, by: str = "window") -> DataFrame:
    """Per window: dates, names on either side, rows and negative variances of (date, factor_i, factor_j, covariance)."""
    names = covariance.select(by, F.explode(F.array("factor_i", "factor_j")).alias("f")).groupBy(by).agg(F.countDistinct("f").alias("n_names"))
    own = F.col("factor_i") == F.col("factor_j")
    rows = covariance.groupBy(by).agg(F.countDistinct("date").alias("dates"), F.count(F.lit(1)).alias("rows"), F.count(F.when(own & (F.col("covariance") < -EPS), 1)).alias("negative_variances"))
    return rows.join(names, by)


def membership_crosswalk(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Codes by pairs of classes of two classifications that are in force at ``on``; a class without a counterpart meets null.

    Both have (code, cls, since, until), in force from since to before until.
    """
    day = F.lit(on).cast("date")
    now = lambda f, name: f.where((F.col("since") <= day) & (F.col("until").isNull() | (day < F.col("until")))).select("code", F.col("cls").alias(name))
    return now(a, "left_class").join(now(b, "right_class"), "code", "full").groupBy("left_class", "right_class").agg(F.count(F.lit(1)).alias("codes"))


def class_coverage(panel: DataFrame, cls: str, date: str = "date", code: str = "code") -> DataFrame:
    """Per year: rows with and without a class, codes and classes."""
    return panel.where(F.col(date).isNotNull()).groupBy(F.year(date).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.count(cls).alias("matched"), (F.count(F.lit(1)) - F.count(cls)).alias("unmatched"), (F.count(cls) / F.count(F.lit(1))).alias("coverage"), F.countDistinct(code).alias("codes"), F.countDistinct(cls).alias("classes"))


def dataset_coverage(sets: dict[str, DataFrame], reference: DataFrame, entity: str, date: str = "date") -> DataFrame:
    """Per dataset: rows, span, dates, their share of the reference's dates, entities and status; datasets are few and share one plan."""
    dates = reference.select(F.col(date).alias("_d")).where("_d is not null").distinct()
    total = dates.agg(F.count(F.lit(1)).alias("reference_dates"))  # one row
    out = None
    for name, frame in sets.items():
        rows = frame.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("date_min"), F.max(date).alias("date_max"), F.countDistinct(date).alias("observed_dates"), F.countDistinct(entity).alias("entities"))
        met = frame.select(F.col(date).alias("_d")).distinct().join(dates, "_d", "left_semi").agg(F.count(F.lit(1)).alias("_met"))
        one = rows.crossJoin(met).crossJoin(total).select(F.lit(name).alias("dataset"), "*", F.when(F.col("reference_dates") > 0, F.col("_met") / F.col("reference_dates")).alias("date_coverage"), F.when(F.col("rows") > 0, "available").otherwise("empty").alias("status")).drop("_met")
        out = one if out is None else out.unionByName(one)
    return out
