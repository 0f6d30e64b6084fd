"""Tables put together from several sources: analyst windows, statements, funds, decisions, weights and regression input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b)


# ---------------------------------------------------------------- events and statements


def analyst_features(keys: DataFrame, reports: DataFrame) -> DataFrame:
    """Windows of calendar days over reports, each seen from the day after it on.

    keys: (code, date, close), one row for a code and date; reports: (code, report_date, org,
    rating, target, eps).  Counts reports of 90 days and distinct orgs of 180, means rating,
    target and eps of 180, and compares eps with that of the 180 days before, [t - 360, t - 180).
    Codes without any report have nulls throughout.  Keys and reports are stacked: one
    shuffle by code, range frames over days, no join.
    """
    null = lambda t: F.lit(None).cast(t)
    k = keys.select("code", F.col("date").alias("d"), F.col("close").cast("double").alias("close"), F.lit(0).alias("e"), null("string").alias("org"), *[null("double").alias(c) for c in ("rating", "target", "eps")])
    r = reports.where(F.col("report_date").isNotNull()).select("code", F.date_add("report_date", 1).alias("d"), null("double").alias("close"), F.lit(1).alias("e"), F.col("org").cast("string").alias("org"), *[F.col(c).cast("double").alias(c) for c in ("rating", "target", "eps")])
    order = Window.partitionBy("code").orderBy(F.unix_date("d"))
    w90, w180, before = order.rangeBetween(-90, 0), order.rangeBetween(-180, 0), order.rangeBetween(-360, -181)
    # the recent window begins at t - 180 inclusive, so the one before it ends at t - 181
    known = F.max("e").over(Window.partitionBy("code")) == 1
    out = k.unionByName(r).select(
        "code", F.col("d").alias("date"), "e",
        F.when(known, F.sum("e").over(w90)).alias("report_count_90"),
        F.when(known, F.size(F.collect_set("org").over(w180)).cast("long")).alias("org_count_180"),
        F.avg("rating").over(w180).alias("rating_180"),
        (_ratio(F.avg("target").over(w180), F.col("close")) - 1).alias("target_upside_180"),
        (_ratio(F.avg("eps").over(w180), F.avg("eps").over(before)) - 1).alias("eps_revision_180"),
        F.avg("eps").over(w180).alias("forward_eps_180"),
    )
    return out.where("e = 0").drop("e")


def merge_statements(statements: dict[str, DataFrame], code: str = "code", period: str = "end_date") -> DataFrame:
    """Full outer join of statements by code and period; available is the latest of their announcements.

    Each has (code, period, available, values ..); value names are their own.  Periods with no
    announcement at all are left out.  Of several rows for one key the first announced counts,
    and of those the one with the least values, from left to right.
    """
    out = None
    for name, s in statements.items():
        others = [c for c in s.columns if c not in (code, period, "available")]
        w = Window.partitionBy(code, period).orderBy(F.col("available").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in others])
        first = s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("available", f"_a_{name}")
        out = first if out is None else out.join(first, [code, period], "full")
    dates = [F.col(f"_a_{name}") for name in statements]
    out = out.withColumn("available", F.greatest(*dates) if len(dates) > 1 else dates[0])
    return out.where(F.col("available").isNotNull()).drop(*[f"_a_{name}" for name in statements])


#: Ratios of merged statements as text: name, numerator, denominator.
STATEMENT_RATIOS = [
    ("roe_ttm", "net_profit_ttm", "equity"),
    ("roa_ttm", "net_profit_ttm", "total_assets"),
    ("gross_margin_ttm", "revenue_ttm - oper_cost_ttm", "revenue_ttm"),
    ("net_margin_ttm", "net_profit_ttm", "revenue_ttm"),
    ("operating_cf_margin_ttm", "cashflow_ttm", "revenue_ttm"),
    ("cashflow_to_profit", "cashflow_ttm", "net_profit_ttm"),
    ("rd_expense_intensity", "rd_exp_ttm", "revenue_ttm"),
    ("capex_to_assets", "capex_ttm", "total_assets"),
    ("debt_to_assets", "total_liab", "total_assets"),
    ("asset_turnover_ttm", "revenue_ttm", "total_assets"),
    ("cash_to_liab", "money_cap", "total_liab"),
    ("working_capital_pressure", "accounts_receiv + inventories - acct_payable", "total_assets"),
]


def statement_ratios(merged: DataFrame, code: str = "code", period: str = "end_date") -> DataFrame:
    """Adds the ratios and the changes over four rows of gross margin and asset turnover; a missing input gives null."""
    out = merged.select("*", *[_ratio(F.expr(a), F.col(b)).alias(n) for n, a, b in STATEMENT_RATIOS])
    w = Window.partitionBy(code).orderBy(period)
    yoy = lambda c: (_ratio(F.col(c), F.lag(c, 4).over(w)) - 1).alias(f"{c[: -len('_ttm')]}_yoy")
    return out.select("*", yoy("gross_margin_ttm"), yoy("asset_turnover_ttm"))


def in_percent(frame: DataFrame, column: str) -> DataFrame:
    """One row (percent): whether the median of the column's absolute values is over 2, as for figures in percent.

    Counts and the two values around 2 decide it, so no values are gathered.  False without values.
    """
    x = F.abs(F.col(column))
    a = frame.agg(F.count(x).alias("n"), F.count(F.when(x <= 2, 1)).alias("low"), F.max(F.when(x <= 2, x)).alias("under"), F.min(F.when(x > 2, x)).alias("over"))
    return a.select(F.expr("case when n = 0 then false when 2 * low = n then (under + over) / 2 > 2 else 2 * low < n end").alias("percent"))


def statement_growth(merged: DataFrame, code: str = "code", period: str = "end_date") -> DataFrame:
    """Adds growth over four rows, leverage, coverage and stability to statements with ratios (``roe_ttm``).

    Growth is a share of the value four rows before, that of return on equity a difference.
    ``earnings_stability``: the negative deviation of the last eight reported returns on
    assets, all of them known; they count in decimals, divided by 100 if ``in_percent``.
    """
    w = Window.partitionBy(code).orderBy(period)
    last8 = w.rowsBetween(-7, 0)
    x = merged.withColumn("working_capital", F.col("total_cur_assets") - F.col("total_cur_liab"))
    growth = {"eps_growth": "eps", "asset_growth": "total_assets", "capex_growth": "capex_ttm", "inventory_growth": "inventories", "working_capital_growth": "working_capital"}
    x = x.withColumns({k: _ratio(F.col(c), F.lag(c, 4).over(w)) - 1 for k, c in growth.items()})
    x = x.join(F.broadcast(in_percent(merged, "roa")))  # one row
    x = x.withColumn("_roa", F.when(F.col("percent"), F.col("roa") / 100).otherwise(F.col("roa")))
    return x.withColumns({
        "roe_growth": F.col("roe_ttm") - F.lag("roe_ttm", 4).over(w),
        "operating_margin_ttm": _ratio(F.col("operate_profit_ttm"), F.col("revenue_ttm")),
        "book_leverage": _ratio(F.col("total_assets"), F.col("equity")),
        "inverse_interest_coverage": _ratio(F.col("fin_exp_ttm"), F.col("operate_profit_ttm")),
        "earnings_stability": F.when(F.count("_roa").over(last8) >= 8, -F.stddev_samp("_roa").over(last8)),
    }).drop("_roa", "percent", "working_capital")


# ---------------------------------------------------------------- funds and decisions


def fund_panel(daily: DataFrame, shares: DataFrame, classes: DataFrame) -> DataFrame:
    """Prices, shares and reviewed classes of funds that have all three, in units of currency.

    Amounts come in thousands, shares in ten thousands.  Rows need a positive close and shares.
    ``classes`` may repeat a key; the least (category, bucket, reviewed) counts.
    """
    w = Window.partitionBy("code", "date").orderBy("category", "risk_bucket", "reviewed")
    one = classes.select("code", "date", "category", "risk_bucket", "reviewed").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    p = daily.join(shares.select("code", "date", "shares"), ["code", "date"]).join(one, ["code", "date"]).where("close > 0 and shares > 0")
    p = p.withColumn("amount_units", F.col("amount") * 1000).withColumn("market_value", F.col("close") * F.col("shares") * 10000)
    return p.withColumn("turnover", _ratio(F.col("amount_units"), F.col("market_value")))


def risk_groups(panel: DataFrame, buckets: Sequence[str] = ("low_risk", "risk")) -> DataFrame:
    """One row per date: by bucket the funds, sums, turnover and the largest fund's share of each sum.

    Conditional aggregates of one pass in place of a pivot; a bucket without rows has nulls.
    """
    cols = []
    for b in buckets:
        mine = F.col("risk_bucket") == b
        x = lambda c: F.when(mine, F.col(c))  # noqa: E731, B023
        some = F.count(F.when(mine, 1)) > 0
        cols += [F.when(some, F.countDistinct(x("code"))).alias(f"{b}_count")]
        cols += [F.sum(x(c)).alias(f"{b}_{c}") for c in ("volume", "amount", "shares", "market_value")]
        cols += [_ratio(F.sum(x("amount")) * 1000, F.sum(x("market_value"))).alias(f"{b}_turnover")]
        cols += [_ratio(F.max(x(c)), F.sum(x(c))).alias(f"{b}_largest_{c}_share") for c in ("volume", "amount", "market_value")]
    return panel.where(F.col("risk_bucket").isin(*buckets)).groupBy("date").agg(*cols)


def direction_status(signal: Column, quality: Column) -> Column:
    """-1 is strong, 1 weak, any other value mixed; no value or grade D: insufficient."""
    return F.when((F.upper(quality) == "D") | signal.isNull(), "insufficient").when(signal == -1, "strong").when(signal == 1, "weak").otherwise("mixed")


def appetite_status(volume: Column, turnover: Column, quality: Column) -> Column:
    """Strong or weak where both signals say so, else mixed; a missing one or grade D: insufficient."""
    missing = (F.upper(quality) == "D") | volume.isNull() | turnover.isNull()
    return F.when(missing, "insufficient").when((volume == -1) & (turnover == -1), "strong").when((volume == 1) & (turnover == 1), "weak").otherwise("mixed")


def dividend_status(source: Column) -> Column:
    return F.when(source == "disclosed_events", "disclosed").when(source.isin("partial_disclosed_events", "estimated_events", "proxy"), "partial").otherwise("unavailable")


def overall_status(basis_quality: Column, signal_quality: Column, basis: Column, appetite: Column) -> Column:
    """The least that basis and appetite support together."""
    poor = (F.coalesce(basis_quality, F.lit("")) == "D") | (F.coalesce(signal_quality, F.lit("")) == "D") | (basis == "insufficient") | (appetite == "insufficient")
    return F.when(poor, "insufficient").when((basis == "neutral") | (appetite == "mixed"), "mixed").otherwise("limited_support")


def decision_summary(basis: DataFrame, signals: DataFrame, basis_status: Column) -> DataFrame:
    """A row for each date and product's main contract with its statuses and reasons.

    basis: (date, product, contract, percentile, basis_quality, dividend_source, is_main);
    signals: (date, volume_signal, turnover_signal, signal_quality), one row a date: a
    date dimension, ordered as a whole for the rows since both signals last agreed.
    ``basis_status`` is a column over basis.  Dates without signals are insufficient.
    """
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    agree = (F.col("volume_signal") == F.col("turnover_signal")) & F.col("volume_signal").isin(-1, 1)
    s = signals.withColumn("_n", F.row_number().over(Window.orderBy("date")))
    s = s.withColumn("last_consensus", F.last(F.when(agree, F.col("date")), ignorenulls=True).over(order)).withColumn("signal_age", (F.col("_n") - F.last(F.when(agree, F.col("_n")), ignorenulls=True).over(order)).cast("long")).drop("_n")
    out = basis.where(F.coalesce("is_main", F.lit(False))).withColumn("basis_status", basis_status).join(s, "date", "left")
    v, t, q = F.col("volume_signal"), F.col("turnover_signal"), F.col("signal_quality")
    out = out.withColumn("dividend_status", dividend_status(F.col("dividend_source"))).withColumn("volume_status", direction_status(v, q)).withColumn("turnover_status", direction_status(t, q)).withColumn("appetite_status", appetite_status(v, t, q))
    out = out.withColumn("overall_status", overall_status(F.col("basis_quality"), q, F.col("basis_status"), F.col("appetite_status")))
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("D")))
    reasons = F.concat_ws(";", part("basis", F.col("basis_status")), part("risk", F.col("appetite_status")), part("basis_quality", F.col("basis_quality")), part("signal_quality", q), F.lit("relative_exposure=unavailable"))  # nothing here says how a product is held
    return out.select("date", "product", "contract", "percentile", "basis_status", "dividend_status", "volume_status", "turnover_status", "appetite_status", "last_consensus", "signal_age", "overall_status", reasons.alias("reasons"))


def quality_grade(native: Column, point_in_time: Column, proxy: Column, validated: Column) -> Column:
    """C: a proxy.  A: validated, native and known at the time.  B: native or known at the time.  D: the rest."""
    return F.when(proxy, "C").when(validated & native & point_in_time, "A").when(native | point_in_time, "B").otherwise("D")


# ---------------------------------------------------------------- weights and regression input


def size_weights(size: Column) -> Column:
    """Square root of a positive size, 1 where there is none."""
    return F.coalesce(F.when(size > 0, F.sqrt(size)), F.lit(1.0))


def clip_weights(panel: DataFrame, weight: str, low: float = 0.01, high: float = 0.99, least: int = 20, date: str = "date") -> DataFrame:
    """Replaces weights that aren't positive by null and clips the others to their date's quantiles, on dates with ``least`` of them."""
    p = panel.withColumn(weight, F.when(F.col(weight) > 0, F.col(weight)))
    q = p.groupBy(date).agg(F.count(weight).alias("_n"), F.expr(f"percentile({weight}, array({low}, {high}))").alias("_q"))
    w = F.col(weight)
    clipped = F.when(w.isNotNull() & (F.col("_n") >= least), F.least(F.greatest(w, F.col("_q")[0]), F.col("_q")[1])).otherwise(w)
    return p.join(q, date, "left").withColumn(weight, clipped).drop("_n", "_q")


def weight_diagnostics(panel: DataFrame, weight: str, by: str = "date") -> DataFrame:
    """Effective sample size and share, largest share, 99th over 50th percentile and variation of positive weights by group."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    p = panel.select(by, w.alias("w"))
    ess = F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))
    return p.groupBy(by).agg(ess.alias("effective_size"), (ess / F.count("w")).alias("effective_share"), (F.max("w") / F.sum("w")).alias("max_share"), (F.expr("percentile(w, 0.99)") / F.expr("percentile(w, 0.5)")).alias("p99_p50"), (F.stddev_pop("w") / F.avg("w")).alias("variation"))


def pool_rare(panel: DataFrame, group: str, least: int, date: str = "date", other: str = "other") -> DataFrame:
    """Groups with fewer than ``least`` rows on a date become ``other``; a null group is ``unknown`` and counts as a group."""
    p = panel.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    return p.withColumn(group, F.when(F.count(F.lit(1)).over(Window.partitionBy(date, group)) < least, F.lit(other)).otherwise(F.col(group)))


def align_returns(panel: DataFrame, mode: str, exposures: Sequence[str], price: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """Adds y, the return that a date's exposures explain: forward_1d (next row), same_day, or lagged_exposure_1d (exposures of the row before)."""
    if mode not in ("forward_1d", "same_day", "lagged_exposure_1d"):
        raise ValueError("mode is forward_1d, same_day or lagged_exposure_1d")
    w = Window.partitionBy(code).orderBy(date)
    step = (_ratio(F.lead(price).over(w), F.col(price)) if mode == "forward_1d" else _ratio(F.col(price), F.lag(price).over(w))) - 1
    lagged = {c: F.lag(c).over(w).alias(c) for c in exposures} if mode == "lagged_exposure_1d" else {}
    return panel.select(*[lagged.get(c, F.col(c)) for c in panel.columns], step.alias("y"))


def lagged_by_calendar(panel: DataFrame, values: DataFrame, columns: Sequence[str], lag: int = 3, code: str = "code", date: str = "date") -> DataFrame:
    """Adds the columns of ``values`` as of the ``lag``-th trading date before, with that date; null where a code has none then."""
    days = panel.select(date).distinct()
    days = days.select(date, F.lag(date, lag).over(Window.orderBy(date)).alias("risk_date"))  # one row per date
    v = values.select(code, F.col(date).alias("risk_date"), *columns)
    return panel.join(days, date, "left").join(v, ["risk_date", code], "left")


def external_signals(wide: DataFrame, signals: Sequence[str], source: str, version: str, release: str | None = None, code: str = "code", date: str = "date") -> DataFrame:
    """Signals computed elsewhere in the long form (date, code, factor, value, source, version, release_date).

    A null or unreadable date or a null code fails the job when it reaches the row; values
    that aren't numbers become null.
    """
    missing = {code, date, *signals} - set(wide.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    text = wide.select(F.col(date).cast("string").alias("_d"), F.col(code).alias("code"), *[F.col(s).cast("string").alias(s) for s in signals])
    long = text.unpivot(["_d", "code"], list(signals), "factor", "_v")
    day = F.col("_d").try_cast("date")
    return long.select(
        F.when(day.isNull(), F.raise_error(F.lit("a date is missing or unreadable"))).otherwise(day).alias("date"),
        F.when(F.col("code").isNull(), F.raise_error(F.lit("a code is missing"))).otherwise(F.col("code")).alias("code"),
        "factor", F.col("_v").try_cast("double").alias("value"), F.lit(source).alias("source"), F.lit(version).alias("version"), F.lit(release).cast("date").alias("release_date"),
    )
