"""Panels from raw tables: adjusted prices, valuation, money flow, membership, benchmark returns.

All joins by (code, date) use one partitioning; what has one row per date or code is small and
joined as it is.  Returns are taken before membership filters: a code that leaves an index and
comes back has its own one-day return, not one over the gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import asof_join, gap_aware_returns, keep_last, snapshot_join

PRICES = ("open", "high", "low", "close")
VALUATION = ("turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "total_mv", "circ_mv")
FLOWS = ("buy_lg_amount", "sell_lg_amount", "buy_elg_amount", "sell_elg_amount", "net_mf_amount")
KEYS = ["code", "date"]


def _present(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("code", "date")) -> DataFrame:
    return df.select(*keys, *[c for c in columns if c in df.columns])


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def adjusted_prices(daily: DataFrame, factors: DataFrame, valuation: DataFrame | None = None) -> DataFrame:
    """daily with ``*_adj`` prices (price by adjustment factor, null without one), valuation where there is some, and ``log_mv``."""
    out = daily.join(_present(factors, ["adj_factor"]), KEYS, "left")
    out = out.withColumns({f"{c}_adj": F.col(c) * F.col("adj_factor") for c in PRICES if c in daily.columns})
    if valuation is not None:
        out = out.join(_present(valuation, VALUATION), KEYS, "left")
    return out.withColumn("log_mv", _log(F.col("total_mv"))) if "total_mv" in out.columns else out


def base_table(daily: DataFrame, valuation: DataFrame, factors: DataFrame, company: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per daily row: adjusted prices, valuation, the company's industry, and the code's own latest index weight (0 before the first).

    The weight is carried by code, so one that left the index keeps its last weight; see
    ``index_panel`` for whole snapshots.
    """
    out = adjusted_prices(daily, factors, valuation).join(company.select("code", "industry").dropDuplicates(["code"]), "code", "left")
    w = keep_last(weights.select("code", "date", F.col("weight").alias("index_weight")), KEYS, "index_weight").withColumnRenamed("date", "seen")
    out = asof_join(out, w, "code", "date", "seen").withColumn("index_weight", F.coalesce("index_weight", F.lit(0.0)))
    kept = ("code", "date", *[f"{c}_adj" for c in PRICES], "volume", "amount", *VALUATION, "industry", "index_weight")
    return out.select(*[c for c in kept if c in out.columns])


def flow_features(flows: DataFrame) -> DataFrame:
    """Large and extra-large net flows, their sums and the days with an inflow; missing columns count as null.

    A day without a known flow is no inflow day.  Sums over 20 days need 10 values, over 10 days 5.
    """
    m = flows.select(*KEYS, *[(F.col(c) if c in flows.columns else F.lit(None)).cast("double").alias(c) for c in FLOWS])
    extra = F.col("buy_elg_amount") - F.col("sell_elg_amount")
    m = m.withColumns({"main_flow": F.col("buy_lg_amount") - F.col("sell_lg_amount") + extra, "slarge_flow": extra, "large_out": F.col("sell_lg_amount") + F.col("sell_elg_amount")})
    m = m.withColumns({"net_flow": F.coalesce("net_mf_amount", "main_flow"), "_in": F.coalesce(F.col("main_flow") > 0, F.lit(False)).cast("double"), "_large": F.coalesce(F.col("slarge_flow") > 0, F.lit(False)).cast("double")})

    def total(c: str, n: int, least: int) -> Column:
        w = Window.partitionBy("code").orderBy("date").rowsBetween(1 - n, 0)
        return F.when(F.count(c).over(w) >= least, F.sum(c).over(w))

    sums = {"main_flow_20": ("main_flow", 20, 10), "flow_days_10": ("_in", 10, 5), "flow_days_20": ("_in", 20, 10), "con_days_10": ("_large", 10, 5)}
    return m.withColumns({k: total(*v) for k, v in sums.items()}).drop("_in", "_large", *FLOWS)


def market_fields(panel: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Adds what published signals ask for, where it is missing and its inputs are there.

    ``vwap``, the change over 60 rows, and stand-ins for two risk styles as cross-sectional
    z-scores: size from log value, beta from volatility over 20 and 60 rows.
    """
    w = Window.partitionBy("code").orderBy("date")
    div = lambda a, b: F.when(F.abs(b) > 1e-12, a / b)
    z = lambda x: div(x - F.avg(x).over(Window.partitionBy("date")), F.stddev_samp(x).over(Window.partitionBy("date")))
    have, out = set(panel.columns), panel
    if "vwap" not in have and {"amount", "volume"} <= have:
        out = out.withColumn("vwap", div(F.col("amount"), F.col("volume")))
    if "close_adj" in have:
        c = F.col("close_adj")
        out = out.withColumns({"change_60": div(c, F.lag(c, 60).over(w)) - 1, "_ret": div(c, F.lag(c).over(w)) - 1})

        def sd(n: int, least: int) -> Column:
            f = w.rowsBetween(1 - n, 0)
            return F.when(F.count("_ret").over(f) >= least, F.stddev_samp("_ret").over(f))

        out = out.withColumn("_vol", 0.5 * sd(20, 10) + 0.5 * sd(60, 30)).withColumn("beta_proxy", z(F.col("_vol"))).drop("_ret", "_vol")
    if "log_mv" in have or "total_mv" in have:
        size = F.col("log_mv") if "log_mv" in have else _log(F.col("total_mv"))
        out = out.withColumn("_size", size).withColumn("size_proxy", z(F.col("_size"))).drop("_size")
    return out.join(flow_features(flows), KEYS, "left") if flows is not None else out


def validation_panel(context: DataFrame, prices: DataFrame, filled: Sequence[str] = ("pb", "pe_ttm", "ps_ttm", "total_mv", "log_mv")) -> DataFrame:
    """Rows of context with prices; of columns on both sides the price table's, and for ``filled`` context's where that is null."""
    both = [c for c in context.columns if c in prices.columns and c not in KEYS]
    x = context.select(*[F.col(c).alias(f"_c_{c}") if c in both else F.col(c) for c in context.columns])
    out = x.join(prices, KEYS, "left")
    out = out.withColumns({c: F.coalesce(c, f"_c_{c}") for c in both if c in filled})
    return out.drop(*[f"_c_{c}" for c in both])


def group_returns(panel: DataFrame, groups: DataFrame, group_daily: DataFrame, market_daily: DataFrame) -> DataFrame:
    """panel (with ``grp``) with its group's and the market's return of the day: groups (index_code, grp), group_daily (index_code, date, ret), market_daily (date, ret)."""
    g = group_daily.join(groups.select("index_code", "grp"), "index_code").select("date", "grp", F.col("ret").alias("group_ret"))
    return panel.join(g, ["date", "grp"], "left").join(market_daily.select("date", F.col("ret").alias("market_ret")), "date", "left")


def index_panel(
    daily: DataFrame,
    factors: DataFrame,
    valuation: DataFrame | None,
    flows: DataFrame | None,
    listing: DataFrame | None,
    weights: DataFrame,
    statements: DataFrame | None = None,
    members_only: bool = True,
) -> DataFrame:
    """The daily panel of an index: every code that was ever in it, with weight, membership, returns and the index's return.

    Weights are whole snapshots: a code that the latest one lacks has none.  ``statements``
    (code, available, ...) join by their date of availability, inclusive.  ``benchmark_return`` is
    the weighted return of members whose return is known; null where there is none.  With
    ``members_only`` other rows go at the very end.
    """
    codes = weights.select("code").where("code is not null").distinct()
    out = adjusted_prices(daily.join(codes, "code", "left_semi"), factors, valuation)
    if flows is not None:
        out = out.join(_present(flows, FLOWS), KEYS, "left")
    if listing is not None:
        out = out.join(_present(listing, ["name", "industry", "market", "exchange", "list_date", "list_status"], ["code"]).dropDuplicates(["code"]), "code", "left")
    out = out.withColumn("industry", F.coalesce("industry", F.lit("unknown")) if "industry" in out.columns else F.lit("unknown"))
    out = snapshot_join(out, weights.groupBy("code", "date").agg(F.max("weight").alias("index_weight")), "code", "date", "index_weight")
    out = out.drop("snapshot").withColumn("index_weight", F.coalesce("index_weight", F.lit(0.0)))
    out = out.withColumn("member", F.col("index_weight") > 0)
    if statements is not None:
        out = asof_join(out, statements, "code", "date", "available")
    out = gap_aware_returns(out, "code", "date", "close_adj")
    known = out.where("member and returns_1d is not null").groupBy("date").agg((F.sum(F.col("index_weight") * F.col("returns_1d")) / F.sum("index_weight")).alias("benchmark_return"))
    out = out.join(known, "date", "left")
    return out.where("member") if members_only else out


def equity_panel(daily: DataFrame, factors: DataFrame, names: DataFrame, groups: DataFrame, young_days: int = 183) -> DataFrame:
    """Adjusted prices with ``ret``, volume and amount weighted by it, the mapped group, and flags for young codes and those under special treatment.

    names: (code, name, industry, list_date); groups: (industry, grp), others are ``unknown``.
    ``young``: listed less than ``young_days`` before; ``special``: ST in the name, in either case.
    A code without a name or date has no flag set.
    """
    w = Window.partitionBy("code").orderBy("date")
    n = names.select("code", "name", "industry", "list_date").dropDuplicates(["code"]).join(groups.select("industry", "grp").dropDuplicates(["industry"]), "industry", "left")
    out = adjusted_prices(daily, factors).join(n, "code", "left").withColumn("grp", F.coalesce("grp", F.lit("unknown")))
    out = out.withColumn("ret", F.when(F.abs(F.lag("close_adj").over(w)) > 1e-12, F.col("close_adj") / F.lag("close_adj").over(w) - 1))
    young = F.coalesce(F.datediff("date", "list_date") < young_days, F.lit(False))
    special = F.coalesce(F.upper("name").contains("ST"), F.lit(False))
    return out.withColumns({"volume_price": F.col("ret") * F.col("volume"), "amount_price": F.col("ret") * F.col("amount"), "young": young, "special": special})
