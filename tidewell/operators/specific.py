"""Specific risk at several frequencies: daily, monthly and quarterly variances, blended and shrunk to priors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.moments import Ewm, ewm_moments, finite


@dataclass(frozen=True)
class Frequency:
    window: int
    half_life: float
    least: int
    weight: float


@dataclass(frozen=True)
class SpecificRisk:
    """Parameters; windows count rows of a code at each frequency."""

    day: Frequency = Frequency(252, 63, 126, 0.5)
    month: Frequency = Frequency(36, 12, 18, 0.3)
    quarter: Frequency = Frequency(20, 8, 8, 0.2)
    completeness: float = 0.6
    members: int = 5
    buckets: int = 5
    target: int = 252
    least_reliability: float = 0.2
    year: int = 252


def period_sums(returns: DataFrame, value: str, period: str, least: float, code: str = "code", date: str = "date") -> DataFrame:
    """(code, period, period_end, total, n, days): additive sums over completed periods that have enough of the market's dates.

    The period of the last date may go on, so it is left out; ``period_end`` is the period's last date of all codes.
    """
    p = returns.where(F.col(code).isNotNull() & F.col(date).isNotNull()).select(code, date, finite(F.col(value)).alias("_v"), F.date_trunc(period, date).cast("date").alias("period"))
    days = p.groupBy("period").agg(F.countDistinct(date).alias("days"), F.max(date).alias("period_end"))
    days = days.withColumn("_last", F.max("period").over(Window.partitionBy())).where("period < _last").drop("_last")  # one row a period
    out = p.groupBy(code, "period").agg(F.sum("_v").alias("total"), F.count("_v").alias("n")).join(days, "period")
    return out.where(F.col("n") / F.col("days") >= least).select(code, "period", "period_end", "total", "n", "days")


def period_variance(sums: DataFrame, f: Frequency, code: str = "code") -> DataFrame:
    """(code, period_end, variance): of period sums, by day."""
    got = ewm_moments(sums, {"total": Ewm(F.col("total"), f.window, f.half_life, f.least), "days": Ewm(F.col("days"), f.window, f.half_life, f.least)}, [code], "period_end")
    return got.select(code, "period_end", F.when(F.col("days_mean") > 0, F.col("total_variance") / F.col("days_mean")).alias("variance"))


def carried(days: DataFrame, periods: dict[str, DataFrame], code: str = "code", date: str = "date") -> DataFrame:
    """days with a column for each of periods (code, period_end, variance): that of the last period that ended before the date.

    All are stacked and carried forward in one order, so nothing is multiplied; the last
    period's variance is taken even if it is null.
    """
    kept = days.columns
    stacked = days.withColumns({f"_{k}": F.lit(None).cast("struct<v: double>") for k in periods}).withColumn("_day", F.lit(True))
    for k, p in periods.items():
        rows = p.select(F.col(code), F.col("period_end").alias(date), F.struct(F.col("variance").alias("v")).alias(f"_{k}"), F.lit(False).alias("_day"))
        stacked = stacked.unionByName(rows, allowMissingColumns=True)
    upto = Window.partitionBy(code).orderBy(date, F.desc("_day")).rowsBetween(Window.unboundedPreceding, 0)  # a period that ends on a date follows it
    out = stacked.withColumns({k: F.last(f"_{k}", ignorenulls=True).over(upto)["v"] for k in periods})
    return out.where("_day").select(*kept, *periods)


def blend(values: dict[str, float]) -> tuple[Column, list[Column]]:
    """Mean of the columns that a row has, by weight, and the weights after that; null and zeros without any."""
    have = sum(F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in values.items())
    total = sum(F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in values.items())
    shares = [F.when(F.col(k).isNotNull(), w / have).otherwise(0.0).alias(f"{k}_weight") for k, w in values.items()]
    return F.when(have > 0, total / have), shares


def quantile_bucket(x: str, buckets: int, by: str) -> Column:
    """Place of x among equal-count intervals (low, high] of its group, from 0; the least value is in the first, equal edges are one, null if all values are equal."""
    edges = F.expr(f"array_distinct(percentile({x}, array({', '.join(str(k / buckets) + 'D' for k in range(buckets + 1))})) over (partition by {by}))")
    at = F.size(F.filter(edges, lambda e: e < F.col(x)))
    at = F.when(at == 0, 1).otherwise(at)
    return F.when(F.col(x).isNotNull() & (F.size(edges) > 1), at - 1)


def structural_shrinkage(frame: DataFrame, variance: str, observations: str, group: str, size: str, p: SpecificRisk = SpecificRisk(), date: str = "date") -> DataFrame:
    """Adds prior, prior_level, reliability and variance_daily.

    The prior is the median of the row's (group, size bucket), or of its group, or of its
    date, the first with enough members; rows without a variance take the prior as it is.
    """
    kept = frame.columns
    f = frame.withColumn("_size", F.when(F.col(size) > 0, F.log(size)))
    f = f.withColumn("_bucket", quantile_bucket("_size", p.buckets, date) if p.buckets > 1 else F.lit(0))

    def median(*by: str) -> Column:
        w = ", ".join(by)
        return F.expr(f"case when count({variance}) over (partition by {w}) >= {p.members} then percentile({variance}, 0.5D) over (partition by {w}) end")

    f = f.withColumns({"_narrow": median(date, group, "_bucket"), "_wide": median(date, group), "_market": F.expr(f"percentile({variance}, 0.5D) over (partition by {date})")})
    f = f.withColumn("prior", F.coalesce("_narrow", "_wide", "_market"))
    f = f.withColumn("prior_level", F.when(F.col("_narrow").isNotNull(), "industry_size").when(F.col("_wide").isNotNull(), "industry").otherwise("market"))
    r = F.greatest(F.lit(p.least_reliability), F.least(F.lit(1.0), F.coalesce(F.col(observations), F.lit(0)) / F.lit(float(p.target))))
    f = f.withColumn("reliability", F.when(F.col(variance).isNotNull(), r).otherwise(0.0))
    v = F.col("reliability") * F.coalesce(F.col(variance), F.lit(0.0)) + (1 - F.col("reliability")) * F.col("prior")
    return f.select(*kept, "prior", "prior_level", "reliability", v.alias("variance_daily"))


def specific_risk(returns: DataFrame, exposures: DataFrame, value: str, group: str, size: str, p: SpecificRisk = SpecificRisk(), code: str = "code", date: str = "date") -> DataFrame:
    """One row per row of returns (code, date, value): components, blend, prior and annualised risk.

    exposures (code, date, group, size) are joined by code and date and may miss rows.  Two
    rows of one code and date are refused on either side.  Later rows change no earlier ones,
    but for the period that they complete.
    """
    rows = returns.select(code, date, value)
    daily = ewm_moments(rows, {"day": Ewm(F.col(value), p.day.window, p.day.half_life, p.day.least)}, [code], date)
    daily = daily.select(code, date, F.col("day_variance").alias("day"), F.col("day_count").alias("observations"))
    periods = {k: period_variance(period_sums(rows, value, k, p.completeness, code, date), getattr(p, k), code) for k in ("month", "quarter")}
    f = carried(daily, periods, code, date)
    once = exposures.groupBy(code, date).agg(F.count(F.lit(1)).alias("_n"), F.first(group).alias(group), F.first(size).alias(size))
    once = once.withColumn(group, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"two exposures of one {code} and {date}")).cast(exposures.schema[group].dataType)).otherwise(F.col(group))).drop("_n")
    blended, shares = blend({"day": p.day.weight, "month": p.month.weight, "quarter": p.quarter.weight})
    f = f.join(once, [code, date], "left").select("*", blended.alias("blended"), *shares)
    f = structural_shrinkage(f, "blended", "observations", group, size, p, date)
    return f.withColumn("risk_annual", F.when(F.col("variance_daily").isNotNull(), F.sqrt(F.greatest(F.col("variance_daily"), F.lit(0.0)) * p.year))).drop(group, size)
