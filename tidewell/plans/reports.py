"""Queries of the report and assembly operators.  Their SQL is written by hand, apart from the operators.

What both engines share is the text of the inputs.  Doubles are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import assembly, reports
from tidewell.sources.panel import BASE, base_panel

DECIMALS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Two signals and a label over the panel, and daily returns of a portfolio and its benchmark.
SIGNALS = "select code, date, industry, amount, close / lag(close, 4) over w - 1 as f_mom, open / close - 1 as f_gap, lead(close, 2) over w / lead(close, 1) over w - 1 as label from panel window w as (partition by code order by date)"
DAYS = "select *, round(portfolio - benchmark, 9) as active from (select date, round(sum(amount * r) / sum(case when r is not null then amount end) / 50, 9) as portfolio, round(avg(r) / 50, 9) as benchmark, avg(turnover_rate) as turnover, max(day(date)) <= 7 as rebalanced from (select *, close / lag(close) over (partition by code order by date) - 1 as r from panel) group by date)"
CLASSES = "select code, date, concat('c', cast(industry % 5 as string)) as category, case industry % 3 when 0 then 'low_risk' when 1 then 'risk' else 'other' end as risk_bucket, true as reviewed from panel where code % 7 <> 0"
SHARES = "select code, date, turnover_rate - 0.2 as shares from panel where code % 4 <> 0"
REPORTS = "select code, date + cast(code % 5 as int) as report_date, concat('o', cast(day(date) % 7 as string)) as org, case when disc > 0.02 then tax end as rating, high as target, low as eps from panel where code % 6 <> 0"
STATEMENTS = {
    "income": "select code, cast(date_trunc('quarter', date) as date) as end_date, cast(date_trunc('quarter', date) as date) + cast(120 + code % 10 as int) as available, sum(amount) as revenue_ttm, sum(amount * disc) as net_profit_ttm, sum(amount * tax) as oper_cost_ttm, sum(amount * tax * disc) as rd_exp_ttm from panel group by 1, 2, 3",
    "balance": "select code, cast(date_trunc('quarter', date) as date) as end_date, cast(date_trunc('quarter', date) as date) + cast(115 + code % 20 as int) as available, sum(close) as total_assets, sum(low) as total_liab, sum(high - low) as equity, sum(open) as money_cap, sum(tax) as accounts_receiv, sum(disc) as inventories, sum(ret_share) as acct_payable from panel where code % 5 <> 0 group by 1, 2, 3",
    "cash": "select code, cast(date_trunc('quarter', date) as date) as end_date, cast(date_trunc('quarter', date) as date) + 125 as available, sum(volume) as cashflow_ttm, sum(volume * tax) as capex_ttm from panel where month(date) not in (4, 5, 6) group by 1, 2, 3",
}
BASIS = "select date, industry as product, concat('k', cast(code as string)) as contract, round(100 * cume_dist() over (partition by industry order by date, code), 6) as percentile, case code % 9 when 0 then 'D' when 1 then cast(null as string) else 'B' end as basis_quality, case code % 4 when 0 then 'disclosed_events' when 1 then 'proxy' when 2 then 'none' end as dividend_source, row_number() over (partition by date, industry order by code) = 1 as is_main from panel"
VOTES = "select date, case day(date) % 4 when 0 then -1 when 1 then 1 when 2 then 0 end as volume_signal, case day(date) % 3 when 0 then -1 when 1 then 1 else -1 end as turnover_signal, case when day(date) = 9 then 'D' else 'B' end as signal_quality from (select distinct date from panel where month(date) <> 11)"
SPANS = "select code, industry % {k} as cls, min(date) as since, case when code % {k} = 0 then max(date) end as until from panel group by code, industry"
FITS = "select code % 4 as variant, date, corr(close, open) as r2, year(date) as year from panel group by code % 4, date having count(*) >= 20"


def _use(spark: SparkSession, sf: str, text: str) -> DataFrame:
    base_panel(spark, sf).createOrReplaceTempView("panel")
    return spark.sql(text)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1.2345e-10, DECIMALS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _register(name: str, sql: str, rounded: str = ""):
    """``rounded`` names the double columns of the SQL's answer."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: _round(f(spark, sf))
        cols = f"* replace ({', '.join(f'round({c} + 1.2345e-10, {DECIMALS}) as {c}' for c in rounded.split())})" if rounded else "*"
        ORACLES[name] = f"with panel as ({BASE}), {sql.strip()} select {cols} from answer"
        return f

    return put


_NAMES = ["f_mom", "f_gap"]
_RANK = lambda x, by: f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count(*) over (partition by {by})"
_LONG = f"f as ({SIGNALS}), l as (select code, date, industry, factor, x, label as y from f unpivot (x for factor in (f_mom, f_gap)) where label is not null and x is not null)"
_DAILY = f"""{_LONG},
e as (select date, factor, quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from l group by 1, 2),
b as (select l.*, greatest(len(list_filter(list_distinct(q), lambda v: v < x)) - 1, 0) as bin, {_RANK("x", "l.date, l.factor")} as rx, {_RANK("y", "l.date, l.factor")} as ry from l join e on l.date = e.date and l.factor = e.factor),
o as (select *, max(bin) over (partition by date, factor) as hi, min(bin) over (partition by date, factor) as lo from b),
daily as (select date, factor, count(*) as n, corr(x, y) as ic, corr(rx, ry) as rank_ic, avg(y) filter (hi > lo and bin = hi) as top, avg(y) filter (hi > lo and bin = lo) as bottom, avg(y) filter (hi > lo and bin = hi) - avg(y) filter (hi > lo and bin = lo) as long_short from o group by 1, 2 having count(*) >= 20)"""


@_register("report_daily_stats", f"{_DAILY}, answer as (select * from daily)", "ic rank_ic top bottom long_short")
def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_factor_stats(_use(spark, sf, SIGNALS), _NAMES)


_STATS = "min(date) as start_date, max(date) as end_date, count(distinct date) as n_dates, avg(n) as n_avg, avg(ic) as ic_mean, avg(ic) / (stddev_samp(ic) + 1e-9) as ic_ir, avg(cast(ic > 0 as int)) as ic_positive, avg(rank_ic) as rank_ic_mean, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-9) as rank_ic_ir, avg(cast(rank_ic > 0 as int)) as rank_ic_positive, avg(top) as top_mean, avg(bottom) as bottom_mean, avg(long_short) as long_short_mean, sum(long_short) as long_short_sum, avg(cast(long_short > 0 as int)) as long_short_win_rate, 10::bigint as label_horizon"


@_register("report_period_stats", f"""{_DAILY},
answer as (select factor, 'full' as period_type, 'full' as period, {_STATS} from daily group by 1
union all select factor, 'year', strftime(date, '%Y'), {_STATS} from daily group by 1, 3
union all select factor, 'month', strftime(date, '%Y-%m'), {_STATS} from daily group by 1, 3
union all select factor, 'ytd', strftime(date, '%Y') || '_YTD', {_STATS} from daily where year(date) = (select max(year(date)) from daily) group by 1, 3)""",
"n_avg ic_mean ic_ir ic_positive rank_ic_mean rank_ic_ir rank_ic_positive top_mean bottom_mean long_short_mean long_short_sum long_short_win_rate")
def _period_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_stats(_daily(spark, sf))


@_register("report_performance_periods", f"""d as ({DAYS}),
p as (select *, 'year' as period_type, strftime(date, '%Y') as period from d union all select *, 'quarter', strftime(date, '%Y') || 'Q' || quarter(date) from d union all select *, 'month', strftime(date, '%Y-%m') from d),
v as (select *, product(1 + active) over w as nav from p window w as (partition by period_type, period order by date)),
u as (select *, nav / max(nav) over (partition by period_type, period order by date) - 1 as fall from v where true),
answer as (select period_type, period, min(date) as start_date, max(date) as end_date, count(*) as n_days, count(*) filter (active > 0) as win_days, count(*) filter (active = 0) as flat_days, count(*) filter (active < 0) as loss_days, avg(cast(active > 0 as int)) as win_rate, avg(active) as active_mean, median(active) as active_median, stddev_samp(active) as active_std, sum(active) as active_sum, product(1 + portfolio) / product(1 + benchmark) - 1 as active_compound, stddev_samp(active) * sqrt(252) as tracking_error, avg(active) * 252 / (stddev_samp(active) * sqrt(252) + 1e-12) as information_ratio, min(fall) filter (active is not null) as max_drawdown, quantile_cont(active, 0.05) as p05, quantile_cont(active, 0.25) as p25, quantile_cont(active, 0.75) as p75, quantile_cont(active, 0.95) as p95, sum(turnover) as turnover_sum, cast(sum(cast(rebalanced as int)) as bigint) as rebalance_count from u group by 1, 2)""",
"win_rate active_mean active_median active_std active_sum active_compound tracking_error information_ratio max_drawdown p05 p25 p75 p95 turnover_sum")
def _periods(spark: SparkSession, sf: str) -> DataFrame:
    return reports.performance_periods(_use(spark, sf, DAYS))


_WINDOWS = {"full": None, "later": "1996-01-01", "last": "1998-01-01"}
_DIST = "min(date) as start_date, max(date) as end_date, count(*) as n_days, avg(cast(active > 0 as int)) as win_rate, avg(active) as mean, median(active) as median, stddev_samp(active) as std, skewness(active) as skew, kurtosis(active) as kurt, min(active) as least, " + ", ".join(f"quantile_cont(active, {p / 100}) as p{p:02d}" for p in (1, 5, 25, 75, 95, 99)) + ", max(active) as most, avg(active) filter (active > 0) as positive_mean, avg(active) filter (active < 0) as negative_mean, avg(active) filter (active > 0) / abs(avg(active) filter (active < 0)) as gain_loss_ratio"


@_register("report_distribution", f"d as ({DAYS}), answer as (" + " union all ".join(f"select '{k}' as \"window\", {_DIST} from d where active is not null" + (f" and date >= date '{v}'" if v else "") + " having count(*) > 0" for k, v in _WINDOWS.items()) + ")", "win_rate mean median std skew kurt least p01 p05 p25 p75 p95 p99 most positive_mean negative_mean gain_loss_ratio")
def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distribution(_use(spark, sf, DAYS), _WINDOWS)


_ROLL = lambda k: ", ".join(f"case when count(active) over w{k} >= {max(5, k // 2)} then {e} end as {n}_{k}d" for n, e in (("win_rate", f"count(case when active > 0 then 1 end) over w{k} / count(*) over w{k}"), ("mean", f"avg(active) over w{k}"), ("te", f"stddev_samp(active) over w{k} * sqrt(252)"), ("ir", f"avg(active) over w{k} * 252 / (stddev_samp(active) over w{k} * sqrt(252) + 1e-12)"), ("sum", f"sum(active) over w{k}")))


@_register("report_rolling_stability", f"""d as ({DAYS}),
s as (select date, active, {_ROLL(20)}, {_ROLL(60)}, {_ROLL(120)}, case when active is not null then product(1 + active) over (order by date) end as nav from d window {", ".join(f"w{k} as (order by date rows between {k - 1} preceding and current row)" for k in (20, 60, 120))}),
answer as (select *, nav / max(nav) over (order by date) - 1 as drawdown from s)""",
"active nav drawdown " + " ".join(f"{n}_{k}d" for k in (20, 60, 120) for n in ("win_rate", "mean", "te", "ir", "sum")))
def _stability(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rolling_stability(_use(spark, sf, DAYS))


_DECILES = f"""{_LONG},
k as (select *, count(*) over (partition by date, factor) as n, avg(y) over (partition by date, factor) as base, row_number() over (partition by date, factor order by x, code) as r from l),
g as (select *, greatest(cast(ceil((r - 1) * 5 / (n - 1)::double) as bigint), 1) as "group" from k where n >= 50),
dec as (select factor, date, "group", avg(y) as mean, avg(y) - max(base) as excess from g group by 1, 2, 3)"""


@_register("report_decile_returns", f"{_DECILES}, answer as (select * from dec)", "mean excess")
def _deciles(spark: SparkSession, sf: str) -> DataFrame:
    return reports.decile_returns(_use(spark, sf, SIGNALS), _NAMES, groups=5)


@_register("report_factor_summary", f"""{_DAILY}, {_DECILES[_DECILES.index("k as") :]},
a as (select factor, avg(rank_ic) as rank_ic_mean, stddev_samp(rank_ic) as rank_ic_std, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12) * sqrt(12) as icir_annual, avg(cast(rank_ic > 0 as int)) as positive_share, count(rank_ic) as n_periods, case when avg(rank_ic) >= 0 then 1.0::double else -1.0 end as direction from daily where rank_ic is not null group by 1),
m as (select factor, avg(excess) filter ("group" = 5) as hi, avg(excess) filter ("group" = 1) as lo from dec group by 1),
answer as (select a.*, case when direction > 0 then hi else lo end as top_excess, case when direction > 0 then lo else hi end as bottom_excess, direction * (hi - lo) as long_short_excess from a left join m using (factor))""",
"rank_ic_mean rank_ic_std icir_annual positive_share top_excess bottom_excess long_short_excess direction")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.factor_summary(_daily(spark, sf), _deciles(spark, sf), groups=5)


@_register("report_industry_rank_ic", f"""{_LONG},
r as (select date, industry, factor, {_RANK("x", "date, industry, factor")} as rx, {_RANK("y", "date, industry, factor")} as ry from l where year(date) = 1996),
d as (select date, industry, factor, count(*) as n, case when stddev_samp(rx) > 1e-9 and stddev_samp(ry) > 1e-9 then corr(rx, ry) end as r from r group by 1, 2, 3 having count(*) >= 3),
answer as (select factor, industry, avg(round(r, 12)) as rank_ic_mean, avg(round(r, 12)) / (stddev_samp(r) + 1e-9) as rank_ic_ir, avg(cast(coalesce(round(r, 12) > 0, false) as int)) as positive_share, count(*) as n_dates, avg(n) as n_avg from d group by 1, 2)""",
"rank_ic_mean rank_ic_ir positive_share n_avg")
def _industry_ic(spark: SparkSession, sf: str) -> DataFrame:
    return reports.industry_rank_ic(_use(spark, sf, SIGNALS), _NAMES, 1996, least=3)


_SCORED = "s as (select *, case when f_gap is not null then (rank() over (partition by date order by f_gap nulls last) + (count(*) over (partition by date, f_gap) - 1) / 2.0) / count(f_gap) over (partition by date) end as p from f), t as (select *, coalesce(p >= 0.9, false) as top, coalesce(p <= 0.1, false) as bottom from s)"


@_register("report_latest_industries", f"f as ({SIGNALS}), {_SCORED}, u as (select * from t where date = (select max(date) from t)), c as (select count(*) as n, greatest(count(*) filter (top), 1) as t, greatest(count(*) filter (bottom), 1) as b from u), answer as (select industry, count(*) as n, avg(f_gap) as avg_score, median(f_gap) as median_score, avg(p) as avg_rank_pct, count(*) filter (top) as top_count, count(*) filter (bottom) as bottom_count, sum(amount) as value_sum, count(*) / max(c.n) as universe_share, count(*) filter (top) / max(c.t) as top_share, count(*) filter (bottom) / max(c.b) as bottom_share, count(*) filter (top) / max(c.t) - count(*) / max(c.n) as top_minus_universe from u, c group by 1)", "avg_score median_score avg_rank_pct value_sum universe_share top_share bottom_share top_minus_universe")
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_industry_exposure(_use(spark, sf, SIGNALS), "f_gap", "amount")


@_register("report_code_exposure", f"f as ({SIGNALS}), {_SCORED}, answer as (select code, avg(f_gap) as avg_score, median(f_gap) as median_score, avg(p) as avg_rank_pct, count(*) filter (top) as top_days, count(distinct date) as days, avg(label) as label_mean from t where year(date) = 1997 group by 1)", "avg_score median_score avg_rank_pct label_mean")
def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.code_exposure(_use(spark, sf, SIGNALS), "f_gap", 1997)


@_register("report_industry_exposure", f"f as ({SIGNALS}), {_SCORED}, d as (select date, industry, avg(f_gap) as a, median(f_gap) as m, avg(cast(top as int)) as t, count(*) as n from t where year(date) = 1997 group by 1, 2), answer as (select industry, avg(a) as avg_score, avg(m) as median_score, avg(t) as top_share, avg(n) as n_avg, count(*) as days from d group by 1)", "avg_score median_score top_share n_avg")
def _industries(spark: SparkSession, sf: str) -> DataFrame:
    return reports.industry_exposure(_use(spark, sf, SIGNALS), "f_gap", 1997)


_GROUPS = f"f as ({SIGNALS}), n as (select date, label, least(cast(floor(row_number() over (partition by date order by f_mom, code) * 5 / count(*) over (partition by date)) as int), 4) as g, count(*) over (partition by date) as n from f where f_mom is not null and label is not null), h as (select date, {', '.join(f'avg(label) filter (g = {k}) as g{k}' for k in range(5))}, avg(label) filter (g = 4) - avg(label) filter (g = 0) as long_short from n where n >= 25 group by 1), c as (select *, {', '.join(f'sum(coalesce({c}, 0)) over (order by date) as {c}_cum' for c in ('g0', 'g1', 'g2', 'g3', 'g4', 'long_short'))} from h)"


def _running(spark: SparkSession, sf: str) -> DataFrame:
    from tidewell.operators.evaluate import group_returns

    return reports.running_groups(group_returns(_use(spark, sf, SIGNALS), "f_mom"))


_register("report_running_groups", f"{_GROUPS}, answer as (select * from c)", "g0 g1 g2 g3 g4 long_short g0_cum g1_cum g2_cum g3_cum g4_cum long_short_cum")(_running)


@_register("report_long_short", f"{_GROUPS}, w as (select *, long_short_cum - max(long_short_cum) over (order by date) as fall from c), answer as (select avg(long_short) * 252 as annual_return, stddev_samp(long_short) * sqrt(252) as annual_deviation, avg(long_short) * 252 / (stddev_samp(long_short) * sqrt(252) + 1e-9) as ratio, min(fall) as max_drawdown, avg(cast(long_short > 0 as int)) as win_rate from w)", "annual_return annual_deviation ratio max_drawdown win_rate")
def _long_short(spark: SparkSession, sf: str) -> DataFrame:
    return reports.long_short_stats(_running(spark, sf))


# ---------------------------------------------------------------- audits


@_register("report_comparable_fits", f"t as ({FITS}), x as (select * from t where date in (select date from t group by 1 having count(distinct variant) = 4)), answer as (select variant, year, count(*) as dates, avg(r2) as r2_mean, median(r2) as r2_median, avg(cast(r2 >= 0.5 as int)) as r2_from_half from x where r2 is not null and not isnan(r2) group by 1, 2)", "r2_mean r2_median r2_from_half")
def _fits(spark: SparkSession, sf: str) -> DataFrame:
    t = _use(spark, sf, FITS).withColumn("r2", F.when(~F.isnan("r2"), F.col("r2"))).withColumn("year", F.col("year").cast("long"))
    return reports.regression_summary(reports.comparable(t, "variant", 4, ["year"]), ["variant", "year"])


_COV = "select 60 + 60 * (x.industry % 2) as \"window\", x.date, x.industry as factor_i, y.industry as factor_j, avg((x.close - 1.5) * (y.close - 1.5)) - 0.2 as covariance from panel x join panel y on x.date = y.date and x.industry = y.industry where x.code <= y.code group by 1, 2, 3, 4"


@_register("report_covariance_audit", f"v as ({_COV}), answer as (select \"window\", count(distinct date) as dates, count(*) as rows, count(*) filter (factor_i = factor_j and covariance < -1e-12) as negative_variances, (select count(*) from (select factor_i from v w where w.\"window\" = v.\"window\" union select factor_j from v w where w.\"window\" = v.\"window\")) as n_names from v group by 1)")
def _covariance(spark: SparkSession, sf: str) -> DataFrame:
    return reports.covariance_audit(_use(spark, sf, _COV.replace('"window"', "`window`")))


@_register("report_crosswalk", f"a as ({SPANS.format(k=6)}), b as ({SPANS.format(k=4)}), x as (select * from a where code % 3 <> 0 and since <= date '1996-06-01' and (until is null or until > date '1996-06-01')), y as (select * from b where code % 5 <> 0 and since <= date '1996-06-01' and (until is null or until > date '1996-06-01')), answer as (select x.cls as left_class, y.cls as right_class, count(*) as codes from x full join y on x.code = y.code group by 1, 2)")
def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _use(spark, sf, SPANS.format(k=6)).where("code % 3 <> 0"), spark.sql(SPANS.format(k=4)).where("code % 5 <> 0")
    return reports.membership_crosswalk(a, b, "1996-06-01")


@_register("report_class_coverage", "x as (select *, case when code % 8 <> 0 then industry end as cls from panel), answer as (select year(date) as year, count(*) as rows, count(cls) as matched, count(*) - count(cls) as unmatched, count(cls) / count(*) as coverage, count(distinct code) as codes, count(distinct cls) as classes from x group by 1)", "coverage")
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.class_coverage(base_panel(spark, sf).withColumn("cls", F.expr("case when code % 8 <> 0 then industry end")), "cls")


_SETS = {"all": "true", "some": "code < 3", "none": "code < 0"}


@_register("report_dataset_coverage", "answer as (" + " union all ".join(f"select '{k}' as dataset, count(*) as rows, min(date) as date_min, max(date) as date_max, count(distinct date) as observed_dates, count(distinct code) as entities, (select count(distinct date) from panel where month(date) <> 2) as reference_dates, count(distinct date) filter (month(date) <> 2) / (select count(distinct date) from panel where month(date) <> 2) as date_coverage, case when count(*) > 0 then 'available' else 'empty' end as status from panel where {v}" for k, v in _SETS.items()) + ")", "date_coverage")
def _datasets(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf).select("code", "date")
    return reports.dataset_coverage({k: p.where(v) for k, v in _SETS.items()}, p.where("month(date) <> 2"), "code")


# ---------------------------------------------------------------- assembly


@_register("assemble_analyst", f"""r as (select *, report_date + 1 as d from ({REPORTS})),
answer as (select p.code, p.date, case when count(*) filter (k.code is not null) > 0 then count(r.d) filter (r.d >= p.date - 90) end as report_count_90, case when count(*) filter (k.code is not null) > 0 then count(distinct r.org) filter (r.d >= p.date - 180) end as org_count_180, avg(rating) filter (r.d >= p.date - 180) as rating_180, avg(target) filter (r.d >= p.date - 180) / p.close - 1 as target_upside_180, avg(eps) filter (r.d >= p.date - 180) / avg(eps) filter (r.d < p.date - 180) - 1 as eps_revision_180, avg(eps) filter (r.d >= p.date - 180) as forward_eps_180
from panel p left join r on p.code = r.code and r.d <= p.date and r.d >= p.date - 360 left join (select distinct code from r) k on k.code = p.code group by p.code, p.date, p.close)""",
"rating_180 target_upside_180 eps_revision_180 forward_eps_180")
def _analyst(spark: SparkSession, sf: str) -> DataFrame:
    reports_ = _use(spark, sf, REPORTS)
    return assembly.analyst_features(spark.table("panel"), reports_)


_SHEET = "code, end_date, available, revenue_ttm, net_profit_ttm, oper_cost_ttm, rd_exp_ttm, total_assets, total_liab, equity, money_cap, accounts_receiv, inventories, acct_payable, cashflow_ttm, capex_ttm"
_SAFE = lambda a, b: f"case when abs({b}) > 1e-12 then ({a}) / {b} end"
_MARGIN, _TURN = _SAFE("revenue_ttm - oper_cost_ttm", "revenue_ttm"), _SAFE("revenue_ttm", "total_assets")


@_register("assemble_statements", f"""i as ({STATEMENTS["income"]}), b as ({STATEMENTS["balance"]}), c as ({STATEMENTS["cash"]}),
k as (select code, end_date, max(available) as available from (select code, end_date, available from i union all select code, end_date, available from b union all select code, end_date, available from c) group by 1, 2),
m as (select k.*, i.* exclude (code, end_date, available), b.* exclude (code, end_date, available), c.* exclude (code, end_date, available) from k left join i using (code, end_date) left join b using (code, end_date) left join c using (code, end_date)),
x as (select {_SHEET}, {_SAFE("net_profit_ttm", "equity")} as roe_ttm, {_SAFE("net_profit_ttm", "total_assets")} as roa_ttm, {_MARGIN} as gross_margin_ttm, {_SAFE("net_profit_ttm", "revenue_ttm")} as net_margin_ttm, {_SAFE("cashflow_ttm", "revenue_ttm")} as operating_cf_margin_ttm, {_SAFE("cashflow_ttm", "net_profit_ttm")} as cashflow_to_profit, {_SAFE("rd_exp_ttm", "revenue_ttm")} as rd_expense_intensity, {_SAFE("capex_ttm", "total_assets")} as capex_to_assets, {_SAFE("total_liab", "total_assets")} as debt_to_assets, {_TURN} as asset_turnover_ttm, {_SAFE("money_cap", "total_liab")} as cash_to_liab, {_SAFE("accounts_receiv + inventories - acct_payable", "total_assets")} as working_capital_pressure from m),
answer as (select *, gross_margin_ttm / lag(gross_margin_ttm, 4) over w - 1 as gross_margin_yoy, asset_turnover_ttm / lag(asset_turnover_ttm, 4) over w - 1 as asset_turnover_yoy from x window w as (partition by code order by end_date))""",
_SHEET.replace(",", "").replace("code end_date available ", "") + " roe_ttm roa_ttm gross_margin_ttm net_margin_ttm operating_cf_margin_ttm cashflow_to_profit rd_expense_intensity capex_to_assets debt_to_assets asset_turnover_ttm cash_to_liab working_capital_pressure gross_margin_yoy asset_turnover_yoy")
def _statements(spark: SparkSession, sf: str) -> DataFrame:
    base_panel(spark, sf).createOrReplaceTempView("panel")
    return assembly.statement_ratios(assembly.merge_statements({k: spark.sql(v) for k, v in STATEMENTS.items()}))


_FUNDS = f"funds as (select p.code, p.date, p.close, p.volume, p.amount, s.shares, c.category, c.risk_bucket, c.reviewed, p.amount * 1000 as amount_units, p.close * s.shares * 10000 as market_value, p.amount * 1000 / (p.close * s.shares * 10000) as turnover from panel p join ({SHARES}) s using (code, date) join ({CLASSES}) c using (code, date) where p.close > 0 and s.shares > 0)"


@_register("assemble_funds", f"{_FUNDS}, answer as (select * from funds)", "close volume amount shares amount_units market_value turnover")
def _funds(spark: SparkSession, sf: str) -> DataFrame:
    daily = _use(spark, sf, "select code, date, close, volume, amount from panel")
    return assembly.fund_panel(daily, spark.sql(SHARES).withColumn("shares", F.col("shares").cast("double")), spark.sql(CLASSES))


_BUCKET = lambda b: f"nullif(count(distinct code) filter (risk_bucket = '{b}'), 0) as {b}_count, " + ", ".join(f"sum({c}) filter (risk_bucket = '{b}') as {b}_{c}" for c in ("volume", "amount", "shares", "market_value")) + f", 1000 * sum(amount) filter (risk_bucket = '{b}') / sum(market_value) filter (risk_bucket = '{b}') as {b}_turnover, " + ", ".join(f"max({c}) filter (risk_bucket = '{b}') / sum({c}) filter (risk_bucket = '{b}') as {b}_largest_{c}_share" for c in ("volume", "amount", "market_value"))


@_register("assemble_risk_groups", f"{_FUNDS}, answer as (select date, {_BUCKET('low_risk')}, {_BUCKET('risk')} from funds where risk_bucket in ('low_risk', 'risk') group by 1)", " ".join(f"{b}_{c}" for b in ("low_risk", "risk") for c in ("volume", "amount", "shares", "market_value", "turnover", "largest_volume_share", "largest_amount_share", "largest_market_value_share")))
def _risk_groups(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.risk_groups(_funds(spark, sf))


_DIRECTION = lambda v: f"case when signal_quality = 'D' or {v} is null then 'insufficient' when {v} = -1 then 'strong' when {v} = 1 then 'weak' else 'mixed' end"


@_register("assemble_decisions", f"""b as ({BASIS}), s as ({VOTES}),
a as (select date, row_number() over (order by date) as n, volume_signal = turnover_signal and volume_signal in (-1, 1) as agree, volume_signal, turnover_signal, signal_quality from s),
c as (select *, max(case when agree then date end) over (order by date) as last_consensus, n - max(case when agree then n end) over (order by date) as signal_age from a),
j as (select b.*, c.* exclude (date, n, agree), case when basis_quality = 'D' or percentile is null then 'insufficient' when percentile <= 20 then 'low' when percentile >= 80 then 'high' else 'neutral' end as basis_status from b left join c using (date) where is_main),
k as (select *, case when signal_quality = 'D' or volume_signal is null or turnover_signal is null then 'insufficient' when volume_signal = -1 and turnover_signal = -1 then 'strong' when volume_signal = 1 and turnover_signal = 1 then 'weak' else 'mixed' end as appetite_status from j),
answer as (select date, product, contract, percentile, basis_status, case when dividend_source = 'disclosed_events' then 'disclosed' when dividend_source in ('partial_disclosed_events', 'estimated_events', 'proxy') then 'partial' else 'unavailable' end as dividend_status, {_DIRECTION("volume_signal")} as volume_status, {_DIRECTION("turnover_signal")} as turnover_status, appetite_status, last_consensus, signal_age, case when coalesce(basis_quality, '') = 'D' or coalesce(signal_quality, '') = 'D' or basis_status = 'insufficient' or appetite_status = 'insufficient' then 'insufficient' when basis_status = 'neutral' or appetite_status = 'mixed' then 'mixed' else 'limited_support' end as overall_status, 'basis=' || basis_status || ';risk=' || appetite_status || ';basis_quality=' || coalesce(basis_quality, 'D') || ';signal_quality=' || coalesce(signal_quality, 'D') || ';relative_exposure=unavailable' as reasons from k)""",
"percentile")
def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    from tidewell.operators.monitor import by_bounds

    return assembly.decision_summary(_use(spark, sf, BASIS), spark.sql(VOTES), by_bounds(F.col("percentile"), F.coalesce("basis_quality", F.lit("")), "low", "high"))


_CLIPPED = "w as (select code, date, case when disc - 0.02 > 0 then disc - 0.02 end as w from panel), q as (select date, count(w) as n, quantile_cont(w, 0.01) as lo, quantile_cont(w, 0.99) as hi from w group by 1), clipped as (select code, w.date, case when n >= 20 and w is not null then least(greatest(w, lo), hi) else w end as w from w join q on w.date = q.date)"


@_register("weights_clipped", f"{_CLIPPED}, answer as (select * from clipped)", "w")
def _clipped(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.clip_weights(base_panel(spark, sf).select("code", "date", (F.col("disc") - 0.02).alias("w")), "w")


@_register("weights_diagnostics", f"{_CLIPPED}, answer as (select date, sum(w) * sum(w) / sum(w * w) as effective_size, sum(w) * sum(w) / sum(w * w) / nullif(count(w), 0) as effective_share, max(w) / sum(w) as max_share, quantile_cont(w, 0.99) / quantile_cont(w, 0.5) as p99_p50, stddev_pop(w) / avg(w) as variation from clipped group by 1)", "effective_size effective_share max_share p99_p50 variation")
def _diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.weight_diagnostics(_clipped(spark, sf), "w")


@_register("weights_size", "answer as (select code, date, case when amount - 1 > 0 then sqrt(amount - 1) else 1 end as w from panel)", "w")
def _size(spark: SparkSession, sf: str) -> DataFrame:
    return base_panel(spark, sf).select("code", "date", assembly.size_weights(F.col("amount") - 1).alias("w"))


@_register("pool_rare_groups", "g as (select code, date, coalesce(cast(case when code % 10 <> 0 then industry end as varchar), 'unknown') as grp from panel), n as (select date, grp, count(*) as n from g group by 1, 2), answer as (select code, date, case when n < 4 then 'other' else grp end as grp from g join n using (date, grp))")
def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf).select("code", "date", F.expr("case when code % 10 <> 0 then industry end").alias("grp"))
    return assembly.pool_rare(p, "grp", 4)


_MODES = {"forward_1d": ("lead(close) over w / close - 1", "disc", "industry"), "same_day": ("close / lag(close) over w - 1", "disc", "industry"), "lagged_exposure_1d": ("close / lag(close) over w - 1", "lag(disc) over w", "lag(industry) over w")}


@_register("align_returns", "answer as (" + " union all ".join(f"select '{k}' as mode, code, date, {d} as disc, {g} as industry, {y} as y from panel window w as (partition by code order by date)" for k, (y, d, g) in _MODES.items()) + ")", "disc y")
def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf).select("code", "date", "close", "disc", "industry")
    parts = [assembly.align_returns(p, k, ["disc", "industry"]).select(F.lit(k).alias("mode"), "code", "date", "disc", "industry", "y") for k in _MODES]
    return parts[0].union(parts[1]).union(parts[2])


@_register("lagged_risk", "d as (select date, lag(date, 3) over (order by date) as risk_date from (select distinct date from panel)), answer as (select p.code, p.date, d.risk_date, v.tax as risk from panel p join d using (date) left join panel v on v.code = p.code and v.date = d.risk_date and v.disc > 0.02)", "risk")
def _lagged(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    return assembly.lagged_by_calendar(p.select("code", "date"), p.where("disc > 0.02").select("code", "date", F.col("tax").alias("risk")), ["risk"]).select("code", "date", "risk_date", "risk")


@_register("external_signals", "answer as (select date, code, 'close' as factor, close as value, 'own' as source, 'v1' as version, date '2000-01-01' as release_date from panel union all select date, code, 'note', try_cast(case when code % 2 = 0 then 'n/a' else cast(tax as varchar) end as double), 'own', 'v1', date '2000-01-01' from panel)", "value")
def _external(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf).select("code", "date", "close", F.expr("case when code % 2 = 0 then 'n/a' else cast(tax as string) end").alias("note"))
    return assembly.external_signals(p, ["close", "note"], "own", "v1", "2000-01-01")
