"""Registered queries over the test tables, each with DuckDB SQL for the same rows.

Doubles are rounded to four decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import rules
from tidewell.operators import evaluate, extremes, joins, monitor, portfolio, risk
from tidewell.plans import catalog
from tidewell.plans.expr import plan
from tidewell.plans.panel_sql import PANEL
from tidewell.sources.panel import BASE, FULL, base_panel, full_sql

DECIMALS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _expressions(name: str, expressions: dict[str, str], full: bool) -> None:
    p = plan(expressions)
    QUERIES[name] = lambda spark, sf: p.spark(base_panel(spark, sf), decimals=DECIMALS, sources=FULL if full else ())
    ORACLES[name] = p.duckdb(full_sql() if full else BASE, decimals=DECIMALS)


for _k, _e in catalog.OPERATORS.items():
    _expressions(f"panel_{_k}", {"value": _e}, False)
    # this SQL doesn't come from the planner
    ORACLES[f"panel_{_k}"] = f"with panel as ({BASE}), {PANEL[_k]} select code, date, cast(round(value + 1.2345e-8, {DECIMALS}) as double) as value from answer"
_expressions("catalog_daily", catalog.daily(), False)
_expressions("catalog_statement", catalog.statement(), True)
_expressions("catalog_atoms", catalog.atoms(), True)
_expressions("catalog_combinations", catalog.combinations(), True)
_expressions("catalog_descriptors", catalog.descriptors(), True)
_expressions("catalog_descriptors_v2", catalog.descriptors_v2(), True)
_expressions("catalog_features", catalog.FEATURES, False)
_expressions("catalog_styles", catalog.STYLES, True)
_public = list(catalog.PUBLIC.items())
for _i in range(0, len(_public), 13):
    _expressions(f"catalog_public_{_i + 1:02d}", dict(_public[_i : _i + 13]), True)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1.2345e-8, DECIMALS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _register(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: _round(f(spark, sf))
        if sql:
            cols = f"* replace ({', '.join(f'round({c} + 1.2345e-8, {DECIMALS}) as {c}' for c in rounded)})" if rounded else "*"
            ORACLES[name] = f"with panel as ({BASE}), answer as ({sql}) select {cols} from answer"
        return f

    return put


# ---------------------------------------------------------------- joins

_STATEMENTS = "select code, date + interval 3 day as available, round(amount, 6) as eps from panel where extract(day from date) <= 7"


def _statements(panel: DataFrame) -> DataFrame:
    return panel.where("day(date) <= 7").select("code", F.date_add("date", 3).alias("available"), F.round("amount", 6).alias("eps"))


@_register("join_asof", f"select p.code, p.date, cast(s.available as date) as available, s.eps from panel p asof left join ({_STATEMENTS}) s on p.code = s.code and p.date >= cast(s.available as date)", ("eps",))
def _asof(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    return joins.asof_join(p.select("code", "date"), _statements(p), "code", "date", "available")


@_register("join_asof_strict", "select p.code, p.date, s.date as before, s.close from panel p asof left join panel s on p.code = s.code and p.date > s.date", ("close",))
def _asof_strict(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    return joins.asof_join(p.select("code", "date"), p.select("code", F.col("date").alias("before"), "close"), "code", "date", "before", strict=True)


_SNAP = "select code, date, amount as weight from panel where extract(day from date) <= 7 and amount > 1"


@_register("join_snapshot", f"select p.code, p.date, s.snapshot, case when s.snapshot is not null then coalesce(w.weight, 0) end as weight from panel p left join (select d.date, s.date as snapshot from (select distinct date from panel) d asof left join (select distinct date from ({_SNAP})) s on d.date >= s.date) s on p.date = s.date left join ({_SNAP}) w on w.date = s.snapshot and w.code = p.code", ("weight",))
def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    return joins.snapshot_join(p.select("code", "date"), p.where("day(date) <= 7 and amount > 1").select("code", "date", F.col("amount").alias("weight")), "code", "date", "weight")


_SPANS = "select code, date as since, lead(date) over (partition by code order by date) as until, industry as cls from panel where extract(month from date) in (1, 7) and extract(day from date) <= 7"


@_register("join_interval", f"select p.code, p.date, s.since, s.until, s.cls from panel p left join ({_SPANS}) s on p.code = s.code and p.date >= s.since and (s.until is null or p.date < s.until)")
def _interval(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    p.createOrReplaceTempView("panel")
    return joins.interval_join(p.select("code", "date"), spark.sql(_SPANS), "code", "date", "since", "until")


@_register("join_calendar_lag", "select date, lag(date, 3) over (order by date) as asof from (select distinct date from panel)")
def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return joins.calendar_lag(base_panel(spark, sf), "date", 3)


@_register("join_latest_snapshot", "select code, date, close from panel where date = (select max(date) from panel where date <= date '1999-06-30')", ("close",))
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_on_or_before(base_panel(spark, sf).select("code", "date", "close"), "date", "1999-06-30")


@_register("gap_aware_returns", "with d as (select date, row_number() over (order by date) n from (select distinct date from panel)), x as (select code, date, close, n, lag(n) over w as a, lead(n) over w as b, lag(close) over w as p, lead(close) over w as f from panel join d using (date) window w as (partition by code order by date)) select code, date, case when n - a = 1 then close / p - 1 end as returns_1d, case when b - n = 1 then f / close - 1 end as fwd_1d_return from x", ("returns_1d", "fwd_1d_return"))
def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return joins.gap_aware_returns(base_panel(spark, sf).select("code", "date", "close"), "code", "date", "close").select("code", "date", "returns_1d", "fwd_1d_return")


_QUARTERS = "select code, (date_trunc('quarter', date) + interval 3 month - interval 1 day)::date as end_date, sum(amount) as revenue from panel group by 1, 2"


@_register(
    "statement_quarters",
    f"with q as ({_QUARTERS}), c as (select code, end_date, sum(revenue) over (partition by code, year(end_date) order by end_date) as revenue from q), s as (select *, case when quarter(end_date) = 1 then revenue else revenue - lag(revenue) over (partition by code, year(end_date) order by end_date) end as revenue_q from c) select code, end_date, revenue, revenue_q, case when count(revenue_q) over f >= 4 then sum(revenue_q) over f end as revenue_ttm, case when abs(lag(revenue_q, 4) over w) > 1e-12 then revenue_q / lag(revenue_q, 4) over w - 1 end as revenue_yoy, case when abs(lag(revenue_q) over w) > 1e-12 then revenue_q / lag(revenue_q) over w - 1 end as revenue_qoq from s window w as (partition by code order by end_date), f as (partition by code order by end_date rows between 3 preceding and current row)",
    ("revenue", "revenue_q", "revenue_ttm", "revenue_yoy", "revenue_qoq"),
)
def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    q = base_panel(spark, sf).groupBy("code", F.last_day(F.add_months(F.date_trunc("quarter", "date"), 2)).alias("end_date")).agg(F.sum("amount").alias("r"))
    q.createOrReplaceTempView("quarter_sums")
    c = spark.sql("select code, end_date, sum(r) over (partition by code, year(end_date) order by end_date) as revenue from quarter_sums")
    return joins.quarterly_features(c, ["revenue"])


@_register("event_windows", "with e as (select user_id as code, cast(ts as date) + 1 as d, value, event_type from events), k as (select distinct user_id as code, cast(ts as date) as date from events) select k.code, k.date, count(e.code) as n_events, count(distinct e.event_type) as n_orgs, avg(e.value) as mean_value from k left join e on e.code = k.code and e.d <= k.date and e.d >= k.date - 7 group by 1, 2", ("mean_value",))
def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("code"), F.to_date("ts").alias("day"), "value", "event_type")
    out = joins.event_windows(e.select("code", F.col("day").alias("date")).distinct(), e, "code", "date", "day", "value", "event_type", 7)
    return out.withColumn("n_orgs", F.col("n_orgs").cast("long"))


_FUT = "select industry as product, date, cast(date + 28 * cast(code % 3 + 1 as int) as date) as expiry, avg(close) as price from panel group by 1, 2, 3"
_IDX = "select industry as product, date, avg(open) as index_close from panel group by 1, 2"
_BASIS = f"select f.product, f.date, f.expiry, f.price, i.index_close, date_diff('day', f.date, f.expiry) as days_to_expiry, f.price - i.index_close as basis, (f.price - i.index_close) / i.index_close * 365 / date_diff('day', f.date, f.expiry) as annualised, row_number() over (partition by f.product, f.date order by f.expiry) as tenor from ({_FUT}) f left join ({_IDX}) i using (product, date)"


def _basis(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    fut = p.groupBy(F.col("industry").alias("product"), "date", F.expr("date_add(date, cast(28 * (code % 3 + 1) as int))").alias("expiry")).agg(F.avg("close").alias("price"))
    idx = p.groupBy(F.col("industry").alias("product"), "date").agg(F.avg("open").alias("index_close"))
    return monitor.basis_table(fut, idx).drop("points")


@_register("monitor_basis", _BASIS, ("price", "index_close", "basis", "annualised"))
def _basis_query(spark: SparkSession, sf: str) -> DataFrame:
    return _basis(spark, sf).withColumn("days_to_expiry", F.col("days_to_expiry").cast("long")).withColumn("tenor", F.col("tenor").cast("long"))


@_register("monitor_pairs", f"with b as (select *, case when tenor = 3 then 'D' else 'B' end as quality from ({_BASIS})) select a.date, a.tenor, a.product as long_product, b.product as short_product, abs(date_diff('day', b.expiry, a.expiry)) as expiry_gap, greatest(a.quality, b.quality) as quality, case when abs(date_diff('day', b.expiry, a.expiry)) <= 7 and greatest(a.quality, b.quality) <> 'D' then a.annualised - b.annualised end as spread from b a join b b on a.date = b.date and a.tenor = b.tenor and a.product <> b.product", ("spread",))
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = _basis(spark, sf).withColumn("quality", F.when(F.col("tenor") == 3, "D").otherwise("B"))
    return joins.pair_legs(b).withColumn("tenor", F.col("tenor").cast("long")).withColumn("expiry_gap", F.col("expiry_gap").cast("long"))


@_register("monitor_expanding_percentile", "select a.code, a.date, a.amount, (count(*) filter (b.amount < a.amount) + (count(*) filter (b.amount = a.amount) + 1) / 2.0) / count(*) * 100 as percentile from panel a join panel b on a.code = b.code and b.date <= a.date group by 1, 2, 3", ("amount", "percentile"))
def _percentile(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.expanding_percentile(base_panel(spark, sf).select("code", "date", "amount"), "amount", "code", "date")


# ---------------------------------------------------------------- evaluation

_SIGNAL_TEXT = {"f_mom": "ts_pct(close, 4)", "f_vol": "-ts_std(ts_pct(close, 1), 8)", "f_turn": "cs_rank(turnover_rate)", "label": "ts_lead(close, 2) / ts_lead(close, 1) - 1"}
_FPLAN = plan(_SIGNAL_TEXT)
_FSQL = _FPLAN.duckdb("select * from panel", ("code", "date", "industry", "amount"))
_R = lambda x, by: f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count(*) over (partition by {by})"
_IC = f"with f as ({_FSQL}), l as (select date, factor, x, label as y from f unpivot (x for factor in (f_mom, f_vol, f_turn)) where label is not null and x is not null), r as (select *, {_R('x', 'date, factor')} as rx, {_R('y', 'date, factor')} as ry from l) select date, factor, count(*) as n, corr(x, y) as ic, corr(rx, ry) as rank_ic from r group by 1, 2 having count(*) >= 3"


def _signal_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _FPLAN.spark(base_panel(spark, sf), ("code", "date", "industry", "amount"))


@_register("evaluate_daily_ic", _IC, ("ic", "rank_ic"))
def _ic(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.daily_ic(_signal_panel(spark, sf), ["f_mom", "f_vol", "f_turn"])


@_register("evaluate_ic_summary", f"with i as ({_IC}) select factor, count(*) as days, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(ic) / (stddev_samp(ic) + 1e-9) as ic_ir, avg(case when round(ic, 12) > 0 then 1.0 else 0.0 end) as ic_positive, avg(rank_ic) as rank_ic_mean, stddev_samp(rank_ic) as rank_ic_std, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-9) as rank_ic_ir, avg(case when round(rank_ic, 12) > 0 then 1.0 else 0.0 end) as rank_ic_positive from i group by factor", ("ic_mean", "ic_std", "ic_ir", "ic_positive", "rank_ic_mean", "rank_ic_std", "rank_ic_ir", "rank_ic_positive"))
def _ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ic_summary(_ic(spark, sf))


@_register("evaluate_monthly_ic", f"with i as ({_IC}) select factor, cast(date_trunc('month', date) as date) as month, count(*) as days, avg(rank_ic) as rank_ic from i group by 1, 2", ("rank_ic",))
def _monthly_ic(spark: SparkSession, sf: str) -> DataFrame:
    return _ic(spark, sf).groupBy("factor", F.date_trunc("month", "date").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("days"), F.avg("rank_ic").alias("rank_ic"))


@_register("evaluate_group_returns", f"with f as ({_FSQL}), p as (select date, label, least(cast(floor(row_number() over (partition by date order by f_mom, code) / count(*) over (partition by date) * 5) as int), 4) as g, count(*) over (partition by date) as n from f where f_mom is not null and label is not null) select date, {', '.join(f'avg(label) filter (g = {k}) as g{k}' for k in range(5))}, avg(label) filter (g = 4) - avg(label) filter (g = 0) as long_short from p where n >= 25 group by date", ("g0", "g1", "g2", "g3", "g4", "long_short"))
def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.group_returns(_signal_panel(spark, sf), "f_mom")


_W = "select code, date, amount / sum(amount) over (partition by date) as w from panel where amount > 1"


@_register("evaluate_turnover", f"with w as ({_W}), d as (select date, row_number() over (order by date) n from (select distinct date from w)), x as (select n, code, w from w join d using (date)), t as (select coalesce(a.n, b.n + 1) as n, coalesce(a.w, 0) - coalesce(b.w, 0) as c from x a full join x b on a.code = b.code and a.n = b.n + 1) select date, sum(abs(c)) / 2 as turnover from t join d using (n) where n > 1 group by date", ("turnover",))
def _turnover(spark: SparkSession, sf: str) -> DataFrame:
    base_panel(spark, sf).createOrReplaceTempView("panel")
    return evaluate.turnover(spark.sql(_W))


@_register("evaluate_factor_correlation", f"with f as ({_FSQL}), r as (select date, {', '.join(f'case when {c} is not null then (rank() over (partition by date order by {c} nulls last) + (count(*) over (partition by date, {c}) - 1) / 2.0) / count({c}) over (partition by date) end as {c}' for c in ('f_mom', 'f_vol', 'f_turn'))} from f), d as (select date, {', '.join(f'case when count(*) filter ({a} is not null and {b} is not null) >= 20 then corr({a}, {b}) end as {a}_{b}' for a, b in (('f_mom', 'f_vol'), ('f_mom', 'f_turn'), ('f_vol', 'f_turn')))} from r group by date) select 'f_mom' as left, 'f_vol' as right, avg(abs(f_mom_f_vol)) as mean_abs from d union all select 'f_mom', 'f_turn', avg(abs(f_mom_f_turn)) from d union all select 'f_vol', 'f_turn', avg(abs(f_vol_f_turn)) from d".replace("as left,", 'as "left",').replace("as right,", 'as "right",'), ("mean_abs",))
def _correlation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_correlation(_signal_panel(spark, sf), ["f_mom", "f_vol", "f_turn"])


@_register("evaluate_validation", f"with i as ({_IC}), s as (select factor, avg(rank_ic) filter (date >= date '1995-01-01' and date < date '1999-01-01') as train, avg(rank_ic) filter (date >= date '1999-01-01' and date < date '2002-01-01') as test from i group by factor) select *, cast(sign(train) as double) as direction, least(train * sign(train), test * sign(train)) as min_adjusted, least(train * sign(train), test * sign(train)) > 0 as passed from s", ("train", "test", "direction", "min_adjusted"))
def _validation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.validate(_ic(spark, sf), {"train": ("1995-01-01", "1999-01-01"), "test": ("1999-01-01", "2002-01-01")})


# ---------------------------------------------------------------- risk, portfolio, monitoring


@_register("risk_style_blend", f"with f as ({_FSQL}), x as (select code, date, (case when f_mom is not null then 0.6 else 0 end) + (case when f_vol is not null then 0.4 else 0 end) as have, coalesce(f_mom, 0) * 0.6 + coalesce(f_vol, 0) * 0.4 as t from f) select code, date, case when have >= 0.6 - 1e-12 then t / have end as style from x", ("style",))
def _blend(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_panel(spark, sf).select("code", "date", risk.blend({"f_mom": 0.6, "f_vol": 0.4}).alias("style"))


@_register("risk_calibration", "select industry, count(*) as n, sqrt(sum(disc) / greatest(sum(tax), 1e-12)) as bias, avg(abs(ln(greatest(disc, 1e-12) / greatest(tax, 1e-12)))) as abs_log_error, avg(greatest(disc, 1e-12) / greatest(tax, 1e-12) - ln(greatest(disc, 1e-12) / greatest(tax, 1e-12)) - 1) as qlike from panel where disc > 0 and tax > 0 group by industry", ("bias", "abs_log_error", "qlike"))
def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    return risk.calibration(base_panel(spark, sf).where("disc > 0 and tax > 0"), "disc", "tax", ["industry"])


@_register("risk_complete_periods", "with p as (select code, date, close, cast(date_trunc('month', date) as date) as period from panel), d as (select period, count(distinct date) as days from p group by 1) select code, period, sum(close) as total, count(close) as n, days, count(close) / days as completeness from p join d using (period) where period < (select max(period) from p) group by code, period, days having count(close) / days >= 0.6", ("total", "completeness"))
def _periods(spark: SparkSession, sf: str) -> DataFrame:
    return risk.complete_periods(base_panel(spark, sf), "close").select("code", "period", "total", "n", "days", "completeness")


@_register("portfolio_style_exposure", f"with f as ({_FSQL}), w as (select *, amount / sum(amount) over (partition by date) as b, 1.0 / count(*) over (partition by date) as w from f) select date, sum((w - b) * coalesce(f_mom, 0)) as f_mom, sum((w - b) * coalesce(f_vol, 0)) as f_vol from w group by date", ("f_mom", "f_vol"))
def _style_exposure(spark: SparkSession, sf: str) -> DataFrame:
    f = _signal_panel(spark, sf).withColumn("w", F.expr("1e0 / count(1) over (partition by date)"))
    return portfolio.active_exposure(f, "w", "amount", ["f_mom", "f_vol"])


@_register("portfolio_rebalance_dates", "select max(date) as date from panel group by date_trunc('month', date)")
def _rebalances(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.rebalance_dates(base_panel(spark, sf).select("date").distinct())


@_register("monitor_signals", "with g as (select industry as grp, date, sum(volume) as volume, sum(amount) as shares from panel group by 1, 2), s as (select *, case when count(volume) over f >= 5 then avg(volume) over f end as smooth from g window f as (partition by grp order by date rows between 4 preceding and current row)), c as (select *, round(smooth / lag(smooth, 5) over w - 1, 12) as volume_change, round(shares / lag(shares, 20) over w - 1, 12) as share_change from s window w as (partition by grp order by date)), a as (select *, cast(case when sign(volume_change) = sign(share_change) then sign(volume_change) end as int) as agreed, row_number() over (partition by grp order by date) as n from c) select grp, date, volume_change, share_change, agreed, coalesce(last_value(agreed ignore nulls) over u, 0) as held, n - last_value(case when agreed is not null then n end ignore nulls) over u as age from a window u as (partition by grp order by date rows between unbounded preceding and current row)", ("volume_change", "share_change"))
def _signals(spark: SparkSession, sf: str) -> DataFrame:
    g = base_panel(spark, sf).groupBy(F.col("industry").alias("grp"), "date").agg(F.sum("volume").alias("volume"), F.sum("amount").alias("shares"))
    out = monitor.risk_signals(g).select("grp", "date", "volume_change", "share_change", "agreed", "held", "age")
    return out.withColumn("age", F.col("age").cast("long"))


@_register("monitor_decisions", "with r as (select code as subject, industry % 3 as evidence_group, sign(disc - tax) as direction from panel union all select code, 7, sign(close - open) from panel), g as (select subject, evidence_group, median(direction) as d from r group by 1, 2), o as (select subject, count(*) as n_groups, count(*) filter (d > 0) as support, count(*) filter (d < 0) as oppose from g group by 1) select *, case when n_groups < 2 then 'insufficient' when support > oppose then 'supported' when oppose > support then 'opposed' else 'mixed' end as status from o")
def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    r = p.select(F.col("code").alias("subject"), (F.col("industry") % 3).alias("evidence_group"), F.signum(F.col("disc") - F.col("tax")).alias("direction"))
    r = r.union(p.select("code", F.lit(7).cast("long"), F.signum(F.col("close") - F.col("open"))))
    return monitor.decision_status(r)


_CO = "select code, date, close / lag(close) over (partition by code order by date) - 1 as ret, amount as turnover_key, avg(disc) over (partition by date, industry) as group_ret, avg(tax) over (partition by date) as market_ret from panel"


@_register("co_momentum_extremes")
def _co_momentum(spark: SparkSession, sf: str) -> DataFrame:
    base_panel(spark, sf).createOrReplaceTempView("panel")
    return extremes.co_momentum(spark.sql(_CO))


@_register("rolling_poly_resid")
def _poly(spark: SparkSession, sf: str) -> DataFrame:
    return extremes.rolling_poly_resid(base_panel(spark, sf), "close", "volume", 20, 2, 10)


_TEXTS = "select p_partkey as id, case p_partkey % 7 when 0 then 'BUY now' when 1 then 'Overweight' when 2 then 'hold' when 3 then 'Sell' when 4 then 'reduce' when 5 then null else p_name end as rating from part"


@_register("rating_scores", f"select id, case when lower(trim(rating)) similar to '.*(buy|outperform).*' then 1.0 when lower(rating) similar to '.*(overweight|add).*' then 0.5 when lower(rating) similar to '.*(neutral|hold|market perform).*' then 0.0 when lower(rating) like '%sell%' then -1.0 when lower(rating) similar to '.*(underweight|reduce|underperform).*' then -0.5 end::double as score from ({_TEXTS})")
def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(_TEXTS).select("id", rules.rating_score(F.col("rating")).alias("score"))


@_register("index_drift_weights", "with s as (select code, date, amount as weight from panel where date in (select min(date) from panel group by date_trunc('quarter', date))), sp as (select distinct date as since, lead(date) over (order by date) as until from (select distinct date from s)), d as (select distinct p.date, since from panel p join sp on p.date >= since and (until is null or p.date < until)), x as (select d.date, d.since, s.code, s.weight as base, p.close from d join s on s.date = d.since left join panel p on p.code = s.code and p.date = d.date), y as (select *, last_value(close ignore nulls) over w as p, first_value(close ignore nulls) over w as b from x window w as (partition by since, code order by date rows between unbounded preceding and current row)) select code, date, base * p / b / sum(base * p / b) over (partition by date) * 100 as weight from y where p is not null and b > 0", ("weight",))
def _drift(spark: SparkSession, sf: str) -> DataFrame:
    p = base_panel(spark, sf)
    first = p.groupBy(F.date_trunc("quarter", "date")).agg(F.min("date").alias("date")).select("date")
    return extremes.drift_weights(p.join(first, "date", "left_semi").select("code", "date", F.col("amount").alias("weight")), p.select("code", "date", "close"))


# Kernels without SQL: their tests compare them with NumPy.


@_register("risk_factor_regression")
def _regression(spark: SparkSession, sf: str) -> DataFrame:
    return risk.factor_regression(_signal_panel(spark, sf), "label", ["f_mom", "f_vol"], "industry", "amount", least=40)


@_register("risk_constrained_regression")
def _constrained(spark: SparkSession, sf: str) -> DataFrame:
    return risk.factor_regression(_signal_panel(spark, sf), "label", ["f_mom", "f_vol"], "industry", "amount", least=40, constrained=True)


@_register("portfolio_backtest")
def _backtest(spark: SparkSession, sf: str) -> DataFrame:
    f = _signal_panel(spark, sf)
    w = portfolio.score_tilt(f.join(portfolio.rebalance_dates(f.select("date").distinct()), "date", "left_semi"), "f_mom", "amount")
    return portfolio.backtest(w, f.select("code", "date", (F.col("label") / 50).alias("ret")))


@_register("portfolio_linear_program")
def _linear(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.optimise_linear(_signal_panel(spark, sf), "f_mom", "amount", "industry")


@_register("portfolio_optimise")
def _optimise(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.optimise(_signal_panel(spark, sf), "f_mom", "amount", "industry", ["f_vol"])
