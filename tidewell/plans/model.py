"""Queries of the risk model's later parts.  Their SQL is written by hand, apart from the operators.

What both engines share is the text of the inputs.  Doubles keep 24 of their 53 bits (seven
digits at any size), as sums that were added in another order differ in the last ones; the
tests compare nine digits with pandas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import attribution, covariance, dividends, evaluate, exposures, joins, specific, weightings
from tidewell.plans import catalog
from tidewell.plans.expr import plan
from tidewell.sources.panel import BASE, FULL, base_panel, full_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def short(x: str) -> str:
    """SQL of both engines: x to 24 bits, by splitting; what is within 1e-12 of zero is zero."""
    return f"(case when abs({x}) < 1e-12 then 0e0 else ({x}) * 536870913e0 - (({x}) * 536870913e0 - ({x})) end)"


def _register(name: str, sql: str, rounded: str = "", panel: str = BASE):
    """``rounded`` names the double columns of the SQL's answer."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(spark, sf)
            return out.select(*[F.expr(short(f"`{c}`")).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        cols = f"* replace ({', '.join(f'{short(c)} as {c}' for c in rounded.split())})" if rounded else "*"
        ORACLES[name] = f"with panel as ({panel}), {sql.strip()} select {cols} from answer"
        return f

    return put


def _use(spark: SparkSession, sf: str, text: str) -> DataFrame:
    base_panel(spark, sf).createOrReplaceTempView("panel")
    return spark.sql(text)


# ---------------------------------------------------------------- specific risk

#: Residual returns with gaps, and exposures that miss some rows, groups and sizes.
RESIDUALS = "select code, date, case when disc > 0.015 then round(close / open - 1, 9) end as ret from panel where code % 9 <> 0 or month(date) > 2"
EXPOSURES = "select code, date, case when code % 11 <> 0 then industry % 4 end as grp, case when tax > 0.01 then amount end as size from panel where code % 13 <> 0 or year(date) < 1996"


def _aged(values: str, source: str, order: str, window: int, half_life: float, least: int) -> str:
    """Weighted moments over pairs of a row and the rows up to ``window`` - 1 before it."""
    w = f"pow(0.5::double, (a.n - b.n) / {half_life}::double)"
    cols = "".join(f", count(b.{v}) as n_{v}, case when count(b.{v}) >= {least} then sum({w} * b.{v}) / sum({w}) filter (b.{v} is not null) end as m_{v}, case when count(b.{v}) >= {least} then sum({w} * b.{v} * b.{v}) / sum({w}) filter (b.{v} is not null) end as q_{v}" for v in values.split())
    numbered = f"(select *, row_number() over (partition by code order by {order}) as n from {source})"
    return f"select a.code, a.{order}{cols} from {numbered} a join {numbered} b on a.code = b.code and b.n between a.n - {window - 1} and a.n group by a.code, a.{order}"


def _periods(unit: str, window: int, half_life: float, least: int) -> str:
    return f"""{unit}_days as (select date_trunc('{unit}', date) as period, count(distinct date) as days, max(date) as period_end from r group by 1),
{unit}_sums as (select code, period, period_end, sum(ret) as total, cast(days as double) as days from (select *, date_trunc('{unit}', date) as period from r) join {unit}_days using (period) where period < (select max(period) from {unit}_days) group by code, period, period_end, days having count(ret) / days >= 0.6),
{unit}_moments as ({_aged('total days', f'{unit}_sums', 'period_end', window, half_life, least)}),
{unit}_var as (select code, period_end, case when m_total is not null then greatest(q_total - m_total * m_total, 0) / m_days end as v from {unit}_moments)"""


_SPECIFIC = f"""
r as ({RESIDUALS}), x as ({EXPOSURES}),
dm as ({_aged('ret', 'r', 'date', 252, 63, 126)}),
{_periods('month', 36, 12, 18)}, {_periods('quarter', 20, 8, 8)},
c as (select d.code, d.date, case when m_ret is not null then greatest(q_ret - m_ret * m_ret, 0) end as day, n_ret as observations, m.v as month, q.v as quarter
  from dm d asof left join month_var m on d.code = m.code and d.date > m.period_end asof left join quarter_var q on d.code = q.code and d.date > q.period_end),
b as (select *, case when day is not null then 0.5 else 0 end + case when month is not null then 0.3 else 0 end + case when quarter is not null then 0.2 else 0 end as have from c),
j as (select b.*, x.grp, case when x.size > 0 then ln(x.size) end as ls, case when have > 0 then (coalesce(day, 0) * 0.5 + coalesce(month, 0) * 0.3 + coalesce(quarter, 0) * 0.2) / have end as blended from b left join x using (code, date)),
e as (select date, list_distinct(quantile_cont(ls, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) as edges from j where ls is not null group by date),
k as (select j.*, case when ls is not null and len(edges) > 1 then greatest(len(list_filter(edges, lambda v: v < ls)), 1) end as bucket from j left join e using (date)),
p1 as (select date, grp, bucket, median(blended) as v, count(blended) as n from k group by 1, 2, 3),
p2 as (select date, grp, median(blended) as v, count(blended) as n from k group by 1, 2), p3 as (select date, median(blended) as v from k group by 1),
s as (select k.*, case when p1.n >= 5 then p1.v end as v1, case when p2.n >= 5 then p2.v end as v2, p3.v as v3 from k
  join p1 on k.date = p1.date and k.grp is not distinct from p1.grp and k.bucket is not distinct from p1.bucket join p2 on k.date = p2.date and k.grp is not distinct from p2.grp join p3 on k.date = p3.date),
t as (select *, coalesce(v1, v2, v3) as prior, case when v1 is not null then 'industry_size' when v2 is not null then 'industry' else 'market' end as prior_level, case when blended is null then 0 else greatest(0.2, least(1, observations / 252)) end::double as reliability from s),
u as (select *, reliability * coalesce(blended, 0) + (1 - reliability) * prior as variance_daily from t),
answer as (select code, date, day, observations, month, quarter, blended, case when day is not null then 0.5 / have else 0 end::double as day_weight, case when month is not null then 0.3 / have else 0 end::double as month_weight, case when quarter is not null then 0.2 / have else 0 end::double as quarter_weight, prior, prior_level, reliability, variance_daily, case when variance_daily is not null then sqrt(greatest(variance_daily, 0) * 252) end as risk_annual from u)
"""


@_register("risk_specific", _SPECIFIC, "day month quarter blended day_weight month_weight quarter_weight prior reliability variance_daily risk_annual")
def _specific(spark: SparkSession, sf: str) -> DataFrame:
    return specific.specific_risk(_use(spark, sf, RESIDUALS), spark.sql(EXPOSURES), "ret", "grp", "size")


# ---------------------------------------------------------------- exposures of the second model

DESCRIPTORS = [exposures.Descriptor(k, style, weight) for k, (style, weight, _, _) in catalog.DESCRIPTORS_V2.items()]
_NAMES = [d.name for d in DESCRIPTORS]
_STYLES = list(dict.fromkeys(d.style for d in DESCRIPTORS))
_RAW = plan({k: f"{sign} * ({f})" for k, (_, _, sign, f) in catalog.DESCRIPTORS_V2.items()})
_RAW_COLUMNS = ("code", "date", "total_mv")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return _RAW.spark(base_panel(spark, sf), _RAW_COLUMNS, sources=FULL).withColumn("member", F.expr("case when code % 10 = 3 then null else code % 10 <> 7 end"))


def _standardised(source: str, out: str) -> str:
    """CTEs from ``source`` (code, date, w, name, x) without nulls to ``out`` with z in place of x."""
    return f"""{out}_1 as (select date, name, median(x) as med, quantile_cont(x, 0.01) as q1, quantile_cont(x, 0.99) as q9 from {source} where w > 0 group by 1, 2),
{out}_2 as (select s.date, s.name, median(abs(x - med)) as mad from {source} s join {out}_1 using (date, name) where w > 0 group by 1, 2),
{out}_3 as (select s.code, s.date, s.w, s.name, case when mad > 0 then greatest(med - 5 * mad, least(med + 5 * mad, x)) else greatest(q1, least(q9, x)) end as c from {source} s join {out}_1 using (date, name) join {out}_2 using (date, name) where w > 0),
{out}_4 as (select date, name, sum(w * c) / sum(w) as mean, stddev_samp(c) as sd from {out}_3 group by 1, 2 having count(*) >= 2),
{out} as (select s.code, s.date, s.w, s.name, case when sd > 1e-12 then (c - mean) / sd else 0 end as x from {out}_3 s join {out}_4 using (date, name))"""


def _less(source: str, target: str, controls: list[str], out: str) -> str:
    """CTEs that give ``source`` with target replaced by its standardised weighted residual, by normal equations of centred values."""
    u, n = ["y", *(f"x{k}" for k in range(len(controls)))], len(controls)
    joins = " ".join(f"join {source} t{k} on t{k}.code = t.code and t{k}.date = t.date and t{k}.name = '{c}'" for k, c in enumerate(controls))
    means = ", ".join(f"sum(w * {c}) / sum(w) as m_{c}" for c in u)
    dot = lambda a, b: f"sum(w * ({a} - m_{a}) * ({b} - m_{b}))"
    if n == 1:
        beta = f"{dot('y', 'x0')} / nullif({dot('x0', 'x0')}, 0) as b0"
    else:
        det = f"nullif({dot('x0', 'x0')} * {dot('x1', 'x1')} - {dot('x0', 'x1')} * {dot('x0', 'x1')}, 0)"
        beta = f"({dot('y', 'x0')} * {dot('x1', 'x1')} - {dot('y', 'x1')} * {dot('x0', 'x1')}) / {det} as b0, ({dot('y', 'x1')} * {dot('x0', 'x0')} - {dot('y', 'x0')} * {dot('x0', 'x1')}) / {det} as b1"
    fit = " - ".join(["y - m_y", *(f"coalesce(b{k}, 0) * (x{k} - m_x{k})" for k in range(n))])
    return f"""{out}_a as (select t.code, t.date, t.w, t.x as y, {", ".join(f"t{k}.x as x{k}" for k in range(n))} from {source} t {joins} where t.name = '{target}'),
{out}_b as (select date, {means} from {out}_a group by date having count(*) >= {n + 2}),
{out}_c as (select date, {beta} from {out}_a join {out}_b using (date) group by date),
{out}_d as (select a.code, a.date, a.w, '{target}' as name, {fit} as x from {out}_a a join {out}_b using (date) join {out}_c using (date)),
{_standardised(f"{out}_d", f"{out}_e")},
{out} as (select * from {source} where name <> '{target}' union all select * from {out}_e)"""


_EXPOSURES = f"""
raw0 as ({_RAW.duckdb(full_sql(), _RAW_COLUMNS)}),
rows0 as (select *, case when total_mv > 0 then sqrt(total_mv) end as w from raw0 where code % 10 not in (3, 7)),
l0 as (select code, date, w, name, x from rows0 unpivot (x for name in ({", ".join(_NAMES)}))),
{_standardised("l0", "z0")},
{_less("z0", "nonlinear_size_residual", ["log_total_mv"], "z1")},
days as (select date, count(*) as n from rows0 group by date),
cover as (select d.date, k.name, (select count(*) from z1 where z1.date = d.date and z1.name = k.name) / d.n as c from days d cross join (select unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) as name) k),
allowed as (select date, name as descriptor, coalesce(count(c) over w >= 126 and avg(c) over w >= 0.7 - 1e-12, false) as admitted from cover window w as (partition by name order by date rows between 252 preceding and 1 preceding))
"""
_STYLE_SQL = f"""{_EXPOSURES},
spec as (select unnest([{", ".join(f"'{d.name}'" for d in DESCRIPTORS)}]) as name, unnest([{", ".join(f"'{d.style}'" for d in DESCRIPTORS)}]) as style, unnest([{", ".join(repr(d.weight) for d in DESCRIPTORS)}])::double as weight),
parts as (select code, date, w, style, sum(weight) as have, count(*) as n, sum(weight * x) / sum(weight) as x from z1 join allowed a using (date) join spec on spec.name = z1.name and a.descriptor = z1.name where admitted group by 1, 2, 3, 4),
s0 as (select code, date, w, 'style_' || style as name, x from parts where have >= 0.6 - 1e-12),
{_standardised("s0", "s1")},
{_less("s1", "style_nonlinear_size", ["style_size"], "s2")},
{_less("s2", "style_residual_volatility", ["style_size", "style_beta"], "s3")},
{_less("s3", "style_liquidity", ["style_size"], "s4")},
answer as (select r.code, r.date, {", ".join(f"max(x) filter (name = 'style_{s}') as style_{s}, coalesce(max(have) filter (style = '{s}'), 0) as style_{s}_weight, coalesce(max(n) filter (style = '{s}'), 0) as style_{s}_n" for s in _STYLES)}
  from (select code, date from rows0) r left join (select code, date, name, x, null as style, null::double as have, null::bigint as n from s4 union all select code, date, null, null, style, have, n from parts) using (code, date) group by 1, 2)
"""


@_register("risk_exposures_v2", _STYLE_SQL, " ".join(f"style_{s} style_{s}_weight" for s in _STYLES))
def _exposures(spark: SparkSession, sf: str) -> DataFrame:
    return exposures.exposures_v2(_raw(spark, sf), DESCRIPTORS, "total_mv", member="member")[1]


@_register("risk_admission", f"{_EXPOSURES}, answer as (select * from allowed)")
def _admission(spark: SparkSession, sf: str) -> DataFrame:
    return exposures.exposures_v2(_raw(spark, sf), DESCRIPTORS, "total_mv", member="member")[2]


# ---------------------------------------------------------------- many weightings of one regression

#: Forward returns, two signals with gaps, groups and sizes that miss rows, and specific risk three rows back.
WEIGHTED = """select code, date, case when code % 17 <> 0 then industry % 8 end as grp, case when tax > 0.012 then amount when code % 5 = 0 then -1e0 end as size, f_mom, case when disc > 0.01 then f_gap end as f_gap, case when code % 19 <> 0 or year(date) > 1995 then label end as label,
  lag(s1, 3) over w as risk_60, case when code % 7 <> 0 then lag(s2, 3) over w end as risk_120, lag(s3, 3) over w as risk_252
  from (select *, close / lag(close, 4) over w - 1 as f_mom, open / close - 1 as f_gap, lead(close, 2) over w / lead(close, 1) over w - 1 as label, stddev_samp(open / close) over (partition by code order by date rows between 59 preceding and current row) as s1, stddev_samp(open / close) over (partition by code order by date rows between 119 preceding and current row) as s2, stddev_samp(open / close) over (partition by code order by date rows between 251 preceding and current row) as s3 from panel window w as (partition by code order by date)) window w as (partition by code order by date)"""
RISKS = {60: "risk_60", 120: "risk_120", 252: "risk_252"}
_MV = "case when size > 0 then sqrt(size) else 1 end"
_ROW_RANK = lambda c: f"(rank() over (partition by date order by {c} desc nulls last) + (count(*) over (partition by date, {c}) - 1) / 2.0) / count({c}) over (partition by date)"
_WEIGHTS = " union all ".join(
    [f"select *, 'sqrt_mv' as strategy, {_MV} as raw, false as clip from base", "select *, 'equal', 1, false from base"]
    + [f"select *, 'inv_specific_{k}', case when risk_{k} > 0 then 1 / (risk_{k} * risk_{k}) end, true from base" for k in RISKS]
    + ["select *, 'inv_specific_vol_252', case when risk_252 > 0 then 1 / risk_252 end, true from base", f"select *, 'sqrt_mv_div_specific_vol_252', case when risk_252 > 0 then {_MV} / risk_252 end, true from base"]
    + [f"select * exclude (s), 'sqrt_mv_x_low_specific_rank_{k}', case when s is not null then {_MV} * (0.75 + 0.5 * {_ROW_RANK('s')}) end, false from (select *, case when risk_{k} > 0 then risk_{k} end as s from base)" for k in RISKS]
)
_FITS = f"""
x as ({WEIGHTED}), base as (select * from x where label is not null and grp is not null), raws as ({_WEIGHTS}),
q as (select date, strategy, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi, count(raw) as n from raws group by 1, 2),
v as (select code, date, grp, strategy, label as y, f_mom, f_gap, {_MV} as mv, case when clip and n >= 20 then greatest(lo, least(hi, raw)) else raw end as w from raws join q using (date, strategy) where raw is not null),
st as (select date, strategy, count(*) as n, count(distinct grp) as n_groups, avg(f_mom) as m1, avg(f_gap) as m2, stddev_samp(f_mom) as s1, stddev_samp(f_gap) as s2, count(f_mom) / count(*) >= 0.5 as u1, count(f_gap) / count(*) >= 0.5 as u2 from v group by 1, 2),
z as (select v.*, case when u1 and s1 > 1e-12 then coalesce((f_mom - m1) / s1, 0) else 0 end as z1, case when u2 and s2 > 1e-12 then coalesce((f_gap - m2) / s2, 0) else 0 end as z2 from v join st using (date, strategy)),
g as (select date, strategy, grp, sum(w * y) / sum(w) as gy, sum(w * z1) / sum(w) as g1, sum(w * z2) / sum(w) as g2 from z group by 1, 2, 3),
d as (select z.*, y - gy as ry, z1 - g1 as a1, z2 - g2 as a2 from z join g using (date, strategy, grp)),
c1 as (select date, strategy, coalesce(sum(w * a1 * a2) / nullif(sum(w * a1 * a1), 0), 0) as c12, coalesce(sum(w * a1 * ry) / nullif(sum(w * a1 * a1), 0), 0) as b1 from d group by 1, 2),
d2 as (select *, a2 - c12 * a1 as a3 from d join c1 using (date, strategy)),
c2 as (select date, strategy, coalesce(sum(w * a3 * ry) / nullif(sum(w * a3 * a3), 0), 0) as b2 from d2 group by 1, 2),
r as (select *, ry - b1 * a1 - b2 * a3 as e from d2 join c2 using (date, strategy)),
wd as (select date, strategy, pow(sum(w), 2) / sum(w * w) as ess, max(w) / sum(w) as top, quantile_cont(w, 0.99) / quantile_cont(w, 0.5) as ratio, stddev_pop(w) / avg(w) as cv from v group by 1, 2),
ev as (select date, strategy, e_name, sum(ew * e * e) as rest, sum(ew * y * y) - pow(sum(ew * y), 2) / sum(ew) as total, sum(ew) as sw from (select *, unnest(['own', 'sqrt_mv', 'equal']) as e_name, unnest([w, mv, 1]) as ew from r) group by 1, 2, 3),
fine as (select *, n_groups + u1::int + u2::int as p from st),
keys as (select date, strategy from (select distinct date from x), (select distinct unnest([{", ".join(f"'{s[0]}'" for s in weightings.STRATEGIES)}]) as strategy)),
answer as (
  select f.date, f.strategy, e_name as evaluation, 'ok' as status, n::bigint as n_obs, p::bigint as n_columns, n_groups::bigint as n_groups, (u1::int + u2::int)::bigint as n_styles, 1 - rest / total as r2, 1 - rest / total * (n - 1) / greatest(n - p, 1) as adj_r2, sqrt(rest / sw) as resid_std, ess as effective_size, ess / n as effective_share, top as max_share, ratio as p99_p50, cv as weight_cv
  from fine f join ev using (date, strategy) join wd using (date, strategy) where n >= greatest(30, p + 5) and n_groups >= 2
  union all
  select k.date, k.strategy, 'own', case when not exists (select 1 from base b where b.date = k.date) then 'failed_empty' when f.n is null then 'failed_no_fit_weight' else 'failed_insufficient_sample' end, coalesce(n, 0), null, null, null, null, null, null, null, null, null, null, null
  from keys k left join fine f using (date, strategy) where f.n is null or n < greatest(30, p + 5) or n_groups < 2)
"""
_FIT_DOUBLES = "r2 adj_r2 resid_std effective_size effective_share max_share p99_p50 weight_cv"


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return weightings.weighted_regressions(_use(spark, sf, WEIGHTED), "label", ["f_mom", "f_gap"], "grp", "size", RISKS)


@_register("risk_weightings", _FITS, _FIT_DOUBLES)
def _weightings(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf).drop("condition")


_MEAN_SQL = ", ".join(f"avg({c}) as {k}" for k, c in weightings.MEANS.items() if c != "condition")


@_register("risk_weighting_summary", _FITS.replace("answer as (", "fits as (") + f", common as (select evaluation, date from fits where status = 'ok' group by 1, 2 having count(distinct strategy) = {len(weightings.STRATEGIES)}), answer as (select strategy, evaluation, year(date)::int as year, min(date) as first, max(date) as last, count(r2) as dates, median(r2) as median_r2, avg(case when r2 >= 0.5 then 1 else 0 end) as share_r2_half, {_MEAN_SQL} from fits join common using (evaluation, date) where status = 'ok' group by 1, 2, 3)", " ".join(["median_r2", "share_r2_half", *(k for k, c in weightings.MEANS.items() if c != "condition")]))
def _weighting_summary(spark: SparkSession, sf: str) -> DataFrame:
    return weightings.summarise(_weighted(spark, sf), year=True, comparable=len(weightings.STRATEGIES)).drop("mean_condition")


# ---------------------------------------------------------------- covariances

#: Group returns in long rows; not every group has every date.
GROUP_RETURNS = "select date, concat('g', cast(industry as string)) as factor, round(avg(close), 9) as ret from panel group by date, industry"
_WINDOWS = (60, 120, 252)
_ROLLING = f"""
r as ({GROUP_RETURNS}), days as (select date, row_number() over (order by date) as n from (select distinct date from r)),
l as (select n, factor, coalesce(ret, 0) as x from days cross join (select distinct factor from r) left join r using (date, factor)),
spans as (select n as last, w, greatest(n - w + 1, 1) as first_n from days, (select unnest({list(_WINDOWS)}) as w)), ok as (select * from spans where last - first_n + 1 >= greatest(20, w // 2)),
z as (select last, w, n, factor, x - avg(x) over (partition by last, w, factor) as z from ok join l on n between first_n and last),
s as (select a.last, a.w, a.factor as i, b.factor as j, avg(a.z * b.z) as s, avg(a.z * a.z * b.z * b.z) as q, count(*) as n from z a join z b on a.last = b.last and a.w = b.w and a.n = b.n and a.factor <= b.factor group by 1, 2, 3, 4),
t as (select last, w, max(n) as n, count(*) filter (i = j) as p, sum(s) filter (i = j) / count(*) filter (i = j) as mu, sum(case when i = j then 1 else 2 end * s * s) as ss, sum(case when i = j then 1 else 2 end * (q - s * s)) as b from s group by 1, 2),
k as (select *, (ss - p * mu * mu) / p as delta, b / (n * p) as beta from t), h as (select last, w, mu, case when delta <= 0 then 0 else greatest(0, least(delta, beta)) / delta end as k from k),
answer as (select date, s.w::int as "window", i as factor_i, j as factor_j, (1 - k) * s.s + case when i = j then k * mu else 0 end as covariance, k::double as shrinkage from s join h using (last, w) join days on days.n = last)
"""


@_register("risk_rolling_covariance", _ROLLING, "covariance shrinkage")
def _rolling_covariance(spark: SparkSession, sf: str) -> DataFrame:
    r = _use(spark, sf, GROUP_RETURNS)
    names = [x[0] for x in r.select("factor").distinct().orderBy("factor").collect()]  # columns of the model
    return covariance.rolling(r, names, _WINDOWS)


#: Country, two styles and five groups in long rows; some dates miss a factor.
FACTOR_RETURNS = """select date, factor, ret from (select date, 'country' as factor, avg(r) as ret from f group by date union all select date, 'style_a', avg(r * disc) from f group by date union all select date, 'style_b', avg(r * tax) from f where day(date) <> 13 group by date
  union all select date, concat('industry_', cast(industry % 5 as string)), avg(r) from f where code % 3 <> 0 group by date, industry % 5)"""
_F = "select code, date, industry, disc, tax, round(close / open - 1, 9) as r from panel"
_FACTOR_NAMES = ["country", "style_a", "style_b", *(f"industry_{k}" for k in range(5))]
_SHARES = {f"industry_{k}": float(k + 1) for k in range(5)}
_PUBLISHED = f"""
f as ({_F}), r as ({FACTOR_RETURNS.replace("string", "varchar")}), wide as (select date, {", ".join(f"max(ret) filter (factor = '{c}') as {c}" for c in _FACTOR_NAMES)} from r group by date),
days as (select *, row_number() over (order by date) as n, lead(date) over (order by date) as following, row_number() over (partition by date_trunc('month', date) order by date desc) = 1 as ends from wide),
ends as (select n as last, following from days where ends and following is not null),
c as (select e.last, e.following, d.* exclude (ends, following), row_number() over (partition by e.last order by d.n desc) as back from ends e join days d on d.n between e.last - 119 and e.last where {" and ".join(f"{c} is not null" for c in _FACTOR_NAMES)}),
o as (select last, following, count(*) as seen from c group by 1, 2),
methods as (select following as date, case when seen >= 60 then 'ewma_newey_west' else 'ledoit_wolf_fallback' end as method, case when seen >= 60 then '' else 'insufficient complete history: ' || seen || ' < 60' end as reason, seen::int as observations from o where seen >= 2)
"""
_CENTRE = " + ".join(f"{w / sum(_SHARES.values())} * {k}" for k, w in _SHARES.items())
_ESTIMATES = f"""{_PUBLISHED},
u as (select last, following, back, country + ({_CENTRE}) as country, style_a, style_b, {", ".join(f"industry_{k} - ({_CENTRE}) as industry_{k}" for k in range(5))} from c join o using (last, following) where seen >= 60),
l as (select last, following, back, factor, x, pow(0.5::double, (back - 1) / 30.0) as w from u unpivot (x for factor in ({", ".join(_FACTOR_NAMES)}))),
z as (select l.*, x - m as z from l join (select last, factor, sum(w * x) / sum(w) as m from l group by 1, 2) using (last, factor)),
g0 as (select a.last, a.following, a.factor as i, b.factor as j, sum(a.w * a.z * b.z) / sum(a.w) as g from z a join z b on a.last = b.last and a.back = b.back group by 1, 2, 3, 4),
g1 as (select a.last, a.factor as i, b.factor as j, k, (1 - k / 3.0) * sum(a.w * a.z * b.z) / sum(a.w) as g from z a, (select unnest([1, 2]) as k), z b where a.last = b.last and b.back = a.back + k group by 1, 2, 3, k),
g as (select g0.following, g0.i, g0.j, g0.g + coalesce(sum(p.g), 0) + coalesce(sum(q.g), 0) as v from g0 left join g1 p on p.last = g0.last and p.i = g0.i and p.j = g0.j left join g1 q on q.last = g0.last and q.i = g0.j and q.j = g0.i and q.k = p.k group by g0.following, g0.i, g0.j, g0.g),
answer as (select following as date, i as factor_i, j as factor_j, v as covariance from g where list_position({_FACTOR_NAMES}, i) <= list_position({_FACTOR_NAMES}, j))
"""


def _published(spark: SparkSession, sf: str) -> DataFrame:
    _use(spark, sf, _F).createOrReplaceTempView("f")
    return covariance.estimates(spark.sql(FACTOR_RETURNS), _FACTOR_NAMES, 120, 60, 30.0, 2, _SHARES)


@_register("risk_covariance_estimates", _ESTIMATES, "covariance")
def _covariance_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf).where("method = 'ewma_newey_west'").select("date", "factor_i", "factor_j", "covariance")


@_register("risk_covariance_methods", f"{_PUBLISHED}, answer as (select * from methods)")
def _covariance_methods(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf).select("date", "method", "reason", "observations").distinct()


# ---------------------------------------------------------------- intervals and dividends

#: Contracts of eight products, monthly snapshots of weights, and dividends announced before they go ex.
CONTRACTS = "select industry % 8 as product, date, cast(date + 7 * (1 + tenor * 9) as date) as expiry, round(avg(open) * 1000, 6) as index_close from panel, (select 0 as tenor union all select 1 union all select 2) t group by industry % 8, date, tenor"
SNAPSHOTS = "select industry % 8 as product, date, code, case when code % 6 <> 0 then amount when code % 12 = 0 then 0e0 end as weight from panel where day(date) <= 7"
PRICES = "select code, date, case when code % 10 <> 0 or month(date) > 3 then close else -close end as close from panel where code % 15 <> 0"
DIVIDENDS = "select code, cast(date - cast(20 + code % 30 as int) as date) as announced, case when code % 21 <> 0 then date end as ex_date, round(tax - 0.01, 6) as cash from panel where month(date) in (2, 5, 8, 11) and day(date) between 8 and 21"
_DAYS = lambda s: s.replace("date + 7 * (1 + tenor * 9)", "date + cast(7 * (1 + tenor * 9) as int)")
_POINTS = f"""
c as ({_DAYS(CONTRACTS)}), s as ({SNAPSHOTS}), e as ({DIVIDENDS}), pr as ({PRICES}),
d as (select c.*, x.date as snapshot from c asof left join (select distinct product, date from s) x on c.product = x.product and c.date >= x.date),
h as (select d.product, d.date, d.expiry, s.code, s.weight from d join s on s.product = d.product and s.date = d.snapshot where s.weight > 0),
q as (select h.*, p.close from h asof join pr p on h.code = p.code and h.date >= p.date where p.close > 0),
y as (select q.product, q.date, q.expiry, q.code, sum(e.cash) / any_value(close) * any_value(weight) / 100 as y from q join e on e.code = q.code and e.announced <= q.date and e.ex_date > q.date and e.ex_date <= q.expiry and e.cash > 0 group by 1, 2, 3, 4),
answer as (select c.product, c.date, c.expiry, c.index_close, coalesce(sum(y), 0) * any_value(c.index_close) as points, count(y) as n_codes from c left join y using (product, date, expiry) group by 1, 2, 3, 4)
"""


@_register("monitor_dividend_points", _POINTS, "index_close points")
def _dividend_points(spark: SparkSession, sf: str) -> DataFrame:
    contracts = _use(spark, sf, _DAYS(CONTRACTS))
    return dividends.contract_dividend_points(contracts, spark.sql(DIVIDENDS), spark.sql(SNAPSHOTS), spark.sql(PRICES))


#: Which group a code is in from one half-year to the next, with gaps, and reviewed classes that hold their last day.
MEMBERS = "select code, concat('g', cast(industry % 6 as string)) as grp, date as in_date, case when code % 3 = 0 then cast(date + 120 as date) else lead(date) over (partition by code order by date) end as out_date from panel where month(date) in (1, 7) and day(date) <= 7"
RATED = "select code, cast(null as date) as since, date '1995-06-30' as until, 'cash' as category, 'low_risk' as risk_bucket, true as reviewed from panel where code % 4 = 1 group by code union all select code, date '1995-07-01', cast(null as date), 'equity', case code % 5 when 0 then 'other' when 1 then null else 'risk' end, case when code % 7 <> 0 then true end from panel where code % 4 <> 2 group by code"


@_register("join_groups", f"m as ({MEMBERS.replace('string', 'varchar')}), answer as (select p.code, p.date, m.grp, m.in_date, m.out_date, case when m.grp is not null then 'members' end as grp_source from panel p left join m on p.code = m.code and p.date >= m.in_date and (m.out_date is null or p.date < m.out_date))")
def _groups(spark: SparkSession, sf: str) -> DataFrame:
    members = _use(spark, sf, MEMBERS)
    return joins.attach_groups(base_panel(spark, sf).select("code", "date"), members, "members")


@_register("join_classes", f"k as ({RATED}), answer as (select p.code, p.date, k.since, k.until, k.category, k.risk_bucket, k.reviewed from panel p join k on p.code = k.code and (k.since is null or p.date >= k.since) and (k.until is null or p.date <= k.until) where k.reviewed and k.risk_bucket in ('low_risk', 'risk'))")
def _classes(spark: SparkSession, sf: str) -> DataFrame:
    rated = _use(spark, sf, RATED)
    return joins.apply_classes(base_panel(spark, sf).select("code", "date"), rated)


# ---------------------------------------------------------------- correlation of many signals

_DAILY = plan(catalog.daily())
_DAILY_NAMES = list(catalog.daily())


@_register("evaluate_pooled_correlation", f"f as ({_DAILY.duckdb('select * from panel')}), l as (select code, date, factor, x * 8193 - (x * 8193 - x) as x from f unpivot (x for factor in ({', '.join(_DAILY_NAMES)}))), r as (select code, date, factor, (rank() over (partition by date, factor order by x) + (count(*) over (partition by date, factor, x) - 1) / 2.0) / count(*) over (partition by date, factor) as r from l), answer as (select a.factor as \"left\", b.factor as \"right\", case when count(*) >= 20 then corr(a.r, b.r) end as correlation from r a join r b on a.code = b.code and a.date = b.date and list_position({_DAILY_NAMES}, a.factor) < list_position({_DAILY_NAMES}, b.factor) group by 1, 2)", "correlation")
def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_correlation(_DAILY.spark(base_panel(spark, sf)), _DAILY_NAMES, pooled=True)


# ---------------------------------------------------------------- attribution and blocks of forecasts

#: Two portfolios, a benchmark that misses codes, quarterly covariances and weekly specific variances.
HOLDINGS = "select 'size' as scenario, date, code, amount as weight from panel where day(date) <= 7 and code % 3 = 0 union all select 'flat', date, code, case when code % 13 = 0 then -1e0 else 1e0 end from panel where day(date) <= 7 and code % 5 <> 0 union all select 'flat', date, -1, 2e0 from panel where day(date) <= 3 group by date"
BENCH = "select code, date, case when code % 8 <> 0 then amount end as bench, close / open - 1 as style_a, case when disc > 0.01 then tax end as style_b, case when code % 11 <> 0 then industry % 5 end as grp from panel where day(date) <= 7"
QUARTERS = "select a.q as date, a.factor as factor_i, b.factor as factor_j, covar_pop(a.ret, b.ret) as covariance from (select *, cast(date_trunc('quarter', date) as date) as q from r) a join (select *, cast(date_trunc('quarter', date) as date) as q from r) b on a.date = b.date where a.factor <= b.factor and a.factor <> 'style_b' group by 1, 2, 3"
SPECIFIC = "select date, code, case when code % 6 <> 0 then tax * tax end as variance from panel where day(date) between 8 and 14"
ACTIVE = "select 'size' as scenario, date, avg(close / open) - avg(tax) as active from panel group by date union all select 'flat', date, avg(disc) - avg(tax) from panel where month(date) <> 7 group by date"
_STYLED = ["style_a", "style_b"]
_ATTRIBUTION = f"""
f as ({_F}), r as ({FACTOR_RETURNS.replace("string", "varchar")}), h as ({HOLDINGS}), bp as ({BENCH}), cv as ({QUARTERS}), sv as ({SPECIFIC}), ar as ({ACTIVE}),
g as (select distinct scenario, date from h where date in (select date from bp)),
u as (select coalesce(a.scenario, h.scenario) as scenario, coalesce(a.date, h.date) as date, coalesce(a.code, h.code) as code, bench, weight, style_a, style_b, grp from (select g.scenario, bp.* from g join bp using (date)) a full join (select h.* from h join g using (scenario, date)) h on a.scenario = h.scenario and a.date = h.date and a.code = h.code),
t as (select scenario, date, sum(greatest(coalesce(weight, 0), 0)) as tw, sum(greatest(coalesce(bench, 0), 0)) as tb from u group by 1, 2),
a as (select u.*, case when tw > 0 then greatest(coalesce(weight, 0), 0) / tw else 0 end as port, case when tb > 0 then greatest(coalesce(bench, 0), 0) / tb else 0 end as ben, bench is not null as inside from u join t using (scenario, date)),
x as (select scenario, date, 'style_a' as factor, 'style' as kind, sum((port - ben) * coalesce(style_a, 0)) as x from a where inside group by 1, 2 union all select scenario, date, 'style_b', 'style', sum((port - ben) * coalesce(style_b, 0)) from a where inside group by 1, 2
  union all select scenario, date, 'industry_' || coalesce(grp::varchar, 'unknown'), 'industry', sum(port - ben) from a where inside group by 1, 2, 3),
ct as (select d.date, q.date as q from (select distinct date from x) d asof join (select distinct date from cv) q on d.date >= q.date),
c2 as (select date as q, factor_i as i, factor_j as j, covariance as c from cv union all select date, factor_j, factor_i, covariance from cv where factor_i <> factor_j),
p as (select x.scenario, x.date, x.factor, x.kind, coalesce(sum(x.x * y.x * c), 0) as part, coalesce(sum(case when x.kind = y.kind then x.x * y.x * c end), 0) as within_kind from x left join ct using (date) left join c2 on c2.q = ct.q and c2.i = x.factor left join x y on y.scenario = x.scenario and y.date = x.date and y.factor = c2.j group by 1, 2, 3, 4),
st as (select d.date, q.date as q from (select distinct date from a) d asof left join (select distinct date from sv) q on d.date >= q.date),
s1 as (select a.scenario, a.date, port - ben as w, sv.variance as v from a join st using (date) left join sv on sv.date = st.q and sv.code = a.code),
s2 as (select scenario, date, median(v) as m from s1 group by 1, 2), sp as (select scenario, date, sum(w * w * coalesce(v, m, 0)) as s from s1 join s2 using (scenario, date) group by 1, 2)
"""
_RISK_SQL = f"""{_ATTRIBUTION},
te as (select scenario, date, case when count(*) over w >= 30 then stddev_samp(active) over w * sqrt(252) end as realised from ar window w as (partition by scenario order by date rows between 59 preceding and current row)),
hd as (select scenario, date, sum(abs(port - ben)) / 2 as active_share, count(*) filter (port > 1e-10) as n_names, coalesce(sum(port) filter (inside), 0) as model_weight, coalesce(sum(port) filter (not inside), 0) as outside_weight, coalesce(sum(ben) filter (inside), 0) as benchmark_weight from a group by 1, 2),
rk as (select scenario, date, sum(part) as factor_variance, coalesce(sum(within_kind) filter (kind = 'style'), 0) as style_variance, coalesce(sum(within_kind) filter (kind = 'industry'), 0) as industry_variance from p group by 1, 2),
z as (select hd.*, coalesce(factor_variance, 0) as factor_variance, coalesce(style_variance, 0) as style_variance, coalesce(industry_variance, 0) as industry_variance, s as specific_variance, greatest(coalesce(factor_variance, 0) + s, 0) as total_variance from hd left join rk using (scenario, date) join sp using (scenario, date)),
answer as (select z.*, sqrt(total_variance * 252) as predicted_error, te.realised from z asof left join te on z.scenario = te.scenario and z.date >= te.date)
"""


def _attribution(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _use(spark, sf, _F).createOrReplaceTempView("f")
    spark.sql(FACTOR_RETURNS).createOrReplaceTempView("r")
    return attribution.attribution(spark.sql(HOLDINGS), spark.sql(BENCH), spark.sql(QUARTERS), spark.sql(SPECIFIC), _STYLED, "grp", "bench", spark.sql(ACTIVE))


@_register("portfolio_risk", _RISK_SQL, "active_share model_weight outside_weight benchmark_weight factor_variance style_variance industry_variance specific_variance total_variance predicted_error realised")
def _portfolio_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _attribution(spark, sf)[2]


@_register("portfolio_risk_parts", f"{_ATTRIBUTION}, al as (select scenario, date, factor, kind, part from p union all select scenario, date, 'specific', 'specific', s from sp), answer as (select *, sum(part) over (partition by scenario, date) as total from al)", "part total")
def _portfolio_parts(spark: SparkSession, sf: str) -> DataFrame:
    _, parts, risk = _attribution(spark, sf)
    return parts.join(risk.select("scenario", "date", (F.col("factor_variance") + F.col("specific_variance")).alias("total")), ["scenario", "date"])


_BLOCKS = f"""
f as ({_F}), r as ({FACTOR_RETURNS.replace("string", "varchar")}), cv as ({QUARTERS}), days as (select date, lag(date, 3) over (order by date) as back from (select distinct date from r)),
dg as (select date as q, factor_i as factor, covariance as v from cv where factor_i = factor_j), k as (select d.date, d.back, q.q from (select * from days where back is not null) d asof join (select distinct q from dg) q on d.back >= q.q),
fr as (select r.date, k.back, r.factor, r.ret * r.ret as realised, v as predicted from r join k using (date) join dg on dg.q = k.q and dg.factor = r.factor where r.ret is not null and v > 1e-12),
fb as (select date, back, unnest([case when factor = 'country' then 'factor_country' when factor like 'style%' then 'factor_style' else 'factor_industry' end, 'factor_all']) as block, predicted, realised, factor from fr),
sr as (select s.date, d.back, 'specific' as block, t.tax * t.tax as predicted, s.r * s.r as realised, s.code from f s join (select date, lag(date, 3) over (order by date) as back from (select distinct date from f)) d using (date) join panel t on t.code = s.code and t.date = d.back where t.tax * t.tax > 1e-12),
bl as (select date, back, block, sum(predicted) as predicted, sum(realised) as realised, count(distinct factor) as n_items from fb group by 1, 2, 3 union all select date, back, block, sum(predicted), sum(realised), count(distinct code) from sr group by 1, 2, 3),
b as (select *, realised / greatest(predicted, 1e-12) as ratio from bl),
hist as (select b.block, b.date, w, count(*) over q as n, sum(predicted * greatest(0.05, least(20, ratio))) over q as sr, sum(predicted) over q as sp, row_number() over (partition by b.block, w order by b.date) as i from b, (select unnest([20, 60]) as w) g window q as (partition by b.block, w order by b.date rows between 19 preceding and current row)),
h60 as (select block, date, 60 as w, count(*) over q as n, sum(predicted * greatest(0.05, least(20, ratio))) over q as sr, sum(predicted) over q as sp from b window q as (partition by block order by date rows between 59 preceding and current row)),
m as (select block, date as seen, w, greatest(0.25, least(4, sr / greatest(sp, 1e-12))) as multiplier from (select block, date, w, n, sr, sp from hist where w = 20 and n >= 5 union all select * from h60 where n >= 15)),
c as (select b.*, 0 as "window", 1 as multiplier from b union all select b.*, 20, m.multiplier from b asof join (select * from m where w = 20) m on b.block = m.block and b.back >= m.seen union all select b.*, 60, m.multiplier from b asof join (select * from m where w = 60) m on b.block = m.block and b.back >= m.seen),
answer as (select block, "window"::int as "window", count(*) as n, avg(multiplier) as multiplier, avg(abs(ln(greatest(predicted, 1e-12) / greatest(realised, 1e-12)))) as raw_error, avg(abs(ln(greatest(predicted * multiplier, 1e-12) / greatest(realised, 1e-12)))) as corrected_error, sum(n_items)::bigint as n_items from c group by 1, 2)
"""


@_register("risk_block_calibration", _BLOCKS, "multiplier raw_error corrected_error")
def _block_calibration(spark: SparkSession, sf: str) -> DataFrame:
    f = _use(spark, sf, _F)
    f.createOrReplaceTempView("f")
    r = spark.sql(FACTOR_RETURNS)
    r.createOrReplaceTempView("r")
    blocks = attribution.factor_blocks(r, spark.sql(QUARTERS)).unionByName(attribution.specific_blocks(f.select("code", "date", F.col("r").alias("ret")), spark.sql("select code, date, tax as risk from panel")))
    out = attribution.calibrated(blocks.withColumn("available", F.col("date")), (20, 60))
    return out.groupBy("block", "window").agg(F.count(F.lit(1)).alias("n"), F.avg("multiplier").alias("multiplier"), F.avg("raw_error").alias("raw_error"), F.avg("corrected_error").alias("corrected_error"), F.sum("n_items").alias("n_items"))
