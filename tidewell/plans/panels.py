"""Queries of panel assembly, registered beside the risk model's.  Their SQL is written by hand; both engines share the text of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import assembly, order, panels
from tidewell.plans.model import _register, _use
from tidewell.sources import ranges

#: Raw tables.  Prices come as two caches that overlap by half a year and name the volume differently.
RAW = {
    "older": "select code, date, open, high, low, close, volume as vol, amount from panel where date < date '1995-07-01'",
    "newer": "select code, date, open, high, low, close * 1.01e0 as close, volume, amount from panel where date >= date '1995-01-01'",
    "factors": "select code, date, 1 + 0.25e0 * (year(date) - 1992) as adj_factor from panel where code % 17 <> 3 or month(date) <> 3",
    "valuation": "select code, date, turnover_rate, case when code % 13 <> 4 then 100 * amount else -amount end as total_mv, 10 * tax as pb from panel where code % 5 <> 1 or day(date) > 8",
    "flows": "select code, date, amount * disc as buy_lg_amount, amount * tax as sell_lg_amount, 0.02e0 * amount as buy_elg_amount, case when code % 6 <> 1 then 0.04e0 * amount * ret_share end as sell_elg_amount, case when code % 2 = 0 then amount * (disc - tax) end as net_mf_amount from panel where code % 7 <> 2",
    "listing": "select code, cast(min(industry) as string) as industry, case when code % 4 = 0 then '*st' else 'plain' end as name, min(date) as list_date from panel where code % 7 <> 0 group by code",
    "weights": "select code, date, case when code % 11 = 5 then 0 else amount end as weight from panel where day(date) <= 7 and month(date) in (1, 4, 7, 10) and code % 3 <> 0 and (code + month(date)) % 4 <> 0",
    "statements": "select code, cast(date + interval 3 day as date) as available, amount as eps from panel where day(date) <= 7",
    "context": "select code, date, disc, amount as total_mv, case when code % 2 = 0 then tax end as pb from panel where code % 3 = 0 or year(date) > 1994",
    "mapping": "select distinct cast(industry as string) as industry, case when industry % 3 = 0 then 'a' else 'b' end as grp from panel where industry % 5 <> 4",
    "group_index": "select distinct industry as index_code, industry % 4 as grp from panel where industry < 3",
    "group_daily": "select industry as index_code, date, max(disc) as ret from panel where month(date) <> 5 group by industry, date",
    "market_daily": "select date, max(tax) as ret from panel where month(date) <> 6 group by date",
    "sheets": "select code, date as end_date, total_assets, equity, eps, case when code % 5 = 0 then null else capex_ttm end as capex_ttm, inventories, total_cur_assets, total_cur_liab, fin_exp_ttm, operate_profit_ttm, revenue_ttm, roa, roe_ttm from (select code, date, amount * (2 + ret_share) as total_assets, amount * (1 + disc) as equity, amount * (tax - disc) as eps, amount * tax as capex_ttm, volume as inventories, amount * (1 + tax) as total_cur_assets, volume as total_cur_liab, amount * tax as fin_exp_ttm, amount * disc as operate_profit_ttm, amount as revenue_ttm, case when code % 9 <> 4 or month(date) <> 2 then 100 * tax end as roa, disc / (1 + disc) as roe_ttm from panel where day(date) <= 7) s",
}


def _raw(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    first = _use(spark, sf, RAW[names[0]])
    return [first, *[spark.sql(RAW[n]) for n in names[1:]]]


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.latest(_raw(spark, sf, "older", "newer"), ["code", "date"])


def _sql(*names: str) -> str:
    return ", ".join(f"{n} as ({RAW[n]})" for n in names)


_DAILY = _sql("older", "newer") + """, daily as (select * from newer union all by name
select code, date, open, high, low, close, vol as volume, amount from older where (code, date) not in (select (code, date) from newer))"""
_ADJUSTED = f"""{_DAILY}, {_sql("factors", "valuation")}, prices as (select d.*, adj_factor, open * adj_factor as open_adj, high * adj_factor as high_adj, low * adj_factor as low_adj, close * adj_factor as close_adj,
turnover_rate, total_mv, pb, case when total_mv > 0 then ln(total_mv) end as log_mv from daily d left join factors using (code, date) left join valuation using (code, date))"""
_PRICE_COLUMNS = "open high low close volume amount adj_factor open_adj high_adj low_adj close_adj turnover_rate total_mv pb log_mv"
_FLOW_COLUMNS = "buy_lg_amount sell_lg_amount buy_elg_amount sell_elg_amount net_mf_amount"


@_register("assemble_prices", f"{_ADJUSTED}, answer as (select * from prices)", _PRICE_COLUMNS)
def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return panels.adjusted_prices(_daily(spark, sf), *_raw(spark, sf, "factors", "valuation"))


@_register("assemble_base", f"""{_ADJUSTED}, {_sql("weights", "listing")}, answer as (select p.code, p.date, open_adj, high_adj, low_adj, close_adj, volume, amount, turnover_rate, pb, total_mv, l.industry,
coalesce((select max_by(w.weight, w.date) from weights w where w.code = p.code and w.date <= p.date), 0) as index_weight from prices p left join listing l using (code))""",
"open_adj high_adj low_adj close_adj volume amount turnover_rate pb total_mv index_weight")
def _base(spark: SparkSession, sf: str) -> DataFrame:
    factors, valuation, company, weights = _raw(spark, sf, "factors", "valuation", "listing", "weights")
    return panels.base_table(_daily(spark, sf), valuation, factors, company, weights)


@_register("assemble_index_panel", f"""{_ADJUSTED}, {_sql("weights", "listing", "flows", "statements")},
mine as (select p.*, {", ".join(_FLOW_COLUMNS.split())}, name, list_date, coalesce(industry, 'unknown') as industry from prices p left join flows using (code, date) left join listing using (code) where code in (select code from weights)),
seen as (select date, (select max(w.date) from weights w where w.date <= d.date) as snapshot, row_number() over (order by date) as place from (select distinct date from mine) d),
joined as (select m.*, coalesce(w.weight, 0) as index_weight, coalesce(w.weight, 0) > 0 as member, place from mine m join seen using (date) left join weights w on w.code = m.code and w.date = seen.snapshot),
stated as (select j.*, s.available, s.eps from joined j asof left join statements s on j.code = s.code and j.date >= s.available),
near as (select a.*, a.close_adj / b.close_adj - 1 as returns_1d, c.close_adj / a.close_adj - 1 as fwd_1d_return from stated a left join stated b on a.code = b.code and b.place = a.place - 1 left join stated c on a.code = c.code and c.place = a.place + 1),
bench as (select date, sum(index_weight * returns_1d) / sum(index_weight) as benchmark_return from near where member and returns_1d is not null group by date),
answer as (select near.* exclude (place), benchmark_return from near left join bench using (date) where member)""",
f"{_PRICE_COLUMNS} {_FLOW_COLUMNS} index_weight eps returns_1d fwd_1d_return benchmark_return")
def _index_panel(spark: SparkSession, sf: str) -> DataFrame:
    factors, valuation, flows, listing, weights, statements = _raw(spark, sf, "factors", "valuation", "flows", "listing", "weights", "statements")
    return panels.index_panel(_daily(spark, sf), factors, valuation, flows, listing, weights, statements)


_FLOW_SQL = f"""{_sql("flows")}, f0 as (select code, date, (buy_lg_amount - sell_lg_amount) + (buy_elg_amount - sell_elg_amount) as main_flow, buy_elg_amount - sell_elg_amount as slarge_flow, sell_lg_amount + sell_elg_amount as large_out, net_mf_amount, row_number() over (partition by code order by date) as i from flows),
f1 as (select a.code, a.date, any_value(a.main_flow) as main_flow, any_value(a.slarge_flow) as slarge_flow, any_value(a.large_out) as large_out, coalesce(any_value(a.net_mf_amount), any_value(a.main_flow)) as net_flow,
case when count(b.main_flow) >= 10 then sum(b.main_flow) end as main_flow_20,
case when count(*) filter (a.i - b.i < 10) >= 5 then count(*) filter (a.i - b.i < 10 and b.main_flow > 0) end::double as flow_days_10,
case when count(*) >= 10 then count(*) filter (b.main_flow > 0) end::double as flow_days_20,
case when count(*) filter (a.i - b.i < 10) >= 5 then count(*) filter (a.i - b.i < 10 and b.slarge_flow > 0) end::double as con_days_10
from f0 a join f0 b on a.code = b.code and b.i between a.i - 19 and a.i group by a.code, a.date)"""
_FLOW_FEATURES = "main_flow slarge_flow large_out net_flow main_flow_20 flow_days_10 flow_days_20 con_days_10"


@_register("assemble_flows", f"{_FLOW_SQL}, answer as (select * from f1)", _FLOW_FEATURES)
def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return panels.flow_features(*_raw(spark, sf, "flows"))


_Z = lambda c: f"case when abs(stddev_samp({c}) over (partition by date)) > 1e-12 then ({c} - avg({c}) over (partition by date)) / stddev_samp({c}) over (partition by date) end"


@_register("assemble_market_fields", f"""{_ADJUSTED}, {_FLOW_SQL}, r0 as (select *, close_adj / lag(close_adj) over (partition by code order by date) - 1 as r, row_number() over (partition by code order by date) as i from prices),
sd as (select a.code, a.date, case when count(b.r) filter (a.i - b.i < 20) >= 10 and count(b.r) >= 30 then 0.5 * stddev_samp(b.r) filter (a.i - b.i < 20) + 0.5 * stddev_samp(b.r) end as vol from r0 a join r0 b on a.code = b.code and b.i between a.i - 59 and a.i group by 1, 2),
answer as (select p.* exclude (r, i), amount / volume as vwap, p.close_adj / q.close_adj - 1 as change_60, {_Z("vol")} as beta_proxy, {_Z("p.log_mv")} as size_proxy, f1.* exclude (code, date)
from r0 p join sd using (code, date) left join (select code, i, close_adj from r0) q on q.code = p.code and q.i = p.i - 60 left join f1 on f1.code = p.code and f1.date = p.date)""",
f"{_PRICE_COLUMNS} vwap change_60 beta_proxy size_proxy {_FLOW_FEATURES}")
def _market_fields(spark: SparkSession, sf: str) -> DataFrame:
    return panels.market_fields(_prices(spark, sf), *_raw(spark, sf, "flows"))


@_register("assemble_validation_panel", f"""{_ADJUSTED}, {_sql("context")}, answer as (select c.code, c.date, c.disc, p.* exclude (code, date, total_mv, pb), coalesce(p.total_mv, c.total_mv) as total_mv, coalesce(p.pb, c.pb) as pb
from context c left join prices p on c.code = p.code and c.date = p.date)""", f"disc {_PRICE_COLUMNS}")  # fmt: skip
def _validation(spark: SparkSession, sf: str) -> DataFrame:
    return panels.validation_panel(*_raw(spark, sf, "context"), _prices(spark, sf))


@_register("assemble_group_returns", f"""{_sql("group_index", "group_daily", "market_daily")}, answer as (select p.code, p.date, p.industry as grp, g.ret as group_ret, m.ret as market_ret
from panel p left join (select date, grp, ret from group_daily join group_index using (index_code)) g on g.date = p.date and g.grp = p.industry left join market_daily m on m.date = p.date)""", "group_ret market_ret")  # fmt: skip
def _group_returns(spark: SparkSession, sf: str) -> DataFrame:
    groups, group_daily, market = _raw(spark, sf, "group_index", "group_daily", "market_daily")
    return panels.group_returns(spark.sql("select code, date, industry as grp from panel"), groups, group_daily, market)


@_register("assemble_equity", f"""{_DAILY}, {_sql("factors", "listing", "mapping")}, e as (select d.*, adj_factor, open * adj_factor as open_adj, high * adj_factor as high_adj, low * adj_factor as low_adj, close * adj_factor as close_adj, industry, name, list_date, coalesce(grp, 'unknown') as grp
from daily d left join factors using (code, date) left join listing using (code) left join mapping using (industry)),
r as (select *, close_adj / lag(close_adj) over (partition by code order by date) - 1 as ret from e),
answer as (select *, ret * volume as volume_price, ret * amount as amount_price, coalesce(date - list_date < 183, false) as young, coalesce(name like '%st%', false) as special from r)""",
"open high low close volume amount adj_factor open_adj high_adj low_adj close_adj ret volume_price amount_price")
def _equity(spark: SparkSession, sf: str) -> DataFrame:
    factors, listing, mapping = _raw(spark, sf, "factors", "listing", "mapping")
    return panels.equity_panel(_daily(spark, sf), factors, listing, mapping)


_GROWTH = lambda a, b: f"{a} / nullif({b}, 0) - 1"


@_register("assemble_statement_growth", f"""{_sql("sheets")}, s as (select *, row_number() over (partition by code order by end_date) as i, roa / (select case when median(abs(roa)) > 2 then 100 else 1 end from sheets) as share from sheets),
st as (select a.code, a.i, case when count(b.share) = 8 then -stddev_samp(b.share) end as earnings_stability from s a join s b on a.code = b.code and b.i between a.i - 7 and a.i group by 1, 2),
answer as (select a.* exclude (i, share), {", ".join(f"{_GROWTH(f'a.{c}', f'b.{c}')} as {n}" for n, c in (("eps_growth", "eps"), ("asset_growth", "total_assets"), ("capex_growth", "capex_ttm"), ("inventory_growth", "inventories")))},
{_GROWTH("(a.total_cur_assets - a.total_cur_liab)", "(b.total_cur_assets - b.total_cur_liab)")} as working_capital_growth, a.roe_ttm - b.roe_ttm as roe_growth, a.operate_profit_ttm / nullif(a.revenue_ttm, 0) as operating_margin_ttm,
a.total_assets / nullif(a.equity, 0) as book_leverage, a.fin_exp_ttm / nullif(a.operate_profit_ttm, 0) as inverse_interest_coverage, earnings_stability
from s a join st using (code, i) left join s b on b.code = a.code and b.i = a.i - 4)""",
"total_assets equity eps capex_ttm inventories total_cur_assets total_cur_liab fin_exp_ttm operate_profit_ttm revenue_ttm roa roe_ttm eps_growth asset_growth capex_growth inventory_growth working_capital_growth roe_growth operating_margin_ttm book_leverage inverse_interest_coverage earnings_stability")
def _statement_growth(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.statement_growth(*_raw(spark, sf, "sheets"))


# ---------------------------------------------------------------- order statistics over long windows

_LONG = "select code, date, close, case when disc > 0.03 then volume end as volume from panel"


@_register("panel_long_order", f"""x as ({_LONG}), r as (select *, row_number() over (partition by code order by date) as i from x),
answer as (select a.code, a.date, case when count(b.close) >= 60 then median(b.close) end as median_252, case when count(b.close) >= 60 then quantile_cont(b.close, 0.1) end as low_252, case when count(b.close) >= 60 then count(*) filter (b.close <= a.close) / count(b.close) end as rank_252,
case when any_value(a.volume) is not null and count(b.volume) filter (a.i - b.i < 120) >= 20 then count(*) filter (a.i - b.i < 120 and b.volume <= a.volume) / count(b.volume) filter (a.i - b.i < 120) end as volume_rank_120
from r a join r b on a.code = b.code and b.i between a.i - 251 and a.i group by a.code, a.date)""", "median_252 low_252 rank_252 volume_rank_120")  # fmt: skip
def _long_order(spark: SparkSession, sf: str) -> DataFrame:
    stats = {"median_252": ("close", 252, 60, 0.5), "low_252": ("close", 252, 60, 0.1), "rank_252": ("close", 252, 60, None), "volume_rank_120": ("volume", 120, 20, None)}
    return order.rolling_order(_use(spark, sf, _LONG), stats)
