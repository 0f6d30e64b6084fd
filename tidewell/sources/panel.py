"""The panel of the test tables: one row per supplier (code) and week (date).

Prices, volume and amount come from line items; statements and flows are fixed formulas of
them, so that every catalogue expression has its columns.  Both engines get the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.expr import plan

BASE = """
select l_suppkey as code, cast(date_trunc('week', l_shipdate) as date) as date, any_value(s_nationkey) as industry,
       round(avg(l_extendedprice / l_quantity) / 1e3 + 3e-10, 6) as close,
       round(sum(l_extendedprice) / sum(l_quantity) / 1e3 + 3e-10, 6) as open,
       round(max(l_extendedprice / l_quantity) / 1e3 + 1e-3 + 3e-10, 6) as high,
       round(min(l_extendedprice / l_quantity) / 1e3 - 1e-3 + 3e-10, 6) as low,
       round(sum(l_quantity) / 1e2 + 3e-10, 6) as volume, round(sum(l_extendedprice) / 1e5, 9) as amount,
       round(avg(l_discount) * 1e1 + 1e-2 * count(*) + 3e-10, 6) as turnover_rate,
       round(avg(l_tax) + 3e-10, 6) as tax, round(avg(l_discount), 9) as disc,
       round(avg(case when l_returnflag = 'R' then 1e0 else 0e0 end) + 3e-10, 6) as ret_share
from lineitem join supplier on l_suppkey = s_suppkey
where l_quantity > 0 group by 1, 2
"""

#: Columns of statements, valuation and flows, as expressions over the base.
DERIVED = {
    "total_mv": "ts_sum(amount, 1000, 1) + 5",
    "log_mv": "log(ts_sum(amount, 1000, 1) + 5)",
    "total_revenue_ttm": "ts_sum(amount, 4, 1)",
    "net_profit_ttm": "ts_sum(amount * (0.2 - disc - tax), 4, 1)",
    "gross_profit_ttm": "ts_sum(amount * (0.5 - disc), 4, 1)",
    "operate_profit_ttm": "ts_sum(amount * (0.3 - disc), 4, 1)",
    "n_cashflow_act_ttm": "ts_sum(amount * (0.25 - 2 * tax), 4, 1)",
    "free_cashflow_ttm": "ts_sum(amount * (0.2 - 2 * tax - 0.1 * ret_share), 4, 1)",
    "capex_ttm": "ts_sum(amount * (0.02 + 0.1 * ret_share), 4, 1)",
    "fin_exp_ttm": "ts_sum(amount * 0.2 * tax, 4, 1)",
    "total_assets": "ts_sum(amount, 12, 1) * (2 + ret_share)",
    "total_liab": "ts_sum(amount, 12, 1) * (0.6 + 4 * disc)",
    "inventories": "volume * (0.1 + disc)",
    "accounts_receiv": "amount * (0.1 + tax)",
    "money_cap": "ts_sum(amount, 6, 1) * (0.2 + tax)",
    "working_capital": "ts_sum(amount, 6, 1) * (0.3 - disc)",
    "rd_exp_ttm": "ts_sum(amount * 0.1 * disc, 4, 1)",
    "eps": "ts_sum(amount * (0.2 - disc - tax), 4, 1) / 10",
    "bps": "ts_sum(amount, 12, 1) * (1.4 + ret_share - 4 * disc) / 10",
    "cfps": "ts_sum(amount * (0.25 - 2 * tax), 4, 1) / 10",
    "dv_ttm": "2 * disc + 0.01",
    "dv_ratio": "disc + tax",
    "buy_lg": "amount * (0.3 + disc)",
    "sell_lg": "amount * (0.3 + tax)",
    "buy_elg": "amount * (0.1 + 2 * tax)",
    "sell_elg": "amount * (0.1 + disc)",
    "market_return": "cs_avg(ts_pct(close, 1))",
    "index_weight": "amount / cs_sum(amount)",
}

#: Columns over the derived ones.
RATIOS = {
    "pe_ttm": "total_mv / positive(net_profit_ttm)",
    "pb": "total_mv / (total_assets - total_liab)",
    "ps_ttm": "total_mv / total_revenue_ttm",
    "roe_ttm": "net_profit_ttm / (total_assets - total_liab)",
    "roe": "net_profit_ttm / (total_assets - total_liab) * (1 + tax)",
    "roa_ttm": "net_profit_ttm / total_assets",
    "roa": "net_profit_ttm / total_assets * (1 + disc)",
    "gross_margin_ttm": "gross_profit_ttm / total_revenue_ttm",
    "grossprofit_margin": "gross_profit_ttm / total_revenue_ttm * (1 + tax)",
    "net_margin_ttm": "net_profit_ttm / total_revenue_ttm",
    "netprofit_margin": "net_profit_ttm / total_revenue_ttm * (1 + disc)",
    "operating_margin_ttm": "operate_profit_ttm / total_revenue_ttm",
    "operating_cf_margin_ttm": "n_cashflow_act_ttm / total_revenue_ttm",
    "ocf_to_or": "n_cashflow_act_ttm / total_revenue_ttm * (1 + tax)",
    "cashflow_to_profit": "n_cashflow_act_ttm / net_profit_ttm",
    "ocf_to_profit": "n_cashflow_act_ttm / net_profit_ttm * (1 + tax)",
    "asset_turnover_ttm": "total_revenue_ttm / total_assets",
    "debt_to_assets": "total_liab / total_assets",
    "current_ratio": "(money_cap + accounts_receiv + inventories) / total_liab",
    "quick_ratio": "(money_cap + accounts_receiv) / total_liab",
    "cash_to_liab": "money_cap / total_liab",
    "inv_turn": "total_revenue_ttm / inventories",
    "ar_turn": "total_revenue_ttm / accounts_receiv",
    "capex_to_assets": "capex_ttm / total_assets",
    "rd_expense_intensity": "rd_exp_ttm / total_revenue_ttm",
    "working_capital_pressure": "(inventories + accounts_receiv) / total_revenue_ttm",
    "revenue_yoy": "ts_pct(total_revenue_ttm, 4)",
    "or_yoy": "ts_pct(total_revenue_ttm, 4) * (1 + tax)",
    "net_profit_yoy": "ts_pct(net_profit_ttm, 4)",
    "netprofit_yoy": "ts_pct(net_profit_ttm, 4) * (1 + disc)",
    "op_yoy": "ts_pct(operate_profit_ttm, 4)",
    "ocf_yoy": "ts_pct(n_cashflow_act_ttm, 4)",
    "gross_margin_yoy": "ts_delta(gross_profit_ttm / total_revenue_ttm, 4)",
    "asset_turnover_yoy": "ts_pct(total_revenue_ttm / total_assets, 4)",
    "eps_growth": "ts_pct(eps, 4)",
    "roe_growth": "ts_delta(net_profit_ttm / (total_assets - total_liab), 4)",
    "asset_growth": "ts_pct(total_assets, 4)",
    "capex_growth": "ts_pct(capex_ttm, 4)",
    "inventory_growth": "ts_pct(inventories, 4)",
    "working_capital_growth": "ts_pct(working_capital, 4)",
    "main_flow": "buy_lg - sell_lg + buy_elg - sell_elg",
    "slarge_flow": "buy_elg - sell_elg",
    "large_out": "sell_lg + sell_elg",
    "main_flow_20": "ts_sum(buy_lg - sell_lg + buy_elg - sell_elg, 20, 10)",
    "flow_days_10": "ts_sum(where(buy_lg - sell_lg + buy_elg - sell_elg > 0, 1, 0), 10, 5)",
    "flow_days_20": "ts_sum(where(buy_lg - sell_lg + buy_elg - sell_elg > 0, 1, 0), 20, 10)",
    "con_days_10": "ts_sum(where(buy_elg - sell_elg > 0, 1, 0), 10, 5)",
    "ret1": "ts_pct(close, 1)",
    "ret5": "ts_pct(close, 5)",
    "vwap": "amount / volume",
    "low_shadow": "(close - low) / (high - low)",
    "book_leverage": "total_assets / (total_assets - total_liab)",
    "inverse_interest_coverage": "fin_exp_ttm / operate_profit_ttm",
    "earnings_stability": "-ts_std(net_profit_ttm / total_assets, 8, 4)",
    "analyst_report_count_90": "ts_sum(where(disc > 0.05, 1, 0), 13, 1)",
    "analyst_org_count_180": "ts_sum(where(tax > 0.04, 1, 0), 26, 1)",
    "analyst_rating_score_180": "ts_mean(disc - tax, 26, 1)",
    "analyst_target_upside_180": "ts_mean(high, 26, 1) / close - 1",
    "analyst_eps_revision_180": "ts_mean(eps, 26, 1) / ts_delay(ts_mean(eps, 26, 1), 26) - 1",
    "analyst_forward_eps_180": "ts_mean(eps, 26, 1) * 1.1",
    "label": "ts_lead(close, 2) / ts_lead(close, 1) - 1",
}

BASE_COLUMNS = ("code", "date", "industry", "close", "open", "high", "low", "volume", "amount", "turnover_rate", "tax", "disc", "ret_share")


def base_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line items move once, by code: their groups and all windows by code find them there, and sums that merge little are not written
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 0").repartition("l_suppkey").createOrReplaceTempView("lineitem")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    return spark.sql(BASE)


#: The plans whose results are the full panel's columns, over the base.
FULL = (plan(DERIVED), plan(RATIOS))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FULL[1].spark(base_panel(spark, sf_dir), (*BASE_COLUMNS, *DERIVED), sources=FULL[:1])


def full_sql() -> str:
    """The full panel as a DuckDB query."""
    derived = plan(DERIVED).duckdb(BASE, BASE_COLUMNS)
    return plan(RATIOS).duckdb(f"select * from ({derived})", (*BASE_COLUMNS, *DERIVED))
