"""The expression catalogue, as text for tidewell.plans.expr.

Names, windows and formulas are fixed values: they must stay as they are for equal results.
"""

from __future__ import annotations

#: Price and volume candidates, for each window w.
DAILY = {
    "mom_close": "ts_pct(close, w)",
    "volatility": "ts_std(ts_pct(close, 1), w)",
    "intraday_strength": "ts_mean(close / open - 1, w)",
    "overnight_reversal": "-ts_mean(open / ts_delay(close, 1) - 1, w)",
    "oi_spread": "ts_mean((close / open - 1) - (open / ts_delay(close, 1) - 1), w)",
    "amount_expansion": "amount / ts_mean(amount, w) - 1",
    "turnover_expansion": "turnover_rate / ts_mean(turnover_rate, w) - 1",
    "turnover_stability": "-ts_std(turnover_rate, w)",
    "price_volume_corr": "ts_corr(ts_pct(close, 1), ts_pct(volume, 1), w)",
    "intraday_amount_confirm": "ts_mean((close / open - 1) * (amount / ts_mean(amount, w)), w)",
    "overnight_amount_corr": "ts_corr(open / ts_delay(close, 1) - 1, amount / ts_mean(amount, w) - 1, w)",
    "close_location": "ts_mean((close - low) / (high - low), w)",
    "range_pressure": "-ts_mean(high / low - 1, w)",
    "liquidity_preference": "-ts_mean(abs(ts_pct(close, 1)) / amount, w)",
    "low_close_support": "ts_mean((close - low) / close, w)",
}

#: Statement candidates.
STATEMENT = {
    "quality_roe_ocf": "cs_rank(roe_ttm) + cs_rank(cashflow_to_profit)",
    "quality_roa_ocf": "cs_rank(roa_ttm) + cs_rank(cashflow_to_profit)",
    "cash_profit_cover": "cs_rank(n_cashflow_act_ttm / net_profit_ttm)",
    "low_accrual_to_assets": "cs_rank((n_cashflow_act_ttm - net_profit_ttm) / total_assets)",
    "gross_margin_quality": "cs_rank(gross_margin_ttm) + cs_rank(gross_margin_yoy)",
    "quality_growth_hmean": "harm_mean(cs_rank(revenue_yoy), cs_rank(net_profit_yoy)) + cs_rank(cashflow_to_profit)",
    "ocf_growth_quality": "cs_rank(ocf_yoy) + cs_rank(cashflow_to_profit)",
    "asset_turnover_improve": "cs_rank(asset_turnover_yoy)",
    "debt_cash_safety": "cs_rank(n_cashflow_act_ttm / total_liab) - cs_rank(debt_to_assets)",
    "low_leverage_quality": "cs_rank(roe_ttm) - cs_rank(debt_to_assets)",
    "capex_efficiency": "cs_rank(revenue_yoy) - cs_rank(capex_to_assets)",
    "roe_value_pb": "cs_rank(roe_ttm) - cs_rank(pb)",
    "earnings_yield_quality": "cs_rank(1 / pe_ttm) + cs_rank(cashflow_to_profit)",
    "shareholder_yield_quality": "cs_rank(dv_ttm) + cs_rank(roe_ttm)",
    "free_cashflow_yield_quality": "cs_rank(free_cashflow_ttm / total_mv) + cs_rank(cashflow_to_profit)",
    "cash_revenue_quality": "cs_rank(operating_cf_margin_ttm) + cs_rank(ocf_to_or)",
    "margin_value_ps": "cs_rank(net_margin_ttm) - cs_rank(ps_ttm)",
    "solvency_liquidity_quality": "cs_rank(current_ratio) + cs_rank(quick_ratio) - cs_rank(debt_to_assets)",
    "working_capital_light": "-cs_rank(working_capital_pressure)",
    "turnover_efficiency_combo": "cs_rank(inv_turn) + cs_rank(ar_turn)",
    "reported_margin_quality": "cs_rank(grossprofit_margin) + cs_rank(netprofit_margin)",
    "eps_bps_value_quality": "cs_rank(eps) + cs_rank(bps) - cs_rank(pb)",
    "cash_buffer_value": "cs_rank(cash_to_liab) - cs_rank(pb)",
    "growth_value_balance": "harm_mean(cs_rank(revenue_yoy), cs_rank(net_profit_yoy)) - cs_rank(pe_ttm)",
    "operating_efficiency_quality": "cs_rank(asset_turnover_ttm) + cs_rank(net_margin_ttm)",
    "clean_growth_quality": "cs_rank(cashflow_to_profit) + cs_rank(net_profit_yoy) - cs_rank(working_capital_pressure)",
    "robust_margin_value_ps": "cs_robust_zscore(net_margin_ttm) - cs_robust_zscore(ps_ttm)",
    "fcf_cash_conversion": "cs_rank(free_cashflow_ttm / n_cashflow_act_ttm) + cs_rank(cashflow_to_profit)",
    "liquidity_solvency_value": "cs_rank(cash_to_liab) + cs_rank(current_ratio) - cs_rank(pb)",
    "dupont_value_quality": "cs_rank(net_margin_ttm) + cs_rank(asset_turnover_ttm) - cs_rank(pb)",
    "inventory_receivable_light": "-cs_rank(inventories / total_assets) - cs_rank(accounts_receiv / total_assets) + cs_rank(ar_turn)",
    "industry_neutral_roe_value_pb": "industry_neutralize(cs_rank(roe_ttm) - cs_rank(pb))",
    "industry_rank_cash_profit_cover": "group_rank(n_cashflow_act_ttm / net_profit_ttm)",
    "size_neutral_earnings_yield_quality": "size_neutralize(cs_rank(1 / pe_ttm) + cs_rank(cashflow_to_profit), log_mv)",
}

#: Statement candidates with one window w.
STATEMENT_WINDOWED = {
    "quality_liquidity_confirm": "cs_zscore(cs_rank(operating_cf_margin_ttm) + cs_rank(amount / ts_mean(amount, w)))",
    "decayed_quality_growth": "ts_decay_linear(cs_rank(revenue_yoy) + cs_rank(net_profit_yoy) + cs_rank(cashflow_to_profit), w)",
    "stable_cash_conversion": "cs_zscore(cashflow_to_profit) - cs_zscore(ts_coef_var(cashflow_to_profit, w))",
    "margin_trend_value": "cs_zscore(ts_zscore(net_margin_ttm, w)) - cs_zscore(ps_ttm)",
    "cash_value_attention_gap": "cs_robust_zscore(cs_rank(cash_to_liab) - cs_rank(pb)) - cs_robust_zscore(turnover_rate / ts_mean(turnover_rate, w))",
    "rd_neglect": "cs_zscore(rd_expense_intensity) - cs_zscore(amount / ts_mean(amount, w))",
    "value_attention_gap": "cs_zscore(cs_rank(1 / pe_ttm) + cs_rank(roe_ttm)) - cs_zscore(amount / ts_mean(amount, w))",
    "growth_turnover_confirm": "cs_zscore(cs_rank(revenue_yoy) + cs_rank(net_profit_yoy)) + cs_zscore(turnover_rate / ts_mean(turnover_rate, w))",
    "quality_attention_gap_robust": "cs_robust_zscore(cs_rank(cashflow_to_profit) + cs_rank(roe_ttm)) - cs_robust_zscore(amount / ts_mean(amount, w))",
    "fcf_turnover_confirm": "cs_zscore(cs_rank(free_cashflow_ttm / total_mv)) + cs_zscore(turnover_rate / ts_mean(turnover_rate, w))",
}

#: Atoms: what is ranked; a leading minus stands for one minus the rank.
ATOMS = {
    "roe": "roe_ttm", "roa": "roa_ttm", "gross_margin": "gross_margin_ttm", "net_margin": "net_margin_ttm",
    "operating_cf_margin": "operating_cf_margin_ttm", "cashflow_to_profit": "cashflow_to_profit",
    "reported_roe": "roe", "reported_roa": "roa", "reported_gross_margin": "grossprofit_margin",
    "reported_net_margin": "netprofit_margin", "reported_ocf_to_or": "ocf_to_or", "reported_ocf_to_profit": "ocf_to_profit",
    "eps": "eps", "bps": "bps", "cfps": "cfps", "revenue_yoy": "revenue_yoy", "net_profit_yoy": "net_profit_yoy",
    "ocf_yoy": "ocf_yoy", "gross_margin_yoy": "gross_margin_yoy", "asset_turnover_yoy": "asset_turnover_yoy",
    "op_yoy": "op_yoy", "or_yoy": "or_yoy", "netprofit_yoy": "netprofit_yoy",
    "low_pe": "-pe_ttm", "earnings_yield": "1 / pe_ttm", "low_pb": "-pb", "low_ps": "-ps_ttm", "dividend_yield": "dv_ttm",
    "current_ratio": "current_ratio", "quick_ratio": "quick_ratio", "cash_to_liab": "cash_to_liab",
    "cashflow_to_liab": "n_cashflow_act_ttm / total_liab", "profit_to_liab": "net_profit_ttm / total_liab",
    "revenue_to_liab": "total_revenue_ttm / total_liab", "net_cash_to_assets": "(money_cap - total_liab) / total_assets",
    "leverage_adjusted_roe": "roe_ttm - debt_to_assets", "low_debt_assets": "-debt_to_assets",
    "low_working_capital_pressure": "-working_capital_pressure", "asset_turnover": "asset_turnover_ttm",
    "inventory_turnover": "inv_turn", "receivable_turnover": "ar_turn", "low_capex_assets": "-capex_to_assets",
    "rd_intensity": "rd_expense_intensity", "fcf_yield": "free_cashflow_ttm / total_mv",
    "fcf_to_assets": "free_cashflow_ttm / total_assets", "fcf_margin": "free_cashflow_ttm / total_revenue_ttm",
    "fcf_to_profit": "free_cashflow_ttm / net_profit_ttm", "profit_to_assets": "net_profit_ttm / total_assets",
    "ocf_to_assets": "n_cashflow_act_ttm / total_assets", "revenue_to_assets": "total_revenue_ttm / total_assets",
    "cash_to_assets": "money_cap / total_assets", "accrual_quality": "(n_cashflow_act_ttm - net_profit_ttm) / total_assets",
    "cash_conversion_spread": "(n_cashflow_act_ttm - net_profit_ttm) / total_revenue_ttm",
    "gross_to_net_margin": "net_margin_ttm / gross_margin_ttm", "low_inventory_assets": "-(inventories / total_assets)",
    "low_receivable_assets": "-(accounts_receiv / total_assets)",
    "low_receivable_inventory_assets": "-((accounts_receiv + inventories) / total_assets)",
}


def atom(name: str) -> str:
    what = ATOMS[name]
    return f"1 - cs_rank({what[1:]})" if what.startswith("-") else f"cs_rank({what})"


#: Which atoms are paired: each of the first with each of the second.
PAIRS = [
    ("roe roa net_margin operating_cf_margin cashflow_to_profit reported_ocf_to_or reported_ocf_to_profit profit_to_assets ocf_to_assets fcf_to_assets fcf_margin fcf_to_profit cash_conversion_spread leverage_adjusted_roe eps", "low_pb low_pe earnings_yield low_ps fcf_yield"),
    ("revenue_yoy net_profit_yoy ocf_yoy gross_margin_yoy asset_turnover_yoy", "cashflow_to_profit operating_cf_margin reported_ocf_to_or reported_ocf_to_profit roe net_margin fcf_margin accrual_quality cash_conversion_spread"),
    ("cash_to_liab cashflow_to_liab profit_to_liab revenue_to_liab net_cash_to_assets cash_to_assets current_ratio quick_ratio leverage_adjusted_roe low_debt_assets", "low_pb low_pe earnings_yield fcf_yield"),
    ("asset_turnover revenue_to_assets inventory_turnover receivable_turnover low_working_capital_pressure low_inventory_assets low_receivable_assets low_receivable_inventory_assets gross_to_net_margin low_capex_assets", "net_margin cashflow_to_profit reported_ocf_to_profit fcf_margin low_pb"),
]

#: Triples; "h" takes the harmonic mean of the first two and adds the third.
TRIPLES = {
    "revenue_profit_cash_hmean": "h revenue_yoy net_profit_yoy cashflow_to_profit",
    "revenue_profit_low_pe_hmean": "h revenue_yoy net_profit_yoy low_pe",
    "roe_cash_low_pb": "roe cashflow_to_profit low_pb",
    "roa_ocf_low_pb": "roa ocf_to_assets low_pb",
    "dupont_low_pb": "net_margin asset_turnover low_pb",
    "cash_safety_low_pb": "cash_to_liab low_debt_assets low_pb",
    "working_capital_cash_growth": "low_working_capital_pressure cashflow_to_profit net_profit_yoy",
    "inventory_receivable_efficiency": "low_inventory_assets low_receivable_assets receivable_turnover",
    "ocf_assets_low_debt": "ocf_to_assets cash_to_assets low_debt_assets",
    "rd_growth_cash": "rd_intensity revenue_yoy cashflow_to_profit",
    "margin_growth_low_ps": "gross_margin_yoy net_margin low_ps",
    "eps_bps_low_pb": "eps bps low_pb",
    "cfps_cash_low_pe": "cfps cashflow_to_profit low_pe",
    "cash_profit_debt_cover": "cashflow_to_liab profit_to_liab low_debt_assets",
    "fcf_margin_low_ps": "fcf_margin reported_ocf_to_or low_ps",
    "accrual_cash_low_pb": "accrual_quality cash_conversion_spread low_pb",
    "working_capital_fcf_value": "low_receivable_inventory_assets fcf_margin low_pb",
    "reported_cash_margin_low_pb": "reported_ocf_to_profit reported_net_margin low_pb",
    "leverage_adjusted_quality_value": "leverage_adjusted_roe cashflow_to_profit low_pb",
    "fcf_assets_low_pb": "fcf_to_assets low_debt_assets low_pb",
    "revenue_liab_efficiency_growth": "revenue_to_liab asset_turnover_yoy revenue_yoy",
    "earnings_yield_quality_cash": "earnings_yield cashflow_to_profit reported_ocf_to_profit",
    "gross_net_cash_value": "gross_to_net_margin operating_cf_margin low_ps",
}

#: Combinations that also come neutral to industry, and to size if their name speaks of value.
NEUTRAL = "roe_low_pb roe_low_pe roa_low_pb net_margin_low_ps operating_cf_margin_low_pb cashflow_to_profit_low_pb profit_to_assets_low_pb ocf_to_assets_low_pb revenue_profit_cash_hmean roe_cash_low_pb roa_ocf_low_pb dupont_low_pb cash_safety_low_pb working_capital_cash_growth eps_bps_low_pb reported_ocf_to_profit_low_pb fcf_margin_low_ps accrual_cash_low_pb working_capital_fcf_value reported_cash_margin_low_pb leverage_adjusted_quality_value fcf_assets_low_pb earnings_yield_quality_cash gross_net_cash_value"
VALUE_WORDS = ("low_pb", "low_pe", "low_ps", "fcf", "value", "dupont")


def _mean(names: list[str]) -> str:
    return "(" + " + ".join(f"({atom(n)})" for n in names) + f") / {len(names)}"


def combinations() -> dict[str, str]:
    """Pairs and triples; of equal names the pair stays for the combination, the triple for its neutral forms."""
    pairs = {f"{a}_{b}": _mean([a, b]) for left, right in PAIRS for a in left.split() for b in right.split()}
    triples = {}
    for name, spec in TRIPLES.items():
        kind, *names = spec.split() if spec.startswith("h ") else ("mean", *spec.split())
        triples[name] = f"harm_mean({atom(names[0])}, {atom(names[1])}) + ({atom(names[2])})" if kind == "h" else _mean(names)
    out = {f"fund_combo_{k}": v for k, v in {**triples, **pairs}.items()}
    both = {**pairs, **triples}
    for k in sorted(NEUTRAL.split()):
        out[f"fund_ind_neu_{k}"] = f"industry_neutralize({both[k]})"
        if any(w in k for w in VALUE_WORDS):
            out[f"fund_size_neu_{k}"] = f"size_neutralize({both[k]}, log_mv)"
    return out


def daily(windows: tuple[int, ...] = (5, 20)) -> dict[str, str]:
    out = {f"{k}_{w}": _with(v, w) for w in windows for k, v in DAILY.items()}
    return out | {"reversal_1d": "-ts_pct(close, 1)"}


def statement(window: int = 20) -> dict[str, str]:
    return STATEMENT | {f"{k}_{window}": _with(v, window) for k, v in STATEMENT_WINDOWED.items()}


def _with(text: str, window: int) -> str:
    import re

    return re.sub(r"\bw\b", str(window), text)


def atoms() -> dict[str, str]:
    return {f"fund_atom_{k}": atom(k) for k in ATOMS}


def mining_universe() -> dict[str, str]:
    """Statement candidates, atoms and combinations: 374."""
    return {**statement(), **atoms(), **combinations()}


_VOL60 = "ts_std(log1p(volume), 60, 30)"
_TVSD20 = "ts_std(cs_regression_resid(close, volume), 20, 10)"
_VROC12 = "ts_pct(positive(volume), 12)"
_BETA = "cs_zscore(0.5 * ts_std(ret1, 20, 10) + 0.5 * ts_std(ret1, 60, 30))"

#: Published signals 1 to 65.
PUBLIC = {
    "rl_01_tail_risk_reversal": "-cs_zscore(signed_log1p(ts_kurt(close, 5)) + ts_max(ts_skew(volume, 5), 3) - ts_min(ts_skew(volume, 20), 3) + rolling_sum_max(ret1, 20, 5))",
    "rl_02_projection_support_proxy": "-(cs_regression_resid(cs_rank(ret5), cs_rank(ts_mean(volume, 15))) * ts_mean(ret1, 20) + ts_sum(main_flow_20 / total_mv, 10, 5) * cs_rank(ts_mean(low_shadow, 5)))",
    "rl_03_pvt_covariance_reversal": "-cs_zscore(signed_log1p(ts_covariance(ret1, ret1 * volume, 20)))",
    "rl_04_valuation_price_resid_proxy": "ts_corr(close / ts_mean(close, 250, 120) - 1, industry_neutralize(-pb), 90, 45) * cs_regression_resid(close, vwap + cs_zscore(volume)) - ts_max(ts_mean(ret1, 5), 25) + 1 / pe_ttm",
    "rl_05_ema_midprice_divergence": "cs_rank(ts_sum(where(abs(ts_pct(ewm(close, 20), 1)) < 0.02, 1, 0), 60) - ts_max(ts_mean((high + low) / 2, 10), 30))",
    "rl_06_vol_compression_momentum": "-((ts_max(close, 20) - ts_min(close, 20)) / ts_mean(close, 20) * cs_rank(ts_skew(close, 30)))",
    "rl_07_log_volume_price_trend": "-signed_log1p(ts_sum(ts_delta(close, 5) * log10(1 + max0(ts_sum(volume, 10))), 10))",
    "rl_08_variance_ratio_divergence": "-cs_rank(abs(ts_var(positive(ret1), 120, 60) / ts_var(negative(ret1), 120, 60) - ts_var(positive(ret1), 60, 30)))",
    "rl_09_filtered_momentum_proxy": "when(pe_ttm > 0, -cs_rank(ts_delta(close, 5) + signed_log1p(volume + 1 / pe_ttm)))",
    "rl_10_cashflow_price_trend_proxy": "cs_rank(cs_rank(mfi(21)) * (operating_cf_margin_ttm - ts_std(close, 60, 30)))",
    "rl_11_large_outflow_reversal": "-cs_rank(coalesce(group_std((ts_mean(close, 3, 2) + ts_mean(close, 6, 3) + ts_mean(close, 12, 6) + ts_mean(close, 24, 12)) / 4 - ewm(close, 60)), 0) * cs_winsorize(close / ts_mean(close, 60, 30) - 1) + log1p(positive(pe_ttm)))",
    "rl_12_industry_mainflow_profit_quality": "-cs_rank(group_rank(main_flow_20) - cs_quantile(roe_ttm - ts_min(ts_delta(roe_ttm, 20), 250, 60), 0.5))",
    "rl_13_fundflow_cross_section_pct": "-cs_rank(round(ts_delta(vwap + ts_delta(high, 10), 15) * where(cs_rank(flow_days_20 + con_days_10) >= 0.8, cs_rank(flow_days_20 + con_days_10), 0)))",
    "rl_14_large_outflow_reversal_dup": "-(turnover_rate + ts_var(large_out, 60, 30))",
    "rl_15_nonlinear_price_volume_proxy": "-(sin(ts_mean(ret1, 5)) * coalesce(cs_skew(vwap), 0) * coalesce(ts_median(flow_days_10, 20, 10), 0) + signed_log1p(ts_max(high - low, 60, 30)) * (ts_max(volume, 20, 10) / ts_mean(volume, 20, 10)))",
    "rl_16_decay_volume_trend": "-cs_zscore(ts_max(ts_decay_linear(ret1, 20, 10) * log1p(max0(volume)), 3))",
    "rl_17_vol_trend_structure": "round(ewm(close, 10) / ts_mean(close, 5)) * (ts_std(ret1, 120, 60) - ts_std(ret1, 20, 10)) + (ts_ir(ret1, 120, 60) - ts_ir(ret1, 20, 10))",
    "rl_18_turnover_adjusted_price": "-cs_rank(signed_log1p(cs_regression_resid(close, -(1 / turnover_rate))))",
    "rl_19_poly_volume_price_reversal": "-((close - (ts_mean(close, 30, 20) + ts_slope(close, volume, 30, 20) * (volume - ts_mean(volume, 30, 20))) + ts_kurt(ret1, 20, 10)) * sqrt(abs(volume)))",
    "rl_20_price_exhaustion_reversal": "-(ts_rank(close, 20) * ((rolling_sum_max(high, 20, 5) - ts_quantile(close, 20, 0.5)) + (close - ts_mean(close, 20))))",
    "rl_21_log_momentum_reversal_proxy": "-cs_rank(cs_zscore(signed_log1p(ts_pct(close, 15) + ts_pct(close, 60))))",
    "rl_22_volume_divergence_momentum": "-cs_rank(ts_corr(cs_rank(ts_mean(close, 15)), cs_rank(ts_mean(volume, 15)), 10)) * cs_rank(ts_mean(ret1, 15)) * cs_rank(ts_mean(turnover_rate, 15)) * cs_rank(ts_mean(volume, 15))",
    "rl_23_turnover_relative_reversal": "-(ts_mean(turnover_rate, 20) / ts_mean(turnover_rate, 120, 60))",
    "rl_24_price_reversal_30d": "-ts_pct(close, 30)",
    "rl_25_high_open_decay": "-ts_wma(high - open, 5)",
    "rl_26_moneyflow_drawdown": "ts_max_drawdown(main_flow, 15, 8)",
    "rl2_27_reverse_price_volume_rank": "-cs_rank(close) * cs_rank(volume)",
    "rl2_28_volatility_spread_proxy": f"ts_percentage({_VOL60}, 5, 3) - ts_percentage({_TVSD20}, 5, 3)",
    "rl2_29_volume_stable_close": "cs_rank(volume) * (1 - cs_rank(ts_std(close, 10, 5)))",
    "rl2_30_short_term_vol_adjusted_return": "-cs_rank(ts_sum(close - open, 15, 8)) * cs_rank(ts_std(close, 15, 8))",
    "rl2_31_gap_momentum": "(ts_mean(open, 10, 5) - ts_mean(close, 10, 5)) * cs_rank(ts_delta(close, 10))",
    "rl2_32_reverse_volatility_covariance_proxy": f"-ts_covariance({_VROC12}, ts_std(cs_rank(close), 15, 8), 20, 10)",
    "rl2_33_reinstatement_vol_ratio": f"ts_std(ts_pct(close, 60), 35, 18) / ts_std({_TVSD20}, 35, 18)",
    "rl2_34_composite_momentum_flow": f"ts_decay_linear({_VROC12}, 10, 5) + ts_decay_linear(main_flow_20, 10, 5)",
    "rl2_35_flow_momentum": "ts_decay_linear(abs(cs_rank(main_flow_20)) - abs(cs_rank(slarge_flow)), 15, 8)",
    "rl2_36_momentum_flow_volatility": f"ts_decay_linear({_VOL60}, 10, 5) * ts_percentage(main_flow_20, 10, 5)",
    "rl2_37_flow_volatility_synergy": f"ts_decay_linear(main_flow_20, 10, 5) * {_VOL60}",
    "rl2_38_main_superlarge_flow_synergy": "cs_rank(ts_percentage(main_flow_20, 30, 15) * ts_decay_linear(slarge_flow, 15, 8))",
    "rl2_39_main_superlarge_flow_spread": "ts_decay_linear(main_flow_20, 5, 3) - ts_decay_linear(slarge_flow, 5, 3)",
    "rl2_40_style_ir_spread": f"ts_ir({_BETA}, 20, 10) - ts_ir(cs_zscore(log_mv), 20, 10)",
    "rl2_41_flow_volatility_factor": f"ts_percentage(main_flow_20, 10, 5) * {_VOL60}",
    "rl2_42_flow_linear_decay": "ts_decay_linear(cs_rank(main_flow_20 - slarge_flow), 15, 8)",
    "rl2_43_main_flow_momentum": "ts_percentage(ts_decay_linear(main_flow_20, 6, 3), 3, 2)",
    "rl2_44_momentum_reversal": "-ts_sum(ts_delta(cs_rank(close), 1), 40, 20)",
    "rl2_45_flow_momentum_reinstatement": "abs(ts_pct(close, 60)) * ts_decay_linear(main_flow_20, 15, 8)",
    "rl2_46_main_flow_linear_decay": "ts_decay_linear(main_flow_20, 10, 5)",
    "rl2_47_price_flow_volatility_coupling": "-cs_rank(close / ts_delay(close, 15)) * cs_rank(ts_std(main_flow, 15, 8))",
    "rl2_48_price_volume_decay_synergy": f"-ts_percentage(cs_rank(close), 10, 5) * ts_decay_linear({_VROC12}, 60, 30)",
    "rl2_49_dual_volatility_flow_inverse": "-cs_rank(ts_std(close, 10, 5)) * cs_rank(ts_std(main_flow, 10, 5))",
    "rl2_50_price_volume_volatility_inverse": "-cs_rank(ts_std(close, 10, 5)) * cs_rank(ts_std(volume, 10, 5))",
    "rl2_51_multidim_reversal": "-cs_rank(close / ts_mean(close, 20, 10)) * cs_rank(ts_mean(volume, 20, 10)) * cs_rank(ts_mean(turnover_rate, 20, 10))",
    "rl2_52_main_flow_peak_inverse": "-cs_rank(ts_max(main_flow, 10, 5))",
    "rl2_53_main_flow_stability": "-ts_std(main_flow, 10, 5)",
    "rl2_54_turnover_volatility_inverse": "-ts_std(turnover_rate, 15, 8)",
    "rl2_55_vol_turnover_coupling": "cs_zscore(cs_rank(ts_std(close, 15, 8))) * (-turnover_rate)",
    "rl2_56_ma_deviation_volume_weighted": "(ts_mean(close, 20, 10) - close) * cs_rank(volume)",
    "rl2_57_vol_adjusted_reversal": "-ts_mean(signed_power(ret1, 2), 30, 15)",
    "rl2_58_liquidity_stability": "-ts_mean(cs_rank(amount), 10, 5)",
    "rl2_59_price_vwap_volume_volatility": "-ts_std((close - vwap) * volume, 10, 5)",
    "rl2_60_ma_filter_reversal": "where(close > ts_mean(close, 35, 18), -ts_delta(close, 10), 0)",
    "rl2_61_price_volume_divergence_cov": "-ts_covariance(ts_delta(volume, 1), ts_delta(close, 1), 30, 15)",
    "rl2_62_reversal_turnover_boost": "-(close / ts_delay(close, 5) * turnover_rate)",
    "rl2_63_price_volume_efficiency": "cs_rank(ts_sum(volume, 30, 15)) / cs_rank(ts_sum(amount, 30, 15))",
    "rl2_64_residual_volatility": _TVSD20,
    "rl2_65_turnover_volatility_momentum": "-signed_power(cs_rank(ts_std(turnover_rate, 14, 7)), 2) * ts_rank(close, 30, 15)",
}

_BETA252 = "rolling_beta(ret1, market_return, 252, 126)"

#: Risk descriptors of the first model: (style, formula).
DESCRIPTORS = {
    "log_total_mv": ("size", "log(total_mv)"),
    "mid_cap_proxy": ("size", "cs_regression_resid(pow(log(total_mv), 2), log(total_mv))"),
    "beta_252": ("volatility", _BETA252),
    "daily_std_252": ("volatility", "ts_std(ret1, 252, 126)"),
    "cumulative_range_252": ("volatility", "log(ts_max(high, 252, 126) / ts_min(low, 252, 126))"),
    "residual_volatility_proxy": ("volatility", f"ts_std(ret1 - {_BETA252} * market_return, 252, 126)"),
    "avg_turnover_21": ("liquidity", "ts_mean(turnover_rate, 21, 10)"),
    "avg_turnover_63": ("liquidity", "ts_mean(turnover_rate, 63, 21)"),
    "avg_amount_21": ("liquidity", "log1p(ts_mean(max0(amount), 21, 10))"),
    "turnover_stability_63": ("liquidity", "-ts_std(turnover_rate, 63, 21)"),
    "ret_252_ex_21": ("momentum", "ts_delay(close, 21) / ts_delay(close, 252) - 1"),
    "ret_126": ("momentum", "ts_pct(close, 126)"),
    "short_reversal_21": ("momentum", "-ts_pct(close, 21)"),
    "book_to_price": ("value", "1 / pb"),
    "earnings_yield": ("value", "1 / pe_ttm"),
    "sales_to_price": ("value", "1 / ps_ttm"),
    "cashflow_to_price": ("value", "n_cashflow_act_ttm / total_mv"),
    "revenue_yoy": ("growth", "revenue_yoy"),
    "net_profit_yoy": ("growth", "net_profit_yoy"),
    "roe_growth": ("growth", "ts_delta(roe_ttm, 252)"),
    "asset_turnover_yoy": ("growth", "asset_turnover_yoy"),
    "roe_ttm": ("quality", "roe_ttm"),
    "roa_ttm": ("quality", "roa_ttm"),
    "gross_margin_ttm": ("quality", "gross_margin_ttm"),
    "cashflow_to_profit": ("quality", "cashflow_to_profit"),
    "low_leverage": ("quality", "-debt_to_assets"),
    "accrual_quality": ("quality", "(n_cashflow_act_ttm - net_profit_ttm) / total_assets"),
    "dv_ttm": ("dividend_yield", "dv_ttm"),
    "dv_ratio": ("dividend_yield", "dv_ratio"),
    "analyst_report_count_90": ("sentiment", "analyst_report_count_90"),
    "analyst_org_count_180": ("sentiment", "analyst_org_count_180"),
    "analyst_rating_score_180": ("sentiment", "analyst_rating_score_180"),
    "analyst_target_upside_180": ("sentiment", "analyst_target_upside_180"),
    "analyst_eps_revision_180": ("sentiment", "analyst_eps_revision_180"),
}

_EXCESS = "(log1p(ret1) - log1p(market_return))"
_EBETA = "fewm_beta(ret1, market_return, 252, 63, 126)"
_MV = "(total_mv * 10000)"

#: Risk descriptors of the second model: (style, weight in it, direction, formula).
DESCRIPTORS_V2 = {
    "log_total_mv": ("size", 1.0, 1, f"log({_MV})"),
    "nonlinear_size_residual": ("nonlinear_size", 1.0, 1, f"pow(log({_MV}), 3)"),
    "beta_252_ewma": ("beta", 0.5, 1, _EBETA),
    "beta_504_ewma": ("beta", 0.3, 1, "fewm_beta(ret1, market_return, 504, 126, 252)"),
    "downside_beta_252": ("beta", 0.2, 1, "fewm_beta(ret1, negative(market_return), 252, 63, 60)"),
    "dastd_252": ("residual_volatility", 0.5, 1, "fewm_std(ret1, 252, 42, 126)"),
    "hsigma_252": ("residual_volatility", 0.3, 1, f"fewm_std(ret1 - {_EBETA} * market_return, 252, 63, 126)"),
    "cmra_12m": ("residual_volatility", 0.2, 1, f"ts_max(ts_sum({_EXCESS}, 21, 10), 252, 126) - ts_min(ts_sum({_EXCESS}, 21, 10), 252, 126)"),
    "stom_21": ("liquidity", 0.3, 1, "log(ts_sum(turnover_rate / 100, 21, 10))"),
    "stoq_63": ("liquidity", 0.3, 1, "log(ts_sum(turnover_rate / 100, 63, 32) / 3)"),
    "stoa_252": ("liquidity", 0.25, 1, "log(ts_sum(turnover_rate / 100, 252, 126) / 12)"),
    "amihud_63": ("liquidity", 0.1, -1, "log(ts_mean(abs(ret1) / (amount * 1000), 63, 32))"),
    "turnover_stability_63": ("liquidity", 0.05, -1, "ts_std(turnover_rate / 100, 63, 32)"),
    "rstr_12m_ex_1m": ("momentum", 0.5, 1, f"ts_sum(ts_delay({_EXCESS}, 21), 231, 116)"),
    "rstr_6m_ex_1m": ("momentum", 0.3, 1, f"ts_sum(ts_delay({_EXCESS}, 21), 105, 53)"),
    "momentum_ewma_252": ("momentum", 0.2, 1, f"fewm_mean(ts_delay({_EXCESS}, 21), 231, 126, 116)"),
    "reversal_5d": ("short_reversal", 0.4, 1, "-ts_pct(close, 5)"),
    "reversal_21d": ("short_reversal", 0.6, 1, "-ts_pct(close, 21)"),
    "book_to_price": ("book_to_price", 1.0, 1, "1 / positive(pb)"),
    "earnings_yield": ("earnings_yield", 0.4, 1, "1 / positive(pe_ttm)"),
    "cashflow_to_price": ("earnings_yield", 0.35, 1, f"n_cashflow_act_ttm / {_MV}"),
    "forecast_earnings_yield": ("earnings_yield", 0.25, 1, "analyst_forward_eps_180 / positive(close)"),
    "revenue_yoy": ("growth", 0.25, 1, "revenue_yoy"),
    "net_profit_yoy": ("growth", 0.25, 1, "net_profit_yoy"),
    "eps_growth": ("growth", 0.2, 1, "eps_growth"),
    "roe_growth": ("growth", 0.15, 1, "roe_growth"),
    "asset_turnover_yoy": ("growth", 0.15, 1, "asset_turnover_yoy"),
    "roe_ttm": ("profitability", 0.2, 1, "roe_ttm"),
    "roa_ttm": ("profitability", 0.15, 1, "roa_ttm"),
    "gross_margin_ttm": ("profitability", 0.15, 1, "gross_margin_ttm"),
    "operating_margin_ttm": ("profitability", 0.1, 1, "operating_margin_ttm"),
    "cashflow_to_profit": ("profitability", 0.15, 1, "cashflow_to_profit"),
    "accrual_quality": ("profitability", 0.15, 1, "(n_cashflow_act_ttm - net_profit_ttm) / total_assets"),
    "earnings_stability": ("profitability", 0.1, 1, "earnings_stability"),
    "asset_growth": ("investment_quality", 0.35, -1, "asset_growth"),
    "capex_growth": ("investment_quality", 0.25, -1, "capex_growth"),
    "inventory_growth": ("investment_quality", 0.2, -1, "inventory_growth"),
    "working_capital_growth": ("investment_quality", 0.2, -1, "working_capital_growth"),
    "debt_to_assets": ("leverage", 0.35, 1, "debt_to_assets"),
    "book_leverage": ("leverage", 0.3, 1, "coalesce(book_leverage, total_assets / (total_assets - total_liab))"),
    "market_leverage": ("leverage", 0.25, 1, f"total_liab / (total_liab + {_MV})"),
    "inverse_interest_coverage": ("leverage", 0.1, 1, "inverse_interest_coverage"),
    "dv_ttm": ("dividend_yield", 0.7, 1, "dv_ttm"),
    "dv_ratio": ("dividend_yield", 0.3, 1, "dv_ratio"),
    "analyst_report_count_90": ("sentiment", 0.15, 1, "analyst_report_count_90"),
    "analyst_org_count_180": ("sentiment", 0.15, 1, "analyst_org_count_180"),
    "analyst_rating_score_180": ("sentiment", 0.2, 1, "analyst_rating_score_180"),
    "analyst_target_upside_180": ("sentiment", 0.25, 1, "analyst_target_upside_180"),
    "analyst_eps_revision_180": ("sentiment", 0.25, 1, "analyst_eps_revision_180"),
}


#: Technical features of a model's input.
FEATURES = {
    "returns_1d": "ts_pct(close, 1)",
    "volatility_5d": "ts_std(ts_pct(close, 1), 5)",
    "sma_5": "ts_mean(close, 5)",
    "sma_10": "ts_mean(close, 10)",
    "sma_20": "ts_mean(close, 20)",
    "ema_12": "ewm(close, 12)",
    "ema_26": "ewm(close, 26)",
    "macd": "macd(close)",
    "macd_signal": "ewm(macd(close), 9)",
    "rsi_14": "rsi(close, 14)",
    "close_sma5_ratio": "close / ts_mean(close, 5)",
    "close_sma20_ratio": "close / ts_mean(close, 20)",
    "volume_change": "ts_pct(volume, 1)",
    "label": "ts_lead(close, 10) / ts_lead(close, 1) - 1",
    "label_rank": "cs_rank(ts_lead(close, 10) / ts_lead(close, 1) - 1)",
}

#: Style exposures of the portfolio tools; what is missing counts as zero.
STYLES = {
    "style_size": "coalesce(cs_winsor_zscore(log_mv), 0)",
    "style_value": "coalesce(cs_winsor_zscore(1 / pe_ttm + 1 / pb), 0)",
    "style_momentum": "coalesce(cs_winsor_zscore(0.5 * ts_pct(close, 20) + 0.5 * ts_pct(close, 60)), 0)",
    "style_volatility": "coalesce(cs_winsor_zscore(0.5 * ts_std(ret1, 20, 10) + 0.5 * ts_std(ret1, 60, 30)), 0)",
    "style_liquidity": "coalesce(cs_winsor_zscore(log1p(max0(amount)) + turnover_rate), 0)",
    "style_quality": "coalesce(cs_winsor_zscore(roe_ttm + cashflow_to_profit), 0)",
    "style_leverage": "coalesce(cs_winsor_zscore(debt_to_assets), 0)",
}


def descriptors() -> dict[str, str]:
    return {f"d_{k}": f for k, (_, f) in DESCRIPTORS.items()}


def descriptors_v2() -> dict[str, str]:
    return {f"d_{k}": (f if sign > 0 else f"-({f})") for k, (_, _, sign, f) in DESCRIPTORS_V2.items()}


#: The panel operators, each on columns with nulls where x is 0 or y is low.
_X, _Y = "when(disc > 0.02, close)", "when(tax > 0.01, volume)"
OPERATORS = {
    "safe_div": f"{_X} / {_Y}", "spread": f"spread({_X}, {_Y})", "geom_mean": f"geom_mean({_X}, {_Y})", "harm_mean": f"harm_mean({_X}, {_Y})",
    "signed_log1p": f"signed_log1p({_X} - 4)", "signed_power": f"signed_power({_X} - 4, 2)",
    "cs_rank": f"cs_rank({_X})", "cs_zscore": f"cs_zscore({_X})", "cs_robust_zscore": f"cs_robust_zscore({_X})", "cs_scale": f"cs_scale({_X} - 4)",
    "cs_winsorize": f"cs_winsorize({_X}, 0.05, 0.95)", "industry_neutralize": f"industry_neutralize({_X})", "group_rank": f"group_rank({_X})",
    "size_neutralize": f"size_neutralize({_X}, log(amount + 1))", "cs_regression_resid": f"cs_regression_resid({_X}, {_Y})",
    "ts_delay": f"ts_delay({_X}, 2)", "ts_delta": f"ts_delta({_X}, 2)", "ts_pct": f"ts_pct({_X}, 3)",
    "ts_mean": f"ts_mean({_X}, 10, 5)", "ts_sum": f"ts_sum({_X}, 10, 5)", "ts_std": f"ts_std({_X}, 10, 5)", "ts_var": f"ts_var({_X}, 10, 5)",
    "ts_median": f"ts_median({_X}, 10, 5)", "ts_quantile": f"ts_quantile({_X}, 10, 0.25, 5)", "ts_min": f"ts_min({_X}, 10, 5)", "ts_max": f"ts_max({_X}, 10, 5)",
    "ts_skew": f"ts_skew({_X}, 10, 5)", "ts_kurt": f"ts_kurt({_X}, 10, 5)", "ts_zscore": f"ts_zscore({_X}, 10, 5)", "ts_coef_var": f"ts_coef_var({_X}, 10, 5)",
    "ts_wma": f"ts_wma({_X}, 10, 5)", "ts_decay_linear": f"ts_decay_linear({_X}, 10, 5)", "ts_argmax": f"ts_argmax({_X}, 10, 5)", "ts_argmin": f"ts_argmin({_X}, 10, 5)",
    "ts_rank": f"ts_rank({_X}, 10, 5)", "ts_percentage": f"ts_percentage({_X}, 20, 8)", "ts_max_drawdown": f"ts_max_drawdown({_X}, 10, 5)",
    "ts_corr": f"ts_corr({_X}, {_Y}, 20, 8)", "ts_covariance": f"ts_covariance({_X}, {_Y}, 20, 8)", "ts_slope": f"ts_slope({_X}, {_Y}, 20, 8)", "ts_rsquare": f"ts_rsquare({_X}, {_Y}, 20, 8)",
    "ewm_mean": "ewm(close, 12)", "finite_ewm_mean": f"fewm_mean({_X}, 60, 20, 10)", "finite_ewm_var": f"fewm_var({_X}, 60, 20, 10)", "rolling_ewm_beta": f"fewm_beta({_X}, {_Y}, 60, 20, 10)",
    "ts_ir": f"ts_ir({_X}, 10, 5)", "rolling_sum_max": "rolling_sum_max(close, 10, 5)", "mfi": "mfi(21)", "rsi": "rsi(close, 14)", "macd": "macd(close)",
    "macd_signal": "ewm(macd(close), 9)", "cross_sectional_normalize": f"cs_mad_zscore({_X})", "forward_label": "ts_lead(close, 10) / ts_lead(close, 1) - 1",
    "forward_rank_label": "cs_rank(ts_lead(close, 5) / close - 1) - 0.5",
}
