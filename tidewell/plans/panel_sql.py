"""DuckDB SQL of the panel operators, written by hand from their definitions.

None of it comes from the expression planner: cross-sections are grouped and joined back,
windows are lists of values, pairs are sums of products.  x and y are the two inputs with
nulls that the queries use, the rest are columns of the panel.
"""

from __future__ import annotations

_XY = "p as (select *, case when disc > 0.02 then close end as x, case when tax > 0.01 then volume end as y from panel)"
_ORDER = "partition by code order by date"
_ROWS = lambda n: f"({_ORDER} rows between {n - 1} preceding and current row)"


def _plain(value: str) -> str:
    return f"{_XY}, answer as (select code, date, {value} as value from p)"


def _ordered(value: str) -> str:
    return f"{_XY}, answer as (select code, date, {value} as value from p window w as ({_ORDER}))"


def _listed(value: str, n: int = 10, least: int = 5, rows: bool = False) -> str:
    """``l`` has the window's values, with nulls if rows; at least ``least`` must not be null."""
    only = "" if rows else "filter (where x is not null)"
    return f"{_XY}, t as (select *, list(x) {only} over w as l, count(x) over w as n from p window w as {_ROWS(n)}), answer as (select code, date, case when n >= {least} then {value} end as value from t)"


def _paired(value: str, n: int = 20, least: int = 8) -> str:
    """Sums over the window's pairs; vy is the variance of all its y."""
    return f"""{_XY}, q as (select *, case when y is not null then x end as a, case when x is not null then y end as b from p),
t as (select *, count(a) over w as n, sum(a) over w as sa, sum(b) over w as sb, sum(a * b) over w as sab, sum(a * a) over w as saa, sum(b * b) over w as sbb, stddev_samp(a) over w as da, stddev_samp(b) over w as db, count(y) over w as ny, var_samp(y) over w as vy from q window w as {_ROWS(n)}),
answer as (select code, date, case when n >= {least} then {value} end as value from t)"""


def _grouped(aggregates: str, value: str, by: str = "date", source: str = "p", more: str = "") -> str:
    on = " and ".join(f"s.{k} = g.{k}" for k in by.split(", "))
    return f"{_XY}{more}, g as (select {by}, {aggregates} from {source} group by {by}), answer as (select s.code, s.date, {value} as value from {source} s left join g on {on})"


def _ranked(by: str, source: str = "p", more: str = "", shift: str = "") -> str:
    """Average rank by count, from running counts of equal values."""
    on = " and ".join(f"s.{k} = g.{k}" for k in [*by.split(", "), "x"])
    return f"{_XY}{more}, e as (select {by}, x, count(*) as c from {source} where x is not null group by {by}, x), g as (select *, sum(c) over (partition by {by} order by x) as upto, sum(c) over (partition by {by}) as n from e), answer as (select s.code, s.date, (upto - c + (c + 1) / 2) / n{shift} as value from {source} s left join g on {on})"


def _safe(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-12 then ({a}) / ({b}) end"


def _fitted(regressor: str) -> str:
    """Residual of x on one regressor by date."""
    pair = f"x is not null and ({regressor}) is not null"
    return f"{_XY}, q as (select *, {regressor} as r from p), g as (select date, count(*) as n, avg(x) as mx, avg(r) as mr, covar_samp(x, r) / var_samp(r) as b from q where {pair.replace(f'({regressor})', 'r')} group by date), answer as (select q.code, q.date, case when n >= 3 and x is not null and r is not null then x - mx - b * (r - mr) end as value from q left join g on q.date = g.date)"


def _ema(column: str, span: int) -> str:
    """Recursive mean of a column without nulls in closed form, over the list of all values so far."""
    a = f"(2.0 / {span + 1})"
    return f"list_sum(list_transform({column}, lambda v, i: v * (case when i = 1 then 1 else {a} end) * pow(1 - {a}, len({column}) - i)))"


def _decayed(value: str) -> str:
    """m(..) over 60 rows: mean with weights that halve in 20 rows; a and b are the values of pairs."""
    w = "pow(0.5::double, (len(r) - i) / 20.0::double)"
    mean = lambda v: f"(list_sum(list_transform(r, lambda s, i: {v} * {w})) / list_sum(list_transform(r, lambda s, i: case when {v} is not null then {w} end)))"
    parts = {"x": "s.x", "xx": "s.x * s.x", "a": "(case when s.y is not null then s.x end)", "b": "(case when s.x is not null then s.y end)", "ab": "s.x * s.y", "bb": "(case when s.x is not null then s.y * s.y end)"}
    cols = ", ".join(f"{mean(v)} as m_{k}" for k, v in parts.items() if f"m_{k}" in value.replace("(", " ").replace(")", " ").split())
    return f"{_XY}, t as (select *, list({{'x': x, 'y': y}}) over w as r, count(x) over w as n, count(case when y is not null then x end) over w as np from p window w as {_ROWS(60)}), m as (select *, {cols} from t), answer as (select code, date, {value} as value from m)"


_MACD = f"{_XY}, t as (select *, list(close) over ({_ORDER}) as c from p), m as (select *, {_ema('c', 12)} - {_ema('c', 26)} as value from t)"
_MEDIAN = "avg(x) as mean, stddev_samp(x) as std, median(x) as med"
_MAD = ", g0 as (select date, median(x) as med from p group by date), g1 as (select p.date, median(abs(x - med)) as mad from p join g0 on p.date = g0.date group by p.date), c as (select p.code, p.date, p.x, med, mad from p join g0 on p.date = g0.date join g1 on p.date = g1.date)"
_STD = "list_stddev_samp(l)"

PANEL: dict[str, str] = {
    "safe_div": _plain(_safe("x", "y")),
    "spread": _plain(_safe("x - y", "abs(x) + abs(y)")),
    "geom_mean": _plain("case when x >= 0 and y >= 0 then sqrt(x * y) end"),
    "harm_mean": _plain(_safe("2 * x * y", "x + y")),
    "signed_log1p": _plain("sign(x - 4) * ln(1 + abs(x - 4))"),
    "signed_power": _plain("sign(x - 4) * (x - 4) * (x - 4)"),
    "cs_rank": _ranked("date"),
    "cs_zscore": _grouped(_MEDIAN, "case when x is not null then case when std > 1e-12 then (x - mean) / std else 0 end end"),
    "cs_robust_zscore": f"{_XY}{_MAD}, answer as (select code, date, case when x is not null then case when mad > 1e-12 then (x - med) / (1.4826 * mad) else 0 end end as value from c)",
    "cs_scale": _grouped("sum(abs(x - 4)) as total", "case when x is not null then case when total > 1e-12 then (x - 4) / total else 0 end end"),
    "cs_winsorize": _grouped("quantile_cont(x, 0.05) as lo, quantile_cont(x, 0.95) as hi", "case when x is not null then greatest(lo, least(hi, x)) end"),
    "industry_neutralize": _grouped("avg(x) as mean", "x - mean", "date, industry"),
    "group_rank": _ranked("date, industry"),
    "size_neutralize": _fitted("ln(amount + 1)"),
    "cs_regression_resid": _fitted("y"),
    "ts_delay": _ordered("lag(x, 2) over w"),
    "ts_delta": _ordered("x - lag(x, 2) over w"),
    "ts_pct": _ordered(_safe("x", "lag(x, 3) over w") + " - 1"),
    "ts_mean": _listed("list_avg(l)"),
    "ts_sum": _listed("list_sum(l)"),
    "ts_std": _listed(_STD),
    "ts_var": _listed("list_var_samp(l)"),
    "ts_median": _listed("list_median(l)"),
    "ts_quantile": _listed("list_aggregate(l, 'quantile_cont', 0.25)"),
    "ts_min": _listed("list_sort(l)[1]"),
    "ts_max": _listed("list_reverse_sort(l)[1]"),
    "ts_skew": _listed("list_skewness(l)"),
    "ts_kurt": _listed("list_kurtosis(l)"),
    "ts_zscore": _listed(_safe("x - list_avg(l)", _STD)),
    "ts_coef_var": _listed(_safe(_STD, "abs(list_avg(l))")),
    "ts_wma": _listed("list_dot_product(l, list_transform(range(11 - len(l), 11), lambda v: v::double)) / list_sum(range(11 - len(l), 11))"),
    "ts_decay_linear": _listed("list_dot_product(l, list_transform(range(1, len(l) + 1), lambda v: v::double)) / list_sum(range(1, len(l) + 1))"),
    "ts_argmax": _listed("list_position(l, list_max(l)) / len(l)", rows=True),
    "ts_argmin": _listed("list_position(l, list_min(l)) / len(l)", rows=True),
    "ts_rank": _listed("case when x is not null then len(list_filter(l, lambda v: v <= x)) / len(l) end"),
    "ts_percentage": _listed("case when x is not null then len(list_filter(l, lambda v: v <= x)) / len(l) end", 20, 8),
    "ts_max_drawdown": _listed("list_min(list_transform(l, lambda v, i: v / list_max(l[1:i]) - 1))"),
    "ts_corr": _paired("case when da * db > 1e-12 then (sab - sa * sb / n) / (n - 1) / (da * db) end"),
    "ts_covariance": _paired("(sab - sa * sb / n) / (n - 1)"),
    "ts_slope": _paired("case when ny >= 8 and vy > 1e-12 then (sab - sa * sb / n) / (n - 1) / vy end"),
    "ts_rsquare": _paired("case when da * db > 1e-12 then pow((sab - sa * sb / n) / (n - 1) / (da * db), 2) end"),
    "ewm_mean": f"{_XY}, t as (select *, list(close) over ({_ORDER}) as c from p), answer as (select code, date, {_ema('c', 12)} as value from t)",
    "finite_ewm_mean": _decayed("case when n >= 10 then m_x end"),
    "finite_ewm_var": _decayed("case when n >= 10 then greatest( m_xx - m_x * m_x , 0) end"),
    "rolling_ewm_beta": _decayed("case when np >= 10 and m_bb - m_b * m_b > 1e-12 then ( m_ab - m_a * m_b ) / ( m_bb - m_b * m_b ) end"),
    "ts_ir": _listed(_safe("list_avg(l)", _STD)),
    "rolling_sum_max": f"{_XY}, s as (select *, case when count(close) over w >= 5 then sum(close) over w end as s from p window w as {_ROWS(5)}), answer as (select code, date, case when count(s) over w >= 10 then max(s) over w end as value from s window w as {_ROWS(10)})",
    "mfi": f"{_XY}, t as (select *, (high + low + close) / 3 as tp, coalesce(sign(tp - lag(tp) over ({_ORDER})), 0) * tp * volume as flow from p), s as (select *, count(flow) over w as n, sum(greatest(flow, 0)) over w as up, -sum(least(flow, 0)) over w as down from t window w as {_ROWS(21)}), answer as (select code, date, case when n >= 21 and down > 1e-12 then 100 - 100 / (1 + up / down) end as value from s)",
    "rsi": f"{_XY}, t as (select *, close - lag(close) over ({_ORDER}) as d from p), s as (select *, count(d) over w as n, avg(greatest(d, 0)) over w as up, avg(greatest(-d, 0)) over w as down from t window w as {_ROWS(14)}), answer as (select code, date, case when n >= 14 and down > 1e-12 then 100 - 100 / (1 + up / down) when n >= 14 and up > 1e-12 then 100 end as value from s)",
    "macd": f"{_MACD}, answer as (select code, date, value from m)",
    "macd_signal": f"{_MACD}, n as (select *, list(value) over ({_ORDER}) as k from m), answer as (select code, date, {_ema('k', 9)} as value from n)",
    "cross_sectional_normalize": f"{_XY}{_MAD}, k as (select code, date, case when x is not null then greatest(med - 5 * mad, least(med + 5 * mad, x)) end as x from c), g as (select date, avg(x) as mean, stddev_samp(x) as std from k group by date), answer as (select k.code, k.date, case when x is not null and std > 1e-12 then (x - mean) / std else 0 end as value from k join g on k.date = g.date)",
    "forward_label": _ordered("lead(close, 10) over w / lead(close, 1) over w - 1"),
    "forward_rank_label": _ranked("date", "f", f", f as (select code, date, lead(close, 5) over ({_ORDER}) / close - 1 as x from p)", " - 0.5"),
}
