"""Panel expressions: parsed once, planned as stages of window projections.

An expression is text such as ``cs_rank(close / ts_mean(close, 20))``.  Functions over rows
of one code are ``ts_*``, over one date ``cs_*``.  Planning replaces each window call by a
column of the earliest stage in which its arguments exist; equal calls of all expressions
share one column.  Each stage is one projection, so Spark sorts once per (partition, order)
and evaluates scalar parts in generated code.  The same plan renders as DuckDB SQL.

Division gives null where the divisor is within 1e-12 of zero; null stands for "no value".
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ranks import share_ranks

Node = tuple  # (kind, ...): ("col", name), ("num", value), ("call", name, args)

BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Gt: "gt", ast.Lt: "lt", ast.GtE: "ge", ast.LtE: "le"}


def parse(text: str) -> Node:
    return _expand(_node(ast.parse(text, mode="eval").body))


def _node(a: ast.AST) -> Node:
    if isinstance(a, ast.Constant):
        return ("num", a.value)
    if isinstance(a, ast.Name):
        return ("col", a.id)
    if isinstance(a, ast.UnaryOp) and isinstance(a.op, ast.USub):
        x = _node(a.operand)
        return ("num", -x[1]) if x[0] == "num" else ("call", "neg", (x,))
    if isinstance(a, ast.BinOp):
        return ("call", BINARY[type(a.op)], (_node(a.left), _node(a.right)))
    if isinstance(a, ast.Compare):
        return ("call", BINARY[type(a.ops[0])], (_node(a.left), _node(a.comparators[0])))
    if isinstance(a, ast.Call):
        return ("call", a.func.id, tuple(map(_node, a.args)))
    raise ValueError(f"not an expression: {ast.dump(a)}")


#: Functions made of others; parameters are replaced by arguments, missing ones by defaults.
MACROS: dict[str, tuple[list[tuple[str, float | None]], str]] = {
    "spread": ([("x", None), ("y", None)], "(x - y) / (abs(x) + abs(y))"),
    "harm_mean": ([("x", None), ("y", None)], "2 * x * y / (x + y)"),
    "signed_log1p": ([("x", None)], "sign(x) * log1p(abs(x))"),
    "signed_power": ([("x", None), ("p", None)], "sign(x) * pow(abs(x), p)"),
    "cs_zscore": ([("x", None)], "same_null(x, coalesce((x - cs_avg(x)) / cs_std(x), 0))"),
    "cs_robust_zscore": ([("x", None)], "same_null(x, coalesce((x - cs_quantile(x, 0.5)) / (1.4826 * cs_quantile(abs(x - cs_quantile(x, 0.5)), 0.5)), 0))"),
    "cs_scale": ([("x", None)], "same_null(x, coalesce(x / cs_sum(abs(x)), 0))"),
    "cs_winsorize": ([("x", None), ("lo", 0.01), ("hi", 0.99)], "clip(x, cs_quantile(x, lo), cs_quantile(x, hi))"),
    "cs_winsor_zscore": ([("x", None)], "cs_zscore(cs_winsorize(x))"),
    "cs_mad_zscore": ([("x", None)], "coalesce(cs_zscore(clip(x, cs_quantile(x, 0.5) - 5 * cs_quantile(abs(x - cs_quantile(x, 0.5)), 0.5), cs_quantile(x, 0.5) + 5 * cs_quantile(abs(x - cs_quantile(x, 0.5)), 0.5))), 0)"),
    "industry_neutralize": ([("x", None)], "group_only(x - group_avg(x))"),
    "size_neutralize": ([("x", None), ("s", None)], "cs_regression_resid(x, s)"),
    "ts_delta": ([("x", None), ("p", 1)], "x - ts_delay(x, p)"),
    "ts_pct": ([("x", None), ("p", 1)], "x / ts_delay(x, p) - 1"),
    "ts_median": ([("x", None), ("n", None), ("mp", 0)], "ts_quantile(x, n, 0.5, mp)"),
    "ts_zscore": ([("x", None), ("n", None), ("mp", 0)], "(x - ts_mean(x, n, mp)) / ts_std(x, n, mp)"),
    "ts_coef_var": ([("x", None), ("n", None), ("mp", 0)], "ts_std(x, n, mp) / abs(ts_mean(x, n, mp))"),
    "ts_rsquare": ([("y", None), ("x", None), ("n", None), ("mp", 0)], "pow(ts_corr(y, x, n, mp), 2)"),
    "ts_wma": ([("x", None), ("n", None), ("mp", 0)], "list_wma(ts_list(x, n, mp), n)"),
    "ts_decay_linear": ([("x", None), ("n", None), ("mp", 0)], "list_decay(ts_list(x, n, mp))"),
    "ts_rank": ([("x", None), ("n", None), ("mp", 0)], "list_rank(ts_list(x, n, mp), x)"),
    "ts_percentage": ([("x", None), ("n", None), ("mp", 0)], "list_rank(ts_list(x, n, mp), x)"),
    "ts_argmax": ([("x", None), ("n", None), ("mp", 0)], "list_argmax(ts_rows(x, n, mp))"),
    "ts_argmin": ([("x", None), ("n", None), ("mp", 0)], "list_argmin(ts_rows(x, n, mp))"),
    "ts_max_drawdown": ([("x", None), ("n", None), ("mp", 0)], "list_drawdown(ts_list(x, n, mp))"),
    "ts_ir": ([("x", None), ("n", None), ("mp", 0)], "ts_mean(x, n, mp) / ts_std(x, n, mp)"),
    "rolling_sum_max": ([("x", None), ("outer", None), ("inner", None)], "ts_max(ts_sum(x, inner), outer)"),
    "rsi": ([("x", None), ("n", 14)], "100 * ts_mean(max0(ts_delta(x, 1)), n) / (ts_mean(max0(ts_delta(x, 1)), n) + ts_mean(max0(-ts_delta(x, 1)), n))"),
    "macd": ([("x", None), ("fast", 12), ("slow", 26)], "ewm(x, fast) - ewm(x, slow)"),
    "mfi": ([("n", 21)], "100 - 100 / (1 + ts_sum(max0(mf_flow(0)), n) / ts_sum(max0(-mf_flow(0)), n))"),
    "mf_flow": ([("z", 0)], "(high + low + close) / 3 * volume * coalesce(sign((high + low + close) / 3 - ts_delay((high + low + close) / 3, 1)), 0)"),
    # sums over the last n rows, in blocks of n rows: the row's block up to it and the rest of the block before
    "block": ([("n", None)], "floor((ts_row(0) - 1) / n)"),
    "age": ([("n", None)], "ts_row(0) - 1 - n * block(n)"),
    "age_weight": ([("n", None), ("hl", None)], "pow(2, age(n) / hl)"),
    "moving": ([("x", None), ("n", None)], "block_run(coalesce(x, 0), block(n)) + coalesce(ts_delay(block_sum(coalesce(x, 0), block(n)) - block_run(coalesce(x, 0), block(n)), n), 0)"),
    "decayed": ([("x", None), ("n", None), ("hl", None)], "block_run(coalesce(x, 0) * age_weight(n, hl), block(n)) / age_weight(n, hl) + coalesce(ts_delay(block_sum(coalesce(x, 0) * age_weight(n, hl), block(n)) - block_run(coalesce(x, 0) * age_weight(n, hl), block(n)), n), 0) / (age_weight(n, hl) * pow(2, n / hl))"),
    "fewm_mean": ([("x", None), ("n", None), ("hl", None), ("mp", None)], "when(moving(same_null(x, 1), n) >= mp, decayed(x, n, hl) / decayed(same_null(x, 1), n, hl))"),
    # recursive mean: each value's share depends on the rows since the last one; shares of older values are products, kept as sums of logarithms and cut into blocks before they underflow
    "ewm_old": ([("x", None), ("a", None)], "pow(1 - a, ts_row(0) - ts_before(same_null(x, ts_row(0))))"),
    "ewm_log": ([("x", None), ("a", None)], "coalesce(ts_run(same_null(x, ln(ewm_old(x, a) / (ewm_old(x, a) + a)))), 0)"),
    "ewm_block": ([("x", None), ("a", None)], "floor(-ewm_log(x, a) / 300)"),
    "ewm_scale": ([("x", None), ("a", None)], "ewm_log(x, a) + 300 * ewm_block(x, a)"),
    "ewm_own": ([("x", None), ("a", None)], "block_run(x * coalesce(a / (ewm_old(x, a) + a), 1) * exp(-ewm_scale(x, a)), ewm_block(x, a)) * exp(ewm_scale(x, a))"),
    "ewm_carry": ([("x", None), ("a", None)], "coalesce(block_first(ts_delay(ewm_own(x, a), 1), ewm_block(x, a)) * exp(ewm_log(x, a) - block_first(ts_delay(ewm_log(x, a), 1), ewm_block(x, a))), 0)"),
    "ewm_mean": ([("x", None), ("a", None)], "coalesce(ewm_own(x, a), 0) + ewm_carry(x, a)"),
    "ewm": ([("x", None), ("span", None)], "when(ts_run(same_null(x, 1)) > 0, ewm_mean(x, 2 / (span + 1)))"),
    "fewm_var": ([("x", None), ("n", None), ("hl", None), ("mp", None)], "max0(fewm_mean(x * x, n, hl, mp) - pow(fewm_mean(x, n, hl, mp), 2))"),
    "fewm_std": ([("x", None), ("n", None), ("hl", None), ("mp", None)], "sqrt(fewm_var(x, n, hl, mp))"),
    "fewm_beta": ([("y", None), ("x", None), ("n", None), ("hl", None), ("mp", None)], "(fewm_mean(x * y, n, hl, mp) - fewm_mean(same_null(y, x), n, hl, mp) * fewm_mean(same_null(x, y), n, hl, mp)) / fewm_var(same_null(y, x), n, hl, mp)"),
    "rolling_beta": ([("y", None), ("x", None), ("n", None), ("mp", 0)], "ts_slope(y, x, n, mp)"),
}


def _expand(n: Node) -> Node:
    if n[0] != "call":
        return n
    args = tuple(map(_expand, n[2]))
    if n[1] not in MACROS:
        return ("call", n[1], args)
    names, body = MACROS[n[1]]
    given = {k: args[i] if i < len(args) else ("num", d) for i, (k, d) in enumerate(names)}
    return _expand(_replace(_node(ast.parse(body, mode="eval").body), given))


def _replace(n: Node, given: dict[str, Node]) -> Node:
    if n[0] == "col":
        return given.get(n[1], n)
    if n[0] == "call":
        return ("call", n[1], tuple(_replace(x, given) for x in n[2]))
    return n


# ---------------------------------------------------------------- rendering

CODE, DATE, GROUP = "code", "date", "industry"
LATEST = f"partition by {CODE} order by {DATE}"


def number(v: float) -> str:
    """A double literal in both dialects."""
    s = format(float(v), ".17g")
    return s if "e" in s else s + "e0"


def _frame(n: Node) -> str:
    return f"{LATEST} rows between {int(n[1]) - 1} preceding and current row"


def _least(n: Node, mp: Node | None) -> int:
    """min_periods; zero or none means the whole window."""
    return int(mp[1]) or int(n[1]) if mp else int(n[1])


def _rolling(call: Callable[[str, str], str]) -> Callable:
    def sql(r: Callable, d: str, x: Node, n: Node, mp: Node | None = None) -> str:
        w, a = _frame(n), r(x)
        return f"case when count({a}) over ({w}) >= {_least(n, mp)} then {call(a, d).replace('@', f'over ({w})')} end"

    return sql


def _paired(call: str) -> Callable:
    def sql(r: Callable, d: str, x: Node, y: Node, n: Node, mp: Node | None = None) -> str:
        w, a, b = _frame(n), r(x), r(y)
        pair = f"case when ({a}) is not null and ({b}) is not null then 1 end"
        return f"case when count({pair}) over ({w}) >= {_least(n, mp)} then {call.format(a=a, b=b, w=f'over ({w})')} end"

    return sql


def _skew(a: str, d: str) -> str:
    if d == "duckdb":
        return f"skewness({a}) @"
    n = f"cast(count({a}) @ as double)"
    return f"nanvl(case when {n} >= 3 then skewness({a}) @ * sqrt({n} * ({n} - 1)) / ({n} - 2) end, null)"


def _kurt(a: str, d: str) -> str:
    if d == "duckdb":
        return f"kurtosis({a}) @"
    n = f"cast(count({a}) @ as double)"
    return f"nanvl(case when {n} >= 4 then ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({a}) @ + 6) end, null)"


def _ts_quantile(r: Callable, d: str, x: Node, n: Node, q: Node, mp: Node | None = None) -> str:
    f = "percentile" if d == "spark" else "quantile_cont"
    return _rolling(lambda a, _: f"{f}({a}, {float(q[1])!r}) @")(r, d, x, n, mp)


def _slope(r: Callable, d: str, y: Node, x: Node, n: Node, mp: Node | None = None) -> str:
    """Covariance over pairs by variance over all x."""
    w, a, b = _frame(n), r(y), r(x)
    pair, mp_ = f"case when ({a}) is not null and ({b}) is not null then 1 end", _least(n, mp)
    ok = f"count({pair}) over ({w}) >= {mp_} and count({b}) over ({w}) >= {mp_} and var_samp({b}) over ({w}) > 1e-12"
    return f"case when {ok} then covar_samp({a}, {b}) over ({w}) / var_samp({b}) over ({w}) end"


def _cs(call: str) -> Callable:
    def sql(r: Callable, d: str, *x: Node) -> str:
        return call.format(*(r(v) if v[0] != "num" else repr(float(v[1])) for v in x), q="percentile" if d == "spark" else "quantile_cont")

    return sql


def _tied(x: str) -> str:
    """x to 40 of its 53 bits (by splitting): equal sums tie, whatever order they were added in, at any size."""
    return f"(({x}) * 8193e0 - (({x}) * 8193e0 - ({x})))"


def _rank(part: str, mask: str = "") -> Callable:
    def sql(r: Callable, d: str, x: Node) -> str:
        a = _tied(r(x))
        order = f"partition by {part} order by {a} asc nulls last"  # one sort serves the rank and the count of ties
        return f"case when ({a}) is not null {mask} then (rank() over ({order}) + 5e-1 * (count(1) over ({order} range between current row and current row) - 1)) / count({a}) over (partition by {part}) end"

    return sql


def _list(nulls: bool) -> Callable:
    def sql(r: Callable, d: str, x: Node, n: Node, mp: Node | None = None) -> str:
        w, a = _frame(n), r(x)
        if d == "spark":
            item = f"transform(collect_list(named_struct('v', {a})) over ({w}), s -> s.v)" if nulls else f"collect_list({a}) over ({w})"
        else:
            item = f"list({a}) over ({w})" if nulls else f"list({a}) filter (where ({a}) is not null) over ({w})"
        return f"case when count({a}) over ({w}) >= {_least(n, mp)} then {item} end"

    return sql


def _corr(r: Callable, d: str, x: Node, y: Node, n: Node, mp: Node | None = None) -> str:
    """Pearson over pairs, null where a side is constant (corr() divides by zero there)."""
    w, a, b = _frame(n), r(x), r(y)
    ok = f"case when ({a}) is not null and ({b}) is not null then"
    sd = " * ".join(f"stddev_samp({ok} {v} end) over ({w})" for v in (a, b))
    return f"case when count({ok} 1 end) over ({w}) >= {_least(n, mp)} and {sd} > 1e-14 then covar_samp({a}, {b}) over ({w}) / ({sd}) end"


#: Window functions: rendered over columns of earlier stages.
WINDOWS: dict[str, Callable] = {
    "ts_mean": _rolling(lambda a, d: f"avg({a}) @"),
    "ts_sum": _rolling(lambda a, d: f"sum({a}) @"),
    "ts_std": _rolling(lambda a, d: f"stddev_samp({a}) @"),
    "ts_var": _rolling(lambda a, d: f"var_samp({a}) @"),
    "ts_min": _rolling(lambda a, d: f"min({a}) @"),
    "ts_max": _rolling(lambda a, d: f"max({a}) @"),
    "ts_skew": _rolling(_skew),
    "ts_kurt": _rolling(_kurt),
    "ts_quantile": _ts_quantile,
    "ts_corr": _corr,
    "ts_covariance": _paired("covar_samp({a}, {b}) {w}"),
    "ts_slope": _slope,
    "ts_delay": lambda r, d, x, p=("num", 1): f"lag({r(x)}, {int(p[1])}) over ({LATEST})",
    "ts_lead": lambda r, d, x, p=("num", 1): f"lead({r(x)}, {int(p[1])}) over ({LATEST})",
    "ts_row": lambda r, d, x: f"cast(row_number() over ({LATEST}) as double)",
    "ts_run": lambda r, d, x: f"sum({r(x)}) over ({LATEST} rows unbounded preceding)",
    "ts_before": lambda r, d, x: (f"last_value({r(x)}) ignore nulls" if d == "spark" else f"last_value({r(x)} ignore nulls)") + f" over ({LATEST} rows between unbounded preceding and 1 preceding)",
    "block_run": lambda r, d, x, b: f"sum({r(x)}) over (partition by {CODE}, {r(b)} order by {DATE} rows unbounded preceding)",
    "block_sum": lambda r, d, x, b: f"sum({r(x)}) over (partition by {CODE}, {r(b)} order by {DATE} rows between unbounded preceding and unbounded following)",
    "block_first": lambda r, d, x, b: f"first_value({r(x)}) over (partition by {CODE}, {r(b)} order by {DATE} rows unbounded preceding)",
    "ts_list": _list(False),
    "ts_rows": _list(True),
    "cs_avg": _cs("avg({0}) over (partition by date)"),
    "cs_std": _cs("stddev_samp({0}) over (partition by date)"),
    "cs_sum": _cs("sum({0}) over (partition by date)"),
    "cs_skew": lambda r, d, x: _skew(r(x), d).replace("@", "over (partition by date)"),
    "cs_count": _cs("count({0}) over (partition by date)"),
    "cs_quantile": _cs("{q}({0}, {1}) over (partition by date)"),
    "group_avg": _cs("avg({0}) over (partition by date, industry)"),
    "group_std": _cs("stddev_samp({0}) over (partition by date, industry)"),
    "cs_rank": _rank("date"),
    "group_rank": _rank("date, industry", "and industry is not null"),
    "cs_regression_resid": _cs("case when ({0}) is not null and ({1}) is not null and regr_count({0}, {1}) over (partition by date) >= 3 then ({0}) - (regr_intercept({0}, {1}) over (partition by date) + regr_slope({0}, {1}) over (partition by date) * ({1})) end"),
}


def _op(text: str, duck: str | None = None) -> Callable:
    def sql(r: Callable, d: str, *x: Node) -> str:
        return (duck if duck and d == "duckdb" else text).format(*map(r, x))

    return sql


def _hof(spark: str, duck: str) -> Callable:
    return _op(spark, duck)


SCALARS: dict[str, Callable] = {
    "add": _op("({0} + {1})"),
    "sub": _op("({0} - {1})"),
    "mul": _op("({0} * {1})"),
    "div": lambda r, d, x, y: f"({r(x)} / {r(y)})" if y[0] == "num" else _op("(case when abs({1}) > 1e-12 then {0} / {1} end)")(r, d, x, y),
    "gt": _op("({0} > {1})"),
    "lt": _op("({0} < {1})"),
    "ge": _op("({0} >= {1})"),
    "le": _op("({0} <= {1})"),
    "neg": _op("(-{0})"),
    "abs": _op("abs({0})"),
    "sign": _op("cast(sign({0}) as double)"),
    "sqrt": _op("(case when {0} >= 0 then sqrt({0}) end)"),
    "sin": _op("sin({0})"),
    "floor": _op("cast(floor({0}) as double)"),
    "exp": _op("exp({0})"),
    "ln": _op("ln({0})"),
    "pow": _op("pow({0}, {1})"),
    "log": _op("(case when {0} > 0 then ln({0}) end)"),
    "log1p": _op("(case when {0} > -1 then ln(1e0 + {0}) end)"),
    "log10": _op("(case when {0} > 0 then ln({0}) / ln(1e1) end)"),
    "round": _op("bround({0})", "round_even({0}, 0)"),
    "max0": _op("(case when {0} > 0 then {0} when {0} is not null then 0e0 end)"),
    "geom_mean": _op("(case when {0} >= 0 and {1} >= 0 then sqrt({0} * {1}) end)"),
    "positive": _op("(case when {0} > 0 then {0} end)"),
    "negative": _op("(case when {0} < 0 then {0} end)"),
    "coalesce": _op("coalesce({0}, {1})"),
    "where": _op("(case when {0} then {1} else {2} end)"),
    "when": _op("(case when {0} then {1} end)"),
    "same_null": _op("(case when ({0}) is not null then {1} end)"),
    "double": _op("cast({0} as double)"),
    "group_only": _op("(case when industry is not null then {0} end)"),
    "clip": _op("(case when {0} < {1} then {1} when {0} > {2} then {2} else {0} end)"),
    "list_wma": _hof(
        "(aggregate(transform({0}, (v, i) -> v * ({1} - size({0}) + i + 1)), 0e0, (s, v) -> s + v) / aggregate(transform({0}, (v, i) -> {1} - size({0}) + i + 1), 0e0, (s, v) -> s + v))",
        "(list_sum(list_transform({0}, lambda v, i: v * ({1} - len({0}) + i))) / list_sum(list_transform({0}, lambda v, i: {1} - len({0}) + i)))",
    ),
    "list_decay": _hof(
        "(aggregate(transform({0}, (v, i) -> v * (i + 1)), 0e0, (s, v) -> s + v) / (5e-1 * size({0}) * (size({0}) + 1)))",
        "(list_sum(list_transform({0}, lambda v, i: v * i)) / (5e-1 * len({0}) * (len({0}) + 1)))",
    ),
    "list_rank": _hof(
        "(case when ({1}) is not null then size(filter({0}, v -> (v * 8193e0 - (v * 8193e0 - v)) <= (({1}) * 8193e0 - (({1}) * 8193e0 - ({1}))))) / cast(size({0}) as double) end)",
        "(case when ({1}) is not null then len(list_filter({0}, lambda v: (v * 8193e0 - (v * 8193e0 - v)) <= (({1}) * 8193e0 - (({1}) * 8193e0 - ({1}))))) / cast(len({0}) as double) end)",
    ),
    "list_argmax": _hof("(array_position({0}, array_max({0})) / cast(size({0}) as double))", "(list_position({0}, list_max({0})) / cast(len({0}) as double))"),
    "list_argmin": _hof("(array_position({0}, array_min({0})) / cast(size({0}) as double))", "(list_position({0}, list_min({0})) / cast(len({0}) as double))"),
    "list_drawdown": _hof(
        "aggregate({0}, named_struct('pk', cast(null as double), 'dd', cast(null as double)), (s, v) -> named_struct('pk', greatest(s.pk, v), 'dd', least(s.dd, case when abs(greatest(s.pk, v)) > 1e-12 then (v - greatest(s.pk, v)) / abs(greatest(s.pk, v)) end)), s -> coalesce(s.dd, 0e0))",
        "(case when {0} is not null then coalesce(list_min(list_transform({0}, lambda v, i: case when abs(list_max({0}[1:i])) > 1e-12 then (v - list_max({0}[1:i])) / abs(list_max({0}[1:i])) end)), 0e0) end)",
    ),
}


def render(n: Node, dialect: str) -> str:
    if n[0] == "col":
        return n[1]
    if n[0] == "num":
        return number(n[1])
    table = WINDOWS if n[1] in WINDOWS else SCALARS
    if n[1] not in table:
        raise ValueError(f"no such function: {n[1]}")
    return table[n[1]](lambda x: render(x, dialect), dialect, *n[2])


# ---------------------------------------------------------------- planning


def _rounded(decimals: int | None) -> Callable[[str], str]:
    """Rounds for comparison; a tiny shift moves exact half-way cases, as of ranks, off the border."""
    return (lambda s: s) if decimals is None else (lambda s: f"round({s} + 1.2345e-8, {decimals})")


#: From so many ranks in a stage on, one kernel by date ranks all of them, as each window would sort all rows for itself.
#: Below, sorts cost less than moving wide rows (sf0.1: 49 ranks 84 to 60 s, a few in each of several stages 50 to 66 s).
MANY_RANKS = 16


def _ranked(panel: DataFrame, names: list[str]) -> DataFrame:
    """panel with each of the columns replaced by its rank in its date."""

    def run(table: pa.Table) -> pa.Table:
        r = share_ranks(np.column_stack([table.column(c).to_numpy() for c in names]))
        for k, c in enumerate(names):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(r[:, k], pa.float64(), mask=np.isnan(r[:, k])))
        return table

    return panel.groupBy(DATE).applyInArrow(run, panel.schema)


@dataclass
class Plan:
    """Stages of (column, window call) and the final scalar expressions."""

    names: list[str]
    stages: list[dict[str, Node]] = field(default_factory=list)
    final: dict[str, Node] = field(default_factory=dict)

    def spark(self, panel: DataFrame, keep: tuple[str, ...] = (CODE, DATE), decimals: int | None = None, sources: tuple[Plan, ...] = ()) -> DataFrame:
        """sources: plans, each over the one before and the first over panel, whose results this one reads."""
        from tidewell.plans import phases

        out, kept, names = phases.run((*sources, self), panel, keep)
        cut = _rounded(decimals)
        return out.select(*[F.col(c).alias(k) for k, c in kept.items()], *[F.expr(f"cast({cut(c)} as double)").alias(k) for k, c in names.items()])

    def duckdb(self, panel: str, keep: tuple[str, ...] = (CODE, DATE), decimals: int | None = None) -> str:
        """SQL over ``panel``, itself a query."""
        parts, last = [f"s0 as ({panel})"], "s0"
        for k, stage in enumerate(self.stages, 1):
            cols = ", ".join(f"{render(n, 'duckdb')} as {c}" for c, n in stage.items())
            parts.append(f"s{k} as (select *, {cols} from {last})")
            last = f"s{k}"
        cut = _rounded(decimals)
        cols = ", ".join([*keep, *(f"cast({cut(render(n, 'duckdb'))} as double) as {k}" for k, n in self.final.items())])
        return f"with {', '.join(parts)} select {cols} from {last}"


def plan(expressions: dict[str, str]) -> Plan:
    """One plan for all expressions; equal window calls are planned once."""
    out, known = Plan(list(expressions)), {}

    def column(node: Node, level: int) -> tuple[Node, int]:
        if node not in known:
            while len(out.stages) <= level:
                out.stages.append({})
            known[node] = (f"_w{len(known)}", level + 1)
            out.stages[level][known[node][0]] = node
        name, level = known[node]
        return ("col", name), level

    def lower(n: Node) -> tuple[Node, int]:
        if n[0] != "call":
            return n, 0
        low = [column(*x) if _size(x[0]) > LARGE else x for x in map(lower, n[2])]
        node, level = ("call", n[1], tuple(x for x, _ in low)), max((k for _, k in low), default=0)
        return (node, level) if n[1] not in WINDOWS else column(node, level)

    out.final = {k: lower(parse(v))[0] for k, v in expressions.items()}
    return out


#: A scalar part of more nodes than this becomes a column of its own, so that text repeated in macros doesn't multiply.
LARGE = 12


def _size(n: Node) -> int:
    return 1 + sum(map(_size, n[2])) if n[0] == "call" else 1
