"""Ordered keyword rules and small scalar rules as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Analyst ratings by the words they contain, tried in this order (fixed values).
RATINGS = [
    (1.0, ["强烈推荐", "强推", "买入", "推荐", "跑赢大市", "跑赢行业", "优于大市", "优于行业", "buy", "outperform"]),
    (0.5, ["增持", "审慎增持", "谨慎推荐", "overweight", "add"]),
    (0.0, ["中性", "持有", "同步大市", "同步行业", "无评级", "未评级", "neutral", "hold", "market perform"]),
    (-1.0, ["卖出", "回避", "sell"]),
    (-0.5, ["减持", "低于大市", "弱于大市", "低于行业", "弱于行业", "underweight", "reduce", "underperform"]),
]


def first_match(text: Column, rules: Sequence[tuple[object, Sequence[str]]]) -> Column:
    """The value of the first rule with a word that the text contains, null if none has."""
    low = F.lower(F.trim(text))
    out = None
    for value, words in rules:
        hit = None
        for w in words:
            c = low.contains(w)
            hit = c if hit is None else hit | c
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def rating_score(text: Column) -> Column:
    return first_match(text, RATINGS)


def first_available(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns])


def percent_to_decimal(x: str) -> tuple[str, str]:
    """Stages for a column in percent if the median of its absolute values is over 2: (name of the median, expression)."""
    return f"percentile(abs({x}), 0.5)", f"case when _median > 2 then {x} / 100 else {x} end"


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether two ranges meet; nulls are open ends."""
    return (start.isNull() | hi.isNull() | (start <= hi)) & (end.isNull() | lo.isNull() | (end >= lo))
