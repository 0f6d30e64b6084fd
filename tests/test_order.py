"""Order statistics of moving windows against pandas; blocks, ties, nulls and empty tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import order


def _panel(n, seed=4):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(0, 1, n), 1)
    x[g.random(n) < 0.25] = np.nan
    return pd.DataFrame({"code": 1, "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "x": x})


def _frame(spark, pdf):
    return spark.createDataFrame([(int(c), d, None if v != v else float(v)) for c, d, v in pdf.itertuples(index=False)], "code int, date date, x double")


@pytest.mark.parametrize("block", [1, 7, 30, 1000])
def test_against_pandas_at_any_block(spark, block):
    pdf = pd.concat([_panel(90), _panel(25, 9).assign(code=2)])
    stats = {"median": ("x", 20, 5, 0.5), "q": ("x", 20, 5, 0.9), "rank": ("x", 8, 3, None), "one": ("x", 1, 1, None)}
    got = order.rolling_order(_frame(spark, pdf), stats, block=block).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    by = pdf.groupby("code").x
    want = pdf.assign(
        median=by.transform(lambda s: s.rolling(20, min_periods=5).median()),
        q=by.transform(lambda s: s.rolling(20, min_periods=5).quantile(0.9)),
        rank=by.transform(lambda s: s.rolling(8, min_periods=3).apply(lambda v: np.nan if np.isnan(v[-1]) else (v <= v[-1]).sum() / (~np.isnan(v)).sum(), raw=True)),
    ).reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("median", "q", "rank"):
        assert np.allclose(got[c], want[c], equal_nan=True), c
    assert ((got.one == 1) | got.one.isna()).all()


def test_nothing_known_and_no_rows(spark):
    frame = spark.createDataFrame([(None, dt.date(2020, 1, 1), 1.0), (1, None, None), (1, dt.date(2020, 1, 1), float("nan")), (1, dt.date(2020, 1, 1), float("inf"))], "code int, date date, x double")
    rows = order.rolling_order(frame, {"m": ("x", 3, 1, 0.5)}).collect()
    assert sorted((r.m for r in rows), key=str) == [1.0, None, None, float("inf")]
    assert order.rolling_order(frame.limit(0), {"m": ("x", 3, 1, 0.5)}).collect() == []
    with pytest.raises(ValueError):
        order.rolling_order(frame, {})
