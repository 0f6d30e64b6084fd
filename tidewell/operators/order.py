"""Medians, quantiles and ranks over long moving windows.

A window function sorts each row's frame anew.  Here a code's rows pass a kernel that keeps
the window in order: a row enters and one leaves by bisection, and every quantile and rank of the
window is read off.  Short windows (some 30 rows) are as fast as window functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a code that one call of the kernel gets, apart from those before that its windows need.
BLOCK = 16_384


def moving_order(x: np.ndarray, n: int, least: int, asks: list[float | None]) -> list[list[float | None]]:
    """For each ask a value per row over its last n rows: the quantile, interpolated, or for None the share of values not above the row's own."""
    window: list[float] = []
    out: list[list[float | None]] = [[None] * len(x) for _ in asks]
    values, known = x.tolist(), (~np.isnan(x)).tolist()
    for i, v in enumerate(values):
        if i >= n and known[i - n]:
            del window[bisect_left(window, values[i - n])]
        if known[i]:
            insort(window, v)
        m = len(window)
        if m < max(least, 1):
            continue
        for k, q in enumerate(asks):
            if q is None:
                out[k][i] = bisect_right(window, v) / m if known[i] else None
            else:
                at = (m - 1) * q
                low, high = window[int(at)], window[min(int(at) + 1, m - 1)]
                out[k][i] = low if low == high else low + (high - low) * (at - int(at))
    return out


def rolling_order(panel: DataFrame, stats: Mapping[str, tuple[str, int, int, float | None]], code: str = "code", date: str = "date", block: int = BLOCK) -> DataFrame:
    """(code, date, name ..): for name (column, n, least, q) the q-quantile, or with q None the rank, of the column's last n rows.

    Nulls and NaN are no values; fewer than ``least`` values give null, as does the rank of a
    null.  Stats of one column and window share one pass.  Rows are those of panel; of rows
    with one date those with the least values come first, nulls before them.

    A code's rows come in blocks with the rows before them that windows reach, so a code of any
    length passes in bounded memory, and a row is read at most twice.
    """
    if not stats:
        raise ValueError("no statistics")
    columns = sorted({c for c, *_ in stats.values()})
    reach = max(n for _, n, *_ in stats.values()) - 1
    size = max(block, reach, 1)
    shared: dict[tuple, list[str]] = {}
    for name, (c, n, least, _) in stats.items():
        shared.setdefault((columns.index(c), n, least), []).append(name)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        mine = table.column("_mine").to_numpy()
        got: dict[str, list] = {}
        for (c, n, least), names in shared.items():
            x = table.column(f"_x{c}").to_numpy().astype(float)
            got.update(zip(names, moving_order(x, n, least, [stats[k][3] for k in names])))
        kept = table.select([0, 1])
        for name in stats:
            kept = kept.append_column(name, pa.array(got[name], pa.float64()))
        return kept.filter(pa.array(mine))

    order = Window.partitionBy(code).orderBy(date, *[F.col(f"_x{k}").asc_nulls_first() for k in range(len(columns))])
    rows = panel.select(code, date, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_x{k}") for k, c in enumerate(columns)])
    rows = rows.withColumn("_row", F.row_number().over(order) - 1).withColumn("_own", F.floor(F.col("_row") / size))
    later = F.col("_row") % size >= size - reach
    rows = rows.withColumn("_block", F.explode(F.when(later, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = rows.select(code, date, "_row", (F.col("_block") == F.col("_own")).alias("_mine"), *[f"_x{k}" for k in range(len(columns))], "_block")
    kinds = dict(panel.select(code, date).dtypes)
    schema = f"`{code}` {kinds[code]}, `{date}` {kinds[date]}, " + ", ".join(f"`{k}` double" for k in stats)
    return rows.groupBy(code, "_block").applyInArrow(run, schema)
