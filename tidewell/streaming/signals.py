"""Stream forms of sequential signals; the batch forms are in tidewell.operators.monitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """First delivery of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, sum and mean by group and tumbling window, emitted when the watermark has passed it."""
    w = F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total", "mean")


def held_signal(stream: DataFrame, by: str, time: str, signal: str) -> DataFrame:
    """(by, time, held): the last non-null signal of each group, 0 before the first; rows of a batch in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(time)
        out = []
        for s in rows[signal]:
            held = held if pd.isna(s) else int(s)
            out.append(held)
        state.update((held,))
        yield pd.DataFrame({by: rows[by], time: rows[time], "held": out})

    kind = dict(stream.dtypes)
    return stream.groupBy(by).applyInPandasWithState(run, f"{by} {kind[by]}, {time} {kind[time]}, held int", "held int", "append", "NoTimeout")
