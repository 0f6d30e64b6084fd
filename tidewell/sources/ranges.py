"""Raw tables kept as range caches: ``<prefix>_<first day>_<last day>.parquet``, each partitioned by month.

A scan takes every cache whose range meets the wanted one, so tables grow by adding caches, and
their columns may differ.  What a scan reads is pruned three times: caches by their names, months by
the wanted range and, at run time, by a table of months (dynamic partition pruning), rows by
date and code.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources.files import clean

#: Vendor names of columns and the names used here; a present column of the right name comes first.
ALIASES = {"vol": "volume"}


def month_of(day: Column) -> Column:
    """yyyymm as int."""
    return F.year(day) * 100 + F.month(day)


def cache_name(prefix: str, start: date, end: date) -> str:
    return f"{prefix}_{start:%Y%m%d}_{end:%Y%m%d}.parquet"


def write_cache(df: DataFrame, root: str, prefix: str, start: date, end: date, column: str = "date") -> str:
    """Writes the rows of [start, end] as a cache by month and returns its path; rows are first gathered by month, so that a month has few files."""
    path = f"{root.rstrip('/')}/{cache_name(prefix, start, end)}"
    rows = df.where(F.col(column).between(F.lit(start), F.lit(end))).withColumn("month", month_of(F.col(column)))
    rows.repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)
    return path


def overlapping(names: Sequence[str], prefix: str, start: date, end: date) -> list[str]:
    """Names of the prefix's caches that meet [start, end], in the order in which later ones win.

    A cache without a range in its name counts as the oldest.  A longer prefix, as
    ``daily_basic`` for ``daily``, is another table.
    """
    pattern = re.compile(re.escape(prefix) + r"(?:_(\d{8})_(\d{8}))?(?:\.parquet)?$")
    found = []
    for name in names:
        m = pattern.match(name)
        if m and (m[1] is None or (m[1] <= f"{end:%Y%m%d}" and m[2] >= f"{start:%Y%m%d}")):
            found.append((m[2] or "", m[1] or "", name))
    return [n for _, _, n in sorted(found)]


def listed(spark: SparkSession, root: str) -> list[str]:
    """Names below root, on any file system that Spark reads; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def latest(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of parts by column name; of rows with equal keys one of the last part stays, the largest by its other columns.

    Aliased columns move to their name first.  One shuffle by the keys, which joins on
    the same keys use again.
    """
    if not parts:
        raise ValueError("no caches")
    out = None
    for k, df in enumerate(parts):
        for old, new in ALIASES.items():
            if old in df.columns:
                df = df.withColumn(new, F.coalesce(new, old) if new in df.columns else F.col(old)).drop(old)
        df = df.withColumn("_part", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    others = [F.col(f"`{c}`").desc_nulls_last() for c in out.columns if c not in (*keys, "_part")]
    w = Window.partitionBy(*keys).orderBy(F.col("_part").desc(), *others)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_part")


def scan(
    spark: SparkSession,
    root: str,
    prefixes: Sequence[str],
    start: date,
    end: date,
    columns: Sequence[str] | None = None,
    codes: DataFrame | None = None,
    months: DataFrame | None = None,
    code: str = "code",
    column: str = "date",
) -> DataFrame | None:
    """Rows of [start, end] from all caches of the prefixes, one per (code, date); None where there is no cache.

    Later prefixes win, then later caches.  ``columns`` beside the keys are read where a cache
    has them and null where none has; ``codes`` and ``months`` (a column ``month``) filter by
    semi-joins below the union, so that every cache is pruned by them.
    """
    names, parts = listed(spark, root), []
    for prefix in prefixes:
        for name in overlapping(names, prefix, start, end):
            df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
            if "month" in df.columns:
                df = df.where(F.col("month").between(start.year * 100 + start.month, end.year * 100 + end.month))
                df = df.join(months.select("month").distinct(), "month", "left_semi") if months is not None else df
            df = df.where(F.col(column).between(F.lit(start), F.lit(end)))
            if codes is not None:
                df = df.join(codes.select(code).distinct(), code, "left_semi")
            wanted = [c for c in df.columns if c != "month" and (columns is None or c in (code, column, *columns) or ALIASES.get(c) in columns)]
            parts.append(clean(df.select(*wanted)))
    if not parts:
        return None
    out = latest(parts, [code, column])
    return out.select(code, column, *[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in columns]) if columns is not None else out
