"""Sources and sinks: typed reads, merged range caches, audits, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every double and float column."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read(spark: SparkSession, path: str | Sequence[str], kind: str = "parquet", schema: str | None = None, columns: Sequence[str] | None = None, codes: DataFrame | None = None, code: str = "code") -> DataFrame:
    """A typed, pruned read: parquet, orc, json or csv (with header).  Missing columns come as null doubles, ``codes`` filters by a semi-join."""
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        r = r.option("header", True)
    df = r.format(kind).load([path] if isinstance(path, str) else list(path))
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
    if codes is not None:
        df = df.join(codes.select(code).distinct(), code, "left_semi")
    return clean(df)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def annual_ranges(start: date, end: date) -> list[tuple[date, date]]:
    """The range cut at the turns of years."""
    out, at = [], start
    while at <= end:
        stop = min(end, date(at.year, 12, 31))
        out.append((at, stop))
        at = stop + timedelta(days=1)
    return out


def merge_ranges(parts: Sequence[tuple[date, date, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Union of range caches, later ones winning per key; fails if the ranges leave a gap."""
    ordered = sorted(parts, key=lambda p: (p[0], p[1]))
    for (_, end, _), (start, _, _) in zip(ordered, ordered[1:]):
        if start > end + timedelta(days=1):
            raise ValueError(f"no cache from {end + timedelta(days=1)} to {start - timedelta(days=1)}")
    all_ = None
    for k, (_, _, df) in enumerate(parts):
        df = df.withColumn("_seq", F.lit(k))
        all_ = df if all_ is None else all_.unionByName(df, allowMissingColumns=True)
    if all_ is None:
        raise ValueError("no caches")
    w = Window.partitionBy(*keys).orderBy(F.col("_seq").desc())
    return all_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_seq")


def covering(names: Sequence[str], start: str, end: str) -> str:
    """Of names that end in _yyyymmdd_yyyymmdd the one that covers the range, the newest end and then the longest first."""
    found = []
    for n in names:
        *_, a, b = n.removesuffix(".parquet").split("_")
        if a <= start and b >= end:
            found.append((b, -int(a), n))
    if not found:
        raise FileNotFoundError(f"no cache covers {start} to {end}")
    return max(found)[2]


def no_future_rows(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """df; fails if a row is later than ``as_of``."""
    if df.where(F.col(column) > F.lit(as_of).cast("date")).limit(1).count():
        raise ValueError(f"{column} has rows after {as_of}")
    return df


def weekdays(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start to end, both included."""
    return F.size(F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5))


def audit(df: DataFrame, dataset: str, keys: Sequence[str], column: str = "date", as_of: str | None = None) -> DataFrame:
    """One row: rows, first and last date, duplicate keys, future rows, share of weekdays seen."""
    future = F.sum((F.col(column) > F.lit(as_of).cast("date")).cast("long")) if as_of else F.lit(0).cast("long")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("first"), F.max(column).alias("last"), F.countDistinct(F.when(F.weekday(column) < 5, F.col(column))).alias("_seen"), F.coalesce(future, F.lit(0)).alias("future"))
    both = a.join(F.broadcast(n))  # one row each
    return both.select(F.lit(dataset).alias("dataset"), "rows", "first", "last", "duplicates", "future", F.when(F.col("first").isNotNull(), F.col("_seen") / weekdays(F.col("first"), F.col("last"))).alias("coverage"))


def coverage_by_year(df: DataFrame, fields: Sequence[str], column: str = "date") -> DataFrame:
    """(year, field, rows, present, share) of each field."""
    cols = [F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f) for f in fields]]
    wide = df.groupBy(F.year(column).alias("year")).agg(*cols)
    return wide.unpivot(["year", "rows"], list(fields), "field", "present").withColumn("share", F.col("present") / F.col("rows"))


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), parameters: dict | None = None) -> dict:
    """Overwrites ``path`` under Spark's commit protocol and returns a manifest with a hash of the parameters."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    text = json.dumps(parameters or {}, sort_keys=True, default=str)
    return {"path": path, "columns": df.dtypes, "parameters": parameters or {}, "hash": hashlib.sha256(text.encode()).hexdigest()}
