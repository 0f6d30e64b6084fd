"""Point-in-time joins: as-of by key, as-of by snapshot, validity intervals, trading calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.monitor import worse_grade


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before its date (before it, if strict).

    One shuffle by key: both sides are stacked and the right payload is carried forward, so
    nothing is multiplied.  A matched row stays matched when its payload is null; of right
    rows with one date the largest payload wins.  Left rows without a match keep nulls.
    """
    payload = [c for c in right.columns if c != by]
    clash = {c: f"{c}_right" if c in left.columns else c for c in payload}
    lcols = left.columns
    l = left.select(F.col(by).alias("_by"), F.col(left_on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*lcols).alias("_l"), F.lit(None).cast(right.select(F.struct(*payload).alias("s")).schema["s"].dataType).alias("_r"))
    r = right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(F.col(by).alias("_by"), F.col(right_on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*payload).alias("_r"))
    w = Window.partitionBy("_by").orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return out.select(*[F.col("_l")[c].alias(c) for c in lcols], *[F.col("_m")[c].alias(clash[c]) for c in payload])


def snapshot_join(keys: DataFrame, snapshots: DataFrame, code: str, date: str, value: str) -> DataFrame:
    """Values of the latest snapshot as a whole: a code that it no longer holds gets 0, and null before the first."""
    days = asof_join(keys.select(date).distinct().withColumn("_k", F.lit(1)), snapshots.select(F.lit(1).alias("_k"), F.col(date).alias("snapshot")).distinct(), "_k", date, "snapshot").select(date, "snapshot")
    rows = snapshots.select(F.col(date).alias("snapshot"), F.col(code), F.col(value).alias("_v"))
    out = keys.join(days, date, "left").join(rows, ["snapshot", code], "left")
    return out.select(*keys.columns, "snapshot", F.when(F.col("snapshot").isNotNull(), F.coalesce("_v", F.lit(0.0))).alias(value))


def interval_join(left: DataFrame, right: DataFrame, by: str, on: str, start: str, end: str, closed: bool = False, how: str = "left") -> DataFrame:
    """Rows with what is valid at their date: [start, end), or [start, end] if closed; a null start or end is open.

    A sweep: interval starts and rows of a key are put in one order and the interval that
    began last is carried forward, so work grows with rows plus intervals.  That needs
    intervals of a key that don't overlap: a row of a key where two do is refused.  Intervals
    that hold no date are left out; a null key or date has none.
    """
    payload = [c for c in right.columns if c != by]
    kept = left.columns
    some = F.col(start).isNull() | F.col(end).isNull() | ((F.col(start) <= F.col(end)) if closed else (F.col(start) < F.col(end)))
    r = right.where(F.col(by).isNotNull() & some).select(F.col(by).alias("_by"), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*payload).alias("_r"))
    kind = r.schema["_r"].dataType
    l = left.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_r"), F.struct(*kept).alias("_l"))
    order = Window.partitionBy("_by").orderBy(F.col("_at").asc_nulls_first(), "_side")
    out = r.unionByName(l, allowMissingColumns=True).withColumns({"_m": F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_before": F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    past = F.col("_before")[end]
    clash = F.col("_r").isNotNull() & F.col("_before").isNotNull() & (past.isNull() | F.col("_at").isNull() | ((past >= F.col("_at")) if closed else (past > F.col("_at"))))
    out = out.withColumn("_clash", F.max(clash).over(Window.partitionBy("_by").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.col("_m").isNotNull() & F.col("_by").isNotNull() & F.col("_at").isNotNull() & (F.col("_m")[end].isNull() | ((F.col("_at") <= F.col("_m")[end]) if closed else (F.col("_at") < F.col("_m")[end])))
    valid = F.when(F.col("_clash"), F.raise_error(F.concat(F.lit(f"intervals of {by} "), F.col("_by").cast("string"), F.lit(" overlap"))).cast(kind)).when(inside, F.col("_m"))
    out = out.where("_l is not null").select("_l", valid.alias("_m"))
    out = out.where("_m is not null") if how == "inner" else out
    return out.select(*[F.col("_l")[c].alias(c) for c in kept], *[F.col("_m")[c].alias(c) for c in payload])


def attach_groups(panel: DataFrame, members: DataFrame, source: str, code: str = "code", date: str = "date", group: str = "grp", start: str = "in_date", end: str = "out_date", coverage: float | None = None) -> DataFrame:
    """panel with the group that a code is in at its date ([in, out), half open), its interval, and ``source`` where it has one.

    ``coverage``: fewer than that share of rows with a group are refused (this one runs a job).
    """
    out = interval_join(panel, members.select(code, group, start, end), code, date, start, end)
    out = out.withColumn(f"{group}_source", F.when(F.col(group).isNotNull(), source))
    if coverage is not None:
        have, rows = out.agg(F.count(group), F.count(F.lit(1))).first()
        if rows and have / rows < coverage:
            raise ValueError(f"only {have} of {rows} rows have a group; {coverage:.0%} are needed")
    return out


def apply_classes(daily: DataFrame, classes: DataFrame, code: str = "code", date: str = "date", start: str = "since", end: str = "until", unreviewed: bool = False) -> DataFrame:
    """daily rows with the class valid at their date ([since, until], closed): reviewed ones of low or some risk, or all.

    A row whose code has no class at all, or none at its date, has none; it stays only with
    ``unreviewed``, as unclassified, where its code has no class at all.
    """
    known = classes.select(code).distinct().withColumn("_known", F.lit(True))
    out = interval_join(daily, classes, code, date, start, end, closed=True).join(known, code, "left")
    out = out.withColumn("_in", F.col("risk_bucket").isNotNull() | F.col(start).isNotNull() | F.col(end).isNotNull() | F.col("reviewed").isNotNull() | F.col("_known").isNull())
    out = out.where("_in").withColumns({"risk_bucket": F.coalesce("risk_bucket", F.lit("unclassified")), "reviewed": F.coalesce("reviewed", F.lit(False))}).drop("_in", "_known")
    return out if unreviewed else out.where(F.col("reviewed") & F.col("risk_bucket").isin("low_risk", "risk"))


LEVELS = 16  # days from FIRST_DAY on that are told apart: 2^16, 179 years
FIRST_DAY = "1900-01-01"


def known_sums(queries: DataFrame, events: DataFrame, by: str, known: str, at: str, value: str, when: str, after: str, until: str, name: str) -> DataFrame:
    """queries with name: the sum of values over events of ``by`` that were known at ``when`` and happen in (after, until].

    A two-dimensional sum without a range join: days up to ``when`` are at most LEVELS blocks
    of a power of two, every event is in one block of each size, and within a block a running
    sum in the order of ``at`` answers both ends.  Events and queries are stacked, so work is
    LEVELS times rows plus events.  Nothing known: zero; a null in a query: null.
    """
    day = lambda c: F.greatest(F.lit(0), F.least(F.lit((1 << LEVELS) - 1), F.datediff(c, F.lit(FIRST_DAY).cast("date"))))
    e = events.where(F.col(by).isNotNull() & F.col(known).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    e = e.select(F.col(by).alias("_by"), day(known).alias("_t"), F.col(at).alias("_x"), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level"))
    e = e.select("_by", "_level", F.expr("shiftright(_t, _level)").alias("_block"), "_x", F.lit(0).alias("_side"), "_v")
    asked = queries.select(F.col(by).alias("_by"), F.col(when).alias("_when"), F.col(after).alias("_after"), F.col(until).alias("_until")).where("_by is not null and _when is not null and _after is not null and _until is not null").distinct()
    q = asked.withColumn("_t", day("_when") + 1).withColumn("_level", F.explode(F.expr(f"filter(sequence(0, {LEVELS}), l -> getbit(_t, l) = 1)")))
    q = q.withColumn("_end", F.explode(F.array(F.struct(F.col("_until").alias("x"), F.lit(1.0).alias("sign")), F.struct(F.col("_after").alias("x"), F.lit(-1.0).alias("sign")))))
    q = q.select("_by", "_when", "_after", "_until", "_level", (F.expr("shiftright(_t, _level)") - 1).alias("_block"), F.col("_end.x").alias("_x"), F.col("_end.sign").alias("_sign"), F.lit(1).alias("_side"))
    upto = Window.partitionBy("_by", "_level", "_block").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(q, allowMissingColumns=True).withColumn("_sum", F.sum("_v").over(upto)).where("_side = 1")
    total = both.groupBy("_by", "_when", "_after", "_until").agg(F.sum(F.col("_sign") * F.coalesce("_sum", F.lit(0.0))).alias(name))
    total = asked.join(total, ["_by", "_when", "_after", "_until"], "left").na.fill(0.0, [name])
    on = (F.col(by) == F.col("_by")) & (F.col(when) == F.col("_when")) & (F.col(after) == F.col("_after")) & (F.col(until) == F.col("_until"))
    return queries.join(total, on, "left").select(*queries.columns, F.when(F.col(until) > F.col(after), F.col(name)).when(F.col(name).isNotNull(), 0.0).alias(name))


def calendar_lag(frame: DataFrame, date: str, days: int, name: str = "asof") -> DataFrame:
    """(date, name): each trading date and the one ``days`` places before it (after it, if negative)."""
    dates = frame.select(date).where(F.col(date).isNotNull()).distinct()
    w = Window.orderBy(date)  # one row per date: a small dimension
    return dates.select(date, (F.lag(date, days) if days >= 0 else F.lead(date, -days)).over(w).alias(name))


def latest_on_or_before(frame: DataFrame, date: str, target: str) -> DataFrame:
    """The rows of the latest date at or before ``target``."""
    last = frame.where(F.col(date) <= F.lit(target).cast("date")).agg(F.max(date).alias("_d"))
    return frame.join(F.broadcast(last), F.col(date) == F.col("_d"), "left_semi")  # one row


def gap_aware_returns(panel: DataFrame, code: str, date: str, price: str) -> DataFrame:
    """Adds returns_1d and fwd_1d_return, null where the neighbouring row isn't the neighbouring market date."""
    days = panel.select(date).distinct().select(date, F.row_number().over(Window.orderBy(date)).alias("_n"))
    w = Window.partitionBy(code).orderBy(date)
    x = panel.join(days, date).withColumn("_p", F.lag("_n").over(w)).withColumn("_f", F.lead("_n").over(w))
    div = lambda a, b: F.when(F.abs(b) > 1e-12, a / b - 1)
    x = x.withColumn("returns_1d", F.when(F.col("_n") - F.col("_p") == 1, div(F.col(price), F.lag(price).over(w))))
    return x.withColumn("fwd_1d_return", F.when(F.col("_f") - F.col("_n") == 1, div(F.lead(price).over(w), F.col(price)))).drop("_n", "_p", "_f")


def keep_last(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in ``order``; of ties the one with the largest other columns, from left to right."""
    others = [c for c in frame.columns if c not in (*keys, order)]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(f"`{c}`").desc_nulls_last() for c in others])
    return frame.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pair_legs(basis: DataFrame, max_gap: int = 7) -> DataFrame:
    """All ordered pairs of products on one (date, tenor); the spread is null unless expiries are near and no leg has grade D.

    A leg without a known grade has grade D.

    Products are few, so the self-join on (date, tenor) stays linear in the dates.
    """
    cols = ["product", "expiry", "annualised", "quality"]
    a, b = (basis.select("date", "tenor", *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in ("long", "short"))
    out = a.join(b, ["date", "tenor"]).where("long_product <> short_product")
    gap = F.abs(F.datediff("long_expiry", "short_expiry"))
    worse = worse_grade(F.col("long_quality"), F.col("short_quality"))
    return out.select("date", "tenor", "long_product", "short_product", gap.alias("expiry_gap"), worse.alias("quality"), F.when((gap <= max_gap) & (worse != "D"), F.col("long_annualised") - F.col("short_annualised")).alias("spread"))


def quarterly_features(statements: DataFrame, fields: list[str], code: str = "code", period: str = "end_date") -> DataFrame:
    """Single-quarter, trailing four-row, year-on-year and quarter-on-quarter values of cumulative statements.

    The first quarter stands as it is, later ones lose the quarter before in the fiscal year.
    Trailing sums and lags count rows, not quarters.
    """
    year = Window.partitionBy(code, F.year(period)).orderBy(period)
    w = Window.partitionBy(code).orderBy(period)
    out = statements
    for f in fields:
        out = out.withColumn(f"{f}_q", F.when(F.quarter(period) == 1, F.col(f)).otherwise(F.col(f) - F.lag(f).over(year)))
    ratio = lambda a, b: F.when(F.abs(b) > 1e-12, a / b - 1)
    for f in fields:
        q = F.col(f"{f}_q")
        four = w.rowsBetween(-3, 0)
        out = out.withColumn(f"{f}_ttm", F.when(F.count(q).over(four) >= 4, F.sum(q).over(four)))
        out = out.withColumn(f"{f}_yoy", ratio(q, F.lag(q, 4).over(w))).withColumn(f"{f}_qoq", ratio(q, F.lag(q, 1).over(w)))
    return out


def event_windows(keys: DataFrame, events: DataFrame, code: str, date: str, event_date: str, value: str, org: str, days: int = 90) -> DataFrame:
    """For each key: events, their distinct orgs and mean value over the last ``days`` calendar days; an event is seen the day after it.

    Keys and events are stacked and a range frame over days does the counting.
    """
    k = keys.select(F.col(code).alias("_c"), F.col(date).alias("_d"), F.lit(True).alias("_key"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("string").alias("_o"))
    e = events.select(F.col(code).alias("_c"), F.date_add(event_date, 1).alias("_d"), F.lit(False).alias("_key"), F.col(value).cast("double").alias("_v"), F.col(org).cast("string").alias("_o"))
    w = Window.partitionBy("_c").orderBy(F.datediff("_d", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, 0)
    out = k.unionByName(e).select("_c", "_d", "_key", F.sum(F.when(~F.col("_key"), 1).otherwise(0)).over(w).alias("n_events"), F.size(F.collect_set("_o").over(w)).alias("n_orgs"), F.avg("_v").over(w).alias("mean_value"))
    return out.where("_key").select(F.col("_c").alias(code), F.col("_d").alias(date), "n_events", "n_orgs", "mean_value")


def month_turns(frame: DataFrame, date: str) -> DataFrame:
    """(date, effective): each last trading date of a month and the next trading date."""
    dates = frame.select(date).where(F.col(date).isNotNull()).distinct()
    out = dates.withColumn("effective", F.lead(date).over(Window.orderBy(date)))  # one row per date
    return out.where(F.date_trunc("month", date) != F.date_trunc("month", "effective"))
