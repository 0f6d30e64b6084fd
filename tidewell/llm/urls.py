"""URL filters by the ratio of two character language models, in DataFrame functions only.

Rules of host and path decide what they fit.  The URLs they decide teach two variable-order
Markov models of characters, one of accepted and one of rejected URLs: a character's chance
after a context blends the counts after that context with the chance after the context less
its first character (Witten-Bell: the weight of the shorter one is the share of first
occurrences), down to a uniform chance, so the order that counts varies with what has been
seen.  A URL's score is the mean over its characters of the log ratio of both models.

URLs of a quarter of the hosts teach nothing; the threshold is calibrated on those that rules
decide, so that the shares of accepted URLs below it and of rejected ones above add up to
the least.

Characters are folded to SYMBOLS, so a model of order three has at most 43^4 entries of some
24 bytes: what is broadcast is bounded by the alphabet, not by the data (82 MB at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

#: (host, path, verdict): the rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "./-_:?=&%#~+@,"
SYMBOLS = len(LOWER) + len(MARKS) + 3  # digits are one symbol, all else another, and the end; the start is never predicted
ORDER = 3
MICRO = 1_000_000  # log ratios are kept as whole millionths, so that sums don't depend on their order
GRID, PLACES = 5_000, 2_000  # thresholds: multiples of 0.005 up to 10 on either side


def parsed(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the scheme) of a URL; null or without ``://``: host and path empty."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text)
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))
    path = F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path, rest


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one that wraps the others is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _folded(text: Column, order: int) -> Column:
    """The letters that the models see, after ``order`` starts and before an end."""
    text = F.translate(text, UPPER + "123456789", LOWER + "0" * 9)
    text = F.regexp_replace(text, "[^a-z0./\\-_:?=&%#~+@,]", "*")
    return F.concat(F.lit("^" * order), text, F.lit("$"))


def _grams(letters: str, order: int) -> Column:
    """Each letter with the ``order`` letters before it; the look-ahead finds overlapping matches in one pass."""
    return F.regexp_extract_all(letters, F.lit(f"(?=(.{{{order + 1}}}))"), F.lit(1))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log of accepted over rejected chance of a gram's last letter after the others, in millionths.

    counts: (gram, a, r), occurrences of each gram in accepted and in rejected URLs; a gram
    with none in either gets the chances of its shorter contexts.
    """
    below = None
    for k in range(order + 1):
        pair = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("w")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("h", F.expr(f"left(w, {k})"))
        head = pair.groupBy("h").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum(F.expr("if(a > 0, 1L, 0L)")).alias("ta"), F.sum(F.expr("if(r > 0, 1L, 0L)")).alias("tr"))
        rows = pair.join(head, "h")
        if below is None:
            rows = rows.withColumns({"la": F.lit(1.0) / SYMBOLS, "lr": F.lit(1.0) / SYMBOLS})
        else:
            rows = rows.join(below, F.expr(f"right(w, {k})") == F.col("lower"))
        chance = lambda c: F.expr(f"if(n{c} > 0, ({c} + t{c} * l{c}) / (n{c} + t{c}), l{c})")
        rows = rows.select("w", chance("a").alias("la"), chance("r").alias("lr"))
        below = rows.withColumnRenamed("w", "lower")
    return rows.select(F.col("w").alias("gram"), F.round(F.ln(F.col("la") / F.col("lr")) * MICRO).cast("long").alias("ratio"))


def threshold(seen: dict[int, tuple[int, int]]) -> int:
    """The grid place from which URLs pass; seen: accepted and rejected URLs at each place.

    Of equally good places the one nearest to zero, then the smaller; zero if either is absent.
    """
    accepted, rejected = (sum(x[k] for x in seen.values()) for k in (0, 1))
    if not accepted or not rejected:
        return 0
    best, below_a, below_r = None, 0, 0
    for t in range(-PLACES, PLACES + 2):
        a, r = seen.get(t - 1, (0, 0))
        below_a, below_r = below_a + a, below_r + r
        cost = (below_a / accepted + (rejected - below_r) / rejected, abs(t), t)
        best = cost if best is None or cost < best else best
    return best[2]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """One row per row of pages: (id_col, host, path, rule, verdict, score).

    verdict: that of the longest rule that fits the host (or one that it is a subdomain of)
    and begins the path; without one (rule is null) the models', and score is their mean log
    ratio a character, positive for URLs like accepted ones.  A null or empty URL has an empty
    host and path, and the models judge its end alone.  URLs of any length are read whole.
    Null and repeated ids and equal rows are kept, one result each.  Without URLs that rules
    accept, or that they reject, the threshold is zero; a score at the threshold passes.  An
    empty table gives an empty one.  Other columns aren't read, so their names don't matter.
    """
    host, path, rest = parsed(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), _folded(rest, order).alias("letters"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict}).withColumn("held", F.substring(F.md5(F.col("host")), 1, 1).isin("0", "1", "2", "3"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()))
    teaches = lambda v: F.expr(f"if(verdict = '{v}' and not held, 1L, 0L)")
    counts = rows.select(F.explode(_grams("letters", order)).alias("gram"), teaches("allow").alias("a"), teaches("block").alias("r")).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    model = materialise(log_ratios(materialise(counts), order))
    judged = rows.where("verdict is null or held").select("uid", F.explode(_grams("letters", order)).alias("gram"))
    total = judged.join(F.broadcast(model), "gram").groupBy("uid").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
    place = F.greatest(F.lit(-PLACES), F.least(F.lit(PLACES), F.floor(F.col("total").cast("double") / (F.col("n") * GRID)))).cast("int")
    rows = materialise(rows.drop("letters").join(total, "uid", "left").withColumn("place", place))
    seen = rows.where("held and verdict is not null").groupBy("place").agg(F.count(F.expr("if(verdict = 'allow', 1, null)")).alias("a"), F.count(F.expr("if(verdict = 'block', 1, null)")).alias("r"))
    least = threshold({x["place"]: (x["a"], x["r"]) for x in seen.collect()})  # at most 4,001 places
    by_model = F.when(F.col("place") >= least, F.lit("allow")).otherwise(F.lit("block"))
    score = F.when(F.col("rule").isNull(), F.col("total").cast("double") / F.col("n") / MICRO)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), score.alias("score"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _level(k: int) -> str:
    low = f"1e0 / {SYMBOLS}"
    la, lr, join = (low, low, "") if k == 0 else ("b.pa", "b.pr", f"join p{k - 1} b on right(x.w, {k}) = b.w")
    return f"""x{k} as (select right(gram, {k + 1}) as w, left(right(gram, {k + 1}), {k}) as h, sum(a)::bigint as a, sum(r)::bigint as r from counts group by 1, 2),
h{k} as (select h, sum(a)::bigint as na, sum(r)::bigint as nr, count(*) filter (a > 0) as ta, count(*) filter (r > 0) as tr from x{k} group by h),
p{k} as (select x.w, case when na > 0 then (a + ta * {la}) / (na + ta) else {la} end as pa, case when nr > 0 then (r + tr * {lr}) / (nr + tr) else {lr} end as pr from x{k} x join h{k} using (h) {join})"""


_SQL = f"""
with cut as (
  select row_number() over () as uid, page_id, instr(coalesce(url, ''), '://') as mark,
    case when instr(coalesce(url, ''), '://') > 0 then substring(url, instr(url, '://') + 3) else coalesce(url, '') end as rest from pages
), named as (
  select *, case when mark > 0 then translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') else '' end as host,
    case when mark > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path,
    '{"^" * ORDER}' || regexp_replace(translate(rest, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./\\-_:?=&%#~+@,]', '*', 'g') || '$' as letters from cut
), ruled as (
  select *, case when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule, left(md5(host), 1) in ('0', '1', '2', '3') as held from named
), decided as (select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as decision from ruled),
grams as (select uid, held, decision, unnest([substring(letters, i, {ORDER + 1}) for i in range(1, length(letters) - {ORDER} + 1)]) as gram from decided),
counts as (select gram, count(*) filter (decision = 'allow' and not held) as a, count(*) filter (decision = 'block' and not held) as r from grams group by gram),
{", ".join(_level(k) for k in range(ORDER + 1))},
model as (select w as gram, round(ln(pa / pr) * {MICRO})::bigint as ratio from p{ORDER}),
totals as (select uid, sum(ratio)::bigint as total, count(*) as n from grams join model using (gram) group by uid),
placed as (select d.*, total, n, greatest(-{PLACES}, least({PLACES}, floor(total::double / (n * {GRID}))))::int as place from decided d join totals using (uid)),
seen as (select place, count(*) filter (decision = 'allow') as a, count(*) filter (decision = 'block') as r from placed where held and decision is not null group by place),
sums as (select coalesce(sum(a), 0) as ta, coalesce(sum(r), 0) as tr from seen),
costs as (select t, (select coalesce(sum(a), 0) from seen where place < t) / ta::double + (tr - (select coalesce(sum(r), 0) from seen where place < t)) / tr::double as cost from range(-{PLACES}, {PLACES + 2}) g(t), sums where ta > 0 and tr > 0),
best as (select coalesce((select t from costs order by cost, abs(t), t limit 1), 0) as least)
select page_id, host, path, rule, coalesce(decision, case when place >= least then 'allow' else 'block' end) as verdict,
  case when rule is null then total::double / n / {MICRO} end as score from placed, best
"""

QUERIES = {"op13_urls": op13_urls}
ORACLES = {"op13_urls": _SQL}
