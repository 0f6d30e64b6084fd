"""One regression by date under many weightings.

Rows are read once.  Fit weights of all strategies are windows by date; then every row counts
into sums of products by (date, strategy, group), plain aggregates that merge.  The design's
standardised styles and group dummies are linear in what is summed, so its cross-products
under every evaluation weight follow from those sums, and only matrices of its width reach a
solver.  Everything after the first exchange by date stays where it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (name, rule, risk column's window): how a row's fit weight follows from its size and lagged specific risk.
STRATEGIES = (
    ("sqrt_mv", "size", None),
    ("equal", "equal", None),
    ("inv_specific_60", "inverse_variance", 60),
    ("inv_specific_120", "inverse_variance", 120),
    ("inv_specific_252", "inverse_variance", 252),
    ("inv_specific_vol_252", "inverse", 252),
    ("sqrt_mv_div_specific_vol_252", "size_by_risk", 252),
    ("sqrt_mv_x_low_specific_rank_60", "size_by_rank", 60),
    ("sqrt_mv_x_low_specific_rank_120", "size_by_rank", 120),
    ("sqrt_mv_x_low_specific_rank_252", "size_by_rank", 252),
)
EVALUATIONS = ("own", "sqrt_mv", "equal")
RESULT = "date date, strategy string, evaluation string, status string, n_obs long, n_columns long, n_groups long, n_styles long, r2 double, adj_r2 double, condition double, resid_std double, effective_size double, effective_share double, max_share double, p99_p50 double, weight_cv double"


def size_weight(size: str) -> Column:
    """Root of the size, 1 where that is missing or not positive."""
    return F.when(F.col(size) > 0, F.sqrt(size)).otherwise(1.0)


def fit_weights(frame: DataFrame, size: str, risks: dict[int, str], strategies: Sequence[tuple] = STRATEGIES, base: str = "true", date: str = "date") -> DataFrame:
    """frame with a column w_{name} for each strategy, null where the row takes no part.

    Weights by risk need a positive one; inverse ones are clipped at the date's 1 % and 99 %
    quantiles if it has 20 or more.  Rows that ``base`` excludes have no weights and count nowhere.
    """
    kept = frame.columns
    sigma = lambda w: f"_sigma_{w}"
    f = frame.withColumns({sigma(w): F.expr(f"case when {base} and `{c}` > 0 and `{c}` < double('infinity') then `{c}` end") for w, c in risks.items()} | {"_mv": F.when(F.expr(base), size_weight(size))})
    part = f"partition by `{date}`"
    f = f.withColumns({f"_rank_{w}": F.expr(f"case when {sigma(w)} is not null then (rank() over ({part} order by -{sigma(w)} asc nulls last) + (count(1) over ({part}, {sigma(w)}) - 1) / 2D) / count({sigma(w)}) over ({part}) end") for w in risks})
    raw = {}
    for name, rule, w in strategies:
        s = F.col(sigma(w)) if w else None
        raw[name] = {"size": lambda s: F.col("_mv"), "equal": lambda s: F.when(F.expr(base), 1.0), "inverse_variance": lambda s: 1.0 / (s * s), "inverse": lambda s: 1.0 / s, "size_by_risk": lambda s: F.col("_mv") / s, "size_by_rank": lambda s: F.col("_mv") * (0.75 + 0.5 * F.col(sigma(w).replace("sigma", "rank")))}[rule](s)
    clipped = [name for name, rule, _ in strategies if rule in ("inverse_variance", "inverse", "size_by_risk")]
    f = f.withColumns({f"_raw_{k}": v for k, v in raw.items()})
    f = f.withColumns({f"_q_{k}": F.expr(f"case when count(_raw_{k}) over ({part}) >= 20 then percentile(_raw_{k}, array(0.01D, 0.99D)) over ({part}) end") for k in clipped})
    cut = lambda k: F.when(F.col(f"_q_{k}").isNotNull(), F.greatest(F.col(f"_q_{k}")[0], F.least(F.col(f"_q_{k}")[1], F.col(f"_raw_{k}")))).otherwise(F.col(f"_raw_{k}"))
    return f.select(*kept, *[(F.when(F.col(f"_raw_{k}").isNotNull(), cut(k)) if k in clipped else F.col(f"_raw_{k}")).alias(f"w_{k}") for k in raw])


def _basis(styles: int) -> list[str]:
    return ["one", "y", *(f"x{k}" for k in range(styles)), *(f"d{k}" for k in range(styles))]


def _products(styles: int) -> dict[tuple[str, str], str]:
    """Which sum each product of two basis values is: x d is x, as d says whether there is an x, and one times x is x."""
    out = {}
    for a, b in combinations_with_replacement(_basis(styles), 2):
        if a == "one" or (a[0], a[1:]) == ("x", b[1:]) and b[0] == "d" or a == b and a[0] == "d":
            out[a, b] = b if a == "one" else a
        else:
            out[a, b] = f"{a} * {b}"
    return out


def weighted_regressions(panel: DataFrame, y: str, styles: Sequence[str], group: str, size: str, risks: dict[int, str], strategies: Sequence[tuple] = STRATEGIES, evaluations: Sequence[str] = EVALUATIONS, least: int = 30, code: str = "code", date: str = "date") -> DataFrame:
    """Rows (date, strategy, evaluation, status, counts, fit and weight figures).

    y on a constant, styles (standardised over the strategy's rows, dropped where fewer than
    half of them have a value, a missing value counts as zero) and dummies of groups, fitted
    with each strategy's weights and judged with each evaluation's.  A date that can't be
    fitted gives one row with what failed and the number of rows.
    """
    k, names = len(styles), [s[0] for s in strategies]
    base = f"`{y}` is not null and `{code}` is not null and `{group}` is not null"
    rows = panel.select(F.col(date).alias("date"), F.col(code), F.col(y), F.col(group), F.col(size), *[c for c in risks.values()], *styles)
    rows = fit_weights(rows, size, risks, strategies, base, "date")
    part = Window.partitionBy("date")
    rows = rows.withColumns({f"_mid_{c}": F.avg(c).over(part) for c in styles} | {f"_top_{n}": F.max(f"w_{n}").over(part) for n in names} | {f"_pct_{n}": F.expr(f"percentile(w_{n}, array(0.5D, 0.99D)) over (partition by date)") for n in names})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"w_{n}").cast("double").alias("w"), F.col(f"_top_{n}").cast("double").alias("top"), F.col(f"_pct_{n}")[0].alias("p50"), F.col(f"_pct_{n}")[1].alias("p99")) for n in names]))
    long = rows.select("date", F.col(group).cast("string").alias("grp"), F.expr(base).alias("base"), size_weight(size).alias("mv"), F.col(y).cast("double").alias("y"), *[F.coalesce(F.col(c) - F.col(f"_mid_{c}"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(styles)], *[F.col(c).isNotNull().cast("double").alias(f"d{i}") for i, c in enumerate(styles)], each.alias("s"))
    long = long.select("*", "s.*", F.lit(1.0).alias("one")).drop("s")
    products, weight = _products(k), {"own": "w", "sqrt_mv": "mv", "equal": "1D"}
    sums = [F.sum(F.expr(f"case when w > 0 then {weight[e]} * ({t}) else 0D end")).alias(f"{e}_{i}") for e in dict.fromkeys([*evaluations, "own", "equal"]) for i, t in enumerate(dict.fromkeys(products.values()))]
    by = long.groupBy("date", "strategy", "grp").agg(F.count(F.expr("case when base then 1 end")).alias("n_base"), F.count(F.expr("case when w > 0 then 1 end")).alias("n"), F.sum(F.expr("case when w > 0 then w * w end")).alias("ww"), F.max("top").alias("top"), F.max("p50").alias("p50"), F.max("p99").alias("p99"), *sums)
    where = {t: i for i, t in enumerate(dict.fromkeys(products.values()))}

    def matrices(one: dict[str, np.ndarray], e: str) -> tuple[np.ndarray, np.ndarray]:
        """Products of basis values summed over all rows, and their sums by group."""
        u = _basis(k)
        total = np.zeros((len(u), len(u)))
        for (a, b), t in products.items():
            i, j = u.index(a), u.index(b)
            total[i, j] = total[j, i] = one[f"{e}_{where[t]}"].sum()
        return total, np.stack([one[f"{e}_{where[products['one', b]]}"] for b in u], axis=1)

    def solve(n_base: int, one: dict[str, np.ndarray]) -> list[dict]:
        """Result rows of one date and strategy; one: the columns of its groups that have rows."""
        n, groups = int(one["n"].sum()), len(one["n"])
        plain = {"evaluation": "own", "n_obs": n}
        if not n_base:
            return [plain | {"status": "failed_empty"}]
        if not n:
            return [plain | {"status": "failed_no_fit_weight"}]
        u, _ = matrices(one, "equal")
        used = [i for i in range(k) if u[0, 2 + k + i] / n >= 0.5]
        p = len(used) + groups
        if n < max(least, p + 5) or groups < 2:
            return [plain | {"status": "failed_insufficient_sample"}]
        t = np.zeros((1 + len(used), 2 + 2 * k))  # the constant and standardised styles in terms of the basis
        t[0, 0] = 1
        for row, i in enumerate(used, 1):
            there, total = u[0, 2 + k + i], u[0, 2 + i]
            sd = np.sqrt(max(0.0, u[2 + i, 2 + i] - total**2 / there) / (there - 1)) if there > 1 else 0.0
            if sd > 1e-12:  # one without spread is zero
                t[row, 2 + i], t[row, 2 + k + i] = 1.0 / sd, -total / there / sd

        def design(e: str) -> tuple[np.ndarray, np.ndarray, float, float, float]:
            total, by_group = matrices(one, e)
            s = by_group[1:]  # the first group is the reference
            g = np.block([[t @ total @ t.T, t @ s.T], [s @ t.T, np.diag(s[:, 0])]])
            return g, np.concatenate([t @ total[:, 1], s[:, 1]]), total[1, 1], total[0, 1], total[0, 0]

        g, b, _, _, total_w = design("own")
        try:
            values = np.linalg.eigvalsh(g)
            beta = np.linalg.lstsq(g / total_w, b / total_w, rcond=1e-13)[0]
        except np.linalg.LinAlgError:
            return [plain | {"status": "failed_linalg"}]
        ww, p50, p99 = float(one["ww"].sum()), one["p50"].max(), one["p99"].max()
        ess = total_w**2 / ww
        figures = {"condition": float(np.sqrt(values[-1] / values[0])) if values[0] > 0 else np.inf, "effective_size": ess, "effective_share": ess / n, "max_share": one["top"].max() / total_w, "p99_p50": p99 / p50 if p50 > 0 else None, "weight_cv": np.sqrt(max(0.0, ww / n - (total_w / n) ** 2)) / (total_w / n)}
        out = []
        for e in evaluations:
            g, b, yy, sy, sw = design(e)
            rest, all_ = max(0.0, yy - 2 * beta @ b + beta @ g @ beta), yy - sy**2 / sw
            r2 = 1 - rest / all_ if all_ > 1e-20 else None
            out.append(plain | {"evaluation": e, "status": "ok", "n_columns": p, "n_groups": groups, "n_styles": len(used), "r2": r2, "adj_r2": None if r2 is None else 1 - (1 - r2) * (n - 1) / max(n - p, 1), "resid_std": np.sqrt(rest / sw)} | figures)
        return out

    def run(table: pa.Table) -> pa.Table:
        """All strategies of one date."""
        cols = {c: table.column(c).to_numpy() for c in table.column_names if c != "date"}
        order = np.lexsort([cols["grp"].astype(str), cols["strategy"].astype(str)])
        cols = {c: v[order] for c, v in cols.items()}
        out = []
        for name in names:
            mine = cols["strategy"] == name
            some = mine & (cols["n"] > 0)
            got = solve(int(cols["n_base"][mine].sum()), {c: v[some] for c, v in cols.items()})
            out += [{"date": table.column("date")[0].as_py(), "strategy": name} | r for r in got]
        kinds = {"date": pa.date32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        return pa.Table.from_pylist(out, pa.schema([(c, kinds[t]) for c, t in (x.split() for x in RESULT.split(", "))]))

    return by.groupBy("date").applyInArrow(run, RESULT)


#: Means over fitted dates, by output name.
MEANS = {"mean_obs": "n_obs", "mean_columns": "n_columns", "mean_groups": "n_groups", "mean_r2": "r2", "mean_adj_r2": "adj_r2", "mean_condition": "condition", "mean_resid_std": "resid_std", "mean_effective_size": "effective_size", "mean_effective_share": "effective_share", "mean_max_share": "max_share", "mean_p99_p50": "p99_p50"}


def summarise(daily: DataFrame, by: Sequence[str] = ("strategy", "evaluation"), year: bool = False, comparable: int | None = None) -> DataFrame:
    """Figures over fitted dates by strategy and evaluation (and year); ``comparable``: only dates that so many strategies fitted under an evaluation."""
    ok = daily.where("status = 'ok'")
    if comparable:
        common = ok.groupBy("evaluation", "date").agg(F.countDistinct("strategy").alias("_n")).where(F.col("_n") == comparable).drop("_n")
        ok = ok.join(common, ["evaluation", "date"], "left_semi")
    keys = [*by, *(["year"] if year else [])]
    ok = ok.withColumn("year", F.year("date")) if year else ok
    return ok.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("r2").alias("dates"), F.expr("percentile(r2, 0.5D)").alias("median_r2"), F.avg(F.when(F.col("r2") >= 0.5, 1.0).otherwise(0.0)).alias("share_r2_half"), *[F.avg(F.col(c).cast("double")).alias(k) for k, c in MEANS.items()])
