import re

from tidewell.plans import catalog, phases
from tidewell.plans.expr import plan
from tidewell.plans.queries import QUERIES, base_panel
from tidewell.sources.panel import BASE_COLUMNS, FULL, full_panel

SF = "/root/testdata/sf0.001"


def moved(expressions):
    """Columns in each exchange of the full panel's rows."""
    graph = phases.Graph((*FULL, plan(expressions)), BASE_COLUMNS)
    at = graph.phases(["code", "date"])
    later = lambda k: {*graph.final.values()}.union(*[phases._columns(graph.nodes[c]) for c in graph.used if at[c] >= k])
    return [len({*BASE_COLUMNS, *[c for c in at if at[c] < k]} & later(k)) for k in range(1, max(at.values()) + 1)]


def exchanges(df):
    """Columns and keys of each exchange that moves rows by hash."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^,()]*?)#\d+L?, \d+\)", text)


def test_few_columns_move():
    public = list(catalog.PUBLIC.items())
    assert moved(catalog.combinations()) == moved(catalog.atoms()) and moved(catalog.atoms())[0] <= 25 and len(moved(catalog.atoms())) == 1
    assert moved(catalog.descriptors()) == [] and moved(catalog.descriptors_v2()) == []
    assert max(moved(catalog.statement())) <= 35 and len(moved(catalog.statement())) == 3
    for k, n in ((0, 30), (13, 25), (26, 15), (39, 15), (52, 12)):
        assert max(moved(dict(public[k : k + 13]))) <= n


def test_panel_moves_once_by_code(spark):
    assert exchanges(base_panel(spark, SF)).count("l_suppkey") == 1
    assert [k for k in exchanges(QUERIES["catalog_daily"](spark, SF)) if k != "s_suppkey"] == ["l_suppkey"]


def test_descriptors_move_no_rows_by_date(spark):
    text = QUERIES["catalog_descriptors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION" in x]
    assert rows and all("suppkey" in x for x in rows) and "BroadcastHashJoin" in text and "Window [" in text


def test_sums_of_a_date_joined_or_by_window(spark):
    """A code's windows over a date's mean need it joined; ranks beside it take it from a window.  Missing dates and groups count, too."""
    rows = [(c, None if d == 3 else f"2020-01-0{d}", None if c == 4 else c % 2, float(c * d)) for c in range(1, 6) for d in range(1, 4)]
    df = spark.createDataFrame(rows, "code long, date string, industry int, x double").withColumn("date", phases.F.to_date("date"))
    got = plan({"a": "ts_sum(x - cs_avg(x), 2, 1)", "b": "cs_rank(x) + cs_avg(x)", "g": "ts_sum(group_avg(x), 1)", "n": "cs_count(x)"}).spark(df)
    got = {(r["code"], str(r["date"])): r for r in got.collect()}
    assert len(got) == 15
    for c in range(1, 6):
        last = 0.0
        for d, n in ((None, 3), ("2020-01-01", 1), ("2020-01-02", 2)):
            r, own = got[c, str(d)], c * n - 3 * n
            same = [k for k in range(1, 6) if (k == 4) == (c == 4) and (k == 4 or k % 2 == c % 2)]
            assert abs(r["a"] - own - last) < 1e-12 and abs(r["b"] - c / 5 - 3 * n) < 1e-12 and r["n"] == 5 and abs(r["g"] - n * sum(same) / len(same)) < 1e-12
            last = own


def test_kept_columns_of_inner_plans(spark):
    a = full_panel(spark, SF).select("code", "date", "total_mv", "pe_ttm").toPandas().sort_values(["code", "date"])
    b = plan({"y": "2 * pe_ttm"}).spark(base_panel(spark, SF), ("code", "date", "total_mv"), sources=FULL).toPandas().sort_values(["code", "date"])
    assert (a["total_mv"].to_numpy() == b["total_mv"].to_numpy()).all() and ((2 * a["pe_ttm"]).dropna().to_numpy() == b["y"].dropna().to_numpy()).all() and a["pe_ttm"].isna().sum() == b["y"].isna().sum()


def test_few_columns_move_after_many_ranks(spark):
    """What is made from ranks is made after the rows moved again, not before."""
    parts = QUERIES["catalog_combinations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    between = parts[: parts.index("FlatMapGroupsInArrow")].split("RepartitionByExpression")
    assert len(between) == 2 and between[1].count("Project") <= 1
