"""As-of joins of busy keys, capped choices, interval tables, company facts, book levels and event attribution on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import intraday as I
from tidepanel.operators import joins as J
from tidepanel.operators import pit as P
from tidepanel.operators import portfolio as Q

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("split", [1_000_000, 50, 3])
def test_asof_join_of_a_busy_key(spark, split):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "a", "b", "c"]), DAY + dt.timedelta(rng.randrange(400)), i) for i in range(600)]
    right = [(rng.choice(["a", "a", "b"]), DAY + dt.timedelta(rng.randrange(20, 380)), i, float(i)) for i in range(400)]
    a = spark.createDataFrame(left, "instrument string, datetime date, n int")
    b = spark.createDataFrame(right, "instrument string, datetime date, seq int, v double")
    got = {r.n: (r.matched_at, r.v) for r in J.asof_join(a, b, tie="seq", split_rows=split).collect()}
    assert len(got) == len(left)
    for key, day, n in left:
        # of equal times the largest seq
        fits = [(d, s, v) for k, d, s, v in right if k == key and d <= day]
        want = (max(fits)[0], max(fits)[2]) if fits else (None, None)
        assert got[n] == want


def test_a_busy_key_is_cut(spark):
    a = spark.range(5000).selectExpr("'a' AS instrument", "date_add(DATE '2000-01-01', CAST(id AS INT)) AS datetime", "id AS n")
    b = a.selectExpr("instrument", "datetime", "n AS v")
    out = J.asof_join(a, b, split_rows=500)
    assert out.where("v <> n").count() == 0 and out.count() == 5000
    # the window takes the part as a key
    assert "__chunk" in out._jdf.queryExecution().optimizedPlan().toString()


def test_capped_choice_with_missing_groups(spark):
    rng = random.Random(2)
    rows = [(DAY + dt.timedelta(d), f"n{i:02}", rng.choice(["s", "t", None]), rng.choice(["x", "y", "z", None]), rng.choice([0.1, 0.2, 0.3, 0.4])) for d in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, instrument string, sector string, industry string, score double")
    for n, caps in ((6, {"sector": 2, "industry": 3}), (12, {"sector": 3, "industry": 1}), (1, {"sector": 1})):
        want = set()
        for d in {r[0] for r in rows}:
            used, taken = {}, 0
            for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], r[1])):
                groups = [(g, r[2 if g == "sector" else 3]) for g in caps]
                if taken < n and all(v is None or used.get((g, v), 0) < caps[g] for g, v in groups):
                    taken += 1
                    want.add(r[:2])
                    for x in groups:
                        used[x] = used.get(x, 0) + 1
        assert {(r.date, r.instrument) for r in Q.capped_topn(df, n, caps).collect()} == want


def test_intervals_are_disjoint_and_say_what_each_day_says(spark):
    rng = random.Random(3)
    sources, spans = ["one", "two"], []
    for i in range(120):
        start = DAY + dt.timedelta(rng.randrange(100))
        spans.append((rng.choice("ab"), start if i % 17 else None, start + dt.timedelta(rng.randrange(-2, 25)) if i % 13 else None, rng.choice("xyz"), rng.choice([*sources, "none"])))
    df = spark.createDataFrame(spans, "instrument string, start date, end date, code string, source string")
    got = {}
    for r in P.disjoint_intervals(df, sources).collect():
        for k in range(((r.end or DAY + dt.timedelta(150)) - r.start).days + 1):
            day = (r.instrument, r.start + dt.timedelta(k))
            assert day not in got
            got[day] = (r.code, r.source)
    for name in "ab":
        for k in range(150):
            day = DAY + dt.timedelta(k)
            fits = [(sources.index(s), -a.toordinal(), c, s) for n, a, b, c, s in spans if n == name and s in sources and a and a <= day and (b is None or b >= day)]
            want = min(fits)[2:] if fits else None
            assert got.get((name, day)) == want
    assert P.disjoint_intervals(df.where("false"), sources).count() == 0


def test_spans_that_cannot_win_a_day_of_a_month_meet_none_of_its_pieces(spark):
    rows = [("a", 2024 * 12 + m, dt.date(2023, 1, 1) + dt.timedelta(i), dt.date(2025, 1, 1), i % 3, "x", "s") for m in (2, 12) for i in range(300)]
    # a better one for some days; one of February that ends on the last day, and one that ends a day before
    rows += [("a", 2024 * 12 + 2, dt.date(2024, 2, 10), dt.date(2024, 2, 20), 0, "y", "s"), ("b", 2024 * 12 + 2, dt.date(2024, 2, 1), dt.date(2024, 3, 1), 1, "y", "s")]
    rows += [("b", 2024 * 12 + 2, dt.date(2024, 2, 1), dt.date(2024, 2, 29), 0, "z", "s"), ("b", 2024 * 12 + 2, dt.date(2024, 1, 1), dt.date(2024, 2, 29), 1, "w", "s")]
    df = spark.createDataFrame(rows, "instrument string, __m int, __a date, __b date, __rank int, __v string, __s string")
    got = sorted((r["instrument"], r["__m"] - 2024 * 12, r["__rank"], r["__v"], str(r["__a"])) for r in P._rivals(df, "instrument").collect())
    assert got == [("a", 2, 0, "x", "2023-10-25"), ("a", 2, 0, "y", "2024-02-10"), ("a", 12, 0, "x", "2023-10-25"), ("b", 2, 0, "z", "2024-02-01"), ("b", 2, 1, "y", "2024-02-01")]


def test_company_facts(spark):
    report = lambda accn, val, end="2020-03-31", filed="2020-05-01": {k: v for k, v in dict(accn=accn, val=val, end=end, filed=filed).items() if v is not None}
    facts = {
        "Revenue": {"units": {"EUR": [report("A", 1.0)], "USD": [report("B", 2.0), report("A", 3.0, end="2020-01-31"), report("A", 4.0), report("A", 5.0)]}},
        "Sales": {"units": {"USD": [report("A", 6.0), report("C", 7.0, end=None), report("C", 8.0, end=None, filed=None), report("D", None)]}},
        "Other": {"units": {"USD": [report("E", 9.0)]}},
    }
    docs = [(1, json.dumps({"facts": {"us-gaap": facts, "dei": {}}})), (2, "{"), (3, None), (4, json.dumps({"facts": {}}))]
    companies = spark.createDataFrame(docs, "company int, json string")
    wanted = spark.createDataFrame([(c, a) for c in (1, 2, 3, 4) for a in "ABCDE"], "company int, accession string")
    got = {(r.company, r.accession): (r.concept, r.unit, r.val) for r in P.facts_extract(companies, wanted, ["Revenue", "Sales"], ["USD", "EUR"]).collect()}
    # the newest of the first concept and unit, ties to the last; a concept that no unit reports under is passed over
    assert got == {(1, "A"): ("Revenue", "USD", 5.0), (1, "B"): ("Revenue", "USD", 2.0), (1, "C"): ("Sales", "USD", 7.0)}


def test_book_levels_of_one_minute(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 0, 0, s), s, [10.0 + s, 12.0 + s], [9.0 + s, 8.0], [1.0, 3.0], [2.0, 4.0]) for s in (1, 2, 7)]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, event_id int, ask array<double>, bid array<double>, asize array<double>, bsize array<double>")
    r = I.order_book_levels(df, 2, rows_back=1, seconds_back=5).first()
    assert abs(r.p_spread_1 - 2 * 1 / 33) < 1e-12 and abs(r.p_mid_2 - (19 + 8) / 33) < 1e-12 and abs(r.p_diff_ask_1_2 - 2 * 2 / 33) < 1e-12
    assert abs(r.p_accspread - 2 * (17 + 19 - 16 - 8) / 33) < 1e-12 and abs(r.v_asize_2 - 3 / 30) < 1e-12 and abs(r.v_accspread - (4 - 6) / 30) < 1e-12
    assert abs(r.change_1_rows - ((23 / 21 - 1) + (33 / 23 - 1)) / 2) < 1e-12
    assert abs(r.change_5_s - (33 / 23 - 1)) < 1e-12  # only the last quote has one at least five seconds older
    assert r.p_diff_ask_1_3s is None or abs(r.p_diff_ask_1_3s - 2 * (17 - 12) / 3 / 33) < 1e-12


def test_attribution_inside_an_event(spark):
    rows = [(DAY + dt.timedelta(d), n, s, v) for d, n, s, v in ((0, "a", "x", 9.0), (1, "a", "x", -1.0), (2, "b", "x", -2.0), (2, "c", None, 1.0), (3, "a", "x", 9.0))]
    df = spark.createDataFrame(rows, "date date, instrument string, sector string, contribution double")
    event = spark.createDataFrame([(DAY, DAY + dt.timedelta(2))], "peak date, trough date")
    got = {(r.level, r.name): (r.contribution, r.share, r.days) for r in Q.event_attribution(event, df, ["instrument", "sector"]).collect()}
    assert got == {("instrument", "a"): (-1.0, 0.5, 1), ("instrument", "b"): (-2.0, 1.0, 1), ("instrument", "c"): (1.0, -0.5, 1), ("sector", "x"): (-3.0, 1.5, 2), ("sector", None): (1.0, -0.5, 1)}


def test_summaries_against_pandas(spark):
    rng = random.Random(9)
    rows = [(DAY + dt.timedelta(28 * i), rng.gauss(0.01, 0.05), rng.gauss(0.005, 0.04) if i % 7 else None, rng.random(), rng.randrange(5, 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, gross double, bench double, turnover double, positions int")
    p = df.toPandas()
    net = p["gross"] - 0.002 * p["turnover"]
    nav = (1 + net).cumprod()
    r = Q.backtest_summary(df, 13, 0.002).first()
    assert (r.periods, r.positions, r.win_rate) == (40, p["positions"].mean(), (net > 0).mean())
    want = [nav.iloc[-1] - 1, nav.iloc[-1] ** (13 / 40) - 1, net.std() * 13**0.5, net.mean() / net.std() * 13**0.5, (nav / nav.cummax() - 1).min(), 0.002 * p["turnover"].sum()]
    assert [r.cumulative, r.annual, r.volatility, r.ir, r.drawdown, r.cost] == pytest.approx(want)
    own, market = (1 + p["gross"]).cumprod(), (1 + p["bench"].fillna(0)).cumprod()
    ok = p["bench"].notna()
    a, b, relative = p["gross"][ok], p["bench"][ok], (own / market)[ok]
    r = Q.benchmark_summary(df.withColumn("ret", F.col("gross")), 13).first()
    beta = a.cov(b) / b.var()
    want = [(1 + a).prod() - 1, (1 + b).prod() - 1, relative.iloc[-1] - 1, (1 + b).prod() ** (13 / ok.sum()) - 1, (market[ok] / market[ok].cummax() - 1).min(), (relative / relative.cummax() - 1).min(), beta, (a.mean() - beta * b.mean()) * 13, a.corr(b), (a > b).mean()]
    assert [r.cumulative, r.bench_cumulative, r.excess_cumulative, r.bench_annual, r.bench_drawdown, r.relative_drawdown, r.beta, r.alpha, r["corr"], r.win_rate] == pytest.approx(want)
