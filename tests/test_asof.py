"""Limits in force at the time, and team-months decided chunk by chunk, against row-by-row folds."""

import datetime as dt
import random
import re
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from brute import admission_fold
from pyspark.sql import functions as F

from tollgate import config
from tollgate.operators import budget, chaining, fold, prefix
from tollgate.operators.asof import asof_join

START = dt.datetime(2024, 1, 28)
REQUESTS = "team_id string, ts timestamp_ntz, event_id long, est_cost decimal(28,11), cost decimal(28,11)"
CHANGES = "team_id string, ts timestamp_ntz, seq long, daily_limit decimal(24,4), monthly_limit decimal(24,4)"


def _log(rng, n, changes):
    """Few instants, so that many rows and changes share one; a team with most of the rows; odd ones without team or time."""
    at = lambda: START + dt.timedelta(minutes=rng.randrange(0, 900) * 10)
    team = lambda: rng.choices(["hot", "a", "b", "never"], [8, 2, 2, 1])[0]
    money = lambda: Decimal(rng.randrange(1, 9)) / 100
    rows = [(team(), at(), i, money(), money()) for i in range(n)] + [(None, at(), n, money(), money()), ("a", None, n + 1, money(), money())]
    log = [(t if (t := team()) != "never" else "a", at(), s, Decimal(rng.randrange(1, 40)) / 10, Decimal(rng.randrange(1, 90)) / 10) for s in range(changes)]
    return rows, log + [(None, at(), -1, Decimal(1), Decimal(1)), ("a", None, -2, Decimal(1), Decimal(1))]


def _in_force(rows, log):
    out = {}
    for team, ts, i, *_ in rows:
        known = [c for c in log if team is not None and ts is not None and c[0] == team and c[1] is not None and c[1] <= ts]
        out[i] = max(known, key=lambda c: (c[1], c[2]))[3:] if known else None
    return out


@pytest.mark.parametrize("seed,parts,changes", [(1, 2, 60), (2, 9, 300), (3, 30, 5), (4, 4, 0)])
def test_asof_join(spark, seed, parts, changes):
    rows, log = _log(random.Random(seed), 600, changes)
    got = asof_join(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(log, CHANGES), "team_id", "ts", ("event_id", "seq"), ("daily_limit", "monthly_limit"), parts)
    assert got.columns == ["team_id", "ts", "event_id", "est_cost", "cost", "daily_limit", "monthly_limit"]
    out = got.collect()
    assert len(out) == len(rows)
    assert {r.event_id: None if r.daily_limit is None else (r.daily_limit, r.monthly_limit) for r in out} == _in_force(rows, log)


def test_asof_join_empty_and_repeated(spark):
    rows = [("a", START, 1, Decimal(1), Decimal(1))] * 3
    log = [("a", START, 1, Decimal(2), Decimal(3))]
    args = ("team_id", "ts", ("event_id", "seq"), ("daily_limit",), 3)
    r, c = spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(log, CHANGES)
    assert [x.daily_limit for x in asof_join(r, c, *args).collect()] == [Decimal(2)] * 3  # a change counts for its own instant
    assert [x.daily_limit for x in asof_join(r, c.limit(0), *args).collect()] == [None] * 3
    assert asof_join(r.limit(0), c, *args).count() == 0


@pytest.mark.parametrize("fold_rows", [10**6, 50])
def test_admission_under_the_limits_of_the_time(spark, fold_rows):
    rows, log = _log(random.Random(7), 400, 80)
    default = config.GatewaySettings(team_budgets=(("b", "0.3", "1"),), default_daily_budget_usd="0.2", default_monthly_budget_usd="2")
    got = budget.budget_admission(spark.createDataFrame(rows, REQUESTS), default, 3, fold_rows=fold_rows, changes=spark.createDataFrame(log, CHANGES))
    got = {r.event_id: (r.allowed, r.denied_by, r.du_before, r.mu_before) for r in got.collect()}
    limits = {i: v or {"b": (Decimal("0.3"), Decimal(1))}.get(t, (Decimal("0.2"), Decimal(2))) for (t, _, i, *_), v in zip(rows, _in_force(rows, log).values(), strict=True)}
    dated = [r for r in rows if r[1] is not None and r[0] is not None]
    assert {i: got[i] for *_, i, _, _ in dated} == _fold(dated, limits)
    assert len(got) == len(rows)


def _fold(rows, limits):
    """admission_fold with a limit a request."""
    out, spent = {}, {}
    for team, ts, i, est, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        keys = (team, ts.date()), (team, ts.year, ts.month)
        before = tuple(spent.get(k, Decimal(0)) for k in keys)
        left = [max(Decimal(0), limit - s) for limit, s in zip(limits[i], before, strict=True)]
        kind = "daily" if est > left[0] else "monthly" if est > left[1] else None
        out[i] = (kind is None, kind, *before)
        if kind is None:
            for k, s in zip(keys, before, strict=True):
                spent[k] = s + cost
    return out


# ---- chunk chaining ------------------------------------------------------------------------------------------------------------

def _traffic(n, seed, days=30):
    rng = np.random.default_rng(seed)
    price, prompt, answer = rng.choice([300, 500, 125], n), rng.integers(1, 4097, n), rng.integers(1, 1025, n)
    act, est = (prompt * price + answer * price * 4) * 1000, (prompt * price + 1024 * price * 4) * 1000
    act[rng.random(n) < 0.1] = 0
    return est, act, np.sort(rng.integers(0, days, n)).astype(np.int32)


#: (daily, monthly) USD: never binding, binding each day, binding within the month, both
LIMITS = [(1e6, 1e6), (10, 1e6), (1e6, 300), (15, 120)]


@pytest.mark.parametrize("daily,monthly", LIMITS)
def test_large_month_is_settled_in_few_rounds(spark, daily, monthly):
    """100,000 requests of one team-month, at most five times as many rows folded, decisions equal to the one fold."""
    n = 100_000
    est, act, day = _traffic(n, 3)
    ts = pd.Timestamp("2024-03-01") + pd.to_timedelta(day, "D") + pd.to_timedelta(np.arange(n) % 86400 // 97, "s")
    order = np.lexsort((np.arange(n), ts))
    est, act, day, ts = est[order], act[order], day[order], ts[order]
    pdf = pd.DataFrame({"e": est, "c": act, "ts": ts, "event_id": np.arange(n)})
    reqs = spark.createDataFrame(pdf).selectExpr("'t' team_id", "cast(ts as timestamp_ntz) ts", "event_id", "cast(e * 0.00000000001BD as decimal(28,11)) est_cost",
                                                 "cast(c * 0.00000000001BD as decimal(28,11)) cost")
    settings = config.GatewaySettings(team_budgets=(("t", str(daily), str(monthly)),))
    trace = []
    got = budget.budget_admission(reqs, settings, 8, fold_rows=1000, trace=trace).select(
        "event_id", "allowed", (F.col("du_before") * 10**11).cast("long").alias("d"), (F.col("mu_before") * 10**11).cast("long").alias("m")).toPandas().sort_values("event_id")
    whole = lambda x: np.full(n, int(x * 10**11))
    allowed, du, mu, _, _ = budget.admit(est, act, day, whole(daily), whole(monthly), 0, 0)
    assert (got["allowed"].to_numpy() == allowed).all() and (got["d"].to_numpy() == du).all() and (got["m"].to_numpy() == mu).all()
    assert 0 < allowed.sum() and sum(trace) <= 5 * n and trace[0] == n


def test_bounds_of_a_chunk_are_the_starts_that_change_nothing():
    rng = random.Random(5)
    for kind in (np.int64, object):
        for _ in range(60):
            n = rng.randrange(1, 40)
            est, act = (np.array([rng.randrange(0, 12) * budget.STEP + rng.randrange(3) for _ in range(n)], kind) for _ in range(2))
            day = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
            daily, monthly = (np.array([rng.randrange(10, 60) * budget.STEP for _ in range(n)], kind) for _ in range(2))
            start_d, start_m = rng.randrange(0, 40) * budget.STEP, rng.randrange(0, 40) * budget.STEP
            span = chaining.Span("k", 0, start_d, start_m)
            allowed, du, mu, sd, sm = budget.admit(est, act, day, daily, monthly, start_d, start_m)
            most = [chaining.greatest_spend(est, limit, budget.STEP) for limit in (daily, monthly)]
            span.add(day, allowed, du, mu, *most, sd, sm)
            assert span.low_d < start_d <= span.high_d and span.low_m < start_m <= span.high_m
            for other in range(20):
                d, m = (start_d + rng.randrange(-8, 9) * budget.STEP // 4, start_m + rng.randrange(-8, 9) * budget.STEP // 4)
                if d >= 0 and m >= 0 and span.low_d < d <= span.high_d and span.low_m < m <= span.high_m:
                    assert (budget.admit(est, act, day, daily, monthly, d, m)[0] == allowed).all()


def test_requests_without_time_or_team_in_large_months(spark):
    rows = [(t, None if k % 3 == 0 else START + dt.timedelta(hours=k), k, Decimal("0.01"), Decimal("0.01")) for k in range(200) for t in ("x", None)]
    rows = [(*r[:2], 2 * r[2] + (r[0] is None), *r[3:]) for r in rows]
    settings = config.GatewaySettings(default_daily_budget_usd="0.1", default_monthly_budget_usd="0.4")
    got = {fr: {r.event_id: (r.allowed, r.denied_by, r.du_before) for r in budget.budget_admission(spark.createDataFrame(rows, REQUESTS), settings, 3, fold_rows=fr).collect()}
           for fr in (10, 10**6)}
    assert got[10] == got[10**6] and len(got[10]) == len(rows)
    dated = [("x", *r[1:]) for r in rows if r[0] == "x" and r[1] is not None]
    want = admission_fold(dated, {}, (Decimal("0.1"), Decimal("0.4")))
    assert {i: w[:3] for i, w in want.items()} == {i: got[10][i] for i in want}


def _limited(n, scale=1):
    """A team with all rows, one instant for every four; limits from a table whose size isn't known beforehand."""
    rng = random.Random(n)
    rows = [("x" if k % 9 else "y", START + dt.timedelta(minutes=k // 4 * 7), k, *(Decimal(rng.randrange(1, 9)) / 100 * scale for _ in range(2))) for k in range(n)]
    return rows, {"x": (Decimal("0.5") * scale, Decimal(3) * scale)}


def test_limits_are_not_joined_by_team_alone(spark):
    """One task would get all rows of a team."""
    rows, limits = _limited(200)
    table = spark.createDataFrame([(t, *v) for t, v in limits.items()], "team_id string, daily_limit decimal(24,4), monthly_limit decimal(24,4)")
    got = budget.budget_admission(spark.createDataFrame(rows, REQUESTS), partitions=3, limits=table)
    assert not re.search(r"hashpartitioning\(team_id#\w+, \d+\)", got._jdf.queryExecution().toString())
    fixed = budget.with_limits(spark.createDataFrame(rows, REQUESTS))
    assert "hashpartitioning" not in fixed._jdf.queryExecution().toString()


@pytest.mark.parametrize("scale", [1, 1000, 10 ** 9])
def test_amounts_of_any_size_in_large_months(spark, scale):
    """Up to 18 digits amounts are written as a word, beyond as they are: every decision is the same."""
    rows, limits = _limited(400, scale)
    table = spark.createDataFrame([(t, *v) for t, v in limits.items()], "team_id string, daily_limit decimal(24,4), monthly_limit decimal(24,4)")
    out = budget.budget_admission(spark.createDataFrame(rows, REQUESTS), partitions=3, limits=table, fold_rows=20)
    assert {kind for c, kind in out.dtypes if c in chaining.AMOUNTS} == {"decimal(37,11)"}
    got = {r.event_id: (r.allowed, r.denied_by, r.du_before, r.mu_before) for r in out.collect()}
    assert got == admission_fold(rows, limits)
    kept = [(r.est_cost, r.cost) for r in out.orderBy("event_id").collect()]
    assert kept == [r[3:] for r in rows]


def test_limits_that_are_never_summed_stay_machine_words():
    """A monthly limit above 2,305 USD made numbers of Python's own of a whole batch."""
    limits = pa.array([Decimal(10_000)] * 10_000, pa.decimal128(37, 11))
    assert chaining.whole_numbers(limits, sums=False).dtype == np.int64
    assert chaining.whole_numbers(limits).dtype == object
    wide = pa.array([Decimal(50_000_000)], pa.decimal128(37, 11))
    assert chaining.whole_numbers(wide, sums=False).tolist() == [5 * 10 ** 18] and chaining.whole_numbers(wide, sums=False).dtype == object


# ---- chunk borders ---------------------------------------------------------------------------------------------------------------

def _jobs(spark, fn):
    sc = spark.sparkContext
    group = f"g{random.random()}"
    sc.setJobGroup(group, "")
    try:
        fn()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_borders_take_as_many_jobs_for_many_hot_instants_as_for_one(spark):
    one = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END ts")
    many = spark.range(6000).selectExpr("id", "id % 12 ts")
    counts = [_jobs(spark, lambda df=df: prefix.chunk_bounds(df, "ts", "id", 60)) for df in (one, many)]
    assert counts[0] == counts[1]
    sizes = [r["count"] for r in prefix.with_chunk(many, ["ts", "id"], 30).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 55 and max(sizes) <= 2.5 * 100


# ---- team-months whose limits change all the time ----------------------------------------------------------------------------------

@pytest.mark.parametrize("far", [False, True])
def test_large_month_of_changing_limits_is_settled_in_three_rounds(spark, far):
    """Limits that change every few requests leave guessed starts no room; rows are folded three times at most, however many chunks there are."""
    n, rng = 20_000, np.random.default_rng(11)
    est, act, day = _traffic(n, 4)
    at = np.sort(day * 86400 + rng.integers(0, 86400, n))
    limit = np.repeat(rng.exponential(3, n // 5), 5).round(2) * (10**9 if far else 1)
    if far:
        est, act = est.astype(object) * 10**9, act.astype(object) * 10**9  # beyond 64 bits in sum
    act = [int(a) - (10**6 if i % 50 == 7 else 0) for i, a in enumerate(act)]  # some are paid back
    money = lambda x: Decimal(int(x)).scaleb(-11)
    ts = [dt.datetime(2024, 3, 1) + dt.timedelta(seconds=int(s)) for s in at]
    reqs = spark.createDataFrame([("t", ts[i], i, money(est[i]), money(act[i])) for i in range(n)], REQUESTS)
    log = {ts[i]: ("t", ts[i], i, Decimal(str(limit[i])).quantize(Decimal("0.01")), Decimal(str(limit[i] * 20)).quantize(Decimal("0.01"))) for i in range(0, n, 5)}
    trace = []
    got = budget.budget_admission(reqs, config.GatewaySettings(), 8, fold_rows=1000, changes=spark.createDataFrame(list(log.values()), CHANGES), trace=trace).select(
        "event_id", "allowed", "du_before", "mu_before", "daily_limit", "monthly_limit").toPandas().sort_values("event_id")
    whole = lambda c: np.array([int(x.scaleb(11)) for x in got[c]], object)
    days = np.array([t.toordinal() for t in ts])
    allowed, du, mu, _, _ = budget.admit(np.array([int(e) for e in est], object), np.array(act, object), days, whole("daily_limit"), whole("monthly_limit"), 0, 0)
    assert 0 < allowed.sum() < n and (got["allowed"].to_numpy() == allowed).all()
    assert (whole("du_before") == du).all() and (whole("mu_before") == mu).all()
    assert len(trace) <= 3 and sum(trace) <= 3 * n


def test_doubts_are_settled_alike_from_every_start_of_the_range():
    rng = random.Random(6)
    for kind in (np.int64, object):
        for _ in range(80):
            n = rng.randrange(1, 40)
            est, act = (np.array([rng.randrange(-1, 12) * fold.STEP + rng.randrange(3) for _ in range(n)], kind) for _ in range(2))
            day = np.sort(np.array([rng.randrange(3) for _ in range(n)], np.int32))
            daily, monthly = (np.array([rng.randrange(10, 60) * fold.STEP for _ in range(n)], kind) for _ in range(2))
            low_d, low_m = rng.randrange(0, 30) * fold.STEP, rng.randrange(0, 30) * fold.STEP
            high_d, high_m = low_d + rng.randrange(0, 9) * fold.STEP, low_m + rng.randrange(0, 9) * fold.STEP
            most = [fold.greatest_spend(est, limit) for limit in (daily, monthly)]
            for _ in range(6):
                d, m = rng.randint(low_d, high_d), rng.randint(low_m, high_m)
                first, chunk, after = chaining.Doubts("k", 0, int(day[0]), d, d, m, m), chaining.Doubts("k", 1, int(day[0]), low_d, high_d, low_m, high_m), \
                    chaining.Doubts("k", 2, int(day[-1]), 0, chaining.FAR, 0, chaining.FAR)
                chunk.add(day, act, *most)
                rows = [e for x in (first, chunk, after) for e in x.taken(last=True)]
                out = [b.to_pylist() for b in chaining.replay(iter([chaining.doubts(rows[:3]), chaining.doubts(rows[3:])]))]
                _, _, _, spent_d, spent_m = budget.admit(est, act, day, daily, monthly, d, m)
                at = {r["_chunk"]: (int(r["start_d"]), int(r["start_m"]), r["fits"]) for part in out for r in part}
                assert at[1] == (d, m, True) and at[2][:2] == (spent_d, spent_m)
