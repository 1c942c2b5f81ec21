"""W2/W3 distributed folds against row-by-row Python folds on random logs.

Random inputs are spread over many range partitions (more partitions than a
provider/team-month has rows, and hot keys), so chunk boundaries fall in
every position of the state machine.
"""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import admission_fold, breaker_fold
from tollgate import config
from tollgate.operators.breaker import breaker_final, breaker_states
from tollgate.operators.budget import admit, budget_admission, daily_usage, monthly_usage
from tollgate.operators.pricing import with_cost
from tollgate.operators.reports import cumulative_cost, kpi_summary
from tollgate.sources import audit_io


def _breaker_log(rng, n):
    rows, t = [], 0
    provs = ["anthropic", "openai", "azure_openai", "gemini"]
    weights = [6, 1, 1, 1]  # one hot provider
    for aid in range(n):
        t += rng.choice([0, 5, 20, 30, 61, 70, 200])
        p = rng.choices(provs, weights)[0]
        o = rng.choices(["ok", "error", "open", "unconfigured"], [3, 5, 1, 1])[0]
        rows.append((p, aid, t, o))
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 3), (2, 8), (3, 17), (4, 40)])
def test_breaker_matches_fold(spark, seed, parts):
    rng = random.Random(seed)
    rows = _breaker_log(rng, 600)
    df = spark.createDataFrame(rows, "provider string, attempt_id long, attempt_s long, outcome string")
    got = {r["attempt_id"]: (r["failures_after"], r["tripped_at_after"], r["trip_set"], r["expired"])
           for r in breaker_states(df, partitions=parts).collect()}
    assert got == breaker_fold(rows)


def test_breaker_gateway_cases(spark):
    # three failures open it; two failures then a success closes it with 0 failures
    rows = [("openai", 1, 0, "error"), ("openai", 2, 1, "error"), ("openai", 3, 2, "error"),
            ("gemini", 4, 0, "error"), ("gemini", 5, 1, "error"), ("gemini", 6, 2, "ok"),
            # tripped at 10; asked at exactly +60 still open (failure re-trips), at +61 expired
            ("anthropic", 7, 8, "error"), ("anthropic", 8, 9, "error"), ("anthropic", 9, 10, "error"),
            ("anthropic", 10, 70, "error"), ("anthropic", 11, 131, "error")]
    df = spark.createDataFrame(rows, "provider string, attempt_id long, attempt_s long, outcome string")
    got = {r["attempt_id"]: r for r in breaker_states(df, partitions=4).collect()}
    assert got[3]["failures_after"] == 3 and got[3]["tripped_at_after"] == 2 and got[3]["trip_set"]
    assert got[6]["failures_after"] == 0 and got[6]["tripped_at_after"] is None
    assert got[10]["expired"] is False and got[10]["failures_after"] == 4 and got[10]["tripped_at_after"] == 70
    assert got[11]["expired"] is True and got[11]["failures_after"] == 1 and got[11]["tripped_at_after"] is None


REQUESTS = "team_id string, ts timestamp_ntz, event_id long, est_cost decimal(28,11), cost decimal(28,11)"


def _budget_log(rng, n):
    """Estimates and costs that differ: cheaper, dearer and failed calls."""
    teams = ["finance-team", "engineering-team", "marketing-team", "ops"]
    rows, t = [], dt.datetime(2024, 1, 28)
    for eid in range(n):
        t += dt.timedelta(minutes=rng.choice([0, 1, 7, 30, 90, 300]))
        team = rng.choices(teams, [5, 2, 1, 1])[0]  # one hot team
        est = Decimal(rng.choice([0, 1, 5, 20, 100, 400, 2500])) / Decimal(10000) + Decimal(rng.choice([0, 0, 49, 51])) / Decimal(10 ** 8)
        cost = rng.choice([est, est, est / 2, Decimal(0), est * 3])
        rows.append((team, t, eid, est, cost))
    return rows


BUDGETS = (("finance-team", "0.05", "1000"), ("engineering-team", "1000", "0.20"), ("marketing-team", "0.03", "0.06"))
SETTINGS = config.GatewaySettings(team_budgets=BUDGETS, default_daily_budget_usd="0.1", default_monthly_budget_usd="0.5")
LIMITS = {t: (Decimal(d), Decimal(m)) for t, d, m in BUDGETS}


def _decided(out):
    return {r["event_id"]: (r["allowed"], r["denied_by"], r["du_before"], r["mu_before"]) for r in out.collect()}


@pytest.mark.parametrize("seed,parts", [(1, 3), (2, 9), (3, 31)])
def test_admission_matches_fold(spark, seed, parts):
    rows = _budget_log(random.Random(seed), 700)
    got = _decided(budget_admission(spark.createDataFrame(rows, REQUESTS), SETTINGS, partitions=parts))
    assert len(got) == len(rows) and got == admission_fold(rows, LIMITS, (Decimal("0.1"), Decimal("0.5")))


def test_admission_carries_across_arrow_batches(spark):
    rows = _budget_log(random.Random(8), 500)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = _decided(budget_admission(spark.createDataFrame(rows, REQUESTS), SETTINGS, partitions=2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == admission_fold(rows, LIMITS, (Decimal("0.1"), Decimal("0.5")))


@pytest.mark.parametrize("seed", [4, 5])
def test_hot_months_are_settled_by_bounds(spark, seed):
    """Team-months over the fold's size never meet in a task; the result is the same."""
    rows = _budget_log(random.Random(seed), 260)
    got = _decided(budget_admission(spark.createDataFrame(rows, REQUESTS), SETTINGS, partitions=3, fold_rows=60))
    assert got == admission_fold(rows, LIMITS, (Decimal("0.1"), Decimal("0.5")))


@pytest.mark.parametrize("numbers", [int, object])
def test_admit_is_the_greedy_fold(numbers):
    rng = random.Random(12)
    for _ in range(300):
        rows = _budget_log(rng, 60)
        rows = [("t", *r[1:]) for r in rows if r[1].month == 1]
        whole = lambda x: int(x * 10 ** 11)
        kind = np.int64 if numbers is int else object
        arrays = [np.array([whole(r[k]) for r in rows], kind) for k in (3, 4)]
        day = np.array([r[1].toordinal() for r in rows])
        limits = [np.full(len(rows), whole(Decimal(x)), kind) for x in ("0.05", "0.3")]
        allowed, du, mu, _, _ = admit(*arrays, day, *limits, 0, 0)
        want = admission_fold(rows, {"t": (Decimal("0.05"), Decimal("0.3"))})
        assert [(bool(a), int(d), int(m)) for a, d, m in zip(allowed, du, mu, strict=True)] == [(want[r[2]][0], whole(want[r[2]][2]), whole(want[r[2]][3])) for r in rows]


def _one(spark, rows, settings, **more):
    return {r["event_id"]: r for r in budget_admission(spark.createDataFrame(rows, REQUESTS), settings, **more).collect()}


def test_admission_reason_text(spark):
    settings = config.GatewaySettings(team_budgets=(("t", "0.001", "100"),))
    r = _one(spark, [("t", dt.datetime(2024, 1, 1), 1, Decimal("1.0"), Decimal("1.0"))], settings)[1]
    assert r["allowed"] is False
    assert r["reason"] == "Daily budget exceeded for team 't'. Used: $0.0000 / $0.00. Resets at midnight UTC."


def test_admission_cost_equal_to_remaining_is_allowed(spark):
    settings = config.GatewaySettings(team_budgets=(("t", "0.5", "100"),))
    rows = [("t", dt.datetime(2024, 1, 1, h), h, Decimal(c), Decimal(c)) for h, c in ((1, "0.3"), (2, "0.2"), (3, "0.000001"), (4, "0"))]
    assert {k: r["allowed"] for k, r in _one(spark, rows, settings).items()} == {1: True, 2: True, 3: False, 4: True}


def test_estimate_is_checked_and_actual_cost_is_spent(spark):
    settings = config.GatewaySettings(team_budgets=(("t", "1", "100"),))
    rows = [("t", dt.datetime(2024, 1, 1, h), h, Decimal(e), Decimal(c)) for h, e, c in ((1, "0.9", "0.1"), (2, "0.9", "0"), (3, "0.9", "0.5"), (4, "0.5", "0.5"))]
    got = _one(spark, rows, settings)
    assert [got[h]["allowed"] for h in (1, 2, 3, 4)] == [True, True, True, False] and got[4]["du_before"] == Decimal("0.6")


@pytest.mark.parametrize("limit", ["10000000", "1000000000", "1000000000000"])
def test_large_limits_and_spend(spark, limit):
    settings = config.GatewaySettings(team_budgets=(("t", limit, limit),))
    rows = [("t", dt.datetime(2024, 1, 1, h), h, Decimal("40000000"), Decimal("40000000")) for h in range(6)]  # 240 M USD in a day
    got = _one(spark, rows, settings)
    assert [got[h]["allowed"] for h in range(6)] == [40_000_000 * (h + 1) <= int(limit) for h in range(6)]


def test_money_of_a_large_log(spark):
    audit = spark.createDataFrame([("t", dt.datetime(2024, 1, d), "success", Decimal("40000000")) for d in (1, 1, 1, 2, 3)], "team_id string, ts timestamp_ntz, status string, cost decimal(28,11)")
    assert {r["cost"] for r in monthly_usage(daily_usage(audit)).collect()} == {Decimal("200000000")}


def test_tiny_costs_add_up(spark):
    """100,000 calls of 4.5e-7 USD: nothing is rounded before the sum."""
    calls = spark.range(100_000).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "'t' team_id", "'gemini' provider_requested", "'gemini' provider_used",
                                            "'gemini-1.5-flash' model_used", "6L prompt_tokens", "0L completion_tokens", "cast(null as string) pii_csv", "0 pii_redaction_count",
                                            "1.0D latency_ms", "false fallback_triggered", "'success' status")
    audit = audit_io.audit_projection(with_cost(calls))
    assert kpi_summary(audit).first()["total_cost_usd"] == 0.045
    assert cumulative_cost(audit).agg(F.max("cumulative_cost_usd")).first()[0] == 0.045


def test_breaker_continues_from_an_opening_state(spark):
    rows = _breaker_log(random.Random(21), 400)
    schema = "provider string, attempt_id long, attempt_s long, outcome string"
    early, late = (spark.createDataFrame([r for r in rows if (r[2] < 9000) == e], schema) for e in (True, False))
    opening = breaker_final(early, partitions=3)
    got = breaker_states(early, partitions=3).unionByName(breaker_states(late, partitions=4, opening=opening))
    assert {r["attempt_id"]: (r["failures_after"], r["tripped_at_after"], r["trip_set"], r["expired"]) for r in got.collect()} == breaker_fold(rows)


def test_breaker_tiny_arrow_batches(spark):
    """Fold state must carry across Arrow batches inside one partition."""
    rng = random.Random(11)
    rows = _breaker_log(rng, 500)
    df = spark.createDataFrame(rows, "provider string, attempt_id long, attempt_s long, outcome string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["attempt_id"]: (r["failures_after"], r["tripped_at_after"], r["trip_set"], r["expired"])
               for r in breaker_states(df, partitions=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == breaker_fold(rows)
