"""Streams over tables in several files that overlap in time: nothing is lost, state carries over, late rows are decided."""

import datetime as dt
import os
import random
import time
from decimal import Decimal

import pandas as pd
import pytest
from conftest import SF001


from tollgate import config, schemas

from tollgate.plans import catalog
from tollgate.streaming import admission, id_index, streams

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _write_batches(root, batches):
    # a folder named like the table; files in the order of their times
    d = os.path.join(root, "events.parquet")
    os.makedirs(d)
    for i, rows in enumerate(batches):
        pdf = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=EVENT_COLS)
        pdf["ts"] = pd.to_datetime(pdf["ts"])
        pdf.to_parquet(os.path.join(d, f"part-{i}.parquet"), index=False, coerce_timestamps="us")
        t = time.time() + i * 10
        os.utime(os.path.join(d, f"part-{i}.parquet"), (t, t))
    return root


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    """The events table as four files dealt row by row, so that all overlap in time."""
    pdf = spark.read.parquet(f"{SF001}/events.parquet").toPandas().sort_values("event_id")
    return _write_batches(str(tmp_path_factory.mktemp("ov")), [pdf.iloc[k::4].copy() for k in range(4)])


@pytest.mark.parametrize("max_files", [None, 1])
def test_audit_sink_keeps_every_request(spark, overlapping, max_files):
    log = streams.stream_audit_sink(spark, overlapping, max_files)
    assert log.count() == log.select("request_id").distinct().count() == 1000


def test_audit_sink_writes_what_comes_twice_once(spark, tmp_path):
    pdf = spark.read.parquet(f"{SF001}/events.parquet").toPandas()
    root = _write_batches(str(tmp_path), [pdf.iloc[:600].copy(), pdf.iloc[300:].copy(), pdf.iloc[[5, 5, 5]].copy()])
    seen = {}

    def spy(df, epoch, target):
        seen["target"] = target
        return original(df, epoch, target)
    original, streams.append_audit = streams.append_audit, spy
    try:
        assert streams.stream_audit_sink(spark, root, 1).count() == 1000
    finally:
        streams.append_audit = original
    log, siem, _ = streams.audit_sink_paths(seen["target"])
    assert spark.read.text(siem).count() == 1000 and spark.read.text(siem).where("value like '%\"sourcetype\":\"ai_gateway\"%'").count() == 1000
    # a replayed epoch overwrites its folder
    again = spark.read.schema(schemas.AUDIT).json(f"{log}/epoch=2")
    assert again.count() == 0


@pytest.mark.parametrize("max_files", [None, 1])
def test_daily_usage_counts_rows_of_any_age(spark, overlapping, max_files):
    got = {(r["team_id"], r["day"]): (r["cost_usd"], r["n_requests"]) for r in streams.stream_daily_usage(spark, overlapping, max_files=max_files).collect()}
    want = {(r["team_id"], r["day"]): (r["cost_usd"], r["n_requests"]) for r in catalog.QUERIES["daily_usage"](spark, SF001).collect()}
    assert got == want


LONG = 400 * 24 * 3600.0


@pytest.mark.parametrize("max_files", [None, 1])
def test_breaker_stream_equals_replay(spark, overlapping, max_files):
    got = {tuple(r) for r in streams.stream_breaker(spark, overlapping, delay_s=LONG, max_files=max_files).where("outcome <> 'closed'").collect()}
    assert got == {tuple(r) for r in catalog.QUERIES["breaker_states"](spark, SF001).collect()} and len(got) == 613


@pytest.mark.parametrize("max_files", [None, 1])
def test_admission_stream_equals_replay(spark, overlapping, max_files):
    got = streams.stream_budget_admission(spark, overlapping, delay_s=LONG, max_files=max_files).collect()
    want = {r["event_id"]: r for r in catalog.QUERIES["budget_admission"](spark, SF001).collect()}
    assert len(got) == len(want) == 1000 and not any(r["late"] for r in got)
    for r in got:
        assert all(r[c] == want[r["event_id"]][c] for c in want[r["event_id"]].asDict())


def test_admission_stream_in_pieces(spark, tmp_path):
    """Files in time order, released piece by piece: spend is carried over and the result is the replay's."""
    pdf = spark.read.parquet(f"{SF001}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    root = _write_batches(str(tmp_path), [pdf.iloc[k * 250:(k + 1) * 250].copy() for k in range(4)])
    got = streams.stream_budget_admission(spark, root, delay_s=60, max_files=1)
    want = {r["event_id"]: (r["allowed"], r["daily_used_before_usd"], r["monthly_used_before_usd"]) for r in catalog.QUERIES["budget_admission"](spark, SF001).collect()}
    assert {r["event_id"]: (r["allowed"], r["daily_used_before_usd"], r["monthly_used_before_usd"]) for r in got.collect()} == want


def test_late_requests_are_decided_and_kept_aside(spark, tmp_path):
    day = dt.datetime(2024, 1, 2)
    # user_id 0 -> finance-team (daily limit 0.50); event_id % 7 == 0 -> claude-opus-4-6 (expensive)
    b1 = [(7 * k, day + dt.timedelta(minutes=10 * k), 0, "click", 1.0, "{}") for k in range(1, 6)]
    b2 = [(7 * 9, day + dt.timedelta(minutes=200), 0, "click", 1.0, "{}"), (7 * 6, day + dt.timedelta(minutes=1), 0, "click", 1.0, "{}")]
    root = _write_batches(str(tmp_path), [b1, b2])
    job = admission.AdmissionStream(spark, 0.0)
    rows = job.run(streams.admission_input(streams.read_stream(spark, root, "events", 1))).collect()
    out = {r["event_id"]: r for r in rows}
    assert len(rows) == 7 and all(r["allowed"] is not None for r in rows)
    assert [e for e, r in out.items() if r["late"]] == [42]
    assert [r["event_id"] for r in job.late_rows().collect()] == [42]
    carried = sum(r["cost"] for e, r in out.items() if e in (7, 14, 21, 28, 35) and r["allowed"])
    assert out[63]["du_before"] >= carried


def test_late_attempts_are_kept_aside(spark, tmp_path):
    # event_id % 4 == 1 -> openai; 'error' events are failures; attempt_s = event_id * 7
    day = dt.datetime(2024, 1, 1)
    b1 = [(k, day, 0, "error", 1.0, "{}") for k in (1, 9, 13)]
    b2 = [(5, day, 0, "error", 1.0, "{}"), (17, day, 0, "click", 1.0, "{}")]
    root = _write_batches(str(tmp_path), [b1, b2])
    job = streams.breaker_stream(spark, 0.0)
    out = {r["attempt_id"]: r for r in job.run(streams.breaker_input(streams.read_stream(spark, root, "events", 1))).collect()}
    late = [r["attempt_id"] for r in job.late_rows().collect()]
    assert sorted([*out, *late]) == [1, 5, 9, 13, 17] and late == [5]
    assert out[13]["failures_after"] == 3 and out[13]["trip_set"] and out[17]["failures_after"] == 0


def test_empty_stream(spark, tmp_path):
    root = _write_batches(str(tmp_path), [pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype="datetime64[us]"), "user_id": pd.Series([], dtype="int64"),
                                                        "event_type": pd.Series([], dtype="str"), "value": pd.Series([], dtype="float64"), "props": pd.Series([], dtype="str")})])
    assert streams.stream_budget_admission(spark, root).count() == 0
    assert streams.stream_breaker(spark, root).count() == 0


REQUESTS = "team_id string, ts timestamp_ntz, event_id long, est_cost decimal(28,11), cost decimal(28,11)"
ONE = Decimal(1)


class Files:
    """A table that grows by files, read as a stream."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def test_admission_state_is_carried_and_rows_wait(spark, tmp_path):
    table = Files(spark, str(tmp_path / "r"), REQUESTS)
    job = admission.AdmissionStream(spark, 3600, config.GatewaySettings(team_budgets=(("t", "3", "100"),)))
    at = lambda h: dt.datetime(2024, 1, 1, h)
    decided = lambda: {r.event_id: r.allowed for r in job.results().collect()}
    table.add([("t", at(2), 2, ONE, ONE), ("t", at(0), 0, ONE, ONE), ("idle", at(0), 90, ONE, ONE)])
    job.advance(table.stream())
    assert decided() == {0: True}  # the newest may still be overtaken, an idle team's only row too
    table.add([("t", at(1), 1, ONE, ONE), ("t", at(4), 4, ONE, ONE), ("t", at(3), 3, ONE, ONE), ("t", None, 80, ONE, ONE)])
    job.advance(table.stream())
    assert decided() == {0: True, 1: True, 2: True, 80: True}  # (1, at one, isn't late: at one the mark stood at one)
    job.advance(table.stream())  # nothing new: nothing is decided twice
    job.release(table.stream())
    assert decided() == {0: True, 1: True, 2: True, 3: False, 4: False, 80: True, 90: True}
    table.add([("t", at(2), 7, ONE, ONE), ("t", dt.datetime(2024, 1, 2), 8, ONE, ONE)])
    job.advance(table.stream())
    job.release(table.stream())
    out = {r.event_id: r for r in job.results().collect()}
    assert len(out) == 9 and out[7].late and not out[7].allowed and out[8].allowed and not out[8].late


def test_spend_of_months_that_are_over_leaves_the_state(spark, tmp_path):
    """A year of days, a micro-batch each month: months go from the state, requests of them are denied as expired."""
    table = Files(spark, str(tmp_path / "r"), REQUESTS)
    job = admission.AdmissionStream(spark, 0, config.GatewaySettings(team_budgets=(("t", "1", "1000"),)), keep_s=5 * 86400)
    day, n = dt.datetime(2023, 1, 1), 0
    for month in range(5):
        rows = []
        while day.month == month + 1:
            rows += [("t", day + dt.timedelta(hours=h), n + h, ONE, ONE) for h in range(2)]
            day, n = day + dt.timedelta(days=1), n + 2
        table.add(rows)
    table.add([("t", dt.datetime(2023, 2, 3), 9000, ONE, ONE), ("t", dt.datetime(2023, 5, 3, 9), 9001, ONE, ONE)])
    job.run(table.stream())
    out = {r.event_id: r for r in job.results().collect()}
    assert [out[k].allowed for k in range(n)] == [True, False] * (n // 2)
    assert (out[9000].allowed, out[9000].denied_by, out[9000].late) == (False, "expired", True)
    assert (out[9001].denied_by, out[9001].late) == ("daily", True)
    state = spark.read.format("statestore").option("path", f"{job.base}/checkpoint").option("stateVarName", "spent").load()
    days = [r.user_map_key.day if hasattr(r, "user_map_key") else r.user_map_value for r in state.collect()]
    assert 28 <= len(days) <= 62


# ---- T4: ends of cooldowns --------------------------------------------------------------------------------------------------------

ATTEMPTS = "provider string, attempt_id long, attempt_s long, outcome string"


@pytest.mark.parametrize("pieces", [1, 6])
def test_breaker_reports_the_end_of_a_cooldown(spark, pieces):
    """At every instant the last report of a provider (trip, attempt or end of the cooldown) tells whether it is open, as A8 does."""
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(120):
        t += rng.choice([1, 5, 20, 59, 60, 61, 62, 200])
        rows.append((rng.choice("aab"), k, t, rng.choice(["error", "error", "error", "ok"])))
    job = streams.breaker_stream(spark, 0.0)
    size = -(-len(rows) // pieces)
    for epoch in range(pieces):
        job._epoch(spark.createDataFrame(rows[epoch * size: (epoch + 1) * size], ATTEMPTS), epoch)
    job._epoch(None, pieces, flush=True)
    out = spark.read.parquet(f"{job.base}/out").collect()
    ends = sorted((r.provider, r.attempt_s) for r in out if r.outcome == "closed")
    assert len(ends) == len(set(ends)) > 3
    for provider in "ab":
        own = [r for r in rows if r[0] == provider]
        failures, trip = 0, None
        want = []
        for (_, _, s, outcome), after in zip(own, [*own[1:], (0, 0, rows[-1][2], "")], strict=True):
            if trip is not None and s - trip > 60:
                failures = 0
            failures, trip = (0, None) if outcome == "ok" else (failures + 1, trip)
            trip = s if failures >= 3 else None
            if trip is not None and after[2] - trip > 60:
                want.append((provider, trip + 60))
        assert [e for e in ends if e[0] == provider] == want


# ---- T5: the index of written ids ----------------------------------------------------------------------------------------------------

def test_an_epoch_reads_only_its_days_of_the_index(spark, tmp_path):
    """20 epochs of a day each, with repeats of the day before: what is read stays the same, and nothing is known twice."""
    index = id_index.IdIndex(spark, str(tmp_path / "index"), buckets=2, folders=3)
    read, known = [], []
    for epoch in range(20):
        day = lambda k: f"2024-01-{k + 1:02d}"
        batch = spark.createDataFrame([(day(epoch), str(epoch * 100 + k)) for k in range(50)] + [(day(max(epoch - 1, 0)), str(max(epoch - 1, 0) * 100 + k)) for k in range(5)], "day string, id string")
        places = index.places(batch, "day", "id")
        seen = index.known(places, epoch)
        read.append(0 if seen is None else len(seen.inputFiles()))
        known.append(0 if seen is None else batch.join(seen, ["day", "id"], "left_semi").count())
        for _ in range(2):  # a replay changes nothing
            index.add(batch, "day", "id", epoch)
            index.compact(places, epoch)
    assert known == [0] + [5] * 19
    assert max(read) <= 4  # two days of two buckets, after 20 epochs as after two


def test_finished_epochs_of_a_bucket_become_one_folder(spark, tmp_path):
    index = id_index.IdIndex(spark, str(tmp_path / "index"), buckets=1, folders=4)
    for epoch in range(30):
        batch = spark.createDataFrame([("2024-01-01", f"{epoch}-{k}") for k in range(3)], "day string, id string")
        places = index.places(batch, "day", "id")
        index.add(batch, "day", "id", epoch)
        index.compact(places, epoch)
        assert len(index._epochs(places[0])) <= 6
    assert index.known([("2024-01-01", 0)], 30).distinct().count() == 90
    assert index.known([("2024-01-02", 0)], 30) is None
