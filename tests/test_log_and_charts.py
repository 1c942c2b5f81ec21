"""The log's tail, the chart's bins, request bodies and keys: literals and counts of what is read."""

import os
import random

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tollgate import config
from tollgate.operators import auth, reports
from tollgate.plans import catalog
from tollgate.sources import audit_io, dims, traffic
from tollgate.streaming import streams

LINES = "seq long, day string, line string"


def _log(spark, path, rows):
    """rows: (seq, day); a line each as the log has them."""
    audit_io.write_lines(spark.createDataFrame([(s, d, '{"seq":%d,"request_id":"%d"}' % (s, s)) for s, d in rows], LINES), path)


def _days(df):
    return {f.split("day=")[1].split("/")[0] for f in df.inputFiles()}


def _seqs(df, n):
    return [r.seq for r in df.orderBy(F.desc("seq")).limit(n).collect()]


def test_tail_reads_the_newest_days_only(spark, tmp_path):
    path = str(tmp_path / "log")
    _log(spark, path, [(k, f"2024-01-{1 + k // 50:02d}") for k in range(1000)])  # 20 days of 50 lines
    for n, days in ((1, 1), (50, 1), (51, 2), (120, 3)):
        got = audit_io.newest_lines(spark, path, n)
        assert len(_days(got)) == days and _seqs(got, n) == list(range(999, 999 - n, -1))
    assert len(_days(audit_io.newest_lines(spark, path, 5000))) == 20


@pytest.mark.parametrize("seed", [1, 2])
def test_tail_of_a_log_whose_days_overlap(spark, tmp_path, seed):
    """Entries of old days that came late: as by a scan of the whole log, over several appends."""
    rng, path = random.Random(seed), str(tmp_path / "log")
    rows = [(k, f"2024-01-{max(1, k // 40 - rng.choice([0, 0, 0, 0, 1, 9])) + 1:02d}") for k in range(600)]
    for part in (rows[:200], rows[200:210], rows[210:]):
        _log(spark, path, part)
    for n in (1, 10, 100, 599):
        assert _seqs(audit_io.newest_lines(spark, path, n), n) == _seqs(audit_io.read_lines(spark, path), n)
    assert len(_days(audit_io.newest_lines(spark, path, 10))) < len(_days(audit_io.read_lines(spark, path)))


def test_tail_without_a_record_of_what_was_written(spark, tmp_path):
    os.makedirs(tmp_path / "day=2024-01-01")
    (tmp_path / "day=2024-01-01" / "a.txt").write_text('{"seq":1,"x":2}\n\n{"seq":2,"x"\n')
    assert _seqs(audit_io.newest_lines(spark, str(tmp_path), 5), 5) == [2, 1]


def test_json_log_keeps_its_record_aside(spark, tmp_path):
    path = str(tmp_path / "log")
    audit_io.write_jsonl(catalog.audit_log(spark, SF001), path)
    assert audit_io.read_jsonl(spark, path).count() == 1000
    assert _seqs(audit_io.newest_lines(spark, path, 30), 30) == _seqs(audit_io.read_lines(spark, path), 30)


# ---- A7 ---------------------------------------------------------------------------------------------------------------------

def _bins(spark, values, bins=30):
    out = reports.nice_histogram(spark.createDataFrame([(v, 1) for v in values], "x double, n long"), bins).orderBy("bin_start").collect()
    return [(r.bin_start, r.bin_end, r["count"]) for r in out]


@pytest.mark.parametrize("values,width,first,bins", [
    ([0.0, 29.0], 1, 0, 30), ([0.0, 30.0], 2, 0, 30), ([3.0, 32.9], 1, 3, 30), ([0.0, 59.9], 2, 0, 30), ([0.0, 60.0], 5, 0, 30), ([0.0, 149.9], 5, 0, 30),
    ([0.0, 150.0], 10, 0, 30), ([-7.0, 7.0], 0.5, -7.0, 30), ([0.0, 0.02], 0.001, 0, 30), ([1000.0, 1e6], 50000, 0, 30), ([450.0, 451.0], 0.05, 450, 30),
    ([0.0, 9.0], 5, 0, 2), ([0.1, 0.4], 0.02, 0.1, 30)])
def test_nice_bins(spark, values, width, first, bins):
    got = _bins(spark, values, bins)
    assert got[0][0] == pytest.approx(first) and all(b - a == pytest.approx(width) for a, b, _ in got)
    assert got[0][0] <= values[0] < got[0][1] and got[-1][0] <= values[-1] < got[-1][1]
    assert round((got[-1][1] - got[0][0]) / width) <= bins


def test_nice_bins_count_every_value(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random() * 500, float(rng.randrange(500)), 250.0]) for _ in range(2000)]
    got = _bins(spark, values)
    assert sum(n for *_, n in got) == 2000
    for a, b, n in got:
        assert n == sum(a <= v < b for v in values)
    assert _bins(spark, [5.0, 5.0, 5.0]) == [(5.0, 6.0, 3)]
    assert _bins(spark, [float("nan")]) == [] and spark.createDataFrame([], "x double, n long").transform(reports.nice_histogram).count() == 0


def test_counts_of_micro_batches_add_up(spark, tmp_path):
    pdf = spark.read.parquet(f"{SF001}/events.parquet").toPandas()
    os.makedirs(tmp_path / "events.parquet")
    for k in range(3):
        pdf.iloc[k::3].to_parquet(tmp_path / "events.parquet" / f"{k}.parquet", index=False, coerce_timestamps="us")
    got = sorted(map(tuple, streams.stream_latency_histogram(spark, str(tmp_path), max_files=1).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["latency_histogram_nice"](spark, SF001).collect()))


# ---- requests and keys ---------------------------------------------------------------------------------------------------------

def test_every_conversation_is_ingested_whole(spark):
    """Each with its own body; malformed ones are extra requests."""
    bodies = {r.request_id: r.body for r in catalog.request_bodies(spark, SF001).collect()}
    conv = spark.read.parquet(f"{SF001}/conversations.parquet").collect()
    assert {i for i in bodies if i >= 0} == {r.conv_id for r in conv}
    assert {-1 - i for i in bodies if i < 0} == {r.conv_id for r in conv if 1 <= r.conv_id % 17 <= 13}
    out = {r.request_id: r for r in auth.ingest(catalog.request_bodies(spark, SF001)).collect()}
    for i in {r.conv_id for r in conv}:
        want = [(r.role, r.text) for r in sorted((r for r in conv if r.conv_id == i), key=lambda r: r.turn)]
        assert [(m.role, m.content) for m in out[i].messages] == want


def test_nobody_is_let_in_by_default(spark):
    r = spark.createDataFrame([(1, traffic.SAMPLE_KEYS[0]), (2, ""), (3, None)], "request_id long, api_key string")
    status = lambda **k: {x.request_id: x.http_status for x in auth.with_team_from_key(r, **k).collect()}
    assert dims.key_dim(spark).count() == 0
    assert status() == {1: 403, 2: 401, 3: 401}
    assert status(keys=traffic.sample_keys(spark)) == {1: 200, 2: 401, 3: 401}
    own = config.GatewaySettings(team_keys=((traffic.sample_keys(spark).first().key_sha256, "us"),))
    assert [x.key_team_id for x in auth.with_team_from_key(r, keys=dims.key_dim(spark, own)).where("request_id = 1").collect()] == ["us"]
