"""Budget usage, status and admission.

The usage store of the gateway (team -> day -> cost/count, team -> month ->
cost) becomes two small aggregate tables.  Aggregations run as partial +
final hash aggregates, so a team holding a third of all traffic is reduced
map-side before the shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate import config
from tollgate.functions.money import COST_T, LIMIT_T, day_key, denial_reason, month_key, remaining, usd
from tollgate.operators.asof import asof_join
from tollgate.operators.chaining import AMOUNTS, Doubts, Span, chained, decimals, doubts, summaries, whole_numbers
from tollgate.operators.fold import NO_DAY, SCALE, STEP, admit, greatest_spend
from tollgate.session import default_partitions, materialize, ship_package
from tollgate.sources.dims import budget_dim


def daily_usage(costed: DataFrame) -> DataFrame:
    """A1: recorded spend and request count per (team, day), exact decimals.

    Usage is recorded after a successful response, so only ``success`` rows count.
    """
    return (costed.where(F.col("status") == "success")
            .groupBy("team_id", day_key(F.col("ts")).alias("day"))
            .agg(F.sum("cost").cast(COST_T).alias("cost"), F.count(F.lit(1)).alias("n_requests")))


def monthly_usage(daily: DataFrame) -> DataFrame:
    """A2: rolled up from A1 (teams x days rows, never the raw traffic)."""
    return (daily.groupBy("team_id", month_key(F.col("day")).alias("month"))
            .agg(F.sum("cost").cast(COST_T).alias("cost"), F.sum("n_requests").alias("n_requests")))


def with_limits(df: DataFrame, settings: config.GatewaySettings = config.DEFAULT_SETTINGS, limits: DataFrame | None = None) -> DataFrame:
    """A team's limits or the defaults.

    ``limits`` (team_id, daily_limit, monthly_limit; one row a team) is any table of budgets, such as S9's; without one the
    settings' own, a few rows that are broadcast.  The former grows with the teams, so whether to broadcast it is left to its size at run
    time: rows of which a team may have very many should be joined by more than the team (see ``budget_admission``).
    """
    limits = F.broadcast(budget_dim(df.sparkSession, settings)) if limits is None else limits
    limits = limits.select(F.col("team_id").alias("_bt"), F.col("daily_limit").cast(LIMIT_T).alias("daily_limit"),
                           F.col("monthly_limit").cast(LIMIT_T).alias("monthly_limit"))
    return (df.join(limits, F.col("team_id") == F.col("_bt"), "left")
            .withColumn("daily_limit", F.coalesce("daily_limit", F.lit(settings.default_daily_budget_usd).cast(LIMIT_T)))
            .withColumn("monthly_limit", F.coalesce("monthly_limit", F.lit(settings.default_monthly_budget_usd).cast(LIMIT_T)))
            .withColumn("configured", F.col("_bt").isNotNull())
            .drop("_bt"))


def limits_asof(requests: DataFrame, changes: DataFrame, settings: config.GatewaySettings = config.DEFAULT_SETTINGS, partitions: int | None = None) -> DataFrame:
    """S9 and J3 in time: each request with the limits in force at its ts, those of its team's newest change at or before it.

    ``changes``: the log that limits are set in (team_id, ts, seq, daily_limit, monthly_limit); of changes of one instant the one of
    the largest seq counts.  Before a team's first change, and for requests without a ts, the settings' limits hold.
    """
    found = asof_join(requests, changes.withColumns({"daily_limit": F.col("daily_limit").cast(LIMIT_T), "monthly_limit": F.col("monthly_limit").cast(LIMIT_T)}),
                      "team_id", "ts", ("event_id", "seq"), ("daily_limit", "monthly_limit"), partitions)
    found = found.withColumnsRenamed({"daily_limit": "_daily", "monthly_limit": "_monthly"})
    first = with_limits(found, settings)
    return first.withColumns({"daily_limit": F.coalesce("_daily", "daily_limit"), "monthly_limit": F.coalesce("_monthly", "monthly_limit"),
                              "configured": F.col("configured") | F.col("_daily").isNotNull()}).drop("_daily", "_monthly")


def _status_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "team_id", "as_of",
        F.col("daily_limit").cast("double").alias("daily_limit_usd"),
        F.col("monthly_limit").cast("double").alias("monthly_limit_usd"),
        usd(F.col("daily_used")).alias("daily_used_usd"),
        usd(F.col("monthly_used")).alias("monthly_used_usd"),
        remaining(F.col("daily_limit"), F.col("daily_used")).cast("double").alias("daily_remaining_usd"),
        remaining(F.col("monthly_limit"), F.col("monthly_used")).cast("double").alias("monthly_remaining_usd"),
        F.col("request_count_today"), F.col("request_count_month"),
    )


def _usage_as_of(daily: DataFrame, as_of) -> DataFrame:
    """Per team with any usage: spend/count on ``as_of`` and in its month.

    One conditional aggregate over A1 (teams x days rows): a team with usage
    only in other periods still appears, with zeros.
    """
    same_day = F.col("day") == as_of
    same_month = month_key(F.col("day")) == month_key(as_of)
    zero = F.lit(0).cast(COST_T)
    return (daily.groupBy("team_id")
            .agg(F.coalesce(F.sum(F.when(same_day, F.col("cost"))), zero).cast(COST_T).alias("daily_used"),
                 F.coalesce(F.sum(F.when(same_month, F.col("cost"))), zero).cast(COST_T).alias("monthly_used"),
                 F.coalesce(F.sum(F.when(same_day, F.col("n_requests"))), F.lit(0)).cast("bigint")
                 .alias("request_count_today"),
                 F.coalesce(F.sum(F.when(same_month, F.col("n_requests"))), F.lit(0)).cast("bigint")
                 .alias("request_count_month")))


def last_day(daily: DataFrame):
    """The newest usage day as a scalar subquery (no driver round trip)."""
    return daily.select(F.max("day")).scalar()


def team_budget_status(daily: DataFrame, as_of=None, settings: config.GatewaySettings = config.DEFAULT_SETTINGS,
                       limits: DataFrame | None = None) -> DataFrame:
    """A3: limits, used, remaining and counts for every team with usage, as of a day.

    ``request_count_month`` is filled with the real count (the gateway declares
    it but leaves it 0).
    """
    as_of = last_day(daily) if as_of is None else F.lit(as_of).cast("date")
    base = _usage_as_of(daily, as_of).withColumn("as_of", as_of)
    return _status_columns(with_limits(base, settings, limits))


def all_teams_budget(daily: DataFrame, as_of=None, settings: config.GatewaySettings = config.DEFAULT_SETTINGS,
                     limits: DataFrame | None = None) -> DataFrame:
    """Configured teams FULL OUTER JOIN teams with usage, then their status.

    This is what the gateway's all-teams listing intends (its own version
    deadlocks on a non-reentrant lock).
    """
    as_of = last_day(daily) if as_of is None else F.lit(as_of).cast("date")
    known = budget_dim(daily.sparkSession, settings) if limits is None else limits
    configured = known.select(F.col("team_id").alias("cfg_team"))
    used = _usage_as_of(daily, as_of).withColumnRenamed("team_id", "use_team")
    zero = F.lit(0).cast(COST_T)
    base = (configured.join(used, F.col("cfg_team") == F.col("use_team"), "full_outer")
            .select(F.coalesce("cfg_team", "use_team").alias("team_id"),
                    F.coalesce("daily_used", zero).alias("daily_used"),
                    F.coalesce("monthly_used", zero).alias("monthly_used"),
                    F.coalesce("request_count_today", F.lit(0).cast("bigint")).alias("request_count_today"),
                    F.coalesce("request_count_month", F.lit(0).cast("bigint")).alias("request_count_month"))
            .withColumn("as_of", as_of))
    return _status_columns(with_limits(base, settings, limits))


# -- W2: budget admission -------------------------------------------------------

FOLD_ROWS = 1_000_000


_IN = ["team_id", "month", "day", "ts", "event_id", "est_cost", "cost", "daily_limit", "monthly_limit"]
_HOT_IN = ["_key", *(c for c in _IN if c != "month")]
_OUT = ["team_id", "ts", "event_id", "est_cost", "cost", "daily_limit", "monthly_limit"]


def _decimals(values: np.ndarray) -> pa.Array:
    """Whole numbers of 1e-11 as decimal(37,11)."""
    return decimals(values, pa.decimal128(37, SCALE))


def _fold(batches: Iterator[pa.RecordBatch]):
    """Admission over rows sorted by (team, month, ts, event_id); the spend is carried from batch to batch."""
    last, day_at, spent_day, spent_month = None, None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        month, team = b.column("month").to_numpy(zero_copy_only=False), b.column("team_id").to_numpy(zero_copy_only=False)
        day = b.column("day").cast(pa.int32()).fill_null(NO_DAY).to_numpy()
        est, act, daily, monthly = (whole_numbers(b.column(c), c == "cost") for c in ("est_cost", "cost", "daily_limit", "monthly_limit"))
        if any(x.dtype == object for x in (est, act, daily, monthly)) or max(int(spent_day), int(spent_month)) > 1 << 61:
            est, act, daily, monthly = (x.astype(object) for x in (est, act, daily, monthly))
        cuts = [0, *(np.flatnonzero((month[1:] != month[:-1]) | (team[1:] != team[:-1])) + 1).tolist(), b.num_rows]
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if (team[lo], month[lo]) != last:
                last, spent_day, spent_month = (team[lo], month[lo]), 0, 0
            elif day[lo] != day_at:
                spent_day = 0
            allowed, du, mu, spent_day, spent_month = admit(est[lo:hi], act[lo:hi], day[lo:hi], daily[lo:hi], monthly[lo:hi], spent_day, spent_month)
            day_at = day[hi - 1]
            out.append((allowed, du, mu))
        allowed, du, mu = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _OUT), pa.array(allowed), _decimals(du), _decimals(mu)],
                                         names=[*_OUT, "allowed", "du_before", "mu_before"])


def _decided_schema(rows: DataFrame):
    # the folds pass the columns through, so that their output needn't be joined back
    return rows.select(*_OUT).withColumns({"allowed": F.lit(True), "du_before": F.lit(0).cast(COST_T), "mu_before": F.lit(0).cast(COST_T)}).schema


def _fold_months(rows: DataFrame, partitions: int) -> DataFrame:
    schema = _decided_schema(rows)
    return (rows.select(*_IN).repartition(partitions, "team_id", "month").sortWithinPartitions("team_id", "month", "ts", "event_id")
            .mapInArrow(_fold, schema))


def _chunk_fold(batches: Iterator[pa.RecordBatch], decide: bool):
    """Admission over rows sorted by (chunk, team-month, ts, event_id), each chunk from the start that stands beside its rows.
    Returns every row's decision or, with ``decide`` off, a summary of each chunk."""
    span, day_at, spent_day, spent_month, done = None, None, 0, 0, []
    for b in batches:
        if not b.num_rows:
            continue
        chunk, key = b.column("_chunk").to_numpy(), b.column("_key").to_numpy()
        day = b.column("day").cast(pa.int32()).fill_null(NO_DAY).to_numpy()
        start_d, start_m = (whole_numbers(b.column(c), sums=False) for c in ("start_d", "start_m"))
        est, act, daily, monthly = (whole_numbers(b.column(c), c == "cost") for c in ("est_cost", "cost", "daily_limit", "monthly_limit"))
        if any(x.dtype == object for x in (est, act, daily, monthly, start_d, start_m)) or max(int(spent_day), int(spent_month)) > 1 << 61:
            est, act, daily, monthly = (x.astype(object) for x in (est, act, daily, monthly))
        most_d, most_m = greatest_spend(est, daily, STEP), greatest_spend(est, monthly, STEP)
        cuts = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), b.num_rows]
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if span is None or (span.chunk, span.key) != (int(chunk[lo]), int(key[lo])):
                span = Span(int(key[lo]), int(chunk[lo]), int(start_d[lo]), int(start_m[lo]))
                done.append(span)
                spent_day, spent_month = span.start_d, span.start_m
            elif day[lo] != day_at:
                spent_day = 0
            at = slice(lo, hi)
            allowed, du, mu, spent_day, spent_month = admit(est[at], act[at], day[at], daily[at], monthly[at], spent_day, spent_month)
            day_at = day[hi - 1]
            if decide:
                out.append((allowed, du, mu))
            else:
                span.add(day[at], allowed, du, mu, most_d[at], most_m[at], spent_day, spent_month)
        if decide:
            allowed, du, mu = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _OUT), pa.array(allowed), _decimals(du), _decimals(mu)],
                                             names=[*_OUT, "allowed", "du_before", "mu_before"])
    if not decide:
        yield summaries(done)


def _doubt_fold(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by (chunk, team-month, ts, event_id), each chunk from the range of starts that stands beside its rows: what isn't
    decided alike for the whole range."""
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        chunk, key = b.column("_chunk").to_numpy(), b.column("_key").to_numpy()
        day = b.column("day").cast(pa.int32()).fill_null(NO_DAY).to_numpy()
        est, act, daily, monthly = (whole_numbers(b.column(c), c == "cost") for c in ("est_cost", "cost", "daily_limit", "monthly_limit"))
        if any(x.dtype == object for x in (est, act, daily, monthly)):
            est, act, daily, monthly = (x.astype(object) for x in (est, act, daily, monthly))
        most_d, most_m = greatest_spend(est, daily), greatest_spend(est, monthly)
        bounds = [whole_numbers(b.column(c)) for c in ("low_d", "high_d", "low_m", "high_m")]
        cuts = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), b.num_rows]
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if at is None or (at.chunk, at.key) != (int(chunk[lo]), int(key[lo])):
                out += at.taken(last=True) if at else []
                at = Doubts(int(key[lo]), int(chunk[lo]), int(day[lo]), *(int(x[lo]) for x in bounds))
            at.add(day[lo:hi], act[lo:hi], most_d[lo:hi], most_m[lo:hi])
        yield doubts(out + at.taken(last=False))
    yield doubts(at.taken(last=True) if at else [])


def _hot_months(rows: DataFrame, order: DataFrame, partitions: int, trace: list[int] | None = None) -> DataFrame:
    """Admission of team-months with too many rows for a task, chunk by chunk (see ``chaining``)."""
    found = chained(rows.select(*_HOT_IN), order, functools.partial(_chunk_fold, decide=False), _doubt_fold, functools.partial(_chunk_fold, decide=True), _decided_schema, partitions, trace)
    return found.withColumns({c: F.col(c).cast(COST_T) for c in AMOUNTS})


def budget_admission(requests: DataFrame, settings: config.GatewaySettings = config.DEFAULT_SETTINGS, partitions: int | None = None,
                     limits: DataFrame | None = None, fold_rows: int = FOLD_ROWS, changes: DataFrame | None = None, trace: list[int] | None = None) -> DataFrame:
    """Per request, in (ts, event_id) order per team: allowed?, reason, spend before.

    ``requests``: team_id, ts, event_id, est_cost (checked before the call), cost (spent after an admitted call; 0 for a
    failed one).  Every request is decided.  One is admitted when its estimate is <= what is left of the day's limit and then of the
    month's (each rounded to 6 places, floored at 0); the counters reset at UTC midnight and month start.
    Requests without a ts have a period of their own and spend nothing of any other.  Limits are those of ``limits`` (a row a team) or,
    with a log of ``changes``, those in force at each request's time (``limits_asof``).

    That is a greedy fold over a team's month.  A team-month of at most ``fold_rows`` requests is folded in one task, streamed
    and vectorised.  Larger ones (a team with a third of all traffic) never meet in a task: their chunks are folded side by side from
    guessed starts, and again where a guess proves wrong (``chaining``).  ``trace`` gets the rows folded in each of these rounds.
    """
    spark = requests.sparkSession
    ship_package(spark)
    n = partitions or default_partitions(spark)
    requests = requests.select("team_id", "ts", "event_id", "est_cost", "cost")

    first = F.trunc(day_key(F.col("ts")), "month")
    its = F.col("team_id").eqNullSafe(F.col("_ht")) & first.eqNullSafe(F.col("_hf"))

    def with_periods(rows: DataFrame, months: DataFrame) -> DataFrame:
        def as_amounts(df: DataFrame) -> DataFrame:
            return df.withColumns({c: F.col(c).cast(COST_T) for c in AMOUNTS if c in df.columns})

        months = as_amounts(months).withColumnsRenamed({"team_id": "_ht", "_first": "_hf"}).drop("n", "configured")
        rows = rows if changes is None else limits_asof(rows, changes, settings, n)
        return as_amounts(rows).join(months, its).withColumn("day", day_key(F.col("ts")))

    # a row per team and month, with its limits unless these change within it: so rows get theirs by team and month, broadcast for the large
    sizes = requests.groupBy("team_id", first.alias("_first")).agg(F.count(F.lit(1)).alias("n")).withColumn("month", month_key(F.col("_first")))
    sizes = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("team_id", "month")))
    sizes = materialize(sizes if changes is not None else with_limits(sizes, settings, limits), "admission-sizes")
    # the large are few, one in fold_rows requests at most: they are numbered
    hot, cold = sizes.where(F.col("n") > fold_rows), sizes.where(F.col("n") <= fold_rows)
    hot = F.broadcast(hot.withColumn("_key", F.dense_rank().over(Window.orderBy("team_id", "month"))))
    if sizes.where(F.col("n") > fold_rows).isEmpty():
        return explain(_fold_months(with_periods(requests, sizes), n))
    # limits are found for the small and the large apart, so that neither pays for the other's rows
    large, small = (requests.join(x.select(F.col("team_id").alias("_ht"), F.col("_first").alias("_hf")), its, "left_semi") for x in (hot, cold))
    decided = _hot_months(with_periods(requests if changes is None else large, hot), large.select("ts", "event_id"), n, trace)
    if not cold.isEmpty():
        decided = decided.unionByName(_fold_months(with_periods(requests if changes is None else small, cold), n))
    return explain(decided)


def explain(out: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The deciding limit and its text, from the spend before each request: the day's is checked first."""
    kind = F.when(F.col("allowed"), None).when(F.col("est_cost") > remaining(F.col("daily_limit"), F.col("du_before")), "daily").otherwise("monthly")
    reason = F.when(kind == "daily", denial_reason(F.lit("daily"), F.col("team_id"), F.col("du_before"), F.col("daily_limit"))) \
        .when(kind == "monthly", denial_reason(F.lit("monthly"), F.col("team_id"), F.col("mu_before"), F.col("monthly_limit"))).otherwise(F.lit(""))
    return out.select("event_id", "team_id", "ts", "est_cost", "cost", "allowed", kind.alias("denied_by"), reason.alias("reason"), "du_before", "mu_before",
                      "daily_limit", "monthly_limit", *keep)
