"""Circuit breaker replay (W3), provider health (A8) and display state.

Breaker rules (per provider): an attempt first checks expiry -- if the breaker
is tripped and more than the cooldown has passed since the trip, failures
reset to 0 -- then a success resets failures, a failure adds one and, at
``threshold`` or more, (re)sets the trip time to now.

Because every failure at or above the threshold re-trips, a tripped breaker's
trip time is always the provider's previous attempt.  The state is therefore
just the consecutive-failure count ``c``, and the fold over a provider's
attempts composes over chunks: a chunk's behaviour depends on its start state
only through ``min(c, threshold)`` and, when tripped, whether its first
attempt finds the trip expired.

Distributed plan (no provider ever lands whole in one task, and nothing is checkpointed):
1. cut the attempts into chunks along time (a pure function of the row, see ``prefix``) and fold every (chunk, provider)
   from each of the ``threshold + 1`` start classes at once, keeping only its summary;
2. chain the summaries per provider (a row per chunk and provider) to get each chunk's real start state;
3. fold each chunk again from that state, now row by row exact.
Provider health needs the first two steps only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.operators.prefix import with_chunk
from tollgate.session import default_partitions, ship_package

def _compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of per-row state maps (row i applied after row i-1).

    ``maps`` has shape (n, k): row i maps a state s to maps[i, s].  Returns P with
    P[i] = maps[i] o ... o maps[0], by log-depth doubling (numpy, no per-row loop).
    """
    p = maps.copy()
    step = 1
    while step < len(p):
        p[step:] = np.take_along_axis(p[step:], p[:-step], axis=1)
        step *= 2
    return p


def _fold_run(t, ok, prev_t, carry_s, carry_c, carry_rel, threshold, cooldown):
    """Fold one provider run (or its continuation in a new batch) from every start class at once.

    State per class k is the failure count capped at ``threshold`` (the only thing the rules look
    at), carried in ``carry_s``; exact counts come from cumulative errors since the last reset.
    Returns per-class arrays c (exact), trip, expired, rel and the carry for the next batch.
    """
    n = len(t)
    k = threshold + 1
    err = ~ok
    gaps = np.empty(n, dtype=bool)
    gaps[0] = prev_t is not None and t[0] - prev_t > cooldown
    gaps[1:] = np.diff(t) > cooldown
    # three possible maps on capped states 0..threshold
    states = np.arange(k)
    on_ok = np.zeros(k, dtype=np.int64)
    on_err = np.minimum(states + 1, threshold)
    on_err_gap = np.where(states >= threshold, 1, np.minimum(states + 1, threshold))
    maps = np.where(ok[:, None], on_ok[None, :], np.where(gaps[:, None], on_err_gap[None, :], on_err[None, :]))
    after = _compose_scan(maps)                       # (n, k): capped state after row i from start state s
    after = after[:, carry_s]                         # start states of the classes, as carried
    before = np.vstack([carry_s[None, :], after[:-1]])
    expired = gaps[:, None] & (before >= threshold)
    reset = ok[:, None] | expired
    trip = err[:, None] & (after >= threshold)
    idx = np.arange(n)[:, None]
    last = np.maximum.accumulate(np.where(reset, idx, -1), axis=0)
    e_cum = np.cumsum(err)
    lj = np.maximum(last, 0)
    since = e_cum[:, None] - e_cum[lj] + err[lj].astype(np.int64)
    c = np.where(last >= 0, since, carry_c[None, :] + e_cum[:, None])
    rel = carry_rel[None, :] & (last < 0)
    return c, trip, expired, rel, after[-1], c[-1], rel[-1]


def _runs(batches):
    """(provider, chunk, times, is ok, row numbers, batch, begins) for each (chunk, provider) run of a sorted stream, a batch at a time."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        chunk, prov = pdf["_chunk"].to_numpy(), pdf["provider"].to_numpy()
        t, ok = pdf["attempt_s"].to_numpy(dtype=np.int64), (pdf["outcome"] == "ok").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (prov[1:] != prov[:-1]) | (chunk[1:] != chunk[:-1]), True])
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (int(chunk[a]), prov[a])
            yield key, t[a:b], ok[a:b], slice(a, b), pdf, key != last
            last = key


def _summary_schema(threshold: int) -> str:
    return "provider string, _chunk int, first_t long, last_t long, " + ", ".join(f"end_c{k} long" for k in range(threshold + 1)) + ", end_rel boolean"


def _summaries(threshold: int, cooldown: int):
    """Each (chunk, provider) folded from every start class: counts at its end.  Class ``threshold`` means tripped and not
    expired at the first row; ``end_rel``: its count has seen no reset, so it is relative to the real start."""
    k = threshold + 1

    def run(batches):
        out, key, state = [], None, None
        for key_, t, ok, _, _, begins in _runs(batches):
            if begins:
                if key is not None:
                    out.append((key[1], key[0], first, last, *map(int, state[1]), bool(state[2][threshold])))
                key, first, last = key_, int(t[0]), None
                state = (np.arange(k, dtype=np.int64), np.arange(k, dtype=np.int64), np.ones(k, dtype=bool))
            state = _fold_run(t, ok, last, *state, threshold, cooldown)[4:]
            last = int(t[-1])
        if key is not None:
            out.append((key[1], key[0], first, last, *map(int, state[1]), bool(state[2][threshold])))
        yield pd.DataFrame(out, columns=["provider", "_chunk", "first_t", "last_t", *(f"end_c{i}" for i in range(k)), "end_rel"])
    return run


def _chain(threshold: int, cooldown: int):
    """Start state of every chunk of a provider, and (as chunk of the largest number) the state after the last one.  A row of
    chunk -1 holds the state that the log starts from."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        c, last_t = 0, None
        rows = []
        for r in pdf.itertuples(index=False):
            if r.first_t is None or pd.isna(r.first_t):  # the opening state
                c, last_t = int(r.end_c0), None if pd.isna(r.last_t) else int(r.last_t)
                continue
            rows.append((pdf["provider"].iloc[0], int(r[1]), c, last_t))
            if c >= threshold and last_t is not None and r.first_t - last_t > cooldown:
                c = r.end_c0
            elif c >= threshold:
                end = getattr(r, f"end_c{threshold}")
                c = end - threshold + c if r.end_rel else end
            else:
                c = getattr(r, f"end_c{c}")
            c, last_t = int(c), int(r.last_t)
        rows.append((pdf["provider"].iloc[0], FINAL, c, last_t))
        return pd.DataFrame({"provider": [r[0] for r in rows], "_chunk": np.array([r[1] for r in rows], np.int32), "start_c": [r[2] for r in rows],
                             "start_t": pd.array([r[3] for r in rows], "Int64")})
    return run


FINAL = (1 << 31) - 1


def _refold(threshold: int, cooldown: int, closings: bool):
    def run(batches):
        state = last = None
        parts, at = [], None
        for _, t, ok, rows, pdf, begins in _runs(batches):
            if at is not None and pdf is not at:
                yield pd.concat(parts, ignore_index=True)
                parts = []
            at = pdf
            if begins:
                c = int(pdf["start_c"].iloc[rows.start])
                s = pdf["start_t"].iloc[rows.start]
                last = None if pd.isna(s) else int(s)
                state = (np.array([min(c, threshold)]), np.array([c]), np.zeros(1, dtype=bool))
            count, trip, expired, _, *state = _fold_run(t, ok, last, *state, threshold, cooldown)
            previous = np.concatenate([[0 if last is None else last], t[:-1]])
            last = int(t[-1])
            part = pdf.iloc[rows][["provider", "attempt_id", "attempt_s", "outcome"]].copy()
            part["failures_after"] = count[:, 0]
            part["tripped_at_after"] = pd.array(t, "Int64")
            part.loc[count[:, 0] < threshold, "tripped_at_after"] = pd.NA
            part["trip_set"], part["expired"] = trip[:, 0], expired[:, 0]
            if closings:  # a tripped breaker's trip is the attempt before
                part["closed_at"] = pd.array(previous + cooldown, "Int64")
                part.loc[~expired[:, 0], "closed_at"] = pd.NA
            parts.append(part)
        if parts:
            yield pd.concat(parts, ignore_index=True)
    return run


STATES = "provider string, attempt_id long, attempt_s long, outcome string, failures_after long, tripped_at_after long, trip_set boolean, expired boolean"


def _chunked(attempts: DataFrame, partitions: int | None) -> DataFrame:
    ship_package(attempts.sparkSession)
    a = attempts.where(F.col("outcome").isin("ok", "error")).select("provider", "attempt_id", "attempt_s", "outcome")
    return with_chunk(a, ["attempt_s", "attempt_id"], partitions)


def _dealt(chunked: DataFrame, partitions: int | None) -> DataFrame:
    n = partitions or default_partitions(chunked.sparkSession)
    return chunked.repartition(n, "_chunk").sortWithinPartitions("_chunk", "provider", "attempt_s", "attempt_id")


def _starts(chunked: DataFrame, threshold: int, cooldown_s: int, partitions: int | None, opening: DataFrame | None) -> DataFrame:
    schema = _summary_schema(threshold)
    summary = _dealt(chunked, partitions).mapInPandas(_summaries(threshold, cooldown_s), schema)
    if opening is not None:
        cols = [F.col("failures").cast("long").alias(f"end_c{k}") for k in range(threshold + 1)]
        summary = summary.unionByName(opening.select("provider", F.lit(-1).alias("_chunk"), F.lit(None).cast("long").alias("first_t"),
                                                     F.col("last_t").cast("long").alias("last_t"), *cols, F.lit(False).alias("end_rel")))
    return summary.groupBy("provider").applyInPandas(_chain(threshold, cooldown_s), "provider string, _chunk int, start_c long, start_t long")


def breaker_states(attempts: DataFrame, threshold: int = config.BREAKER_FAILURE_THRESHOLD,
                   cooldown_s: int = config.BREAKER_COOLDOWN_SECONDS, partitions: int | None = None,
                   opening: DataFrame | None = None, closings: bool = False) -> DataFrame:
    """Per attempt (outcome ok/error): failures after, trip time after, trip set, expiry seen.  With ``closings`` also ``closed_at``:
    when the cooldown ended whose expiry the attempt saw.

    ``attempts``: provider, attempt_id, attempt_s (seconds), outcome.  ``opening`` (provider, failures, last_t): the state
    before the first attempt, as ``breaker_final`` returns it.  A provider may be any key, such as instance and provider.
    """
    chunked = _chunked(attempts, partitions)
    # a row per chunk and provider; whether it is broadcast is left to its size at run time
    starts = _starts(chunked, threshold, cooldown_s, partitions, opening)
    return _dealt(chunked.join(starts, ["_chunk", "provider"]), partitions).mapInPandas(_refold(threshold, cooldown_s, closings), STATES + (", closed_at long" if closings else ""))


def breaker_final(attempts: DataFrame, threshold: int = config.BREAKER_FAILURE_THRESHOLD, cooldown_s: int = config.BREAKER_COOLDOWN_SECONDS,
                  partitions: int | None = None, opening: DataFrame | None = None) -> DataFrame:
    """(provider, failures, last_t) after the last attempt, from the chunk summaries alone."""
    ends = _starts(_chunked(attempts, partitions), threshold, cooldown_s, partitions, opening).where(F.col("_chunk") == FINAL)
    return ends.select("provider", F.col("start_c").alias("failures"), F.col("start_t").alias("last_t"))


def provider_health(attempts: DataFrame, providers: DataFrame, as_of: int | None = None, threshold: int = config.BREAKER_FAILURE_THRESHOLD,
                    cooldown_s: int = config.BREAKER_COOLDOWN_SECONDS) -> DataFrame:
    """Every registered provider's breaker as of ``as_of`` (seconds; default: the newest attempt of any outcome).

    Like the gateway's status call, failures and trip time are read before
    the expiry check, so an expired breaker shows its old count and trip time
    with ``open = false``.
    """
    if as_of is None:
        now = attempts.select(F.max("attempt_s")).scalar()
    else:
        now = F.lit(as_of)
        attempts = attempts.where(F.col("attempt_s") <= as_of)
    j = providers.join(breaker_final(attempts, threshold, cooldown_s), "provider", "left")
    failures = F.coalesce(F.col("failures"), F.lit(0)).cast("bigint")
    tripped = F.when(failures >= threshold, F.col("last_t"))
    return j.select("provider", failures.alias("failures"), tripped.alias("tripped_at"),
                    (tripped.isNotNull() & ((now - tripped) <= cooldown_s)).alias("open"),
                    *[c for c in ("configured", "default_model") if c in providers.columns])


def display_state(configured, is_open):
    """dashboard (icon, label).  Unconfigured + open shows label OPEN with the 'off' icon."""
    icon = F.when(configured & ~is_open, "normal").when(configured & is_open, "inverse").otherwise("off")
    label = F.when(is_open, "OPEN").when(configured, "OK").otherwise("N/A")
    return icon, label
