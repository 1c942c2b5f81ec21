"""Budget admission of team-months too large for a task (W2): speculative chunk chaining.

Admission is a fold: whether a request fits depends on what its day and its month have spent before.  Such a team-month is cut into
chunks along time, and every chunk is folded at once from a guessed start.  A fold also finds for which starts all its decisions
would be the same: a request is admitted up to a greatest amount spent before it, so the admitted ones bound the start from
above and the denied ones from below.  A walk along the chunks' summaries (a row each) then starts from zero: where the amounts lie
within a chunk's bounds its decisions stand, and its spend is added.

Where limits change all the time these bounds are narrow, and most guesses miss them.  Where few
chunks miss, those are folded again from what the walk arrived with, a few times at most.  Where many do, from the first one on a
team-month's chunks are folded again from a range of starts, around what the walk arrived with.  All decisions that are the
same for the whole range are settled there, side by side; the others, the doubtful requests, are replayed in order, a few numbers each
(a team-month's in one task, streamed), which finds every chunk's true start up to the first outside its range.  Chunks from
there on, if any, get the ranges that costs and limits before them allow, which hold every start: so rows are folded four times at
most before the last pass, in seven rounds, whatever the limits are and however many chunks there are.  Then each is folded from its true start, row by row.

Rows are shuffled and written once, by chunk; a round reads the chunks to be folded again and returns their summaries or doubtful requests only.
Every round shuffles and sorts its rows, so these are kept narrow: a team-month is a number, and amounts are decimals of 18 digits where
all fit (else of 37).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tollgate.functions.money import COST_T
from tollgate.operators.fold import FAR, NO_DAY, greatest_spend
from tollgate.operators.prefix import with_chunk
from tollgate.session import materialize, shared_path

WHOLE = "decimal(38,0)"
SUMMARY = (f"_key int, _chunk int, n long, first_day int, last_day int, low_d {WHOLE}, high_d {WHOLE}, low_m {WHOLE}, high_m {WHOLE}, "
           f"first_day_spend {WHOLE}, last_day_spend {WHOLE}, month_spend {WHOLE}")
STARTS = f"_key int, _chunk int, start_d {WHOLE}, start_m {WHOLE}, fits boolean"
#: Starts that a chunk may have; what no start can be outside of.
RANGES = f"_key int, _chunk int, low_d {WHOLE}, high_d {WHOLE}, low_m {WHOLE}, high_m {WHOLE}"
DOUBTS = f"_key int, _chunk int, _place long, day int, more_d {WHOLE}, more_m {WHOLE}, most_d {WHOLE}, most_m {WHOLE}, spends {WHOLE}"
AMOUNTS = ("est_cost", "cost", "daily_limit", "monthly_limit")
#: What a fold that returns no rows reads.
FOLDED = ("_key", "_chunk", "day", "ts", "event_id", *AMOUNTS)
#: Amounts of up to 18 digits are one machine word in rows, files and shuffles, and several times as fast as wider ones.
WORD = "decimal(18,11)"
_WIDE = Context(prec=60)
#: Rounds that fold missed chunks alone, while these hold at most one in so many of the rows.
FEW_ROUNDS = 4

#: A fold of rows sorted by (_chunk, _key, ts, event_id), each with its chunk's start_d and start_m.
Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def whole_numbers(column: pa.Array, sums: bool = True) -> np.ndarray:
    """Decimals as whole numbers of their last place: int64 where they and, with ``sums``, sums of them surely fit, else Python's numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    words = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset: column.offset + len(column)]
    low, high = words[:, 0], words[:, 1]
    if len(column) and ((high != 0).any() or (low < 0).any() or int(low.max()) > (1 << 62) // (2 * len(column) + 2 if sums else 2)):
        return np.array([(int(h) << 64) + (int(x) & 0xFFFFFFFFFFFFFFFF) for x, h in words], object)
    return low


def decimals(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Whole numbers of the last place as decimals."""
    if values.dtype == object:
        raw = b"".join(int(v).to_bytes(16, "little", signed=True) for v in values)
    else:
        raw = np.stack([values.astype(np.int64), np.where(values < 0, -1, 0)], axis=1).tobytes()
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(raw)])


class Span:
    """One chunk of a team-month while it is folded: the starts that leave its decisions alone, and what it spends."""

    def __init__(self, key: int | str, chunk: int, start_d: int, start_m: int):
        self.key, self.chunk, self.start_d, self.start_m = key, chunk, start_d, start_m
        self.n, self.first_day = 0, None
        self.low_d = self.low_m = -FAR
        self.high_d = self.high_m = FAR

    def add(self, day, allowed, before_d, before_m, most_d, most_m, spent_d: int, spent_m: int) -> None:
        """The next rows in order, with the decisions made, and what was spent at their end."""
        if self.first_day is None:
            self.first_day = int(day[0])
        self.n += len(day)
        first = day == self.first_day
        by_day = ~allowed & (before_d > most_d)
        room_d, room_m = most_d - before_d, most_m - before_m
        least = lambda start, x, old: min(old, start + int(x.min())) if len(x) else old
        greatest = lambda start, x, old: max(old, start + int(x.max())) if len(x) else old
        # days that begin within the chunk begin at nothing, whatever its start
        self.high_d = least(self.start_d, room_d[first & allowed], self.high_d)
        self.low_d = greatest(self.start_d, room_d[first & by_day], self.low_d)
        self.high_m = least(self.start_m, room_m[allowed], self.high_m)
        self.low_m = greatest(self.start_m, room_m[~allowed & ~by_day], self.low_m)
        self.last_day, self.spent_d, self.spent_m = int(day[-1]), int(spent_d), int(spent_m)

    def summary(self) -> tuple:
        amounts = (self.low_d, self.high_d, self.low_m, self.high_m, self.spent_d - self.start_d, self.spent_d, self.spent_m - self.start_m)
        return (self.key, self.chunk, self.n, self.first_day, self.last_day, *map(Decimal, amounts))


def summaries(spans: list[Span]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.decimal128(38, 0)] * 7]
    names = [c.strip().split(" ")[0] for c in SUMMARY.replace("(38,0)", "").split(",")]
    columns = list(zip(*(s.summary() for s in spans), strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([_keys(columns[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=names)


def _keys(values: tuple) -> pa.Array:
    """Team-months' numbers; callers that have texts may keep them."""
    return pa.array(values, pa.string() if values and isinstance(values[0], str) else pa.int32())


class Doubts:
    """One chunk of a team-month while it is folded from a range of starts: the requests that aren't decided alike for all of it.

    Each is kept as what has surely been spent since the one before it (or since its day began), the most that may have been spent
    before it, and what it spends.  The first entry holds the chunk's first day and its range, the last the spend after the last doubt.
    """

    def __init__(self, key: int | str, chunk: int, day: int, low_d: int, high_d: int, low_m: int, high_m: int):
        self.key, self.chunk, self.day, self.place = key, chunk, day, 0
        self.low_d, self.high_d, self.low_m, self.high_m = low_d, high_d, low_m, high_m
        self.more_d = self.more_m = 0
        self.out = [(key, chunk, 0, day, low_d, low_m, high_d, high_m, 0)]

    def add(self, day, act, most_d, most_m) -> None:
        """The next rows in order."""
        cuts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), len(day)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if int(day[lo]) != self.day:
                self.day, self.low_d, self.high_d, self.more_d = int(day[lo]), 0, 0, 0
            self._day(zip(act[lo:hi].tolist(), most_d[lo:hi].tolist(), most_m[lo:hi].tolist(), strict=True))

    def _day(self, rows) -> None:
        low_d, high_d, low_m, high_m, more_d, more_m = self.low_d, self.high_d, self.low_m, self.high_m, self.more_d, self.more_m
        for cost, d, m in rows:
            if low_d > d or low_m > m:
                continue
            if high_d <= d and high_m <= m:
                low_d, high_d, low_m, high_m, more_d, more_m = low_d + cost, high_d + cost, low_m + cost, high_m + cost, more_d + cost, more_m + cost
                continue
            self.place += 1
            self.out.append((self.key, self.chunk, self.place, self.day, more_d, more_m, d, m, cost))
            more_d = more_m = 0
            # denied, by the only limit that can; or admitted, and then not above either
            least_d, least_m = (d + 1 if high_m <= m else low_d), (m + 1 if high_d <= d else low_m)
            low_d, high_d = min(low_d + cost, least_d), max(min(high_d, d) + cost, high_d)
            low_m, high_m = min(low_m + cost, least_m), max(min(high_m, m) + cost, high_m)
        self.low_d, self.high_d, self.low_m, self.high_m, self.more_d, self.more_m = low_d, high_d, low_m, high_m, more_d, more_m

    def taken(self, last: bool) -> list[tuple]:
        """The entries since the last call."""
        if last:
            self.out.append((self.key, self.chunk, self.place + 1, self.day, self.more_d, self.more_m, 0, 0, 0))
        out, self.out = self.out, []
        return out


def doubts(entries: list[tuple]) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in DOUBTS.replace("(38,0)", "").split(",")]
    columns = list(zip(*entries, strict=True)) or [()] * len(names)
    kinds = [pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([_keys(columns[0]), *(pa.array(c, k) for c, k in zip(columns[1:4], kinds, strict=True)), *(_amounts(c) for c in columns[4:])], names=names)


def _amounts(values: tuple) -> pa.Array:
    try:
        whole = np.array(values, np.int64)
    except OverflowError:
        whole = np.array(values, object)
    return decimals(whole, pa.decimal128(38, 0))


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubtful requests, sorted by (_key, _chunk, _place), decided in order from the start of each team-month's first chunk, whose range
    is that start alone.  Returns each chunk's start and whether it is known: all are up to the first outside its range."""
    key_at, day_at, spent_d, spent_m, known = None, None, 0, 0, True
    for b in batches:
        out = []
        text = [b.column(c).to_pylist() for c in ("_key", "_chunk", "_place", "day")]
        amounts = [whole_numbers(b.column(c)).tolist() for c in ("more_d", "more_m", "most_d", "most_m", "spends")]
        for key, chunk, place, day, more_d, more_m, most_d, most_m, cost in zip(*text, *amounts, strict=True):
            if place == 0:
                if key != key_at:
                    key_at, day_at, spent_d, spent_m, known = key, day, more_d, more_m, True
                elif day != day_at:
                    day_at, spent_d = day, 0
                out.append((key, chunk, spent_d, spent_m, known := known and more_d <= spent_d <= most_d and more_m <= spent_m <= most_m))
                continue
            if day != day_at:
                day_at, spent_d = day, 0
            spent_d, spent_m = spent_d + more_d, spent_m + more_m
            if spent_d <= most_d and spent_m <= most_m:
                spent_d, spent_m = spent_d + cost, spent_m + cost
        keys, chunks, *starts, fits = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([_keys(keys), pa.array(chunks, pa.int32()), *map(_amounts, starts), pa.array(fits, pa.bool_())],
                                         names=["_key", "_chunk", "start_d", "start_m", "fits"])


def walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Along one team-month's summaries: every chunk's start as far as known, and whether its fold stands for that start.
    Up to the first one that doesn't, starts are exact."""
    day, spent_d, spent_m, out = None, 0, 0, []
    for key, chunk, _, first, last, low_d, high_d, low_m, high_m, first_spend, last_spend, month_spend in rows.sort_values("_chunk").itertuples(index=False, name=None):
        start_d = spent_d if first == day else 0
        out.append((key, chunk, Decimal(start_d), Decimal(spent_m), bool(low_d < start_d <= high_d and low_m < spent_m <= high_m)))
        spent_d = start_d + int(first_spend) if first == last else int(last_spend)
        spent_m, day = spent_m + int(month_spend), last
    return pd.DataFrame(out, columns=["_key", "_chunk", "start_d", "start_m", "fits"])


def guess(rows: pd.DataFrame) -> pd.DataFrame:
    """First starts of one team-month: all is spent until a day's or the month's limit is used up."""
    whole = lambda d: int(d.scaleb(11, _WIDE))
    out, at, today, spent_d, spent_m = [], None, None, 0, 0
    for key, chunk, day, spend, daily, monthly in rows.sort_values(["_chunk", "day"]).itertuples(index=False, name=None):
        if day != today:
            today, spent_d = day, 0
        if chunk != at:
            at = chunk
            out.append((key, chunk, Decimal(spent_d), Decimal(spent_m), False))
        more = max(0, min(whole(spend), whole(daily) - spent_d, whole(monthly) - spent_m))
        spent_d, spent_m = spent_d + more, spent_m + more
    return pd.DataFrame(out, columns=["_key", "_chunk", "start_d", "start_m", "fits"])


def ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """What no start of one team-month's chunks can be outside of: the least and the most that costs before it can add up to; and where every
    request that spends has an estimate above 0, no more than the greatest limit less the estimate, and the cost."""
    whole = lambda d: int(d.scaleb(11, _WIDE))
    out, at, today = [], None, None
    low_d = high_d = low_m = high_m = 0
    cap_d = cap_m = 0
    free_d = free_m = False
    for key, chunk, day, less, more, top_d, top_m, free in rows.sort_values(["_chunk", "day"]).itertuples(index=False, name=None):
        if day != today:
            today, low_d, high_d, cap_d, free_d = day, 0, 0, 0, False
        if chunk != at:
            at = chunk
            bounds = low_d, high_d if free_d else min(high_d, cap_d), low_m, high_m if free_m else min(high_m, cap_m)
            out.append((key, chunk, *map(Decimal, bounds)))
        low_d, high_d, low_m, high_m = low_d + whole(less), high_d + whole(more), low_m + whole(less), high_m + whole(more)
        cap_d, cap_m = max(cap_d, whole(top_d)), max(cap_m, whole(top_m))
        free_d, free_m = free_d or free, free_m or free
    return pd.DataFrame(out, columns=["_key", "_chunk", "low_d", "high_d", "low_m", "high_m"])


def around(starts: DataFrame, guessed: DataFrame | None, bounds: DataFrame) -> DataFrame:
    """The ranges to fold again, from each team-month's first chunk whose start isn't known on.  That one's is its start alone; the others' go
    beside ``starts`` as far as those have moved from what was ``guessed``, or as far as the ``bounds`` where nothing was."""
    missed = starts.where(~F.col("fits")).groupBy("_key").agg(F.min("_chunk").alias("_from"))
    found = starts.join(missed, "_key").where(F.col("_chunk") >= F.col("_from")).join(bounds, ["_key", "_chunk"])
    if guessed is not None:
        found = found.join(guessed.select("_key", "_chunk", F.col("start_d").alias("_gd"), F.col("start_m").alias("_gm")), ["_key", "_chunk"])

    def edge(bound: str, start: str, guess: str, sign: int):
        if guessed is None:
            beside = F.col(bound)
        else:
            moved = F.col(start) + F.lit(sign) * F.abs(F.col(start) - F.col(guess))
            beside = (F.greatest if sign < 0 else F.least)(F.col(bound), moved)
        return F.when(F.col("_chunk") == F.col("_from"), F.col(start)).otherwise(beside).cast(WHOLE).alias(bound)

    return found.select("_key", "_chunk", edge("low_d", "start_d", "_gd", -1), edge("high_d", "start_d", "_gd", 1),
                        edge("low_m", "start_m", "_gm", -1), edge("high_m", "start_m", "_gm", 1))


def _stored(keyed: DataFrame, amount: str, partitions: int) -> DataFrame | None:
    """The rows written by chunk, a folder each: a round reads those it needs.  None if not all amounts are of that kind."""
    spark = keyed.sparkSession
    kinds = {c: F.col(c).try_cast(amount) for c in AMOUNTS}
    lost = functools.reduce(lambda a, b: a | b, (F.col(c).isNotNull() & kind.isNull() for c, kind in kinds.items()))
    seen = Observation()
    path = shared_path(spark, "admission-chunks")
    found = keyed.observe(seen, F.count_if(lost).alias("lost")).withColumns(kinds)
    found.repartitionById(partitions, F.col("_chunk") % partitions).write.partitionBy("_chunk").parquet(path)
    return None if seen.get["lost"] else spark.read.schema(found.schema).parquet(path)


def chained(rows: DataFrame, order: DataFrame, to_summaries: Fold, to_doubts: Fold, to_rows: Fold, out_schema: Callable, partitions: int, trace: list[int] | None = None) -> DataFrame:
    """The rows (_key, day, ts, event_id, est_cost, cost, daily_limit, monthly_limit and what ``to_rows`` needs) decided by ``to_rows``,
    every chunk from its true start, as ``out_schema`` of the rows.  ``order``: ts and event_id of the same rows, for the borders.  ``trace`` gets the number of rows folded in each round."""
    spark = rows.sparkSession
    keyed = with_chunk(rows, ["ts", "event_id"], partitions, of=order)
    stored = _stored(keyed, WORD, partitions) or _stored(keyed, COST_T, partitions)

    def folded(part: DataFrame, beside: DataFrame, fold: Fold, schema) -> DataFrame:
        # whether the starts are broadcast is left to their size at run time
        amounts = [c for c, kind in beside.dtypes if kind == WHOLE]
        if (beside.agg(F.max(F.greatest(*(F.abs(c) for c in amounts)))).first()[0] or 0) < 10 ** 18:
            beside = beside.withColumns({c: F.col(c).cast("decimal(18,0)") for c in amounts})
        begun = (part if fold is to_rows else part.select(*FOLDED)).join(beside, ["_key", "_chunk"])
        begun = begun.repartitionById(partitions, F.col("_chunk") % partitions).sortWithinPartitions("_chunk", "_key", "ts", "event_id")
        return (begun if fold is to_rows else begun.drop("ts", "event_id")).mapInArrow(fold, schema)

    zero, after = F.lit(0).cast(COST_T), F.col("cost") - F.col("est_cost") + F.expr("0.0000005BD")
    by_day = materialize(stored.groupBy("_key", "_chunk", F.coalesce(F.datediff("day", F.lit("1970-01-01")), F.lit(NO_DAY)).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").cast(COST_T).alias("spend"), F.max("daily_limit").alias("daily"), F.max("monthly_limit").alias("monthly"),
        *(F.coalesce(F.sum(F.when(of, F.col("cost"))), zero).cast(COST_T).alias(name) for of, name in ((F.col("cost") < 0, "less"), (F.col("cost") > 0, "more"))),
        *(F.coalesce(F.max(F.when(F.col("est_cost") > 0, F.col(limit) + after)), zero).cast(COST_T).alias(name) for limit, name in (("daily_limit", "top_d"), ("monthly_limit", "top_m"))),
        F.max(F.coalesce((F.col("est_cost") <= 0) & (F.col("cost") > 0), F.lit(False))).alias("free")), "admission-days")
    per_day = ("_key", "_chunk", "day")
    guessed = materialize(by_day.select(*per_day, F.coalesce("spend", zero).alias("spend"), "daily", "monthly").groupBy("_key").applyInPandas(guess, STARTS), "admission-starts")
    bounds = materialize(by_day.select(*per_day, "less", "more", "top_d", "top_m", "free").groupBy("_key").applyInPandas(ranges, RANGES), "admission-ranges")
    known = materialize(folded(stored, guessed.select("_key", "_chunk", "start_d", "start_m"), to_summaries, SUMMARY), "admission-summaries")
    total = known.agg(F.sum("n")).first()[0]
    if trace is not None:
        trace.append(total)
    starts = materialize(known.groupBy("_key").applyInPandas(walk, STARTS), "admission-starts")
    for _ in range(FEW_ROUNDS):
        # few chunks missed (lasting limits): those alone, from what the walk arrived with
        todo = starts.where(~F.col("fits"))
        rows_again = by_day.join(todo.select("_key", "_chunk"), ["_key", "_chunk"]).agg(F.sum("n")).first()[0] or 0
        if not 0 < rows_again * FEW_ROUNDS <= total:
            break
        if trace is not None:
            trace.append(rows_again)
        chunks = [r[0] for r in todo.select("_chunk").distinct().collect()]  # at most the number of chunks
        new = materialize(folded(stored.where(F.col("_chunk").isin(chunks)), todo.select("_key", "_chunk", "start_d", "start_m"), to_summaries, SUMMARY), "admission-summaries")
        known = materialize(new.unionByName(known.join(new, ["_key", "_chunk"], "left_anti")), "admission-summaries")
        starts = materialize(known.groupBy("_key").applyInPandas(walk, STARTS), "admission-starts")
    beside = guessed
    while True:
        chunks = [r[0] for r in starts.where(~F.col("fits")).groupBy("_key").agg(F.min("_chunk").alias("_from")).join(starts, "_key")
                  .where(F.col("_chunk") >= F.col("_from")).select("_chunk").distinct().collect()]
        if not chunks:
            return folded(stored, starts.select("_key", "_chunk", "start_d", "start_m"), to_rows, out_schema(stored))
        to_fold = materialize(around(starts, beside, bounds), "admission-ranges")
        if trace is not None:
            trace.append(by_day.join(to_fold, ["_key", "_chunk"]).agg(F.sum("n")).first()[0])
        # a team-month's doubtful requests: some numbers each, streamed through a task
        left = folded(stored.where(F.col("_chunk").isin(chunks)), to_fold, to_doubts, DOUBTS)
        again = left.repartition(partitions, "_key").sortWithinPartitions("_key", "_chunk", "_place").mapInArrow(replay, STARTS)
        new = materialize(again, "admission-starts")
        starts = materialize(new.unionByName(starts.join(new, ["_key", "_chunk"], "left_anti")), "admission-starts")
        beside = None
