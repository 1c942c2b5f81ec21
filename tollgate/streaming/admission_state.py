"""T3's stateful processor.  ``transformWithStateInPandas`` also loads it in a driver-side worker that doesn't see shipped files, so this
module and the fold it uses travel by value; it imports nothing else of the package."""

from __future__ import annotations

import pickle
from decimal import Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tollgate.operators.fold import NO_DAY, admit

HOUR = 3_600_000_000
DAY = 24 * HOUR
NEVER = -(1 << 62)
#: Rows of a team and micro-batch that wait outside the state store.
IN_MEMORY = 1 << 20
WIDE = Context(prec=60)
AMOUNTS = ("est_cost", "cost", "daily_limit", "monthly_limit")
OUT = ("team_id string, t long, event_id long, est_cost decimal(37,11), cost decimal(37,11), daily_limit decimal(37,11), monthly_limit decimal(37,11), "
       "allowed boolean, du_before decimal(37,11), mu_before decimal(37,11), late boolean, expired boolean")
COLUMNS = [c.strip().split(" ")[0] for c in OUT.replace("(37,11)", "").split(",")]


def month_of(day: int) -> int:
    """Months since 1970-01 of a day since 1970-01-01; requests without a time have one of their own."""
    return NO_DAY if day == NO_DAY else int(np.datetime64(day, "D").astype("datetime64[M]").astype(np.int64))


class Admission(StatefulProcessor):
    """One team's requests: held back until the team's newest is ``delay`` past them, then decided in (time, id) order.

    State: ``held`` (rows by hour), ``spent`` (per day) and the mark up to which rows are decided.  Rows that come after their time was
    decided are late: they are decided at once, by what their day and month have spent so far.  Spend of a month goes once the mark is
    ``keep`` past its end; requests of such a month are denied as expired.
    """

    def __init__(self, delay: int, keep: int):
        self.delay, self.keep = delay, keep

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "hour long", "rows binary")
        self.spent = handle.getMapState("spent", "day int", "amount string")
        self.mark = handle.getValueState("mark", "mark long, newest long, first_day int")

    def handleInputRows(self, key, rows, timerValues):
        known = self.mark.exists()
        mark, newest, first_day = self.mark.get() if known else (NEVER, NEVER, NO_DAY + 1)
        if not known:  # the team, once: what a flush has to know
            yield self._out(key[0], pd.DataFrame({"t": [NEVER], "event_id": [None], **{c: [0] for c in AMOUNTS}}), [None], [0], [0], False, False)
        self.days = {k[0]: int(v[0]) for k, v in self.spent.iterator()}
        self.changed: set[int] = set()
        release, waiting, size = False, {}, 0
        for pdf in rows:
            release |= bool(pdf["release"].any())
            times = pdf.loc[pdf["t"].notna(), "t"]
            newest = max(newest, int(times.max())) if len(times) else newest
            pdf = pdf[pdf["event_id"].notna()]
            part = pd.DataFrame({"t": pdf["t"].fillna(NEVER).astype(np.int64), "event_id": pdf["event_id"].astype(np.int64), **{c: [int(x) for x in pdf[c]] for c in AMOUNTS}})
            at_once = (part["t"] < mark) | (part["t"] == NEVER)
            if at_once.any():
                yield from self._decide(key[0], part[at_once], first_day, True)
            for hour, own in part[~at_once].groupby(part["t"] // HOUR):
                waiting.setdefault(int(hour), []).append(own)
                size += len(own)
            if size > IN_MEMORY:
                for hour, parts in waiting.items():
                    self._hold(hour, parts)
                waiting, size = {}, 0
        mark = max(mark, newest - self.delay)
        for hour in sorted({*waiting, *(k[0] for k in self.held.keys())}):
            if not release and hour * HOUR >= mark:
                if hour in waiting:
                    self._hold(hour, waiting[hour])
                continue
            stored = self.held.containsKey((hour,))
            own = pd.concat([*(self._stored(hour) if stored else ()), *waiting.get(hour, ())])
            ready = own if release else own[own["t"] < mark]
            yield from self._decide(key[0], ready, first_day, False)
            if stored:
                self.held.removeKey((hour,))
            if len(ready) < len(own):
                self._hold(hour, [own[own["t"] >= mark]])
        if release:
            mark = max(mark, newest + 1)
        if mark > NEVER:
            # months whose end the mark is far enough past are done with
            month = month_of((mark - self.keep) // DAY)
            first_day = max(first_day, int(np.datetime64(month, "M").astype("datetime64[D]").astype(np.int64)))
        for day in [d for d in self.days if NO_DAY < d < first_day]:
            del self.days[day]
            self.spent.removeKey((day,))
        for day in self.changed & self.days.keys():
            self.spent.updateValue((day,), (str(self.days[day]),))
        self.mark.update((mark, newest, first_day))

    def _stored(self, hour: int) -> list[pd.DataFrame]:
        old = self.held.getValue((hour,))
        return [] if old is None else [pickle.loads(bytes(old[0]))]

    def _hold(self, hour: int, parts: list[pd.DataFrame]) -> None:
        self.held.updateValue((hour,), (pickle.dumps(pd.concat([*self._stored(hour), *parts]), protocol=5),))

    def _decide(self, team, rows: pd.DataFrame, first_day: int, late: bool):
        rows = rows.sort_values(["t", "event_id"])
        days = np.where(rows["t"].to_numpy() == NEVER, NO_DAY, rows["t"].to_numpy() // DAY)
        for day in np.unique(days).tolist():
            own = rows[days == day]
            if NO_DAY < day < first_day:
                yield self._out(team, own, [False] * len(own), [0] * len(own), [0] * len(own), late, True)
                continue
            of_month = sum(v for d, v in self.days.items() if month_of(d) == month_of(day))
            arrays = [np.array(own[c].tolist(), object) for c in AMOUNTS]
            if max(int(np.abs(a).max()) for a in arrays) * (len(own) + 2) + of_month < 1 << 61:
                arrays = [a.astype(np.int64) for a in arrays]
            allowed, du, mu, total, _ = admit(*arrays[:2], np.full(len(own), day), *arrays[2:], self.days.get(day, 0), of_month)
            self.days[day] = int(total)
            self.changed.add(day)
            yield self._out(team, own, allowed.tolist(), du.tolist(), mu.tolist(), late and day != NO_DAY, False)

    def _out(self, team, rows: pd.DataFrame, allowed, du, mu, late: bool, expired: bool) -> pd.DataFrame:
        money = lambda xs: [Decimal(int(x)).scaleb(-11, WIDE) for x in xs]
        return pd.DataFrame({"team_id": team, "t": rows["t"].to_numpy(), "event_id": rows["event_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                             **{c: money(rows[c]) for c in AMOUNTS}, "allowed": allowed, "du_before": money(du), "mu_before": money(mu), "late": late, "expired": expired},
                            columns=COLUMNS)

    def close(self) -> None:
        pass
