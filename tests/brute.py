"""Plain-Python reference folds used by the property tests (row by row, no Spark)."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

Q6 = Decimal("0.000001")


def breaker_fold(rows, threshold=3, cooldown=60):
    """rows: (provider, attempt_id, attempt_s, outcome) in any order -> {attempt_id: (failures, tripped, trip_set, expired)}."""
    state = defaultdict(lambda: [0, None])
    out = {}
    for p, aid, t, o in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if o not in ("ok", "error"):
            continue
        s = state[p]
        expired = s[1] is not None and t - s[1] > cooldown
        if expired:
            s[0], s[1] = 0, None
        trip = False
        if o == "ok":
            s[0], s[1] = 0, None
        else:
            s[0] += 1
            if s[0] >= threshold:
                s[1] = t
                trip = True
        out[aid] = (s[0], s[1], trip, expired)
    return out


def admission_fold(rows, limits, default=(Decimal(10), Decimal(200))):
    """rows: (team, ts, event_id, est Decimal, cost Decimal) -> {event_id: (allowed, kind, du_before, mu_before)}."""
    du, mu = defaultdict(Decimal), defaultdict(Decimal)
    out = {}
    for team, ts, eid, est, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ld, lm = limits.get(team, default)
        dk, mk = (team, ts.date()), (team, (ts.year, ts.month))
        rd = max(Decimal(0), ld - du[dk]).quantize(Q6, ROUND_HALF_UP)
        rm = max(Decimal(0), lm - mu[mk]).quantize(Q6, ROUND_HALF_UP)
        before = (du[dk], mu[mk])
        if est > rd:
            out[eid] = (False, "daily") + before
        elif est > rm:
            out[eid] = (False, "monthly") + before
        else:
            out[eid] = (True, None) + before
            du[dk] += cost
            mu[mk] += cost
    return out
