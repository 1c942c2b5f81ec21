"""The greedy admission fold in numpy.  Free of package imports, so that it can travel by value (see ``streaming.admission``).

Money is a whole number of 1e-11 USD, the scale of the decimals.
"""

from __future__ import annotations

import numpy as np

SCALE = 11
STEP = 10 ** (SCALE - 6)  # remaining budgets are rounded to 6 places
NO_DAY = -(1 << 31)
#: No bound; beyond every amount.
FAR = 10 ** 36


def greatest_spend(est: np.ndarray, limit: np.ndarray, step: int = STEP) -> np.ndarray:
    """The most that can have been spent before a request of this estimate so that what is left, rounded half up to ``step`` and
    floored at 0, covers it."""
    always = FAR if est.dtype == object else 1 << 62
    return np.where(est > 0, limit + step // 2 + (-est // step) * step, always)


def admit(est: np.ndarray, act: np.ndarray, day: np.ndarray, daily: np.ndarray, monthly: np.ndarray, spent_day, spent_month):
    """Greedy admission of one team-month's requests in order.

    A request is admitted if its estimate is within what is left of the day's limit and then of the month's; then its actual
    cost is spent.  What may have been spent before each is found for all at once, so that a row takes two comparisons however
    often limits change and runs of admitted requests end.  Returns (allowed, daily spend before, monthly spend before) and
    the spend at the end.
    """
    n = len(est)
    allowed = np.zeros(n, bool)
    before_day, before_month = np.zeros(n, est.dtype), np.zeros(n, est.dtype)
    most_day, most_month = greatest_spend(est, daily), greatest_spend(est, monthly)
    spent_day, spent_month = int(spent_day), int(spent_month)
    cuts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), n] if n else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo:
            spent_day = 0
        at = slice(lo, hi)
        first_day, first_month, taken = spent_day, spent_month, bytearray(hi - lo)
        for i, (most_d, most_m, cost) in enumerate(zip(most_day[at].tolist(), most_month[at].tolist(), act[at].tolist(), strict=True)):
            if spent_day <= most_d and spent_month <= most_m:
                taken[i] = 1
                spent_day += cost
                spent_month += cost
        allowed[at] = np.frombuffer(taken, bool)
        spend = np.where(allowed[at], act[at], 0)
        run = np.cumsum(spend) - spend
        before_day[at], before_month[at] = first_day + run, first_month + run
    return allowed, before_day, before_month, spent_day, spent_month
