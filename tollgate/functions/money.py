"""Cost and budget column expressions.

Money stays an exact decimal through every product and sum (decimal(28,11) for one request, decimal(37,11) for sums), so
results do not depend on partition order; it becomes a double rounded to 6 places only at the edge (``usd``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate import schemas

COST_T = "decimal(37,11)"
LIMIT_T = "decimal(24,4)"
THOUSANDTH = Decimal("0.001")


def token_cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """tokens / 1000 x USD-per-1K price, in exact decimals."""
    per_thousand = (prompt_tokens * price_in + completion_tokens * price_out).cast("decimal(28,8)")
    return (per_thousand * F.lit(THOUSANDTH)).cast(schemas.COST)


def usd(amount: Column, places: int = 6) -> Column:
    """Edge conversion: round half-up on the decimal, then double."""
    return F.round(amount, places).cast("double")


def logged(cost: Column) -> Column:
    """A cost as the audit log holds it: unrounded."""
    return cost.cast("double")


def from_log(estimated_cost_usd: Column) -> Column:
    """The exact cost back from a logged one (a double tells 15 digits apart, a cost has 11 places)."""
    return estimated_cost_usd.cast(schemas.COST)


def usage_struct(prompt_tokens: Column, completion_tokens: Column, cost: Column) -> Column:
    """TokenUsage; total is the sum of the two counts."""
    return F.struct(prompt_tokens.cast("bigint").alias("prompt_tokens"),
                    completion_tokens.cast("bigint").alias("completion_tokens"),
                    (prompt_tokens + completion_tokens).cast("bigint").alias("total_tokens"),
                    usd(cost).alias("estimated_cost_usd"))


def remaining(limit: Column, used: Column) -> Column:
    """round(max(0, limit - used), 6), still a decimal."""
    return F.round(F.greatest(F.lit(0).cast(COST_T), (limit - used).cast(COST_T)), 6)


def fixed(amount: Column, places: int) -> Column:
    """Render a decimal with exactly ``places`` digits (half-up), like '%.{places}f'."""
    return F.round(amount, places).cast(f"decimal(36,{places})").cast("string")


def denial_reason(kind: Column, team: Column, used: Column, limit: Column) -> Column:
    """the gateway's denial text; ``used`` is shown to 4 places, ``limit`` to 2."""
    used6 = F.round(used, 6)
    daily = F.concat(F.lit("Daily budget exceeded for team '"), team, F.lit("'. Used: $"), fixed(used6, 4),
                     F.lit(" / $"), fixed(limit, 2), F.lit(". Resets at midnight UTC."))
    monthly = F.concat(F.lit("Monthly budget exceeded for team '"), team, F.lit("'. Used: $"), fixed(used6, 4),
                       F.lit(" / $"), fixed(limit, 2), F.lit("."))
    return F.when(kind == "daily", daily).when(kind == "monthly", monthly)


def traffic_light(daily_used: Column, daily_limit: Column) -> tuple[Column, Column, Column]:
    """(pct of daily limit, colour, progress bar fraction capped at 1)."""
    pct = F.when(daily_limit > 0, daily_used.cast("double") / daily_limit.cast("double") * 100).otherwise(F.lit(0.0))
    colour = F.when(pct > 90, "red").when(pct > 70, "yellow").otherwise("green")
    bar = F.least(pct / 100, F.lit(1.0))
    return pct, colour, bar


def day_key(ts: Column) -> Column:
    """ISO day (session time zone is UTC)."""
    return F.to_date(ts)


def month_key(ts: Column) -> Column:
    """%Y-%m month key."""
    return F.date_format(ts, "yyyy-MM")
