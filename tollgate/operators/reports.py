"""Dashboard numbers over the whole audit log.

All of them are single aggregations or top-k cuts over the whole log; the dashboard's row cut (newest 200 entries) is the
parameter ``rows`` of ``kpi_summary`` and ``fetched`` of ``audit_table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.functions.money import COST_T, usd
from tollgate.operators.prefix import running_sum

DISPLAY_COLUMNS = ("timestamp", "request_id", "team_id", "provider_used", "model_used", "prompt_tokens",
                   "completion_tokens", "estimated_cost_usd", "pii_redaction_count", "latency_ms",
                   "fallback_triggered", "status")


def kpi_summary(audit: DataFrame, rows: int | None = None) -> DataFrame:
    """A4: one row, one pass (partial + final aggregate) over the exact costs; ``rows``: of the newest entries only."""
    if rows is not None:
        audit = audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(rows)
    n = F.count(F.lit(1))
    return audit.agg(
        n.alias("total_requests"),
        usd(F.sum("cost").cast(COST_T)).alias("total_cost_usd"),
        F.round(F.count_if("fallback_triggered") / n * 100, 4).alias("fallback_pct"),
        F.count_if(F.col("pii_redaction_count") > 0).alias("pii_requests"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
    )


def requests_by_provider(audit: DataFrame) -> DataFrame:
    """A5: value_counts of provider_used (nulls excluded), descending, name as tie-break."""
    return (audit.where(F.col("provider_used").isNotNull()).groupBy("provider_used")
            .agg(F.count(F.lit(1)).alias("requests"))
            .orderBy(F.desc("requests"), "provider_used"))


def pii_breakdown(audit: DataFrame) -> DataFrame:
    """Entity type counts over all entries (empty lists contribute nothing)."""
    return (audit.select(F.explode("pii_entities_redacted").alias("entity_type"))
            .groupBy("entity_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "entity_type"))


def latency_histogram(audit: DataFrame, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins between min and max latency (non-empty bins only).

    min and max come from one scalar subquery (one extra scan), not a driver round trip.
    """
    lat = audit.where(F.col("latency_ms").isNotNull())
    bounds = lat.select(F.struct(F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("latency_ms") - lo) / width))).cast("int")
    return (lat.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_end"), "count"))


#: Steps of bin widths within a power of ten, from one below the narrowest that can do to one above.
NICE = (1, 2, 5, 10, 20, 50, 100, 200)


def nice_width(lo, hi, bins: int = 30):
    """(multiple, power): the least width multiple x 10^power, of multiples 1, 2 and 5, whose bins from a multiple of it on cover ``lo`` to
    ``hi`` with at most ``bins`` of them; as columns.  A single value has a bin of width 1."""
    power = (F.floor(F.log10((hi - lo) / F.lit(float(bins)))) - 1).cast("int")
    fits = [F.when(nice_bin(hi, F.lit(m), power) - nice_bin(lo, F.lit(m), power) + 1 <= bins, F.lit(m)) for m in NICE]
    return F.when(hi == lo, 1).otherwise(F.coalesce(*fits)), F.when(hi == lo, 0).otherwise(power)


def nice_bin(x, multiple, power):
    """Number of the bin of ``x``; powers of ten stay whole numbers, so that borders are where they should be."""
    scaled = F.when(power < 0, x * F.pow(F.lit(10.0), -power)).otherwise(x / F.pow(F.lit(10.0), power))
    return F.floor(scaled / multiple)


def _border(bin_, multiple, power):
    return F.when(power < 0, bin_ * multiple / F.pow(F.lit(10.0), -power)).otherwise(bin_ * multiple * F.pow(F.lit(10.0), power))


def nice_histogram(counts: DataFrame, bins: int = 30) -> DataFrame:
    """A7 as the chart draws it: (bin_start, bin_end, count) of at most ``bins`` bins of a nice width, empty ones left out.

    ``counts``: (x, n), each value with its weight, such as ``latency_counts`` of any number of micro-batches.  One pass for the
    range, one for the bins.
    """
    seen = counts.where(F.col("x").isNotNull() & ~F.isnan("x"))
    span = seen.select(F.min("x").alias("lo"), F.max("x").alias("hi"))
    multiple, power = nice_width(F.col("lo"), F.col("hi"), bins)
    width = F.broadcast(span.select(multiple.alias("_m"), power.alias("_p")))  # one row
    # the range joins as a single row, so that both passes stay declarative
    binned = seen.join(width).groupBy("_m", "_p", nice_bin(F.col("x"), F.col("_m"), F.col("_p")).alias("_b")).agg(F.sum("n").alias("count"))
    return binned.select(_border(F.col("_b"), F.col("_m"), F.col("_p")).cast("double").alias("bin_start"),
                         _border(F.col("_b") + 1, F.col("_m"), F.col("_p")).cast("double").alias("bin_end"), "count")


def latency_counts(audit: DataFrame, places: int | None = None) -> DataFrame:
    """(x, n): entries by latency, cut to ``places`` decimal places (None: as they are).  Counts of micro-batches add up, and give the
    histogram of all entries whenever its bins are no narrower than those places."""
    x = F.col("latency_ms")
    if places is not None:
        x = F.floor(x * F.lit(10.0 ** places)) / F.lit(10.0 ** places)
    return audit.where(F.col("latency_ms").isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_cost(audit: DataFrame) -> DataFrame:
    """Running total of cost in (timestamp, request) order, exact decimals."""
    base = audit.select("event_id", "ts", F.col("cost").cast(COST_T).alias("cost"))
    out = running_sum(base, "cost", ["ts", "event_id"], "cum")
    return out.select("event_id", "ts", usd(F.col("cost")).alias("cost_usd"),
                      usd(F.col("cum")).alias("cumulative_cost_usd"))


def audit_table(audit: DataFrame, fetched: int = 200, shown: int = 50) -> DataFrame:
    """O2: the dashboard table: of the newest ``fetched`` entries, the oldest ``shown``.

    Both cuts are top-k (TakeOrderedAndProject): no global sort of the log.
    """
    cols = [c for c in DISPLAY_COLUMNS if c in audit.columns]
    newest = audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(fetched)
    return newest.orderBy("ts", "event_id").limit(shown).select(*cols)


def entities_distinct(audit: DataFrame) -> DataFrame:
    """The set of entity types present in the log."""
    return audit.select(F.explode("pii_entities_redacted").alias("entity_type")).distinct()


def dashboard(audit: DataFrame, settings: config.GatewaySettings = config.DEFAULT_SETTINGS) -> dict[str, DataFrame]:
    """The dashboard's numbers under a job's options: rows shown, histogram bins."""
    return {"kpi": kpi_summary(audit, settings.dashboard_rows), "providers": requests_by_provider(audit), "pii": pii_breakdown(audit),
            "latency": latency_histogram(audit, settings.histogram_bins), "table": audit_table(audit, settings.dashboard_rows, settings.dashboard_shown)}
