"""Provider routing with fallback.

The gateway walks an ordered candidate list per request: preferred provider
first (even when it is not in the priority list), then the priority list
without it.  Unconfigured and breaker-open candidates are skipped and never
become ``first_tried``; the first tried candidate that succeeds serves the
request; the fallback reason always cites the first tried provider.

Spark form: each attempt row gets its candidate position with
``array_position`` on the request's own candidate array (no join), and one
``groupBy(request_id)`` resolves the outcome with positional min/min_by
aggregates.  That is the only shuffle, with partial aggregation; a group is
one request's attempts (bounded by the number of providers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.functions.money import usd

TRIED = ("ok", "error")


def candidates(preferred: Column, priority=config.PROVIDERS) -> Column:
    """[preferred] + priority minus preferred, nulls removed."""
    prio = F.array(*[F.lit(p) for p in priority])
    return F.filter(F.array_distinct(F.concat(F.array(preferred), prio)), lambda x: x.isNotNull())


def route_candidates(requests: DataFrame, priority=config.PROVIDERS) -> DataFrame:
    """One row per (request, 1-based position, provider); a generator, no join."""
    return (requests.select("request_id", F.posexplode(candidates(F.col("preferred"), priority))
                            .alias("pos0", "provider"))
            .select("request_id", (F.col("pos0") + 1).cast("int").alias("pos"), "provider"))


def resolve_routes(attempts: DataFrame, priority=config.PROVIDERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per request: provider_used, first_tried, fallback flag/reason, status and error trace.

    ``attempts``: request_id, provider, preferred, outcome in
    (ok, error, unconfigured, open), error_msg.  ``carry`` columns of the
    serving attempt ride along in the same aggregate as ``served`` (a struct),
    so response facts need no join back to the attempts.
    """
    pos = F.array_position(candidates(F.col("preferred"), priority), F.col("provider"))
    # an attempt by a provider that isn't a candidate settles nothing, but its request stays
    a = attempts.withColumn("pos", F.when(pos > 0, pos))
    slots = range(1, len(priority) + 2)
    tried = F.col("outcome").isin(*TRIED)
    ok = F.col("outcome") == "ok"
    err_text = F.when(F.col("outcome") == "unconfigured", F.lit(config.UNCONFIGURED_MSG)) \
        .when(F.col("outcome") == "open", F.lit(config.BREAKER_OPEN_MSG)).otherwise(F.col("error_msg"))
    g = a.groupBy("request_id").agg(
        F.first("preferred", ignorenulls=True).alias("preferred"),
        F.min(F.when(tried, F.col("pos"))).alias("first_pos"),
        F.min(F.when(ok, F.col("pos"))).alias("used_pos"),
        F.min_by(F.when(tried, F.struct("provider", err_text.alias("err"))),
                 F.when(tried, F.col("pos"))).alias("first"),
        F.min_by(F.when(ok, F.col("provider")), F.when(ok, F.col("pos"))).alias("provider_used"),
        F.min_by(F.when(ok, F.col("attempt_id")), F.when(ok, F.col("pos"))).alias("served_attempt_id"),
        *([F.min_by(F.when(ok, F.struct(*carry)), F.when(ok, F.col("pos"))).alias("served")] if carry else []),
        # one error a provider, its last one; there are as many positions as candidates, so no list grows with the attempts
        *[F.max_by(F.when(~ok & (F.col("pos") == p), F.struct("pos", "provider", err_text.alias("err"))),
                   F.when(~ok & (F.col("pos") == p), F.col("attempt_id"))).alias(f"_e{p}") for p in slots],
    ).withColumn("errs", F.filter(F.array(*[F.col(f"_e{p}") for p in slots]), lambda e: e.isNotNull()))
    used = F.col("used_pos")
    fallback = used.isNotNull() & (used > F.col("first_pos"))
    trace = F.filter("errs", lambda e: used.isNull() | (e["pos"] < used))
    return g.select(
        "request_id", "preferred", "provider_used", "served_attempt_id", *(["served"] if carry else []),
        F.col("first.provider").alias("first_tried"),
        fallback.alias("fallback_triggered"),
        F.when(fallback, F.concat(F.lit("Fell back from "), F.col("first.provider"), F.lit(": "),
                                  F.coalesce(F.col("first.err"), F.lit("unknown error")))).alias("fallback_reason"),
        F.when(used.isNotNull(), "success").otherwise("error").alias("status"),
        trace.alias("provider_errors"),
    )


def failed_requests(routes: DataFrame) -> DataFrame:
    """Requests where every candidate failed or was skipped, with the ordered trace."""
    errs = F.col("provider_errors")
    names = F.transform(errs, lambda e: F.concat(F.lit("'"), e["provider"], F.lit("'")))
    return routes.where(F.col("status") == "error").select(
        "request_id",
        F.concat(F.lit("All providers failed after trying: ["), F.array_join(names, ", "), F.lit("]"))
        .alias("error_message"),
        F.array_join(F.transform(errs, lambda e: F.concat(e["provider"], F.lit(": "), e["err"])), "; ")
        .alias("provider_errors"),
        F.size(errs).alias("n_providers"))


RESPONSE_FACTS = ("model_used", "prompt_tokens", "completion_tokens", "cost", "pii_redaction_count",
                  "pii_entities_redacted", "latency_ms", "timestamp")


def response_assembly(routes: DataFrame) -> DataFrame:
    """CompletionResponse rows for served requests.

    ``routes`` must come from ``resolve_routes(..., carry=RESPONSE_FACTS)``: the
    serving attempt's facts were picked inside the routing aggregate, so this is
    a projection (no join of two large tables).
    """
    ok = routes.where(F.col("status") == "success")
    s = lambda c: F.col(f"served.{c}")
    return ok.select(
        F.concat(F.lit("req-"), F.col("request_id").cast("string")).alias("id"),
        "provider_used", s("model_used").alias("model_used"), s("prompt_tokens").alias("prompt_tokens"),
        s("completion_tokens").alias("completion_tokens"),
        (s("prompt_tokens") + s("completion_tokens")).alias("total_tokens"),
        usd(s("cost")).alias("estimated_cost_usd"),
        (s("pii_redaction_count") > 0).alias("pii_redacted"),
        F.array_join(s("pii_entities_redacted"), ",").alias("pii_entities"),
        s("pii_redaction_count").alias("pii_count"),
        s("latency_ms").alias("latency_ms"), "fallback_triggered",
        F.when(F.col("fallback_triggered"), F.col("fallback_reason")).alias("fallback_reason"),
        s("timestamp").alias("timestamp"))
