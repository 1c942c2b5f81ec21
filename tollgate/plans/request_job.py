"""The gateway's whole request path as one job: ingest, authentication, redaction, estimate, admission, routing, response and audit.

The steps are the operators of their own; this only joins them on the request: a request's team comes from its key, its token
estimate from its redacted messages, its admission from estimate and actual cost, and its status from all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import config, schemas
from tollgate.functions import messages as msg
from tollgate.functions import money, pii
from tollgate.operators import auth, budget, pricing, routing
from tollgate.session import materialize
from tollgate.sources.dims import provider_dim

#: Facts of the serving attempt that a response and its audit entry hold.
FACTS = ("model_used", "prompt_tokens", "completion_tokens", "cost", "latency_ms")


def redacted_requests(accepted: DataFrame, settings: config.GatewaySettings) -> DataFrame:
    """F12 and F13 per request: redacted messages, number and types of redactions, estimated prompt tokens."""
    rows = accepted.select("request_id", F.posexplode("messages").alias("turn", "m"))
    rows = pii.redact_steps(rows.withColumn("content", F.col("m.content")), "content", settings.pii_entities, settings.pii_redaction_enabled)
    rows = rows.withColumn("words", msg.word_count(F.col("pii_text")))
    return rows.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("m.role").alias("role"), F.col("pii_text").alias("content")).alias("message")))).alias("turns"),
        F.sum("pii_count").cast("int").alias("redaction_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_entities")))).alias("entities"),
        F.sum("words").alias("words"),
    ).select("request_id", F.transform("turns", lambda t: t["message"]).alias("redacted_messages"), "redaction_count", "entities",
             msg.token_estimate(F.col("words")).alias("prompt_tokens_est"))


def run_requests(bodies: DataFrame, attempts: DataFrame, settings: config.GatewaySettings = config.DEFAULT_SETTINGS,
                 limits: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row per request.

    ``bodies``: request_id, ts, api_key, body (JSON text).  ``attempts``: what became of the calls to providers (see
    ``routing.resolve_routes``), with the ``FACTS`` of each.  http_status: 401/403 for keys, 422 for bodies, 429 for budgets, 502 when
    every provider failed, else 200; only requests that pass the first two are redacted, checked and routed.
    """
    # several steps read both of the tables written here: bodies are parsed once, and routes resolved once
    checked = materialize(auth.with_team_from_key(auth.ingest(bodies), keys=keys), "requests")
    good = (F.col("http_status") == 200) & F.col("valid")
    accepted = checked.where(good)
    # what a call may cost: the provider asked for, or the first by priority, and its model
    models = provider_dim(bodies.sparkSession, settings).select(F.col("provider").alias("est_provider"), "default_model")
    asked = accepted.withColumn("est_provider", F.coalesce("provider", F.lit(settings.provider_priority[0]))).join(F.broadcast(models), "est_provider", "left")
    asked = asked.withColumn("est_model", msg.resolve_model(F.col("model"), F.col("default_model")))
    asked = asked.select("request_id", "ts", F.col("key_team_id").alias("team_id"), "max_tokens", "est_provider", "est_model")
    redacted = redacted_requests(accepted, settings)
    answer = ("content",) if "content" in attempts.columns else ()
    routes = routing.resolve_routes(attempts, settings.provider_priority, carry=FACTS + answer)
    called = asked.join(redacted, "request_id").join(routes, "request_id", "left")
    priced = pricing.with_price(called, "est_provider", "est_model")
    served = F.col("status") == "success"
    priced = priced.withColumns({
        "est_cost": money.token_cost(F.col("prompt_tokens_est"), F.col("max_tokens"), F.col("price_in"), F.col("price_out")),
        "cost": F.when(served, F.col("served.cost")).otherwise(F.lit(0)).cast(schemas.COST)})
    priced = materialize(priced, "priced")
    admitted = budget.budget_admission(priced.select("team_id", "ts", F.col("request_id").alias("event_id"), "est_cost", "cost"), settings, limits=limits)
    decided = priced.drop("cost", "ts", "team_id", "est_cost").join(
        admitted.select(F.col("event_id").alias("request_id"), "est_cost", "cost", "allowed", "denied_by", "reason"), "request_id")
    out = checked.select("request_id", "ts", "http_status", "auth_detail", "valid", "errors", F.col("provider").alias("provider_requested"),
                         F.when(good, F.col("key_team_id")).alias("team_id")).join(decided, "request_id", "left")
    allowed, used = F.col("allowed"), F.col("allowed") & F.coalesce(served, F.lit(False))
    of_served = lambda c: F.when(used, F.col(f"served.{c}"))
    failed = F.concat(F.lit("All providers failed after trying: ["), F.array_join(F.transform("provider_errors", lambda e: F.concat(F.lit("'"), e["provider"], F.lit("'"))), ", "), F.lit("]"))
    return out.select(
        "request_id", "ts", "team_id",
        F.when(F.col("http_status") != 200, F.col("http_status")).when(~F.col("valid"), 422).when(~allowed, 429).when(used, 200).otherwise(502).alias("http_status"),
        F.when(allowed.isNull(), "rejected").when(~allowed, "budget_exceeded").when(used, "success").otherwise("error").alias("status"),
        "provider_requested", F.when(used, F.col("provider_used")).alias("provider_used"), of_served("model_used").alias("model_used"),
        "prompt_tokens_est", of_served("prompt_tokens").alias("prompt_tokens"), of_served("completion_tokens").alias("completion_tokens"),
        "est_cost", F.when(used, F.col("cost")).otherwise(F.when(allowed.isNotNull(), F.lit(0))).cast(schemas.COST).alias("cost"),
        F.col("redaction_count").alias("pii_redaction_count"), F.col("entities").alias("pii_entities_redacted"), "redacted_messages",
        *[of_served(c).alias(c) for c in answer], of_served("latency_ms").alias("latency_ms"), F.coalesce(used & F.col("fallback_triggered"), F.lit(False)).alias("fallback_triggered"),
        F.when(used, F.col("fallback_reason")).alias("fallback_reason"), "denied_by",
        F.when(F.col("http_status") != 200, F.col("auth_detail")).when(~F.col("valid"), F.array_join("errors", ","))
        .when(~allowed, F.col("reason")).when(~used, F.coalesce(failed, F.lit("All providers failed after trying: []"))).alias("error_message"))


def responses(done: DataFrame) -> DataFrame:
    """F27 in the gateway's own shape: what the callers of served requests get, usage and redaction summary nested.  ``content`` is
    the answer, if the attempts had one."""
    served = done.where(F.col("status") == "success")
    content = F.col("content") if "content" in done.columns else F.lit(None).cast("string")
    return served.select(
        F.concat(F.lit("req-"), F.col("request_id").cast("string")).alias("id"), content.alias("content"), "provider_used", "model_used",
        money.usage_struct(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cost")).alias("usage"),
        F.struct((F.col("pii_redaction_count") > 0).alias("redacted"), F.col("pii_entities_redacted").alias("entities_found"),
                 F.col("pii_redaction_count").alias("redaction_count")).alias("pii_summary"),
        "latency_ms", "fallback_triggered", "fallback_reason", "ts")


def audit_entries(done: DataFrame) -> DataFrame:
    """The audit log's 16 columns (and ts, event_id, cost) for the requests that got past validation."""
    from tollgate.sources.audit_io import iso_timestamp
    kept = done.where(F.col("status") != "rejected")
    return kept.select(
        iso_timestamp(F.col("ts")).alias("timestamp"), F.col("request_id").cast("string").alias("request_id"), "team_id", "provider_requested",
        "provider_used", "model_used", F.coalesce("prompt_tokens", F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).cast("bigint").alias("completion_tokens"), money.logged(F.col("cost")).alias("estimated_cost_usd"),
        "pii_entities_redacted", "pii_redaction_count", "latency_ms", "fallback_triggered", "fallback_reason", "status", "error_message", "ts",
        F.col("request_id").cast("bigint").alias("event_id"), "cost")
