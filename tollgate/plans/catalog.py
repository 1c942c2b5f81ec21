"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (or views Spark derives from them) in
full; none runs on made-up input alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import config, schemas
from tollgate.functions import messages as msg
from tollgate.functions import money, pii
from tollgate.operators import auth, breaker, budget, completion, detector, pricing, reports, routing
from tollgate.session import cores_if_few, shared_path, ship_package, spread
from tollgate.sources import audit_io, dims, traffic
from tollgate.sources.tables import read_table
from tollgate.plans import request_job
from tollgate.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query; the registered callable first ships the package to the executors."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


# -- shared inputs ----------------------------------------------------------

def events(spark, sf):
    return read_table(spark, sf, "events")


def audit(spark, sf):
    return traffic.gw_audit(events(spark, sf))


def costed(spark, sf):
    return pricing.with_cost(audit(spark, sf))


def daily(spark, sf):
    return budget.daily_usage(costed(spark, sf))


# -- cost and budget --------------------------------------------------------

@register("price_catalog")
def q_price_catalog(spark, sf):
    """The catalogue as used by the traffic: resolved price per (provider, model)."""
    return (pricing.with_price(audit(spark, sf))
            .groupBy("provider_used", "model_used", "price_in", "price_out", "price_tier")
            .agg(F.count(F.lit(1)).alias("n_requests"))
            .select("provider_used", "model_used", F.col("price_in").cast("double").alias("price_in"),
                    F.col("price_out").cast("double").alias("price_out"), "price_tier", "n_requests"))


@register("price_join")
def q_price_join(spark, sf):
    return pricing.with_price(audit(spark, sf)).select(
        "event_id", "provider_used", "model_used", F.col("price_in").cast("double").alias("price_in"),
        F.col("price_out").cast("double").alias("price_out"), "price_tier")


@register("estimate_cost")
def q_estimate_cost(spark, sf):
    return costed(spark, sf).select("event_id", "provider_used", "model_used", "prompt_tokens",
                                    "completion_tokens", money.usd(F.col("cost")).alias("cost_usd"))


@register("usage_struct")
def q_usage_struct(spark, sf):
    return (costed(spark, sf)
            .select("event_id", money.usage_struct(F.col("prompt_tokens"), F.col("completion_tokens"),
                                                   F.col("cost")).alias("usage"))
            .select("event_id", "usage.*"))


@register("daily_usage")
def q_daily_usage(spark, sf):
    return daily(spark, sf).select("team_id", "day", money.usd(F.col("cost")).alias("cost_usd"), "n_requests")


@register("monthly_usage")
def q_monthly_usage(spark, sf):
    return budget.monthly_usage(daily(spark, sf)).select(
        "team_id", "month", money.usd(F.col("cost")).alias("cost_usd"), F.col("n_requests").cast("bigint"))


@register("team_budget_status")
def q_team_budget_status(spark, sf):
    return budget.team_budget_status(daily(spark, sf))


@register("all_teams_budget")
def q_all_teams_budget(spark, sf):
    return budget.all_teams_budget(daily(spark, sf))


@register("team_ids_union")
def q_team_ids_union(spark, sf):
    """Configured team ids UNION team ids with usage."""
    cfg = dims.budget_dim(spark).select("team_id")
    return cfg.union(daily(spark, sf).select("team_id")).distinct()


@register("budget_limits_join")
def q_budget_limits_join(spark, sf):
    return budget.with_limits(audit(spark, sf).select("event_id", "team_id")).select(
        "event_id", "team_id", F.col("daily_limit").cast("double").alias("daily_limit_usd"),
        F.col("monthly_limit").cast("double").alias("monthly_limit_usd"), "configured")


@register("budget_remaining")
def q_budget_remaining(spark, sf):
    return budget.with_limits(daily(spark, sf)).select(
        "team_id", "day",
        money.remaining(F.col("daily_limit"), F.col("cost")).cast("double").alias("daily_remaining_usd"))


@register("budget_traffic_light")
def q_budget_traffic_light(spark, sf):
    status = budget.all_teams_budget(daily(spark, sf))
    pct, colour, bar = money.traffic_light(F.col("daily_used_usd"), F.col("daily_limit_usd"))
    return status.select("team_id", F.round(pct, 4).alias("daily_pct"), colour.alias("colour"),
                         F.round(bar, 6).alias("bar"))


@register("usage_period_keys")
def q_usage_period_keys(spark, sf):
    return audit(spark, sf).select("event_id", money.day_key(F.col("ts")).alias("day"),
                                   money.month_key(F.col("ts")).alias("month"))


@register("budget_config_upsert")
def q_budget_config_upsert(spark, sf):
    latest = dims.latest_budget_config(traffic.budget_changes(events(spark, sf)))
    return latest.select("team_id", F.col("daily_limit").cast("double").alias("daily_limit_usd"),
                         F.col("monthly_limit").cast("double").alias("monthly_limit_usd"), "n_changes")


# -- PII --------------------------------------------------------------------


def documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return spread(docs, cores_if_few(docs))


def _one(entity):
    def q(spark, sf):
        redacted, n = pii.redact_one(F.col("text"), entity)
        return documents(spark, sf).select("doc_id", n.cast("bigint").alias("n_matches"),
                                           redacted.alias("redacted_text"))
    return q


register("redact_email")(_one("EMAIL_ADDRESS"))
register("redact_phone")(_one("PHONE_NUMBER"))
register("redact_card")(_one("CREDIT_CARD"))
register("redact_ssn")(_one("US_SSN"))
register("redact_ip")(_one("IP_ADDRESS"))


@register("redact_text")
def q_redact_text(spark, sf):
    return pii.redact_steps(documents(spark, sf), "text").select(
        "doc_id", F.col("pii_text").alias("redacted_text"), F.col("pii_count").alias("redaction_count"),
        F.array_join("pii_entities", ",").alias("entities_found"))


@register("pii_counts")
def q_pii_counts(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    pages = spread(pages, cores_if_few(pages))
    short = {"EMAIL_ADDRESS": "n_email", "PHONE_NUMBER": "n_phone", "CREDIT_CARD": "n_card",
             "US_SSN": "n_ssn", "IP_ADDRESS": "n_ip"}
    out = pii.redact_steps(pages, "html")
    return out.select("page_id", *[F.col(f"pii_n_{e}").cast("bigint").alias(short[e]) for e in pii.ENTITY_ORDER],
                      F.col("pii_count").alias("redaction_count"))


@register("pii_entities_found")
def q_pii_entities_found(spark, sf):
    return pii.redact_steps(documents(spark, sf), "text").select(
        "doc_id", F.array_join("pii_entities", ",").alias("entities_found"))


@register("redact_messages")
def q_redact_messages(spark, sf):
    """redact every message of a request, then merge the per-request summary.

    Messages are rows of ``conversations``; the merge is one groupBy on the
    request id (partial aggregation; a group is one request's messages).
    """
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    msgs = pii.redact_steps(conv, "text")
    return (msgs.groupBy(F.col("conv_id").alias("request_id"))
            .agg(F.count(F.lit(1)).alias("n_messages"),
                 F.sum("pii_count").cast("int").alias("redaction_count"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_entities")))).alias("ents"),
                 F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "pii_text").alias("m"))))
                 .alias("msgs"))
            .select("request_id", "n_messages", "redaction_count", (F.col("redaction_count") > 0).alias("redacted"),
                    F.array_join("ents", ",").alias("entities_found"),
                    F.array_join(F.transform("msgs", lambda x: x["m"]), "\n").alias("redacted_transcript")))


# -- audit log and dashboard reports --------------------------------------------


def audit_log(spark, sf):
    """F26 over the costed traffic: the audit fact table (with ts/event_id for ordering)."""
    return audit_io.audit_projection(costed(spark, sf))


def _shown(df):
    """Audit entries for comparison: entity lists joined, costs rounded to 6 places (here only)."""
    return df.withColumns({"pii_entities_redacted": F.array_join("pii_entities_redacted", ","),
                           "estimated_cost_usd": money.usd(money.from_log(F.col("estimated_cost_usd")))})


@register("audit_projection")
def q_audit_projection(spark, sf):
    return _shown(audit_io.audit_only(audit_log(spark, sf)))


@register("kpi_summary")
def q_kpi_summary(spark, sf):
    return reports.kpi_summary(audit_log(spark, sf))


@register("requests_by_provider")
def q_requests_by_provider(spark, sf):
    return reports.requests_by_provider(audit_log(spark, sf))


@register("pii_breakdown")
def q_pii_breakdown(spark, sf):
    return reports.pii_breakdown(audit_log(spark, sf))


@register("latency_histogram")
def q_latency_histogram(spark, sf):
    return reports.latency_histogram(audit_log(spark, sf))


@register("latency_histogram_nice")
def q_latency_histogram_nice(spark, sf):
    """A7 as the chart draws it: bins of a nice width, at most 30."""
    return reports.nice_histogram(reports.latency_counts(audit(spark, sf)))


@register("cumulative_cost")
def q_cumulative_cost(spark, sf):
    return reports.cumulative_cost(audit_log(spark, sf))


@register("audit_table")
def q_audit_table(spark, sf):
    return reports.audit_table(audit_log(spark, sf)).withColumn(
        "estimated_cost_usd", money.usd(money.from_log(F.col("estimated_cost_usd"))))


@register("entities_distinct")
def q_entities_distinct(spark, sf):
    return reports.entities_distinct(audit_log(spark, sf))


# -- requests, auth, messages ---------------------------------------------------


def requests(spark, sf):
    return traffic.gw_requests(read_table(spark, sf, "conversations"))


def requests_with_messages(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return traffic.gw_requests(conv).join(traffic.request_messages(conv), "request_id")


_ONE = '{"messages":[{"role":"user","content":"x"}],'
ODD_BODIES = (_ONE + '"max_tokens":"abc"}', _ONE + '"max_tokens":2.5}', _ONE + '"max_tokens":null}', _ONE + '"temperature":"hot"}',
              _ONE + '"stream":"maybe"}', '{"messages":"hi"}', '{"messages":[1]}', '{"messages":[{"role":"user","content":123}]}',
              _ONE + '"max_tokens":"12","stream":"yes","temperature":1}', '[]', '{"model":"gpt-4o"}', _ONE + '"team_id":7,"model":1}')


def request_bodies(spark, sf):
    """Raw JSON bodies as clients send them (null fields omitted): every conversation's own and, as requests of their own with negative
    ids, malformed or wrongly typed ones."""
    r = requests_with_messages(spark, sf)
    body = F.to_json(F.struct("messages", "model", "provider", "max_tokens", "temperature"))
    kind = F.col("request_id") % 17
    odd = F.when(kind == 1, F.substr(body, F.lit(1), (F.length(body) / 2).cast("int")))
    for n, text in enumerate(ODD_BODIES, start=2):
        odd = odd.when(kind == n, F.lit(text))
    sent = F.array(F.struct("request_id", body.alias("body")), F.struct((-1 - F.col("request_id")).alias("request_id"), odd.alias("body")))
    return r.select("api_key", F.explode(sent).alias("s")).select("s.request_id", "api_key", "s.body").where("body is not null")


@register("request_ingest")
def q_request_ingest(spark, sf):
    out = auth.ingest(request_bodies(spark, sf))
    return out.select("request_id", "valid", F.array_join("errors", ",").alias("errors"), "provider", "model",
                      F.col("max_tokens").cast("bigint").alias("max_tokens"), "temperature", "team_id", "stream",
                      F.when(F.col("messages").isNotNull(), F.size("messages")).cast("bigint").alias("n_messages"))


@register("request_defaults")
def q_request_defaults(spark, sf):
    r = requests(spark, sf).withColumn("team_id", F.lit(None).cast("string")).withColumn(
        "stream", F.lit(None).cast("boolean"))
    return auth.with_defaults(r).select("request_id", "max_tokens", "temperature", "team_id", "stream")


@register("auth_status")
def q_auth_status(spark, sf):
    return auth.with_team_from_key(requests(spark, sf), keys=traffic.sample_keys(spark)).select("request_id", "http_status", "auth_detail",
                                                               "key_team_id")


@register("auth_join")
def q_auth_join(spark, sf):
    """Authorised requests with the effective team (the key's team overrides the body's)."""
    r = auth.with_defaults(requests(spark, sf).withColumn("team_id", F.lit(None).cast("string"))
                           .withColumn("stream", F.lit(None).cast("boolean")))
    out = auth.with_team_from_key(r, keys=traffic.sample_keys(spark)).where(F.col("http_status") == 200)
    return out.select("request_id", F.col("team_id").alias("body_team_id"),
                      F.col("key_team_id").alias("team_id"))


@register("token_estimate")
def q_token_estimate(spark, sf):
    r = traffic.request_messages(read_table(spark, sf, "conversations"))
    words = msg.prompt_words(F.col("messages"))
    return r.select("request_id", words.cast("bigint").alias("n_words"),
                    msg.token_estimate(words).alias("prompt_tokens_est"))


@register("resolve_model")
def q_resolve_model(spark, sf):
    prov = F.broadcast(dims.provider_dim(spark).select(F.col("provider").alias("_p"), "default_model"))
    r = requests(spark, sf)
    return (r.join(prov, F.col("provider") == F.col("_p"), "left")
            .select("request_id", "provider", "model",
                    msg.resolve_model(F.col("model"), F.col("default_model")).alias("resolved_model")))


AZURE_NO_ENDPOINT = config.GatewaySettings(azure_endpoint_set=False)


@register("provider_available")
def q_provider_available(spark, sf):
    """F17 with Azure's endpoint unset: a key alone does not make Azure available."""
    prov = F.broadcast(dims.provider_dim(spark, AZURE_NO_ENDPOINT).select(F.col("provider").alias("_p"),
                                                                          "configured"))
    att = traffic.gw_attempts(events(spark, sf))
    return (att.join(prov, F.col("provider") == F.col("_p"), "left")
            .select("attempt_id", "provider", F.coalesce("configured", F.lit(False)).alias("available")))


@register("providers_available")
def q_providers_available(spark, sf):
    """Configured providers among those the traffic uses (health check shape)."""
    prov = F.broadcast(dims.provider_dim(spark, AZURE_NO_ENDPOINT))
    used = traffic.gw_attempts(events(spark, sf)).groupBy("provider").agg(F.count(F.lit(1)).alias("attempts"))
    j = used.join(prov, "provider").where(F.col("configured"))
    return j.agg(F.count(F.lit(1)).alias("providers_available"),
                 F.array_join(F.array_sort(F.collect_list("provider")), ",").alias("providers"),
                 F.sum("attempts").alias("attempts_on_available"))


@register("provider_registry")
def q_provider_registry(spark, sf):
    """The registry joined with the traffic each provider received."""
    prov = F.broadcast(dims.provider_dim(spark))
    used = traffic.gw_attempts(events(spark, sf)).groupBy("provider").agg(F.count(F.lit(1)).alias("attempts"))
    return prov.join(used, "provider", "left").select(
        "provider", "default_model", "configured", "priority", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def _payload_base(spark, sf):
    return auth.with_defaults(requests_with_messages(spark, sf).withColumn("team_id", F.lit(None).cast("string"))
                              .withColumn("stream", F.lit(None).cast("boolean")))


def _model_for(provider):
    return F.lit(dict(config.DEFAULT_MODELS)[provider])


@register("payload_anthropic")
def q_payload_anthropic(spark, sf):
    r = _payload_base(spark, sf)
    system, rest = msg.anthropic_payload(F.col("messages"))
    return r.select("request_id", msg.resolve_model(F.col("model"), _model_for("anthropic")).alias("model"),
                    "max_tokens", system.alias("system"), msg.flat(rest).alias("messages_flat"))


@register("payload_openai")
def q_payload_openai(spark, sf):
    r = _payload_base(spark, sf)
    return r.select("request_id", msg.resolve_model(F.col("model"), _model_for("openai")).alias("model"),
                    "max_tokens", "temperature", msg.flat(F.col("messages")).alias("messages_flat"))


@register("payload_gemini")
def q_payload_gemini(spark, sf):
    r = _payload_base(spark, sf)
    prompt, history = msg.gemini_payload(F.col("messages"))
    return r.select("request_id", msg.resolve_model(F.col("model"), _model_for("gemini")).alias("model"),
                    prompt.alias("prompt"), msg.flat(history).alias("history_flat"),
                    F.size(history).alias("n_history"))


# -- routing --------------------------------------------------------------------


def attempts(spark, sf):
    return traffic.gw_attempts(events(spark, sf))


def routes(spark, sf):
    return routing.resolve_routes(attempts(spark, sf))


@register("route_candidates")
def q_route_candidates(spark, sf):
    reqs = attempts(spark, sf).groupBy("request_id").agg(F.first("preferred").alias("preferred"))
    return routing.route_candidates(reqs).select("request_id", "pos", "provider")


@register("route_resolution")
def q_route_resolution(spark, sf):
    return routes(spark, sf).select(
        "request_id", "preferred", "provider_used", "first_tried", "fallback_triggered", "fallback_reason",
        "status", F.size("provider_errors").alias("n_errors"),
        (F.col("provider_used").isNotNull() & (F.col("provider_used") != F.col("preferred")))
        .alias("served_by_other"))


@register("failed_requests")
def q_failed_requests(spark, sf):
    return routing.failed_requests(routes(spark, sf))


@register("response_assembly")
def q_response_assembly(spark, sf):
    """attempts and their response facts are projections of the same rows, so the serving
    attempt's facts are picked in the routing aggregate itself (one shuffle, no join)."""
    facts = audit_io.audit_projection(pricing.with_cost(traffic.gw_audit(events(spark, sf), keep=("event_type",))),
                                      keep=("event_type",))
    att = traffic.gw_attempts(facts.drop("request_id", "provider_used"), keep=routing.RESPONSE_FACTS)
    return routing.response_assembly(routing.resolve_routes(att, carry=routing.RESPONSE_FACTS))


# -- circuit breaker --------------------------------------------------------------


def breaker_rows(spark, sf):
    return breaker.breaker_states(attempts(spark, sf))


@register("breaker_states")
def q_breaker_states(spark, sf):
    return breaker_rows(spark, sf)


def _health(spark, sf, settings=config.DEFAULT_SETTINGS):
    return breaker.provider_health(attempts(spark, sf), dims.provider_dim(spark, settings), threshold=settings.breaker_threshold,
                                   cooldown_s=settings.breaker_cooldown_s)


@register("provider_health")
def q_provider_health(spark, sf):
    return _health(spark, sf).select("provider", "failures", "tripped_at", "open")


@register("provider_display_state")
def q_provider_display_state(spark, sf):
    h = _health(spark, sf, AZURE_NO_ENDPOINT)
    icon, label = breaker.display_state(F.col("configured"), F.col("open"))
    return h.select("provider", "configured", "open", icon.alias("icon_state"), label.alias("label"))


# -- budget admission -------------------------------------------------------------


def admission_requests(spark, sf):
    """Every request with its estimate; a failed call is checked and spends nothing."""
    return costed(spark, sf).withColumn("cost", F.when(F.col("status") == "error", F.lit(0).cast(schemas.COST)).otherwise(F.col("cost")))


def admission(spark, sf):
    return budget.budget_admission(admission_requests(spark, sf))


@register("budget_admission")
def q_budget_admission(spark, sf):
    return admission(spark, sf).select(
        "event_id", "team_id", "ts", money.usd(F.col("est_cost")).alias("estimated_cost_usd"), money.usd(F.col("cost")).alias("cost_usd"),
        "allowed", "denied_by", "reason", money.usd(F.col("du_before")).alias("daily_used_before_usd"),
        money.usd(F.col("mu_before")).alias("monthly_used_before_usd"))


def latest_limits(spark, sf):
    return dims.latest_budget_config(traffic.budget_changes(events(spark, sf)))


@register("budget_admission_configured")
def q_budget_admission_configured(spark, sf):
    """W2 as it would have been under the budgets that S9 finds at the end of the change log; see ``budget_admission_asof``."""
    return budget.budget_admission(admission_requests(spark, sf), limits=latest_limits(spark, sf)).select(
        "event_id", "allowed", "denied_by", money.usd(F.col("du_before")).alias("daily_used_before_usd"),
        money.usd(F.col("mu_before")).alias("monthly_used_before_usd"))


@register("budget_limits_asof")
def q_budget_limits_asof(spark, sf):
    """S9 and J3 in time: the limits in force when each request came."""
    rows = audit(spark, sf).select("event_id", "team_id", "ts")
    return budget.limits_asof(rows, traffic.budget_changes(events(spark, sf))).select(
        "event_id", "team_id", F.col("daily_limit").cast("double").alias("daily_limit_usd"), F.col("monthly_limit").cast("double").alias("monthly_limit_usd"), "configured")


@register("budget_admission_asof")
def q_budget_admission_asof(spark, sf):
    """W2 as it happened: a change of limits affects later checks only."""
    out = budget.budget_admission(admission_requests(spark, sf), changes=traffic.budget_changes(events(spark, sf)))
    return out.select("event_id", "allowed", "denied_by", F.col("daily_limit").cast("double").alias("daily_limit_usd"), F.col("monthly_limit").cast("double").alias("monthly_limit_usd"),
                      money.usd(F.col("du_before")).alias("daily_used_before_usd"), money.usd(F.col("mu_before")).alias("monthly_used_before_usd"))


@register("all_teams_budget_configured")
def q_all_teams_budget_configured(spark, sf):
    """J4 and A3 under the budgets that S9 finds in the change log."""
    return budget.all_teams_budget(daily(spark, sf), limits=latest_limits(spark, sf))


@register("budget_reason")
def q_budget_reason(spark, sf):
    """the denial messages, one row per denied request."""
    return admission(spark, sf).where(~F.col("allowed")).select("event_id", "team_id", "denied_by", "reason")


@register("admitted_spend")
def q_admitted_spend(spark, sf):
    """The usage store after admission: admitted spend and count per (team, month)."""
    adm = admission(spark, sf).where(F.col("allowed"))
    return (adm.groupBy("team_id", money.month_key(F.col("ts")).alias("month"))
            .agg(money.usd(F.sum("cost")).alias("cost_usd"), F.count(F.lit(1)).alias("n_allowed")))


# -- audit log I/O ------------------------------------------------------------------


def _corrupt():
    # every 97th entry is written half-flushed
    return F.col("event_id") % 97 == 0


@register("audit_jsonl_roundtrip")
def q_audit_jsonl_roundtrip(spark, sf):
    """Append the audit log as day-partitioned JSONL, read it back, aggregate per day."""
    path = shared_path(spark, "audit-jsonl")
    audit_io.write_jsonl(audit_log(spark, sf), path)
    back = audit_io.read_jsonl(spark, path)
    return (back.groupBy(F.substring("timestamp", 1, 10).alias("day"))
            .agg(F.count(F.lit(1)).alias("entries"),
                 money.usd(F.sum(money.from_log(F.col("estimated_cost_usd")))).alias("cost_usd"),
                 F.sum("pii_redaction_count").alias("pii_redactions"),
                 F.count_if(F.col("status") == "success").alias("successes")))


@register("audit_jsonl_scan")
def q_audit_jsonl_scan(spark, sf):
    """Scan a log with half-written lines; malformed lines are dropped, nothing else."""
    path = shared_path(spark, "audit-lines")
    audit_io.write_lines(audit_io.to_log_lines(audit_log(spark, sf), _corrupt()), path)
    back = audit_io.read_jsonl(spark, path)
    return _shown(back.select(*[c for c in back.columns if c != "day"]))


@register("audit_recent")
def q_audit_recent(spark, sf):
    """S3: recent_entries over a log on disk with half-written lines, of which only the newest days are read."""
    path, limit = shared_path(spark, "audit-recent"), config.DEFAULT_SETTINGS.audit_recent_limit
    audit_io.write_lines(audit_io.to_log_lines(audit_log(spark, sf), _corrupt()), path)
    out = audit_io.recent_entries(audit_io.newest_lines(spark, path, limit), limit)
    return out.select("seq", "request_id", "team_id", "status", money.usd(money.from_log(F.col("estimated_cost_usd"))).alias("estimated_cost_usd"))


@register("siem_envelope")
def q_siem_envelope(spark, sf):
    """The webhook bodies; fields read back out of the JSON text (one parse per body)."""
    path = shared_path(spark, "siem")
    audit_io.write_siem(audit_log(spark, sf), path)
    body = spark.read.text(path).withColumnRenamed("value", "body")
    env = T.StructType([T.StructField("event", schemas.AUDIT), T.StructField("sourcetype", T.StringType())])
    # a key is `"name":` in the text; inside an escaped JSON string that byte sequence cannot occur
    no_content = (F.instr("body", '"content":') == 0) & (F.instr("body", '"prompt":') == 0)
    parsed = body.select(F.from_json("body", env).alias("e"), no_content.alias("no_content"))
    return parsed.select(F.col("e.event.request_id").alias("request_id"), F.col("e.event.team_id").alias("team_id"),
                         F.col("e.event.status").alias("status"),
                         money.usd(money.from_log(F.col("e.event.estimated_cost_usd"))).alias("estimated_cost_usd"),
                         F.col("e.sourcetype").alias("sourcetype"), "no_content")


# -- streaming (run with availableNow; the sink table is the result) ----------------------


@register("stream_redact")
def q_stream_redact(spark, sf):
    return streams.stream_redact(spark, sf)


@register("stream_daily_usage")
def q_stream_daily_usage(spark, sf):
    return streams.stream_daily_usage(spark, sf)


@register("stream_budget_admission")
def q_stream_budget_admission(spark, sf):
    return streams.stream_budget_admission(spark, sf)


@register("stream_breaker")
def q_stream_breaker(spark, sf):
    return streams.stream_breaker(spark, sf).where("outcome <> 'closed'")


@register("stream_audit_sink")
def q_stream_audit_sink(spark, sf):
    return _shown(streams.stream_audit_sink(spark, sf))


@register("stream_kpi")
def q_stream_kpi(spark, sf):
    return streams.stream_kpi(spark, sf)


@register("stream_breaker_closings")
def q_stream_breaker_closings(spark, sf):
    """T4's reports of cooldowns that ended, without another attempt or before it."""
    return streams.stream_breaker(spark, sf).where("outcome = 'closed'").select("provider", F.col("attempt_s").alias("closed_at"))


@register("stream_latency_histogram")
def q_stream_latency_histogram(spark, sf):
    return streams.stream_latency_histogram(spark, sf)


# -- extension points ---------------------------------------------------------------


@register("detector_plugin")
def q_detector_plugin(spark, sf):
    """Detector spans (Python regex in Arrow batches), resolved and applied natively."""
    red, n, ents = detector.detect_and_redact(F.col("text"))
    return documents(spark, sf).select("doc_id", red.alias("redacted_text"), n.alias("redaction_count"),
                                       F.array_join(ents, ",").alias("entities_found"))


@register("batch_completion")
def q_batch_completion(spark, sf):
    """Every request's payload through the (echo) adapter."""
    return completion.batch_complete(completion.with_payload(_payload_base(spark, sf)))


def job_bodies(spark, sf):
    """Request bodies with the time of each request's first attempt, null for a request without any."""
    first = events(spark, sf).groupBy(F.expr("CAST(floor(event_id / 4) AS BIGINT)").alias("request_id")).agg(F.min("ts").alias("ts"))
    return request_bodies(spark, sf).join(first, "request_id", "left")


JOB = config.GatewaySettings(team_budgets=config.JOB_BUDGETS)


def job_attempts(spark, sf):
    facts = pricing.with_cost(traffic.gw_audit(events(spark, sf), keep=("event_type",))).drop("provider_used")
    return traffic.gw_attempts(facts, keep=request_job.FACTS)


@register("request_job")
def q_request_job(spark, sf):
    """The whole request path: every request's outcome, and what its audit entry and response hold."""
    done = request_job.run_requests(job_bodies(spark, sf), job_attempts(spark, sf), JOB, keys=traffic.sample_keys(spark))
    return done.select("request_id", "ts", "team_id", "http_status", "status", "provider_requested", "provider_used", "model_used", "prompt_tokens_est",
                       "prompt_tokens", "completion_tokens", money.usd(F.col("est_cost")).alias("estimated_cost_usd"), money.usd(F.col("cost")).alias("cost_usd"),
                       "pii_redaction_count", F.array_join("pii_entities_redacted", ",").alias("pii_entities"), "latency_ms", "fallback_triggered",
                       "fallback_reason", "denied_by", "error_message")


@register("request_job_responses")
def q_request_job_responses(spark, sf):
    """What the callers of served requests get (nested fields taken apart for comparison)."""
    done = request_job.run_requests(job_bodies(spark, sf), job_attempts(spark, sf), JOB, keys=traffic.sample_keys(spark))
    return request_job.responses(done).select(
        "id", "provider_used", "model_used", F.col("usage.total_tokens").alias("usage_total_tokens"), F.col("usage.estimated_cost_usd").alias("usage_estimated_cost_usd"),
        F.col("pii_summary.redacted").alias("pii_redacted"), F.col("pii_summary.redaction_count").alias("pii_redaction_count"), "fallback_triggered", "ts")


@register("request_job_audit")
def q_request_job_audit(spark, sf):
    """The audit entries of the whole request path."""
    done = request_job.run_requests(job_bodies(spark, sf), job_attempts(spark, sf), JOB, keys=traffic.sample_keys(spark))
    return _shown(audit_io.audit_only(request_job.audit_entries(done))).drop("latency_ms")


@register("team_keys")
def q_team_keys(spark, sf):
    """The key -> team dimension as the traffic uses it (keys kept as SHA-256 digests only)."""
    keys = traffic.sample_keys(spark)
    r = requests(spark, sf).where(F.col("api_key").isNotNull() & (F.col("api_key") != ""))
    used = r.groupBy(F.sha2("api_key", 256).alias("key_sha256")).agg(F.count(F.lit(1)).alias("n_requests"))
    return used.join(keys, "key_sha256", "left").select("key_sha256", "team_id", "n_requests")


@register("redaction_toggle")
def q_redaction_toggle(spark, sf):
    """redaction switched off at plan time: text passes through, nothing counted."""
    return pii.redact_steps(documents(spark, sf), "text", enabled=False).select(
        "doc_id", F.col("pii_text").alias("redacted_text"), F.col("pii_count").alias("redaction_count"),
        F.array_join("pii_entities", ",").alias("entities_found"))
