"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("team_id", T.StringType()),
    T.StructField("provider_requested", T.StringType()),
    T.StructField("provider_used", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("estimated_cost_usd", T.DoubleType()),
    T.StructField("pii_entities_redacted", T.ArrayType(T.StringType())),
    T.StructField("pii_redaction_count", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("fallback_triggered", T.BooleanType()),
    T.StructField("fallback_reason", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
AUDIT_COLUMNS = [f.name for f in AUDIT.fields]

PRICE = T.StructType([
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("input", T.DecimalType(12, 8), False),
    T.StructField("output", T.DecimalType(12, 8), False),
])

# Money is an exact decimal and turned into a rounded double at the edge.  One request's cost: prices have 8 places and are
# per 1000 tokens.  Sums have 26 digits before the point; limits 20, so "no limit" can be any large number.
COST = T.DecimalType(28, 11)
SPEND = T.DecimalType(37, 11)
LIMIT = T.DecimalType(24, 4)
