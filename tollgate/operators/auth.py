"""Request ingest, defaults and authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.sources.dims import key_dim

def with_defaults(df: DataFrame) -> DataFrame:
    """absent fields take the declared defaults."""
    return (df.withColumn("max_tokens", F.coalesce(F.col("max_tokens").cast("bigint"),
                                                   F.lit(config.DEFAULT_MAX_TOKENS).cast("bigint")))
            .withColumn("temperature", F.coalesce(F.col("temperature").cast("double"),
                                                  F.lit(config.DEFAULT_TEMPERATURE)))
            .withColumn("team_id", F.coalesce(F.col("team_id"), F.lit(config.DEFAULT_TEAM)))
            .withColumn("stream", F.coalesce(F.col("stream"), F.lit(False))))


def _rule(name: str, failed: Column) -> Column:
    return F.when(failed, F.lit(name))


def _kind(value: Column) -> Column:
    """Kind of a JSON value: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (null), ARRAY, OBJECT; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "variant")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def _integer(value: Column) -> Column:
    """Whole numbers, also written with a zero fraction or as text, and booleans; else null."""
    kind, text = _kind(value), F.trim(_as(value, "string"))
    number = F.when(kind.isin(*NUMBERS), _as(value, "double"))
    return (F.when(number == F.floor(number), number.cast("bigint")).when(kind == "BOOLEAN", _as(value, "boolean").cast("int").cast("bigint"))
            .when((kind == "STRING") & text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), text.try_cast("double").try_cast("bigint")))


def _real(value: Column) -> Column:
    kind, text = _kind(value), F.trim(_as(value, "string"))
    return (F.when(kind.isin(*NUMBERS), _as(value, "double")).when(kind == "BOOLEAN", _as(value, "boolean").cast("int").cast("double"))
            .when(kind == "STRING", text.try_cast("double")))


def _boolean(value: Column) -> Column:
    kind, text, number = _kind(value), F.lower(_as(value, "string")), F.when(_kind(value).isin(*NUMBERS), _as(value, "double"))
    return (F.when(kind == "BOOLEAN", _as(value, "boolean")).when((kind == "STRING") & text.isin(*TRUE), True)
            .when((kind == "STRING") & text.isin(*FALSE), False).when(number == 1, True).when(number == 0, False))


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", _as(value, "string"))


def ingest(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse request JSON once, check every field's presence and type, apply defaults to absent ones, list failed rules.

    Adds the fields (null where the type is wrong), ``errors`` (array of rule names, empty when valid) and ``valid``.  Bad
    rows are kept (quarantine = ``~valid``), never dropped.  Numbers and booleans may also be written as text, as the
    gateway's schema allows; an explicit null is wrong for every field but model and provider.
    """
    v = F.col("_v")
    names = ("messages", "model", "provider", "max_tokens", "temperature", "team_id", "stream")
    parsed = raw.withColumn("_v", F.try_parse_json(F.col(body_col)))
    parsed = parsed.withColumn("_v", F.when(_kind(v) == "OBJECT", v)).withColumns({f"_{n}": _field(v, n) for n in names})
    raw_of = lambda n: F.col(f"_{n}")
    there = lambda n: raw_of(n).isNotNull()
    items = F.when(_kind(raw_of("messages")) == "ARRAY", _as(raw_of("messages"), "array<variant>"))
    part = lambda m, n: F.try_variant_get(m, f"$.{n}", "variant")
    messages = F.transform(items, lambda m: F.struct(_text(part(m, "role")).alias("role"), _text(part(m, "content")).alias("content"),
                                                     (_kind(m) == "OBJECT").alias("ok")))
    out = parsed.withColumn("_m", messages).withColumns({
        "messages": F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))),
        "model": _text(raw_of("model")), "provider": _text(raw_of("provider")),
        "max_tokens": F.when(there("max_tokens"), _integer(raw_of("max_tokens"))).otherwise(F.lit(config.DEFAULT_MAX_TOKENS).cast("bigint")),
        "temperature": F.when(there("temperature"), _real(raw_of("temperature"))).otherwise(F.lit(config.DEFAULT_TEMPERATURE)),
        "team_id": F.when(there("team_id"), _text(raw_of("team_id"))).otherwise(F.lit(config.DEFAULT_TEAM)),
        "stream": F.when(there("stream"), _boolean(raw_of("stream"))).otherwise(F.lit(False)),
    })
    lo, hi = config.MAX_TOKENS_RANGE
    tlo, thi = config.TEMPERATURE_RANGE
    typed = F.size(F.filter("_m", lambda m: ~m["ok"])) == 0
    objects = F.filter("_m", lambda m: m["ok"])
    wrong = lambda n: there(n) & F.col(n).isNull()
    optional = lambda n: wrong(n) & (_kind(raw_of(n)) != "VOID")
    errors = F.array(
        _rule("json", v.isNull()),
        _rule("messages_missing", v.isNotNull() & ~there("messages")),
        _rule("messages_type", there("messages") & (F.col("_m").isNull() | ~typed)),
        _rule("message_role", F.exists(objects, lambda m: ~F.coalesce(m["role"].isin(*config.MESSAGE_ROLES), F.lit(False)))),
        _rule("message_content", F.exists(objects, lambda m: m["content"].isNull())),
        _rule("model_type", optional("model")),
        _rule("provider_enum", optional("provider") | ~F.col("provider").isin(*config.PROVIDERS)),
        _rule("max_tokens_type", wrong("max_tokens")),
        _rule("max_tokens_range", (F.col("max_tokens") < lo) | (F.col("max_tokens") > hi)),
        _rule("temperature_type", wrong("temperature")),
        _rule("temperature_range", (F.col("temperature") < tlo) | (F.col("temperature") > thi)),
        _rule("team_id_type", wrong("team_id")),
        _rule("stream_type", wrong("stream")),
    )
    return (out.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).withColumn("valid", F.size("errors") == 0)
            .drop("_v", "_m", *(f"_{n}" for n in names)))


def with_team_from_key(df: DataFrame, key_col: str = "api_key", keys: DataFrame | None = None) -> DataFrame:
    """J1 + F2: lookup of the key's SHA-256 in a table of digests (``keys``: key_sha256, team_id; without one
    no key is known).  It grows with the teams, so whether it is broadcast is left to its size at run time.

    Missing/empty key -> 401, unknown key -> 403, known key -> 200 and
    ``key_team_id`` (which overrides any team the request body named).
    """
    keys = (key_dim(df.sparkSession) if keys is None else keys).select(F.col("key_sha256"), F.col("team_id").alias("_key_team"))
    k = F.col(key_col)
    status = (F.when(k.isNull() | (k == ""), F.lit(401))
              .when(F.col("key_sha256").isNull(), F.lit(403)).otherwise(F.lit(200)))
    detail = (F.when(status == 401, F.lit("Missing API key. Include X-API-Key header."))
              .when(status == 403, F.lit("Invalid API key.")))
    return (df.join(keys, F.sha2(k, 256) == F.col("key_sha256"), "left")
            .withColumn("http_status", status)
            .withColumn("auth_detail", detail)
            .withColumn("key_team_id", F.when(F.col("http_status") == 200, F.col("_key_team")))
            .drop("_key_team", "key_sha256"))
