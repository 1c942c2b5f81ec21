"""Small dimension tables (prices, keys, providers, budgets).

Each one has a fixed, tiny row count, so joins against them are broadcast by
construction; their size never grows with the traffic.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import config, schemas


def price_dim(spark: SparkSession) -> DataFrame:
    """(provider, model, input, output) in USD per 1K tokens, decimal(12,8)."""
    rows = [(p, m, Decimal(i), Decimal(o)) for p, m, i, o in config.PRICES]
    return spark.createDataFrame(rows, schemas.PRICE)


def key_dim(spark: SparkSession, settings: config.GatewaySettings = config.DEFAULT_SETTINGS) -> DataFrame:
    """SHA-256 digest of an API key -> team, from the settings; by default nobody is let in."""
    return spark.createDataFrame(list(settings.team_keys), "key_sha256 string, team_id string")


def provider_dim(spark: SparkSession, settings: config.GatewaySettings = config.DEFAULT_SETTINGS) -> DataFrame:
    """Registered providers with default model, configured flag and priority position.

    ``configured`` follows the adapters: a key must be present, and Azure also
    needs its endpoint (F17).
    """
    prio = {p: i + 1 for i, p in enumerate(settings.provider_priority)}
    rows = []
    for p, default_model in config.DEFAULT_MODELS:
        has_key = p in settings.configured_providers
        configured = has_key and (settings.azure_endpoint_set if p == "azure_openai" else True)
        rows.append((p, default_model, bool(configured), prio.get(p)))
    return spark.createDataFrame(rows, "provider string, default_model string, configured boolean, priority int")


def budget_dim(spark: SparkSession, settings: config.GatewaySettings = config.DEFAULT_SETTINGS) -> DataFrame:
    """Configured team limits (teams not listed fall back to the defaults, J3)."""
    rows = [(t, Decimal(d), Decimal(m)) for t, d, m in settings.team_budgets]
    return spark.createDataFrame(rows, "team_id string, daily_limit decimal(24,4), monthly_limit decimal(24,4)")


def latest_budget_config(changes: DataFrame) -> DataFrame:
    """Last write wins per team, ordered by (ts, seq).

    ``max_by`` is a plain aggregate, so it runs as partial + final
    aggregation: a team with a huge change log is combined map-side first.
    """
    return (changes.groupBy("team_id")
            .agg(F.max_by(F.struct("daily_limit", "monthly_limit"), F.struct("ts", "seq")).alias("cfg"),
                 F.count(F.lit(1)).alias("n_changes"))
            .select("team_id", "cfg.daily_limit", "cfg.monthly_limit", "n_changes"))
