"""J2 price lookup and F14 cost over a traffic table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.functions.money import token_cost
from tollgate.sources.dims import price_dim


def with_price(df: DataFrame, provider: str = "provider_used", model: str = "model_used") -> DataFrame:
    """Attach price_in/price_out and the tier that resolved them.

    Exact (provider, model) -> provider's ``default`` -> global fallback.  Both
    lookups are broadcast hash joins against the fixed 13-row catalogue, so the
    traffic side is never shuffled.
    """
    prices = price_dim(df.sparkSession)
    exact = prices.select(F.col("provider").alias("_xp"), F.col("model").alias("_xm"),
                          F.col("input").alias("_xi"), F.col("output").alias("_xo"))
    dflt = prices.where(F.col("model") == "default").select(
        F.col("provider").alias("_dp"), F.col("input").alias("_di"), F.col("output").alias("_do"))
    fin, fout = (F.lit(v).cast("decimal(12,8)") for v in config.FALLBACK_PRICE)
    return (df
            .join(F.broadcast(exact), (F.col(provider) == F.col("_xp")) & (F.col(model) == F.col("_xm")), "left")
            .join(F.broadcast(dflt), F.col(provider) == F.col("_dp"), "left")
            .withColumn("price_in", F.coalesce("_xi", "_di", fin))
            .withColumn("price_out", F.coalesce("_xo", "_do", fout))
            .withColumn("price_tier", F.when(F.col("_xp").isNotNull(), "model")
                        .when(F.col("_dp").isNotNull(), "provider_default").otherwise("global_default"))
            .drop("_xp", "_xm", "_xi", "_xo", "_dp", "_di", "_do"))


def with_cost(df: DataFrame, provider: str = "provider_used", model: str = "model_used",
              prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """F14 on every row: exact decimal ``cost``, and ``est_cost``, what the call may cost at most and is checked against
    budgets before it: the prompt and as many tokens as it may return (``max_tokens``, or the default)."""
    most = F.coalesce(F.col("max_tokens"), F.lit(config.DEFAULT_MAX_TOKENS)) if "max_tokens" in df.columns else F.lit(config.DEFAULT_MAX_TOKENS)
    return with_price(df, provider, model).withColumns({
        "cost": token_cost(F.col(prompt), F.col(completion), F.col("price_in"), F.col("price_out")),
        "est_cost": token_cost(F.col(prompt), most.cast("bigint"), F.col("price_in"), F.col("price_out"))})
