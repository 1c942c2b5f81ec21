"""PII detection and redaction as native column expressions.

The five patterns run in their fixed order on the progressively redacted
text; each step's count is taken on the text as it stands at that step, and a
pattern replaces only when it matched (the gateway's regex backend).  Every
pattern is compiled with ``(?U)`` so ``\\b \\d \\s`` are Unicode-aware as in
Python (and do not silently turn ASCII-only on newer JDKs).

Cheap exact guards skip the regex engine: EMAIL needs an ``@``; every other
pattern needs a digit.  Redaction only inserts ``<ENTITY>`` tokens, which hold
neither, so a guard computed on the original text holds for every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import config

PATTERNS = dict(config.PII_PATTERNS)
ENTITY_ORDER = tuple(name for name, _ in config.PII_PATTERNS)


def java_pattern(entity: str) -> str:
    return "(?U)" + PATTERNS[entity]


def token(entity: str) -> str:
    return f"<{entity}>"


def _guard(entity: str, text: Column) -> Column:
    if entity == "EMAIL_ADDRESS":
        return F.instr(text, "@") > 0
    return text.rlike(r"(?U)\d")


def redact_one(text: Column, entity: str) -> tuple[Column, Column]:
    """(redacted text, match count) for one entity type on ``text``."""
    pat = java_pattern(entity)
    n = F.when(_guard(entity, text), F.regexp_count(text, F.lit(pat))).otherwise(F.lit(0))
    out = F.when(n > 0, F.regexp_replace(text, F.lit(pat), F.lit(token(entity)))).otherwise(text)
    return out, n


def redact_steps(df: DataFrame, text_col: str, entities: Sequence[str] | None = None,
                 enabled: bool = True, prefix: str = "pii") -> DataFrame:
    """F8-F11 over a DataFrame column.

    Adds ``{prefix}_text`` (redacted), ``{prefix}_n_<ENTITY>`` per entity,
    ``{prefix}_count`` and ``{prefix}_entities`` (array, pattern order).
    Each step is its own projection so the intermediate text is computed once
    (no exponential expression trees), all inside one codegen stage.
    """
    chosen = [e for e in ENTITY_ORDER if entities is None or e in entities]
    cur = f"{prefix}_text"
    if not enabled:  # plan-time switch, text passes through untouched
        out = df.withColumn(cur, F.col(text_col))
        for e in ENTITY_ORDER:
            out = out.withColumn(f"{prefix}_n_{e}", F.lit(0))
        return (out.withColumn(f"{prefix}_count", F.lit(0))
                .withColumn(f"{prefix}_entities", F.array().cast("array<string>")))
    has_at = F.instr(F.col(text_col), "@") > 0
    has_digit = F.col(text_col).rlike(r"(?U)\d")
    out = df.withColumn(f"{prefix}_g_at", has_at).withColumn(f"{prefix}_g_digit", has_digit)
    out = out.withColumn(cur, F.col(text_col))
    for e in ENTITY_ORDER:
        ncol = f"{prefix}_n_{e}"
        if e not in chosen:
            out = out.withColumn(ncol, F.lit(0))
            continue
        pat = F.lit(java_pattern(e))
        guard = F.col(f"{prefix}_g_at") if e == "EMAIL_ADDRESS" else F.col(f"{prefix}_g_digit")
        out = out.withColumn(ncol, F.when(guard, F.regexp_count(F.col(cur), pat)).otherwise(F.lit(0)))
        out = out.withColumn(cur, F.when(F.col(ncol) > 0, F.regexp_replace(F.col(cur), pat, F.lit(token(e))))
                             .otherwise(F.col(cur)))
    counts = [F.col(f"{prefix}_n_{e}") for e in ENTITY_ORDER]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    found = F.filter(F.array(*[F.when(F.col(f"{prefix}_n_{e}") > 0, F.lit(e)) for e in ENTITY_ORDER]),
                     lambda x: x.isNotNull())
    return (out.withColumn(f"{prefix}_count", total.cast("int"))
            .withColumn(f"{prefix}_entities", found)
            .drop(f"{prefix}_g_at", f"{prefix}_g_digit"))
