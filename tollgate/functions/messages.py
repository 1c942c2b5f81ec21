"""Message-list expressions: token estimate, model resolution, vendor payloads.

Messages are ``array<struct<role, content>>``; everything here is a
higher-order column function (filter/transform/aggregate), evaluated per row
in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate import config


def word_count(text: Column) -> Column:
    """Python ``len(text.split())``: runs of Unicode whitespace, no empty pieces."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1C-\x1F]+"), lambda w: w != ""))


def token_estimate(words: Column) -> Column:
    """``int(words * 1.3)`` (truncation, double arithmetic as in Python)."""
    return (words * F.lit(float(config.GEMINI_TOKENS_PER_WORD))).cast("bigint")


def prompt_words(messages: Column) -> Column:
    """Words over *all* messages, system included."""
    return F.aggregate(messages, F.lit(0), lambda acc, m: acc + word_count(m["content"]))


def resolve_model(model: Column, default_model: Column) -> Column:
    """F16: ``model or default``; the empty string counts as absent."""
    return F.coalesce(F.nullif(model, F.lit("")), default_model)


def flat(messages: Column) -> Column:
    """Canonical text rendering of a message list: ``role:content`` lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")


def anthropic_payload(messages: Column) -> tuple[Column, Column]:
    """(system, messages): the *first* system message is kept, every one removed."""
    system = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"]
    rest = F.filter(messages, lambda m: m["role"] != "system")
    return system, rest


def gemini_payload(messages: Column) -> tuple[Column, Column]:
    """(prompt, history): system dropped, assistant -> model, last turn is the prompt."""
    chat = F.transform(F.filter(messages, lambda m: m["role"] != "system"),
                       lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("model").alias("role"),
                                          m["content"].alias("content")))
    prompt = F.coalesce(F.try_element_at(chat, F.lit(-1))["content"], F.lit(""))
    history = F.when(F.size(chat) > 0, F.slice(chat, 1, F.size(chat) - 1)).otherwise(chat)
    return prompt, history


def payload_json(model: Column, messages: Column, max_tokens: Column, temperature: Column | None = None,
                 system: Column | None = None) -> Column:
    """Request body as JSON text (null fields omitted, as the SDKs do)."""
    fields = [model.alias("model"), max_tokens.alias("max_tokens"), messages.alias("messages")]
    if temperature is not None:
        fields.append(temperature.alias("temperature"))
    if system is not None:
        fields.append(system.alias("system"))
    return F.to_json(F.struct(*fields))
