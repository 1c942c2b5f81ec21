"""Batch completion through a provider adapter, as ``mapInPandas``.

An adapter is a callable ``(pandas.DataFrame) -> pandas.DataFrame`` taking
columns request_id, provider, model, payload (JSON text) and returning
request_id, provider, model_used, content, prompt_tokens, completion_tokens,
error.  It runs once per Arrow batch on the executors; network adapters
would batch their calls there.  The shipped adapter is a deterministic echo
used for tests (no network).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import config
from tollgate.session import ship_package
from tollgate.functions import messages as msg

RESULT_SCHEMA = ("request_id long, provider string, model_used string, content string, prompt_tokens long, "
                 "completion_tokens long, error string")


def _words(s: str | None) -> int:
    return len(s.split()) if s else 0


def echo_adapter(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers with the last non-system turn it was sent; token counts as each vendor reports them
    (whitespace words; Gemini's estimate is int(words * 1.3) over every message, system included)."""
    out = []
    for r in pdf.itertuples(index=False):
        p = json.loads(r.payload)
        if r.provider == "gemini":
            content = p.get("prompt", "")
            every = [m["content"] for m in p.get("all_messages", [])]
            pt = int(_words(" ".join(every)) * float(config.GEMINI_TOKENS_PER_WORD))
            ct = int(_words(content) * float(config.GEMINI_TOKENS_PER_WORD))
        else:
            sent = p.get("messages", [])
            non_system = [m for m in sent if m["role"] != "system"]
            content = non_system[-1]["content"] if non_system else ""
            texts = [m["content"] for m in sent] + ([p["system"]] if p.get("system") else [])
            pt = sum(_words(t) for t in texts)
            ct = _words(content)
        out.append((r.request_id, r.provider, r.model, content, pt, ct, None))
    return pd.DataFrame(out, columns=["request_id", "provider", "model_used", "content", "prompt_tokens",
                                      "completion_tokens", "error"])


def with_payload(requests: DataFrame) -> DataFrame:
    """Pick the provider (invalid/absent -> first in priority), resolve the model, build its payload."""
    prio = config.PROVIDERS
    prov = F.when(F.col("provider").isin(*prio), F.col("provider")).otherwise(F.lit(prio[0]))
    defaults = dict(config.DEFAULT_MODELS)
    dflt = F.when(prov == "anthropic", defaults["anthropic"]).when(prov == "openai", defaults["openai"]) \
        .when(prov == "azure_openai", defaults["azure_openai"]).otherwise(defaults["gemini"])
    m = F.col("messages")
    system, rest = msg.anthropic_payload(m)
    prompt, history = msg.gemini_payload(m)
    model = msg.resolve_model(F.col("model"), dflt)
    payload = (F.when(prov == "anthropic", msg.payload_json(model, rest, F.col("max_tokens"), system=system))
               .when(prov == "gemini", F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"),
                                                          history.alias("history"), m.alias("all_messages"))))
               .otherwise(msg.payload_json(model, m, F.col("max_tokens"), F.col("temperature"))))
    return requests.select("request_id", prov.alias("provider"), model.alias("model"), payload.alias("payload"))


def batch_complete(payloads: DataFrame, adapter=echo_adapter) -> DataFrame:
    """Run ``adapter`` over Arrow batches.

    An adapter reports a failed request in its ``error`` column.  If it raises, its batch is halved until the requests
    that fail stand alone; each of those gets the exception as its ``error``, and the others their answers.
    """
    ship_package(payloads.sparkSession)

    def answers(pdf):
        try:
            return [adapter(pdf)]
        except Exception as e:  # noqa: BLE001 - an adapter failure is data, not a job failure
            if len(pdf) > 1:
                half = len(pdf) // 2
                return answers(pdf.iloc[:half]) + answers(pdf.iloc[half:])
            return [pd.DataFrame({"request_id": pdf["request_id"], "provider": pdf["provider"], "model_used": pdf["model"], "content": None,
                                  "prompt_tokens": None, "completion_tokens": None, "error": f"{type(e).__name__}: {e}"})]

    def run(batches):
        for pdf in batches:
            yield from answers(pdf)

    return payloads.mapInPandas(run, RESULT_SCHEMA)
