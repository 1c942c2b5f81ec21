"""Job settings and the fixed values the results depend on.

Settings are plain frozen dataclasses passed to the jobs; nothing is read
from the environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the gateway's published behaviour for equal results)
# ---------------------------------------------------------------------------

PROVIDERS = ("anthropic", "openai", "azure_openai", "gemini")

# USD per 1K tokens: (provider, model, input, output)
PRICES = (
    ("anthropic", "claude-opus-4-6", "0.015", "0.075"),
    ("anthropic", "claude-sonnet-4-6", "0.003", "0.015"),
    ("anthropic", "claude-haiku-4-5", "0.00025", "0.00125"),
    ("anthropic", "default", "0.003", "0.015"),
    ("openai", "gpt-4o", "0.005", "0.015"),
    ("openai", "gpt-4o-mini", "0.00015", "0.0006"),
    ("openai", "gpt-4-turbo", "0.010", "0.030"),
    ("openai", "default", "0.005", "0.015"),
    ("azure_openai", "gpt-4o", "0.005", "0.015"),
    ("azure_openai", "default", "0.005", "0.015"),
    ("gemini", "gemini-1.5-pro", "0.00125", "0.005"),
    ("gemini", "gemini-1.5-flash", "0.000075", "0.0003"),
    ("gemini", "default", "0.00125", "0.005"),
)
# price used when the provider is not in the table at all
FALLBACK_PRICE = ("0.005", "0.015")

# provider -> default model (azure uses its deployment name)
DEFAULT_MODELS = (
    ("anthropic", "claude-sonnet-4-6"),
    ("openai", "gpt-4o"),
    ("azure_openai", "gpt-4o"),
    ("gemini", "gemini-1.5-flash"),
)

# PII entity -> pattern, applied in this order on the progressively redacted text
PII_PATTERNS = (
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE_NUMBER", r"\b(\+?1?\s?)?(\(?\d{3}\)?[\s.\-]?)(\d{3}[\s.\-]?\d{4})\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)

BREAKER_FAILURE_THRESHOLD = 3
BREAKER_COOLDOWN_SECONDS = 60

DEFAULT_DAILY_BUDGET_USD = "10"
DEFAULT_MONTHLY_BUDGET_USD = "200"

# request defaults and validation ranges
DEFAULT_MAX_TOKENS = 1024
MAX_TOKENS_RANGE = (1, 8192)
DEFAULT_TEMPERATURE = 0.7
TEMPERATURE_RANGE = (0.0, 2.0)
DEFAULT_TEAM = "default"
MESSAGE_ROLES = ("user", "assistant", "system")

GEMINI_TOKENS_PER_WORD = "1.3"

UNCONFIGURED_MSG = "Not configured (missing API key)"
BREAKER_OPEN_MSG = "Circuit breaker open (too many recent failures)"
SIEM_SOURCETYPE = "ai_gateway"

# ---------------------------------------------------------------------------
# Fixed values of the test workload (team budgets used by the budget jobs)
# ---------------------------------------------------------------------------

# team -> (daily, monthly) USD limits; other teams get the defaults
TEAM_BUDGETS = (
    ("finance-team", "0.50", "1000"),
    ("engineering-team", "1000", "10"),
    ("marketing-team", "1000", "1000"),
)
# the same for the composed request job, whose requests are few
JOB_BUDGETS = (
    ("finance-team", "0.02", "1000"),
    ("engineering-team", "1000", "0.03"),
)


@dataclass(frozen=True)
class GatewaySettings:
    """Options a job can change; defaults are the gateway's defaults."""

    pii_redaction_enabled: bool = True
    pii_entities: tuple[str, ...] = tuple(name for name, _ in PII_PATTERNS)
    provider_priority: tuple[str, ...] = PROVIDERS
    configured_providers: tuple[str, ...] = PROVIDERS
    azure_endpoint_set: bool = True
    default_daily_budget_usd: str = DEFAULT_DAILY_BUDGET_USD
    default_monthly_budget_usd: str = DEFAULT_MONTHLY_BUDGET_USD
    breaker_threshold: int = BREAKER_FAILURE_THRESHOLD
    breaker_cooldown_s: int = BREAKER_COOLDOWN_SECONDS
    audit_recent_limit: int = 100
    dashboard_rows: int = 200
    dashboard_shown: int = 50
    histogram_bins: int = 30
    team_budgets: tuple[tuple[str, str, str], ...] = field(default=TEAM_BUDGETS)
    #: (SHA-256 of an API key, team); keys themselves are never kept
    team_keys: tuple[tuple[str, str], ...] = ()


DEFAULT_SETTINGS = GatewaySettings()
