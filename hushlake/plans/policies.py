"""Policies as data: actions by type, thresholds, automatic-pseudonymisation rules; all small enough to be map literals."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import taxonomy as tax

ACTIONS = ("redact", "review", "allow", "block")
# Types pseudonymised without review from these confidences on, by source.
_BOTH = (
    "email", "phone", "address", "street_address", "house_number", "postcode", "date_of_birth", "passport_number", "driving_licence_number", "national_id", "customer_number", "case_number", "employee_id", "payroll_number",
    "patient_number", "medical_record_number", "policy_number", "invoice_number", "bic_swift", "bank_account_reference", "payment_reference", "card_expiry", "ipv4", "ipv6", "mac_address", "device_identifier",
    "sensitive_url_parameter", "internal_url",
)
AUTO = (
    {t: {"regex": 0.99, "label": 0.99} for t in _BOTH}
    | {t: {"regex": 1.0, "label": 0.99} for t in ("bsn", "iban", "credit_card_number")}
    | {"person": {"label": 0.95, "contextual": 0.98, "flair": 0.98}, "location": {"contextual": 0.99, "flair": 0.99}}
)
NEED_CONTEXT = ("person", "location")


class PolicyError(ValueError):
    """Says which rule a policy breaks, by code."""


@dataclass(frozen=True)
class Policy:
    name: str
    actions: dict[str, str] = field(default_factory=lambda: dict(tax.ACTION))
    minimum: float = 0.30
    thresholds: dict[str, float] = field(default_factory=dict)
    review_contextual: bool = False
    contextual_residual: bool = False
    auto: bool = True
    blocked: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    always_review: tuple[str, ...] = ()
    low_confidence_review: tuple[str, ...] = (*tax.CRITICAL, *tax.SPECIAL)
    redaction: str = "typed_tokens"
    block_on_unreviewed: bool = True
    built_in: bool = True

    def action_for(self, entity_type: str) -> str:
        if entity_type in self.blocked:
            return "block"
        if entity_type in self.disabled:
            return "allow"
        return self.actions.get(entity_type, tax.ACTION[entity_type])

    def threshold_for(self, entity_type: str) -> float:
        return self.thresholds.get(entity_type, self.minimum)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def focused(*groups: str, strict: bool = False) -> dict[str, str]:
    """Default actions inside the groups and for critical types; review elsewhere; strict settles special categories."""
    out = {t: a if tax.GROUP[t] in groups or t in tax.CRITICAL else "review" for t, a in tax.ACTION.items()}
    if strict:
        out |= {t: "block" if t in ("genetic_data", "biometric_data") else "redact" for t in tax.SPECIAL}
    return out


_WIDE = dict(minimum=0.15, review_contextual=True, contextual_residual=True)
_PEOPLE = (tax._ID, tax._CO, tax._LO, tax._DA, tax._GO)
BUILT_IN = {
    p.name: p
    for p in (
        Policy("default"),
        Policy("strict_external_ai", {t: "block" if tax.GROUP[t] in (tax._CR, tax._SP) else "review" if t == "organization" else a for t, a in tax.ACTION.items()}, 0.15, {"person": 0.85, "organization": 0.92}, contextual_residual=True),
        Policy("gdpr", **_WIDE),
        Policy("gdpr_strict", **_WIDE),
        Policy("identifiers_only", focused(*_PEOPLE, tax._FI, tax._TE)),
        Policy("review_all_contextual", review_contextual=True, contextual_residual=True),
        Policy("personal_data", focused(*_PEOPLE, tax._RE, tax._TE)),
        Policy("financial_data", focused(tax._FI)),
        Policy("medical_data", focused(tax._ME, tax._SP), review_contextual=True),
        Policy("credentials_and_secrets", focused(tax._CR, tax._TE)),
        Policy("business_confidential", focused(tax._BU)),
        Policy("special_category_strict", focused(tax._SP, strict=True), **_WIDE),
        Policy("custom", **_WIDE, built_in=False),
    )
}


class Registry:
    """Named policies; a name is registered once."""

    def __init__(self, policies: dict[str, Policy] | None = None):
        self._own = dict(policies or BUILT_IN)

    def get(self, name: str) -> Policy:
        if name not in self._own:
            raise PolicyError("unknown_policy")
        return self._own[name]

    def names(self) -> list[str]:
        return sorted(self._own)

    def register(self, policy: Policy) -> None:
        if policy.name in self._own:
            raise PolicyError("duplicate_policy")
        self._own[policy.name] = policy

    def with_auto(self, on: bool) -> Registry:
        return Registry({k: replace(p, auto=on) for k, p in self._own.items()})


def resolve(policy: Policy, overrides: dict[str, str], unsafe: bool = False, confirmed: bool = False) -> tuple[dict[str, str], list[str]]:
    """(action by type, exceptions): allowing a critical type takes unsafe mode and confirmation, else it blocks; allowing
    a special category takes confirmation, else it is reviewed."""
    out, exceptions = {}, []
    for t in tax.TYPES:
        action = overrides.get(t, policy.action_for(t))
        if overrides.get(t) == "allow":
            if t in tax.CRITICAL and not (unsafe and confirmed):
                action = "block"
            elif t in tax.SPECIAL and not confirmed:
                action = "review"
            else:
                exceptions.append(t)
        out[t] = action
    return out, sorted(exceptions)


MAX_FILES, MAX_BYTES = 64, 64 * 1024


def load_policies(folder: str) -> dict[str, Policy]:
    """Strict policies from JSON files of a driver-side folder; anything off fails the whole load."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix == ".json")
    if len(files) > MAX_FILES:
        raise PolicyError("too_many_files")
    out: dict[str, Policy] = {}
    for p in files:
        if p.is_symlink():
            raise PolicyError("symlink")
        if p.stat().st_size > MAX_BYTES:
            raise PolicyError("file_too_large")
        try:
            raw = json.loads(p.read_text("utf-8"))
        except ValueError as bad:
            raise PolicyError("invalid_file") from bad
        if not isinstance(raw, dict) or set(raw) - set(Policy.__dataclass_fields__) or "name" not in raw:
            raise PolicyError("invalid_schema")
        policy = replace(Policy(raw["name"], built_in=False), **{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        bad_types = set(policy.actions) - set(tax.TYPES)
        if bad_types or set(policy.actions.values()) - set(ACTIONS):
            raise PolicyError("invalid_schema")
        if any(policy.action_for(t) == "allow" for t in (*tax.CRITICAL, *tax.SPECIAL)):
            raise PolicyError("allows_protected_type")
        if policy.name in out or policy.name in BUILT_IN:
            raise PolicyError("duplicate_policy")
        out[policy.name] = policy
    return out


def auto_from_env(registry: Registry, name: str = "HUSHLAKE_AUTO_PSEUDONYMISATION") -> Registry:
    value = os.environ.get(name)
    if value is None:
        return registry
    if value not in ("0", "1"):
        raise PolicyError("invalid_environment_override")
    return registry.with_auto(value == "1")


def rules_table(spark: SparkSession, policies: dict[str, Policy] | None = None) -> DataFrame:
    """(policy, entity_type, action, threshold, auto, review_contextual): policies times 67 rows."""
    rows = [(p.name, t, p.action_for(t), float(p.threshold_for(t)), p.auto, p.review_contextual) for p in (policies or BUILT_IN).values() for t in tax.TYPES]
    return spark.createDataFrame(rows, "policy string, entity_type string, action string, threshold double, auto boolean, review_contextual boolean")
