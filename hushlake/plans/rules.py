"""Detection rules as data. A guard is a cheap test of the whole text; only texts that pass it meet the pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    entity_type: str
    pattern: str
    guard: str
    validator: str | None = None
    confidence: float = 1.0
    precedence: int = 50
    fix: str | None = None  # what happens to a match before it is checked


@dataclass(frozen=True)
class Label:
    name: str
    entity_type: str
    labels: tuple[str, ...]
    value: str
    validator: str | None = None
    confidence: float = 0.99

    @property
    def pattern(self) -> str:
        names = "|".join(re.escape(x) for x in sorted(self.labels, key=len, reverse=True))
        return rf"(?imuU)(?<!\w)(?:{names})[^\S\r\n]*[:=#][^\S\r\n]*({self.value})"


# The patterns, in Java syntax, that findings must agree with.
EMAIL_ATOM = "[A-Z0-9_%+'-]"
EMAIL_LABEL = "[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
EMAIL = rf"{EMAIL_ATOM}+(?:\.{EMAIL_ATOM}+)*@(?:{EMAIL_LABEL}\.)+[A-Z]{{2,63}}"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december"
DATE = rf"(?:\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}})"
IDENTIFIER = "[A-Z0-9][A-Z0-9._/-]{2,127}"
FIELD = r"[^\r\n;|]{2,160}"
CAP = "[A-ZÀ-ÖØ-Ý][\\wÀ-ÖØ-öø-ÿ'’.-]+"
DIGIT = "[0-9]"
RULES = (
    Rule("private_key", "private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]{1,8192}?-----END [A-Z0-9 ]*PRIVATE KEY-----", "PRIVATE KEY-----", precedence=95),
    Rule("complete_dutch_address", "address", rf"(?U)(?<!\w)(?:{CAP}(?:\s+|$)){{1,5}}\d{{1,5}}[A-Za-z]?(?:[-/]\d+)?\s*,?\s*[1-9]\d{{3}}\s?[A-Z]{{2}}\s+{CAP}(?:\s+{CAP}){{0,3}}(?:\s*,\s*(?:Netherlands|Nederland|Belgium|België|Germany|Deutschland))?", r"[1-9][0-9]{3}\s?[A-Z]{2}\s", precedence=90),
    Rule("credit_card", "credit_card_number", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", DIGIT, "luhn", precedence=90),
    Rule("iban", "iban", r"(?i)(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])", "[A-Za-z]{2}[0-9]{2}", "iban", precedence=90, fix="iban"),
    Rule("mac_address", "mac_address", r"(?i)(?<![0-9A-F])(?:(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}|[0-9A-F]{4}(?:\.[0-9A-F]{4}){2})(?![0-9A-F])", r"[0-9A-Fa-f]{2}[:.-][0-9A-Fa-f]{2}", precedence=85),
    Rule("dutch_bsn", "bsn", r"(?<!\d)\d{9}(?!\d)", "[0-9]{9}", "bsn", precedence=90),
    Rule("ipv6", "ipv6", r"(?i)(?<![0-9A-F:.])(?:[0-9A-F]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-F]{0,4})(?![0-9A-F:.])", ":[0-9A-Fa-f]{0,4}:", "ipv6", precedence=80),
    Rule("ipv4", "ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"[0-9]\.[0-9]", "ipv4", precedence=80),
    Rule("email", "email", rf"(?iU)(?<![\w.%+'@-])(?=[^@\s]{{1,64}}@){EMAIL}(?![\w-]|[/\\?&#=:]|\.(?:[\w-]|\.))", "@", "email", precedence=80, fix="quote"),
    Rule("dutch_postcode", "postcode", r"(?i)(?<![A-Z0-9])[1-9]\d{3}\s?[A-Z]{2}(?![A-Z0-9])", "[1-9][0-9]{3}", precedence=70),
    Rule("general_date", "date", rf"(?i){DATE}", "[0-9]{4}", confidence=0.90, precedence=55),
    Rule("time", "time", r"(?i)(?<![A-Z0-9:])(?:[01]\d|2[0-3]):[0-5]\d(?![A-Z0-9:])", "[0-9]:[0-5]", confidence=0.95, precedence=55),
    Rule("phone", "phone", r"(?U)(?<![\w-])(?:\+\s*|(?=\d))\d[\d(). -]{5,}\d(?![\w-])", DIGIT, "phone", precedence=40),
)
_FREE = dict(value=FIELD, confidence=0.95)
_NUM = dict(value=IDENTIFIER, validator="identifier")
LABELS = (
    Label("name_label", "person", ("name", "naam"), **_FREE),
    Label("date_of_birth_label", "date_of_birth", ("date of birth", "birth date", "geboortedatum"), DATE),
    Label("address_label", "address", ("address", "adres", "street address"), r"[^\r\n;|]{5,180}"),
    Label("email_label", "email", ("email", "e-mail", "e-mailadres"), EMAIL, "email"),
    Label("phone_label", "phone", ("telephone", "phone", "telefoon", "mobiel"), r"\+?\d[\d(). -]{5,}\d", "phone"),
    Label("bsn_label", "bsn", ("BSN", "burgerservicenummer"), r"\d{9}", "bsn"),
    Label("passport_label", "passport_number", ("passport", "passport number", "paspoort", "paspoortnummer"), **_NUM),
    Label("driving_licence_label", "driving_licence_number", ("driving licence", "driving licence number", "driver licence", "driver license", "rijbewijs", "rijbewijsnummer"), **_NUM),
    Label("national_id_label", "national_id", ("national ID", "ID number", "identiteitsnummer"), **_NUM),
    Label("customer_number_label", "customer_number", ("customer number", "customer ID", "klantnummer", "klant ID"), **_NUM),
    Label("case_number_label", "case_number", ("case number", "case ID", "zaaknummer", "dossiernummer"), **_NUM),
    Label("employee_id_label", "employee_id", ("employee ID", "employee number", "medewerker ID", "personeelsnummer"), **_NUM),
    Label("payroll_number_label", "payroll_number", ("payroll number", "payroll ID", "loonnummer", "salarisnummer"), **_NUM),
    Label("patient_number_label", "patient_number", ("patient number", "patient ID", "patiëntnummer", "patientnummer"), **_NUM),
    Label("medical_record_number_label", "medical_record_number", ("medical record number", "medical record ID", "MRN", "medisch dossiernummer"), **_NUM),
    Label("policy_number_label", "policy_number", ("policy number", "insurance policy", "polisnummer"), **_NUM),
    Label("invoice_number_label", "invoice_number", ("invoice number", "invoice ID", "factuurnummer"), **_NUM),
    Label("iban_label", "iban", ("IBAN",), r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", "iban"),
    Label("bic_swift_label", "bic_swift", ("BIC", "SWIFT", "BIC/SWIFT"), "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", "bic"),
    Label("account_reference_label", "bank_account_reference", ("account reference", "bank account reference", "rekeningreferentie"), **_NUM),
    Label("payment_reference_label", "payment_reference", ("payment reference", "betalingskenmerk", "betalingsreferentie"), **_NUM),
    Label("credit_card_label", "credit_card_number", ("credit card", "card number", "creditcard", "kaartnummer"), r"(?:\d[ -]?){12,18}\d", "luhn"),
    Label("card_expiry_label", "card_expiry", ("expiry", "expiry date", "card expiry", "valid thru", "vervaldatum"), r"(?:0[1-9]|1[0-2])/(?:\d{2}|\d{4})", "card_expiry"),
    Label("card_security_code_label", "card_security_code", ("CVV", "CVC", "security code", "card security code", "beveiligingscode"), r"\d{3,4}"),
    Label("department_label", "department", ("department", "internal department", "afdeling"), **_FREE),
    Label("project_label", "project_name", ("project", "project name", "confidential project", "projectnaam"), **_FREE),
    Label("diagnosis_label", "medical_condition", ("diagnosis", "diagnose", "condition", "aandoening"), **_FREE),
    Label("medication_label", "medication", ("medication", "medicine", "medicatie", "geneesmiddel"), **_FREE),
    Label("dosage_label", "dosage", ("dosage", "dose", "dosering"), **_FREE),
    Label("health_insurer_label", "health_insurer", ("health insurer", "insurer", "zorgverzekeraar"), **_FREE),
    Label("ipv4_label", "ipv4", ("IPv4", "IPv4 address"), r"(?:\d{1,3}\.){3}\d{1,3}", "ipv4"),
    Label("ipv6_label", "ipv6", ("IPv6", "IPv6 address"), "[0-9A-F:.]{2,45}", "ipv6"),
    Label("mac_label", "mac_address", ("MAC", "MAC address", "MAC-adres"), r"(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}|[0-9A-F]{4}(?:\.[0-9A-F]{4}){2}"),
    Label("device_label", "device_identifier", ("device identifier", "device ID", "apparaat-ID"), **_NUM),
    Label("session_token_label", "session_token", ("session token", "session ID", "sessietoken", "session key"), FIELD),
    Label("api_token_label", "api_token", ("API token", "API key", "API-token", "API-sleutel"), FIELD),
    Label("access_token_label", "access_token", ("access token", "bearer token", "authorization token", "toegangstoken"), FIELD),
    Label("password_label", "password", ("password", "passphrase", "wachtwoord"), r"\S{4,255}"),
    Label("appointment_label", "appointment", ("appointment", "appointment date", "afspraak", "afspraakdatum"), rf"{DATE}(?:\s+(?:at|om)\s+(?:[01]\d|2[0-3]):[0-5]\d)?", confidence=0.98),
)
#: One scan decides whether any label rule can apply.
ANY_LABEL = "(?iuU)(?:" + "|".join(re.escape(x) for x in sorted({y for r in LABELS for y in r.labels}, key=len, reverse=True)) + r")[^\S\r\n]*[:=#]"
PREFIXES = dict(
    ACC="bank_account_reference", CUST="customer_number", KLANT="customer_number", CASE="case_number", ZAAK="case_number", EMP="employee_id", PAYROLL="payroll_number", PAY="payment_reference", PAT="patient_number", MRN="medical_record_number",
    POL="policy_number", INV="invoice_number", DEV="device_identifier", DL="driving_licence_number", DV="driving_licence_number", UNION="trade_union_membership", GEN="genetic_data", BIO="biometric_data", FACE="biometric_data",
    IRIS="biometric_data", VOICE="biometric_data",
)
QUERY_KEYS = ("account", "account_id", "account_reference", "api_key", "apikey", "case", "case_id", "customer", "customer_id", "email", "session", "session_id", "token", "access_token", "user", "user_id")
URL = r"(?iU)\b(?:https?://|www\.)[^\s<>\[\]()]+"
CREDITOR = r"(?i)(?<![A-Z0-9])RF\d{8,25}(?![A-Z0-9])"
SECRET = "(?i)(?<![A-Z0-9])(?:sk-(?:test|live)-[A-Z0-9_-]{3,}|ghp_[A-Z0-9]{8,}|xox[baprs]-[A-Z0-9-]{8,}|sess(?:ion)?[-_][A-Z0-9_-]{6,})(?![A-Z0-9])"
INTERNAL_PATHS = ("/case-management", "/crm/", "/portal/", "/admin/")
# Own rules for credentials: header values, vendor keys, assignments of long random values.
CREDENTIALS = (
    Rule("bearer_header", "access_token", r"(?i)\bBearer\s+([A-Z0-9._~+/=-]{8,})", "(?i)bearer", precedence=95),
    Rule("vendor_key", "api_token", r"\b((?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}|sk-(?:test|live)-[A-Za-z0-9_-]{3,}|xox[baprs]-[A-Za-z0-9-]{8,})", "gh[posr]_|AKIA|sk-|xox", precedence=95),
    Rule("assigned_secret", "unknown_secret", r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\s*[:=]\s*[\"']?([A-Z0-9_./+=-]{16,})", "(?i)key|secret|token|passw", precedence=90),
)
