"""Rows made from a table's keys that each rule should and should not find, with what it should find, in SQL that Spark and
other engines read alike. k stands for the key."""

from __future__ import annotations

from dataclasses import dataclass

from . import rules as R

K = "CAST(k AS STRING)"
#: Every fourth key brings a value that a rule must refuse.
BAD = "k % 4 = 0"


def _lpad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def _either(bad: str, good: str) -> str:
    return f"CASE WHEN {BAD} THEN {bad} ELSE {good} END"


def choice(n: str, values) -> str:
    values = list(values)
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_DIGITS = lambda v, n: [f"CAST(substr({v}, {i + 1}, 1) AS INT)" for i in range(n)]
NINE, SIXTEEN = _lpad("k * 104729 % 1000000000", 9), "lpad(CAST(k * 7919 AS STRING), 16, '4')"
BSN_OK = f"{NINE} <> '000000000' AND (" + " + ".join(f"({9 - i if i < 8 else -1}) * {d}" for i, d in enumerate(_DIGITS(NINE, 9))) + ") % 11 = 0"
LUHN_OK = "(" + " + ".join(f"({d} * {2 - i % 2} - CASE WHEN {d} * {2 - i % 2} > 9 THEN 9 ELSE 0 END)" for i, d in enumerate(_DIGITS(SIXTEEN, 16))) + ") % 10 = 0"
_ACCOUNT = _lpad("k * 7919", 10)
_CHECK = _lpad(f"98 - CAST(CAST('10112310' || {_ACCOUNT} || '232100' AS DECIMAL(38, 0)) % 97 AS INT)", 2)
_DAY = "CAST(1 + k % 28 AS STRING)"
_YEAR = "CAST(1950 + k % 50 AS STRING)"

GOOD = f"NOT ({BAD})"
IDENTIFIER = _either("'ABCDEF'", f"'AB-' || {K}"), GOOD
FREE = f"'some words ' || {K}", "true"
DATE = f"{_DAY} || {_either(chr(39) + ' Floreal ' + chr(39), chr(39) + ' March ' + chr(39))} || {_YEAR}", GOOD
IBAN = _either("'ZZ'", "'NL'") + f" || {_CHECK} || 'ABNA' || {_ACCOUNT}", GOOD
EMAIL = f"'user' || {_either(chr(39) + '..' + chr(39), chr(39) + '.' + chr(39))} || {K} || '@example.com'", GOOD
PHONE = _either("'12 34'", f"'+31 20 ' || {_lpad('k', 7)}"), GOOD
IPV4 = "'10.' || CAST(k % 300 AS STRING) || '.0.' || CAST(k % 200 AS STRING)", "k % 300 <= 255"
IPV6 = f"'2001:db8::' || {_either(chr(39) + '1::' + chr(39), chr(39) + chr(39))} || CAST(k % 10000 AS STRING)", GOOD
MAC = f"{_either(chr(39) + 'GG' + chr(39), chr(39) + '0A' + chr(39))} || ':1B:44:11:3A:' || {_lpad('k % 100', 2)}", GOOD
#: Value and whether it must be found, by label rule; the others take an identifier.
LABELLED = {
    **dict.fromkeys(("name_label", "department_label", "project_label", "diagnosis_label", "medication_label", "dosage_label", "health_insurer_label", "session_token_label", "api_token_label", "access_token_label"), FREE),
    "address_label": FREE,
    "date_of_birth_label": DATE,
    "email_label": EMAIL,
    "phone_label": PHONE,
    "bsn_label": (NINE, BSN_OK),
    "iban_label": IBAN,
    "bic_swift_label": ("'ABNANL2' || " + _either("''", "'A'"), GOOD),
    "credit_card_label": (SIXTEEN, LUHN_OK),
    "card_expiry_label": (f"{_lpad('k % 20', 2)} || '/27'", "k % 20 BETWEEN 1 AND 12"),
    "card_security_code_label": (_either("'x' || " + _lpad("k % 100", 2), _lpad("k % 1000", 3)), GOOD),
    "ipv4_label": IPV4,
    "ipv6_label": IPV6,
    "mac_label": MAC,
    "password_label": (_either("'abc'", f"'pass' || {K}"), GOOD),
    "appointment_label": (f"{DATE[0]} || ' at 10:30'", GOOD),
}
#: The same by unlabelled rule.
PLAIN = {
    "private_key": ("'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || " + K + " || chr(10) || " + _either("'-----END CERTIFICATE-----'", "'-----END RSA PRIVATE KEY-----'"), GOOD),
    "complete_dutch_address": ("'Dorpsstraat ' || CAST(1 + k % 900 AS STRING) || ', ' || " + _either("'0'", "'1'") + " || '234 AB Utrecht'", GOOD),
    "credit_card": (SIXTEEN, LUHN_OK),
    "iban": IBAN,
    "mac_address": MAC,
    "dutch_bsn": (NINE, BSN_OK),
    "ipv6": IPV6,
    "ipv4": IPV4,
    "email": EMAIL,
    "dutch_postcode": (_either("'0'", "''") + " || CAST(1000 + k % 9000 AS STRING) || ' AB'", GOOD),
    "general_date": DATE,
    "time": (f"{_lpad('k % 30', 2)} || ':' || {_lpad('k % 60', 2)}", "k % 30 < 24"),
    "phone": PHONE,
}
PREFIX = choice("k", R.PREFIXES)
#: Rules outside the table of rules: reference prefixes, creditor references, secrets by prefix.
OTHER = {
    "configured_prefix": (f"{PREFIX} || '-' || {_either(chr(39) + 'ABC' + chr(39), _lpad('k', 5))}", GOOD),
    "rf_reference": (f"'RF' || {_either(_lpad('k % 1000', 5), _lpad('k', 10))}", GOOD),
    "secret_prefix": (choice("k", ("sk-test-", "ghp_", "xoxb-", "session-")) + " || " + _either("'ab'", f"'abcdef' || {_lpad('k', 6)}"), GOOD),
}


@dataclass(frozen=True)
class Probe:
    """SQL of a text made from k, of the value in it, of its place, and of whether the rule must find it."""

    rule: str
    text: str
    value: str
    start: str
    hit: str


def label_probe(label: R.Label) -> Probe:
    value, ok = LABELLED.get(label.name, IDENTIFIER)
    name = choice("k", label.labels)
    sign = "CASE WHEN k % 7 = 0 THEN ' ;' WHEN k % 3 = 0 THEN ':' WHEN k % 3 = 1 THEN ' =' ELSE '" + " " * 70 + "#' END"
    head = f"'note ' || {K} || chr(10) || {name} || {sign} || ' '"
    return Probe(label.name, f"{head} || {value} || chr(10) || 'end'", value, f"CAST(length({head}) AS INT)", f"k % 7 <> 0 AND ({ok})")


def plain_probe(rule: str, value: str, ok: str) -> Probe:
    return Probe(rule, f"'x ' || {value} || ' y'", value, "CAST(2 AS INT)", ok)


LABEL_PROBES = [label_probe(x) for x in R.LABELS]
PLAIN_PROBES = [plain_probe(k, *v) for k, v in PLAIN.items()]
OTHER_PROBES = [plain_probe(k, *v) for k, v in OTHER.items()]


def expected_sql(p: Probe) -> str:
    return f"SELECT k, {p.start} AS start, {p.value} AS text FROM (SELECT c_custkey AS k FROM customer) WHERE {p.hit}"


_NAME = {x.name: choice("k", x.labels) for x in R.LABELS}
_SHORT = "length(CAST(k % 300 AS STRING)) + length(CAST(k % 200 AS STRING)) >= 4"
#: What other rules find in a rule's rows: (rows of, rule, where, whether at the value). Without a label a value is found by
#: its form alone; a date can look like a postcode, and a key before a label that begins with ID as well.
ELSEWHERE = [
    ("appointment_label", "dutch_postcode", "true", False), ("appointment_label", "general_date", GOOD, False), ("appointment_label", "time", "true", False),
    ("bsn_label", "dutch_bsn", f"k % 7 = 0 AND ({BSN_OK})", True), ("bsn_label", "phone", f"{NINE} LIKE '0%'", True), ("credit_card_label", "credit_card", f"k % 7 = 0 AND ({LUHN_OK})", True),
    ("date_of_birth_label", "general_date", GOOD, True), ("email_label", "email", f"k % 7 = 0 AND {GOOD}", True), ("iban_label", "iban", f"k % 7 = 0 AND {GOOD}", True),
    ("ipv4_label", "address_label", f"k % 7 <> 0 AND k % 300 > 255 AND {_NAME['ipv4_label']} LIKE '%dres%'", True), ("ipv4_label", "ipv4", "k % 7 = 0 AND k % 300 <= 255", True), ("ipv4_label", "phone", _SHORT, True),
    ("ipv6_label", "ipv6", f"k % 7 = 0 AND {GOOD}", True), ("mac_label", "address_label", f"k % 7 <> 0 AND {BAD} AND {_NAME['mac_label']} LIKE '%dres%'", True), ("mac_label", "mac_address", f"k % 7 = 0 AND {GOOD}", True),
    ("national_id_label", "dutch_postcode", f"k BETWEEN 1000 AND 9999 AND {_NAME['national_id_label']} LIKE 'ID %'", False), ("phone_label", "phone", f"k % 7 = 0 AND {GOOD}", True),
    ("complete_dutch_address", "dutch_postcode", GOOD, False), ("dutch_bsn", "phone", f"{NINE} LIKE '0%'", True), ("ipv4", "phone", _SHORT, True),
]


def counts_sql(probes: list[Probe]) -> str:
    """(wanted, rule, n, n_right) of every span that the rules find in all probes' rows."""
    own = [(p.rule, p.rule, p.hit, True) for p in probes] + [x for x in ELSEWHERE if x[0] in {p.rule for p in probes}]
    each = " UNION ALL ".join(f"SELECT '{w}' AS wanted, '{r}' AS rule, count(*) AS n, {'count(*)' if right else '0::BIGINT'} AS n_right FROM (SELECT c_custkey AS k FROM customer) WHERE {hit}" for w, r, hit, right in own)
    return f"SELECT * FROM ({each}) WHERE n > 0"
