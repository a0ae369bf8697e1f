"""Fixtures made from a table's keys, with what the engine must find in each, as SQL that Spark and other engines read alike."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.golden import CRITICAL_RULES, STAGES
from .probes import K

_BELIEF = "religious_or_philosophical_belief"


@dataclass(frozen=True)
class Case:
    """when: the keys; text and entities (text, type): the fixture; found: (stages, text, type) that the engine gives, by first
    letters; claims and said: (category, negated) wanted and given; forbidden: (text, whether it is left over)."""

    when: str
    text: str
    entities: tuple[tuple[str, str], ...] = ()
    found: tuple[tuple[str, str, str], ...] = ()
    claims: tuple[tuple[str, bool], ...] = ()
    said: tuple[tuple[str, bool, bool], ...] = ()
    policy: tuple[tuple[str, str], ...] = ()
    forbidden: tuple[tuple[str, bool], ...] = ()
    safe: bool = True
    dispatch: str = "permit"
    reasons: tuple[str, ...] = ()


_MAIL, _IP, _PHONE, _ACC = f"'user' || {K} || '@example.com'", "'10.0.0.' || CAST(k % 200 AS STRING)", f"'+31 20 ' || lpad({K}, 7, '0')", f"'ACC-NL-' || lpad({K}, 5, '0')"
_SECRET, _NAME, _MARIA, _CATHOLIC = f"'secret' || {K} || 'x'", "'Jan Smit'", "'Maria Jansen'", "'Catholic'"
_BOTH = f"'IP ' || {_IP} || ' and mail ' || {_MAIL}"
_TWO = ((_MARIA, "person"), (_CATHOLIC, _BELIEF))
_SEEN = (("c", _MARIA, "person"), ("c", _CATHOLIC, _BELIEF), ("c", _CATHOLIC, "person"), ("m", _MARIA, "person"), ("m", _CATHOLIC, _BELIEF))
CASES = (
    Case("k % 8 = 0", f"'Mail ' || {_MAIL} || ' today'", ((_MAIL, "email"),), (("dm", _MAIL, "email"),), policy=(("email", "redact"),), forbidden=((_MAIL, False),)),
    Case("k % 16 = 1", f"'Row ' || {K} || ' says nothing of note.'"),
    Case("k % 16 = 9", f"'Religion: Taoist' || {K}", (), (("cm", f"'Taoist' || {K}", _BELIEF),), said=((_BELIEF, False, False),), dispatch="review", reasons=("general_discussion",)),
    Case("k % 8 = 2 AND k % 200 < 100", _BOTH, ((_IP, "mac_address"),), (("dm", _IP, "ipv4"), ("dm", _MAIL, "email")), reasons=("missed_entity",)),
    # seven digits and more pass for a phone number too, until findings are merged
    Case("k % 8 = 2 AND k % 200 >= 100", _BOTH, ((_IP, "mac_address"),), (("dm", _IP, "ipv4"), ("d", _IP, "phone"), ("dm", _MAIL, "email")), reasons=("missed_entity",)),
    Case("k % 8 = 3", f"'Name: ' || {_NAME}", ((_NAME, "person"), (_NAME, "person")), (("dlm", _NAME, "person"),), forbidden=((_NAME, False), ("'Name'", True)), reasons=("forbidden_text",)),
    Case("k % 16 = 4", f"{_MARIA} || ' is a ' || {_CATHOLIC} || '.'", _TWO, _SEEN, ((_BELIEF, False),), ((_BELIEF, False, True),), dispatch="review"),
    Case("k % 16 = 12", f"{_MARIA} || ' is not a ' || {_CATHOLIC} || '.'", _TWO, _SEEN, ((_BELIEF, False),), ((_BELIEF, True, True),), dispatch="review"),
    Case("k % 8 = 5", f"'password: ' || {_SECRET}", ((_SECRET, "password"),), (("dlm", _SECRET, "password"),), policy=(("password", "allow"),), reasons=("policy_action", "dispatch")),
    Case("k % 8 = 6", f"{_ACC} || ' is here. acc-nl- remains'", ((_ACC, "bank_account_reference"), ("'acc-nl-'", "bank_account_reference")), (("dm", _ACC, "bank_account_reference"),), forbidden=(("'acc-nl-'", True),), safe=False, reasons=("missed_entity", "forbidden_text")),
    Case("k % 8 = 7", f"'Call ' || {_PHONE} || ' soon'", ((_PHONE, "phone"),), (("dm", _PHONE, "phone"),), (("health_data", False),), dispatch="review", reasons=("dispatch", "assertion")),
)
_STAGE = {s[0]: s for s in STAGES}


def _array(items: list[str], kind: str) -> str:
    return f"CAST(array({', '.join(items)}) AS array<{kind}>)"


def _by_case(tell) -> str:
    return "CASE " + " ".join(f"WHEN {c.when} THEN {tell(c)}" for c in CASES) + " END"


#: Columns of a fixture, as Spark expressions over k.
FIXTURE = {
    "id": f"'fixture-' || {K}",
    "language": "CASE WHEN k % 3 = 0 THEN 'nl' ELSE 'en' END",
    "input": _by_case(lambda c: c.text),
    "expected_entities": _by_case(lambda c: _array([f"named_struct('text', {t}, 'type', '{x}')" for t, x in c.entities], "struct<text:string,type:string>")),
    "expected_assertions": _by_case(lambda c: _array([f"named_struct('category', '{x}', 'negated', {str(n).lower()})" for x, n in c.claims], "struct<category:string,negated:boolean>")),
    "expected_policy_actions": _by_case(lambda c: f"CAST(map({', '.join(f'{a!r}, {b!r}' for a, b in c.policy)}) AS map<string,string>)"),
    "sanitized_must_not_contain": _by_case(lambda c: _array([t for t, _ in c.forbidden], "string")),
    "expected_residual_safe": _by_case(lambda c: str(c.safe).lower()),
    "provider_dispatch": _by_case(lambda c: f"'{c.dispatch}'"),
}

# --- the SQL: rows of what is wanted, found and left, counted ---


def _rows(parts: list[tuple[Case, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {what} FROM (SELECT c_custkey AS k FROM customer) WHERE {c.when}" for c, what in parts)


_EXPECTED = _rows([(c, f"{t} AS text, '{x}' AS type") for c in CASES for t, x in c.entities])
_FOUND = _rows([(c, f"'{_STAGE[s]}' AS stage, {t} AS text, '{x}' AS type") for c in CASES for stages, t, x in c.found for s in stages])
_KEPT = _rows([(c, f"'merged' AS stage, '{x}' AS type") for c in CASES for t, x in c.entities for f, left in c.forbidden if left and f == t])
_OVERLAP = "sum(least(e, a))::BIGINT AS tp, sum(a - least(e, a))::BIGINT AS fp, sum(e - least(e, a))::BIGINT AS fn"
STAGES_SQL = f"""WITH e AS ({_EXPECTED}), a AS ({_FOUND}), s AS (SELECT unnest({list(STAGES)}) AS stage),
w AS (SELECT stage, text, type, count(*) AS e FROM s CROSS JOIN e GROUP BY ALL), g AS (SELECT stage, text, type, count(*) AS a FROM a GROUP BY ALL),
b AS (SELECT stage, text, type, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM w FULL JOIN g USING (stage, text, type)),
c AS (SELECT stage, type AS entity_type, {_OVERLAP} FROM b GROUP BY ALL), k AS (SELECT stage, type AS entity_type, count(*) AS n FROM ({_KEPT}) GROUP BY ALL),
r AS (SELECT c.*, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall, coalesce(k.n, 0)::BIGINT AS partial_span_failures FROM c LEFT JOIN k USING (stage, entity_type))
SELECT stage, entity_type, tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, recall AS exact_span_accuracy, partial_span_failures FROM r"""
FAILED_SQL = _rows([(c, f"'fixture-' || {K} AS id, {list(c.reasons)} AS reasons") for c in CASES if c.reasons])
CONFUSION_SQL = "SELECT expected, actual, count(*) AS n FROM (" + _rows([(c, f"'{x}' AS expected, '{y}' AS actual") for c in CASES for t, x in c.entities for stages, u, y in c.found if "m" in stages and t == u and x != y]) + ") GROUP BY ALL"

_CLAIMS = _rows([(c, f"'{x}' AS category, {n} AS negated, {any(x == y for y, *_ in c.said)} AS met, {next((linked for y, _, linked in c.said if x == y), False)} AS linked, {any((x, n) == s[:2] for s in c.said)} AS good") for c in CASES for x, n in c.claims])
_SAID = _rows([(c, f"'{x}' AS category, {n} AS negated") for c in CASES for x, n, _ in c.said])
_EACH = _rows([(c, f"{len(c.forbidden)} AS forbidden, {sum(left for _, left in c.forbidden)} AS lost, {not c.claims and not c.entities} AS quiet, {bool(c.said)} AS loud, {c.safe} AS safe") for c in CASES])
SUMMARY_SQL = f"""WITH cl AS ({_CLAIMS}), sa AS ({_SAID}), f AS ({_EACH}), e AS (SELECT * FROM ({_EXPECTED}) WHERE type IN {(*CRITICAL_RULES, '')}), a AS (SELECT * FROM ({_FOUND}) WHERE stage = 'deterministic' AND type IN {(*CRITICAL_RULES, '')}),
m AS (SELECT {_OVERLAP} FROM (SELECT coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM (SELECT category, negated, count(*) AS e FROM cl GROUP BY ALL) FULL JOIN (SELECT category, negated, count(*) AS a FROM sa GROUP BY ALL) USING (category, negated))),
cr AS (SELECT sum(least(e, a)) AS c, sum(e) AS ce FROM (SELECT coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM (SELECT text, type, count(*) AS e FROM e GROUP BY ALL) FULL JOIN (SELECT text, type, count(*) AS a FROM a GROUP BY ALL) USING (text, type)))
SELECT (SELECT count(*) FROM customer) AS n_fixtures, tp, fp, fn, tp / (tp + fp)::DOUBLE AS assertion_precision, tp / (tp + fn)::DOUBLE AS assertion_recall, (SELECT count(*) FILTER (WHERE linked) / count(*) FILTER (WHERE met)::DOUBLE FROM cl) AS subject_linking_accuracy,
(SELECT count(*) FILTER (WHERE good) / count(*)::DOUBLE FROM cl) AS negation_accuracy, (SELECT count(*) FILTER (WHERE quiet AND loud) / count(*) FILTER (WHERE quiet)::DOUBLE FROM f) AS general_discussion_false_positive_rate, (SELECT c / ce::DOUBLE FROM cr) AS critical_span_recall,
(SELECT (sum(forbidden) - sum(lost)) / sum(forbidden)::DOUBLE FROM f) AS full_span_replacement_rate, (SELECT (sum(lost) + count(*) FILTER (WHERE NOT safe))::BIGINT FROM f) AS residual_leaks FROM m"""
COUNTS_SQL = f"SELECT axis, value, count(*) AS n FROM (SELECT 'language' AS axis, {FIXTURE['language']} AS value FROM (SELECT c_custkey AS k FROM customer) UNION ALL SELECT 'category', type FROM ({_EXPECTED})) GROUP BY ALL"
