"""Short texts searched together give what each gives alone."""

import random

from hushlake.functions import normalise, scan
from hushlake.plans import rules

VALUES = [
    "NL91 ABNA 0417 1643 00", "12 March 2020", "12-03-2020", "1234 AB", "Dorpsstraat 12, 1234 AB Utrecht", "4111 1111 1111 1111", "123456782", "+31 20 1234567", "10.0.0.1", "2001:db8::1", "0A:1B:44:11:3A:05", "o'x.y@example.com", "10:30", "ACC-NL-12345",
    "RF12345678901", "sk-test-abcdef", "https://x.local/a?token=1", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "Bearer abcdefgh12", "password=abcdefghijklmnop1", "&#46;", "ſ", "é", "\0", " " * 90, "\n", "\t", "\r", ":", " =", "ID", "x", "7", "2024", ";", "-",
]
LABELS = [x for r in rules.LABELS for x in r.labels]


def texts(n):
    r = random.Random(7)
    own = ["".join(r.choice(LABELS if r.random() < 0.4 else VALUES) + r.choice(("", " ", "\n", ": ")) for _ in range(r.randint(1, 12))) for _ in range(n)]
    return [*own, "", None, "x" * (scan.SHORT + 1) + " 10.0.0.1"]


def test_texts_together_and_alone():
    own = texts(4000)
    assert scan.scan_all(own) == [[] if t is None else scan.scan(t) for t in own]
    assert scan.scan_all([]) == [] and scan.scan_all([None]) == [[]]


def test_no_finding_goes_over_the_edge_of_a_text():
    assert scan.scan_all(["10.0.", "0.1", "name", ": x y", "-----BEGIN RSA PRIVATE KEY-----\n1", "-----END RSA PRIVATE KEY-----"]) == [[]] * 6


def test_labels_are_matched_where_they_stand(monkeypatch):
    """Against a search of every rule over the whole text; a rule without a label in an ASCII text isn't searched for."""
    for t in (t for t in texts(1500) if t and t.isascii()):
        found = [(i, m.span()) for i in range(len(rules.LABELS)) for m in scan._label(i).finditer(t)]
        assert [(i, m.span()) for i, m in scan._label_matches(t, None)] == found
    monkeypatch.setattr(scan, "structured", lambda *a: 1 / 0)
    assert [s["text"] for s in scan.scan_all(["name: Jan", "nothing of note"])[0]] == ["Jan"]


def test_rules_of_spaces_alone_see_the_view():
    t = "Dorpsstraat 12\n1234 AB\tUtrecht and 1234\n\nAB"
    assert normalise.requires(t) and [s["text"] for s in scan.scan_all([t])[0]] == [s["text"] for s in scan.scan(t)]
