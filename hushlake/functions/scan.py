"""All rules over one text in Python: what the Arrow-batched detection stage runs, a batch of texts at a time.

One native expression per rule exists too (operators.detect.rule_findings); sixty of them in one plan took minutes to
compile, so whole-stack detection reads each text once here instead.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate
from urllib.parse import urlsplit

from ..plans import rules as R
from . import normalise
from .validators import IBAN_LENGTHS

Span = dict  # start, end, text, entity_type, confidence, source, rule, precedence


@cache
def compiled(java: str) -> re.Pattern:
    """A pattern in Java syntax for re, whose classes are Unicode-aware already."""
    m = re.match(r"\(\?([A-Za-z]+)\)", java)
    flags = sum({"i": re.I, "m": re.M}.get(c, 0) for c in m[1]) if m else 0
    return re.compile(java[m.end() :] if m else java, flags)


def luhn(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    doubled = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0


def iban(v: str) -> bool:
    c = "".join(v.split()).upper()
    if IBAN_LENGTHS.get(c[:2]) != len(c) or not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", c):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def bsn(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    return len(d) == 9 and any(d) and (sum((9 - i) * x for i, x in enumerate(d[:8])) - d[8]) % 11 == 0


def _ip(version: int):
    def ok(v: str) -> bool:
        try:
            return ipaddress.ip_address(v).version == version
        except ValueError:
            return False

    return ok


def phone(v: str) -> bool:
    n = sum(c.isdigit() for c in v)
    if not 7 <= n <= 15:
        return False
    if v.lstrip().startswith("+"):
        return True
    return bool(re.search(r"\d\d", v)) and (bool(re.search(r"[(). ]", v)) or v.lstrip().startswith("0"))


def email(v: str) -> bool:
    local, at, domain = v.rpartition("@")
    if not at or "@" in local or len(v) > 254 or not 1 <= len(local) <= 64 or len(domain) > 253:
        return False
    return not re.search(r"^\.|\.$|\.\.", local) and all(1 <= len(p) <= 63 and p[0] != "-" != p[-1] for p in domain.split("."))


CHECKS = {
    "luhn": luhn, "iban": iban, "bsn": bsn, "ipv4": _ip(4), "ipv6": _ip(6), "phone": phone, "email": email,
    "bic": lambda v: bool(re.fullmatch("[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", v.upper())),
    "card_expiry": lambda v: bool(re.fullmatch(r"(?:0[1-9]|1[0-2])/(?:\d{2}|\d{4})", v)),
    "identifier": lambda v: 3 <= len(v) <= 128 and any(c.isdigit() for c in v) and bool(re.fullmatch("[A-Za-z0-9][A-Za-z0-9._/-]*", v)),
}


def span(start: int, text: str, kind: str, confidence: float, source: str, rule: str, precedence: int) -> Span:
    return {"start": start, "end": start + len(text), "text": text, "entity_type": kind, "confidence": float(confidence), "source": source, "rule": rule, "precedence": precedence}


def _iban_head(v: str) -> str:
    left = IBAN_LENGTHS.get(v[:2].upper())
    for i, c in enumerate(v):
        if left is None:
            break
        left -= not c.isspace()
        if not left:
            return v[: i + 1]
    return v


_SIGN = re.compile("[:=#]")
_LONGEST = max(len(x) for r in R.LABELS for x in r.labels)
#: Labels by their last three letters: (label, number of its rule).
_BY_TAIL: dict[str, list[tuple[str, int]]] = {}
for _i, _r in enumerate(R.LABELS):
    for _x in _r.labels:
        _BY_TAIL.setdefault(_x.lower()[-3:], []).append((_x.lower(), _i))
#: Letters that a pattern takes for an ASCII one though they aren't its capital.
_FOLDED = re.compile("[ſıİ]")


def _named(text: str) -> list[int]:
    """The rules that have a label before a sign. The blanks before each sign are walked once: no pattern tries them anew."""
    rules: set[int] = set()
    for m in _SIGN.finditer(text):
        at = m.start()
        while at and text[at - 1].isspace() and text[at - 1] not in "\r\n":
            at -= 1
        before = text[max(0, at - _LONGEST) : at].lower()
        rules.update(i for x, i in _BY_TAIL.get(before[-3:], ()) if before.endswith(x))
    return sorted(rules) if not rules or not _FOLDED.search(text) else list(range(len(R.LABELS)))


#: A label's last character, blanks, and a sign.
_ENDED = re.compile(rf"[{re.escape(''.join(sorted({x[-1].lower() for r in R.LABELS for x in r.labels})))}][^\S\r\n]*[:=#]")


def _starts(low: str) -> Iterator[tuple[int, int]]:
    """(place, number of its rule) of the labels before a sign in an ASCII text in lower case: the only places at which a
    rule's pattern can match."""
    for m in _ENDED.finditer(low):
        end = m.start() + 1
        for x, i in _BY_TAIL.get(low[max(0, end - 3) : end], ()):
            if low.endswith(x, 0, end):
                yield end - len(x), i


def _label_matches(text: str, starts: Iterable[tuple[int, int]] | None) -> Iterator[tuple[int, re.Match]]:
    """(number of its rule, match) of every label with a value behind it, by rule and by place."""
    if starts is None and not text.isascii():
        for i in _named(text):
            for m in _label(i).finditer(text):
                yield i, m
        return
    last, end = -1, 0
    for i, start in sorted({(i, start) for start, i in (_starts(text.lower()) if starts is None else starts)}):
        end = end if i == last else 0
        last = i
        if start >= end and (m := _label(i).match(text, start)):
            end = m.end()
            yield i, m


def labelled(text: str, starts: Iterable[tuple[int, int]] | None = None) -> list[Span]:
    best: dict[tuple[int, int], tuple[int, Span]] = {}
    for i, m in _label_matches(text, starts):
        r = R.LABELS[i]
        value = m[1].strip()
        if value and (r.validator is None or CHECKS[r.validator](value)):
            s = span(m.start(1) + len(m[1]) - len(m[1].lstrip()), value, r.entity_type, r.confidence, "label", r.name, 100)
            size = m.start(1) - m.start()
            if size > best.get((s["start"], s["end"]), (0, s))[0]:
                best[s["start"], s["end"]] = (size, s)
    return [s for _, s in best.values()]


@cache
def _label(i: int) -> re.Pattern:
    """A label rule's pattern; to spell it out takes longer than most texts take to search."""
    return compiled(R.LABELS[i].pattern)


def url_kind(url: str) -> str:
    try:
        parts = urlsplit("http://" + url if url.lower().startswith("www.") else url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return "url"
    private = False
    if CHECKS["ipv4"](host) or CHECKS["ipv6"](host):
        private = ipaddress.ip_address(host).is_private
    if private or host == "localhost" or re.search(r"\.(?:local|internal|localhost)$|intranet|corp|internal|portal", host) or any(p in parts.path.lower() for p in R.INTERNAL_PATHS):
        return "internal_url"
    keys = {p.partition("=")[0].lower() for p in parts.query.split("&")}
    return "sensitive_url_parameter" if keys & set(R.QUERY_KEYS) or "@" in parts.netloc else "url"


_DIGIT = re.compile(r"\d")
#: Every match of these rules holds such a run, and one search for it is cheaper than theirs.
_LONG, _IN_LONG = re.compile(r"\d[\d(). -]{5,}\d"), ("credit_card", "dutch_bsn", "phone")
_UNDIGITED = ("private_key", "email", "ipv6", "mac_address")
_PREFIX = re.compile(rf"(?<![A-Z0-9])({'|'.join(sorted(R.PREFIXES, key=len, reverse=True))})(?:-[A-Z]{{2,8}})?[-_][A-Z0-9][A-Z0-9_-]{{2,}}(?![A-Z0-9])", re.I)


_PREFIX_HEADS = tuple(x.lower() for x in R.PREFIXES)
_HYPHEN = re.compile("[-_]")
_ALL = tuple((r, compiled(r.guard), compiled(r.pattern)) for r in R.RULES)
#: An ASCII text's shape: letters as a, digits as 0, white space but blanks as line feeds.
_SHAPE = bytes(97 if chr(c).isalpha() else 48 if chr(c).isdigit() else 10 if chr(c).isspace() and c != 32 else c for c in range(128)) + bytes(range(128, 256))
#: What every match of a rule shows in a text's shape, by rule.
_FORMS = {
    "private_key": rb"-----aaaaa ", "complete_dutch_address": rb"0000[ \n]?aa[ \n]", "credit_card": rb"0(?:[ -]?0){12}", "iban": rb"aa00(?: ?[a0]){11}", "mac_address": rb"[:-][a0]{2}[:-]|\.[a0]{4}\.", "dutch_bsn": rb"0{9}",
    "ipv6": rb":[a0]{0,4}:", "ipv4": rb"0\.0{1,3}\.0{1,3}\.0", "email": rb"@", "dutch_postcode": rb"0000[ \n]?aa(?![a0])", "general_date": rb"0(?:[ \n]+a{3,9}[ \n]+0000|[-/.]00?[-/.]0000)", "time": rb"00:00", "phone": rb"0[0(). -]{5,}0",
}
_FORMS = {k: re.compile(v) for k, v in _FORMS.items()}
#: Rules whose matches hold white space: the others find the same in a text and in its view with single blanks.
_SPACED = {k: _FORMS[k] for k in ("private_key", "complete_dutch_address", "credit_card", "iban", "dutch_postcode", "general_date", "phone")}
#: What every match of the others holds, in lower case.
_CUES = {"url": ("://", "www."), "secret_prefix": ("sk-", "ghp_", "xox", "sess"), "rf_reference": ("rf",), "credentials": ("bearer", "ghp_", "gho_", "ghs_", "ghr_", "akia", "sk-", "xox", "key", "secret", "token", "passw")}


def structured(text: str, only: set[str] | None = None) -> list[Span]:
    """Rules that need no label: all of them, or those of only, which are all that can match."""
    low, out = text.lower(), []
    may = (lambda name: True) if only is None else only.__contains__
    digit = _DIGIT.search(text) is not None
    if may("configured_prefix") and digit and ("-" in text or "_" in text):
        out = [span(m.start(), m[0], R.PREFIXES[m[1].upper()], 1.0, "regex", "configured_prefix", 95) for m in _PREFIX.finditer(text) if CHECKS["identifier"](m[0])]
    if may("url") and ("://" in text or "www." in low):
        for m in compiled(R.URL).finditer(text):
            url = m[0].rstrip(".,;:!?")
            kind = url_kind(url)
            out.append(span(m.start(), url, kind, 0.95 if kind == "url" else 1.0, "regex", kind, 60 if kind == "url" else 95))
    for m in compiled(R.SECRET).finditer(text) if may("secret_prefix") and any(x in low for x in ("sk-", "ghp_", "xox", "sess")) else ():
        out.append(span(m.start(), m[0], "session_token" if m[0].lower().startswith("sess") else "api_token", 1.0, "regex", "secret_prefix", 100))
    for m in compiled(R.CREDITOR).finditer(text) if may("rf_reference") and digit and "rf" in low else ():
        out.append(span(m.start(), m[0], "payment_reference", 1.0, "regex", "rf_reference", 95))
    long = only is not None or (digit and _LONG.search(text) is not None)
    for r, guard, pattern in _ALL:
        if not may(r.name) or (not digit and r.name not in _UNDIGITED) or (not long and r.name in _IN_LONG) or not guard.search(text):
            continue
        for m in pattern.finditer(text):
            start, v = m.start(), m[0]
            if r.fix == "iban":
                v = _iban_head(v)
            elif r.fix == "quote" and v.startswith("'"):
                start, v = start + 1, v[1:]
            if r.validator is None or CHECKS[r.validator](v):
                out.append(span(start, v, r.entity_type, r.confidence, "regex", r.name, r.precedence))
    return out


def credentials(text: str) -> list[Span]:
    return [span(m.start(1), m[1], r.entity_type, 1.0, "credentials", r.name, r.precedence) for r in R.CREDENTIALS if compiled(r.guard).search(text) for m in compiled(r.pattern).finditer(text)]


def scan(text: str) -> list[Span]:
    """Every candidate of the deterministic rules, on the text and on its normalised view; of equal place and type the
    one with the highest precedence and confidence."""
    found = labelled(text) + structured(text)
    if normalise.requires(text):
        simple = normalise.spaces_only(text)
        if simple is not None:  # most texts differ in white space alone: no map of single characters is made for them
            hits = structured(simple)
            place = normalise.place(normalise.spaces(text)) if hits else None
        else:
            norm, cells = normalise.view(text)
            hits, place = structured(norm), lambda a, b: (cells[a][1], cells[b - 1][2])
        for s in hits:
            a, b = place(s["start"], s["end"])
            found.append(s | {"start": a, "end": b, "text": text[a:b]})
    return _best(found + credentials(text))


def _best(found: list[Span]) -> list[Span]:
    best: dict[tuple, Span] = {}
    for s in found:
        k = (s["start"], s["end"], s["entity_type"])
        if k not in best or (s["precedence"], s["confidence"]) > (best[k]["precedence"], best[k]["confidence"]):
            best[k] = s
    return list(best.values())


#: Texts up to this length are searched together, so many characters at once.
SHORT, TOGETHER = 2048, 1 << 18
_NOT_TOGETHER = re.compile("[&%\0]")
_SHAPE_SPACES, _SHAPE_MORE = re.compile(rb"\n[ \n]*| [ \n]+"), _SPACED.items()


def scan_all(texts: list[str | None]) -> list[list[Span]]:
    """scan() of each text, none of a null. Short ASCII texts are joined and searched once for what each rule's matches
    show, so that a rule costs nothing in the texts that have none of it."""
    out: list[list[Span]] = [[] for _ in texts]
    some: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if len(t) > SHORT or not t.isascii() or _NOT_TOGETHER.search(t):
            out[i] = scan(t)
            continue
        some.append(i)
        size += len(t) + 1
        if size >= TOGETHER:
            _together(texts, some, out)
            some, size = [], 0
    if some:
        _together(texts, some, out)
    return out


def _together(texts: list[str], some: list[int], out: list[list[Span]]) -> None:
    """Texts without a null character, which parts them here: no form, cue or label goes over it."""
    own = [texts[i] for i in some]
    joined = "\0".join(own)
    low, shape = joined.lower(), joined.encode().translate(_SHAPE)
    starts = list(accumulate((len(t) + 1 for t in own), initial=0))
    rules: dict[int, set[str]] = {}
    labels: dict[int, list[tuple[int, int]]] = {}

    def mark(name: str, at: int) -> None:
        rules.setdefault(bisect_right(starts, at) - 1, set()).add(name)

    for name, form in _FORMS.items():
        for m in form.finditer(shape):
            mark(name, m.start())
    for name, cues in _CUES.items():
        for cue in cues:
            at = low.find(cue)
            while at >= 0:
                mark(name, at)
                at = low.find(cue, at + 1)
    for m in _HYPHEN.finditer(low):
        if low.endswith(_PREFIX_HEADS, 0, m.start()):
            mark("configured_prefix", m.start())
    for at, i in _starts(low):
        k = bisect_right(starts, at) - 1
        labels.setdefault(k, []).append((at - starts[k], i))
    simple = _SHAPE_SPACES.sub(b" ", shape)
    again: dict[int, set[str]] = {}
    ends = list(accumulate((len(x) + 1 for x in simple.split(b"\0")), initial=0))
    for name, form in _SHAPE_MORE:
        for m in form.finditer(simple):
            again.setdefault(bisect_right(ends, m.start()) - 1, set()).add(name)
    for k in sorted(rules.keys() | labels.keys() | again.keys()):
        t, only = own[k], rules.get(k, ())
        found = labelled(t, labels[k]) if k in labels else []
        if only:
            found += structured(t, only)
        if k in again and normalise.requires(t) and (hits := structured(normalise.spaces_only(t), again[k])):
            place = normalise.place(normalise.spaces(t))
            for s in hits:
                a, b = place(s["start"], s["end"])
                found.append(s | {"start": a, "end": b, "text": t[a:b]})
        if "credentials" in only:
            found += credentials(t)
        if found:
            out[some[k]] = _best(found)
