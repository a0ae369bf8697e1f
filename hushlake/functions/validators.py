"""Checks of identifiers as boolean columns; null gives false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IBAN lengths by country (ISO 13616).
IBAN_LENGTHS = dict(
    AL=28, AD=24, AT=20, AZ=28, BH=22, BE=16, BA=20, BR=29, BG=22, CR=22, HR=21, CY=28, CZ=24, DK=18, DO=28, EE=20, FO=18, FI=18, FR=27, GE=22, DE=22, GI=23, GR=27, GL=18, GT=28, HU=28, IS=26, IE=22, IL=23, IT=27,
    JO=30, KZ=20, XK=20, KW=30, LV=21, LB=28, LI=21, LT=20, LU=20, MK=19, MT=31, MR=27, MU=30, MC=27, MD=24, ME=22, NL=18, NO=15, PK=24, PS=29, PL=28, PT=25, QA=29, RO=24, SM=27, SA=24, RS=22, SK=24, SI=19, ES=24,
    SE=24, CH=21, TL=23, TN=24, TR=26, UA=29, AE=23, GB=22, VA=22,
)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _digit(d: Column, i: Column) -> Column:
    return F.ascii(F.substring(d, i, F.lit(1))) - 48


def luhn_valid(v: Column) -> Column:
    """13 to 19 digits, not all the same, with a Luhn sum divisible by 10."""
    d = digits(v)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = _digit(d, i) * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)
    return _sure(n.between(13, 19) & ~d.rlike("^(.)\\1*$") & (total % 10 == 0))


def iban_length(v: Column) -> Column:
    table = F.create_map(*[x for k, n in IBAN_LENGTHS.items() for x in (F.lit(k), F.lit(n))])
    return F.try_element_at(table, F.upper(F.substring(v, 1, 2)))


def iban_valid(v: Column) -> Column:
    """The country's length, letters and digits only, remainder 1 modulo 97."""
    c = F.upper(F.regexp_replace(v, "\\s", ""))
    turned = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))

    def add(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), add)
    return _sure((F.length(c) == iban_length(c)) & F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), rest == 1))


def trim_iban(v: Column) -> Column:
    """The first characters of a candidate that make up its country's length, spaces not counted; v if it is shorter."""
    n = iban_length(v)
    seen = F.aggregate(
        F.split(v, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda acc, ch: F.when(acc["n"] >= n, acc).otherwise(F.struct((acc["n"] + F.when(ch == " ", 0).otherwise(1)).alias("n"), F.concat(acc["out"], ch).alias("out"))),
        lambda acc: acc["out"],
    )
    return F.when(n.isNull(), v).otherwise(seen)


def bsn_valid(v: Column) -> Column:
    """Nine digits, not all 0, with a weighted sum divisible by 11."""
    d = digits(v)
    total = sum((_digit(d, F.lit(i + 1)) * w for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1))), F.lit(0))
    return _sure((F.length(d) == 9) & (d != "000000000") & (total % 11 == 0))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4_valid(v: Column) -> Column:
    return _sure(v.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))


def ipv6_valid(v: Column) -> Column:
    """Eight groups of up to four hex digits, one run of zeros left out as ::, perhaps with an IPv4 tail."""
    tail = rf":(?:{_OCTET}\.){{3}}{_OCTET}$"
    w = F.regexp_replace(v, tail, ":0:0")
    groups = F.filter(F.split(w, ":"), lambda g: g != "")
    fine = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    short = w.contains("::")
    edges = ~w.rlike("^:[^:]") & ~w.rlike("[^:]:$")
    return _sure(fine & edges & ~w.rlike(":::|::.*::") & F.when(short, F.size(groups) <= 7).otherwise((F.size(groups) == 8) & (F.size(F.split(w, ":")) == 8)))


def phone_valid(v: Column) -> Column:
    """7 to 15 digits; written with a plus, or with a bracket, dot, space or leading 0, but not digit by digit."""
    n = F.length(digits(v))
    bare = F.ltrim(v)
    single = ~v.rlike("[0-9]{2}")
    return _sure(n.between(7, 15) & (bare.startswith("+") | (~single & (v.rlike("[(). ]") | bare.startswith("0")))))


def bic_valid(v: Column) -> Column:
    return _sure(F.upper(v).rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"))


def card_expiry_valid(v: Column) -> Column:
    return _sure(v.rlike("^(?:0[1-9]|1[0-2])/(?:[0-9]{2}|[0-9]{4})$"))


def email_valid(v: Column) -> Column:
    """One @, bounded lengths, no empty or hyphen-edged part."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    parts = F.split(domain, "\\.")
    ok = F.forall(parts, lambda p: F.length(p).between(1, 63) & ~p.startswith("-") & ~p.endswith("-"))
    return _sure((F.length(v) <= 254) & (F.size(F.split(v, "@")) == 2) & F.length(local).between(1, 64) & ~local.rlike("^\\.|\\.$|\\.\\.") & (F.length(domain) <= 253) & ok)


def identifier_valid(v: Column) -> Column:
    return _sure(F.length(v).between(3, 128) & v.rlike("[0-9]") & v.rlike("^[A-Za-z0-9][A-Za-z0-9._/-]*$"))


def internal_host(host: Column) -> Column:
    """Local names, host names that say so, and private addresses."""
    h = F.lower(host)
    private = h.rlike(r"^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)[0-9.]+$") & ipv4_valid(h)
    return _sure(h.isin("localhost", "127.0.0.1", "::1") | h.rlike(r"\.(?:local|internal|localhost)$") | h.rlike("intranet|corp|internal|portal") | private)


VALIDATORS = {
    "luhn": luhn_valid, "iban": iban_valid, "bsn": bsn_valid, "ipv4": ipv4_valid, "ipv6": ipv6_valid, "phone": phone_valid, "bic": bic_valid,
    "card_expiry": card_expiry_valid, "email": email_valid, "identifier": identifier_valid,
}
