"""A deterministic synthetic corpus: numbers in, labelled samples out, all by expressions on the row number; offsets come from a
fold that carries the text written so far."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import taxonomy

# Transformations with their level of support, templates, names, profiles.
TRANSFORMATIONS = dict(
    dict.fromkeys(("original", "casing", "line-wrapping", "punctuation-spacing", "unicode-normalization", "dutch-surname-prefix", "apostrophe", "spaced-iban"), "supported")
    | dict.fromkeys(("whitespace-insertion", "whitespace-removal", "url-encoding", "html-entities", "fullwidth", "initials", "hyphenation", "split-phone", "nested-overlap"), "partial")
    | dict.fromkeys(("zero-width", "homoglyph", "ocr-like", "email-obfuscation"), "deliberately_unsupported")
)
FORMATS = (
    ("healthcare", "medical_letter"), ("government", "case_note"), ("finance", "csv_row"), ("legal", "legal_form"), ("support", "support_ticket"), ("human_resources", "email_thread"), ("technology", "json_record"), ("education", "meeting_minutes"),
    ("customer_support", "chat"), ("general", "prose"), ("technology", "source_code"), ("technology", "configuration"), ("operations", "log_record"), ("government", "form"), ("technology", "yaml_record"), ("technology", "xml_record"), ("general", "markdown"), ("finance", "invoice"),
)
SPLITS = ("train", "development", "validation", "release_gate")
ASSERTIONS = ("current", "negated", "uncertain", "hypothetical", "quotation", "historical", "family_history", "general_discussion", "organization_level", "near_miss")
#: Kinds of value that a transformation is about; the others' values stay as they are.
SCOPE = {"dutch-surname-prefix": "person", "email-obfuscation": "email", "hyphenation": "person", "initials": "person", "spaced-iban": "iban", "split-phone": "phone"}
#: Kinds of the two values of a sample, where a transformation needs some.
WANTED = {
    "apostrophe": ("person", "email"), "dutch-surname-prefix": ("person", "email"), "email-obfuscation": ("email", "customer_number"), "hyphenation": ("person", "case_number"), "initials": ("person", "email"), "spaced-iban": ("iban", "case_number"),
    "split-phone": ("phone", "email"), "unicode-normalization": ("accented", "email"), "url-encoding": ("person", "email"), "html-entities": ("email", "person"), "homoglyph": ("email", "customer_number"), "ocr-like": ("email", "customer_number"), "whitespace-removal": ("person", "email"),
}

# Own wording: one template a format and language.
TEXTS = {
    "en": (
        "Dear colleague: we saw {0} last week; write to {1} with any result.", "Visit | spoke with {0} | next step: {1} | open", "name,contact\n{0},{1}", "The undersigned: {0}; in the matter of {1}.", "Ticket opened by {0}\nPlease answer: {1}", "To: {0}\nAbout: your leave, {1}",
        '{"who":"{0}","where":"{1}","made_up":true}', "Present: {0}; to follow up: {1}.", "visitor: {0}\nhelpdesk: noted, {1}; anything else?", "Nobody in this story is real, neither {0} nor {1}.", "owner = '{0}'  # see {1}", "first={0}\nsecond={1}\nmode=demo",
        "WARN made_up_event who={0} where={1}", "Form\nLine one: {0}\nLine two: {1}", "who: '{0}'\nwhere: '{1}'\nmade_up: true", '<row made_up="true"><a>{0}</a><b>{1}</b></row>', "# Made-up note\n* one: {0}\n* two: {1}", "Invoice (specimen) | for {0} | about {1}",
    ),
    "nl": (
        "Beste collega: wij zagen {0} vorige week; schrijf naar {1} met de uitslag.", "Bezoek | gesproken met {0} | vervolg: {1} | open", "naam,contact\n{0},{1}", "Ondergetekende: {0}; inzake {1}.", "Melding van {0}\nGraag antwoord: {1}", "Aan: {0}\nBetreft: uw verlof, {1}",
        '{"wie":"{0}","waar":"{1}","verzonnen":true}', "Aanwezig: {0}; actie: {1}.", "bezoeker: {0}\nbalie: genoteerd, {1}; verder nog iets?", "Niemand in dit verhaal bestaat, {0} niet en {1} ook niet.", "eigenaar = '{0}'  # zie {1}", "eerste={0}\ntweede={1}\nmodus=demo",
        "WARN verzonnen_event wie={0} waar={1}", "Formulier\nRegel een: {0}\nRegel twee: {1}", "wie: '{0}'\nwaar: '{1}'\nverzonnen: true", '<rij verzonnen="true"><a>{0}</a><b>{1}</b></rij>', "# Verzonnen notitie\n* een: {0}\n* twee: {1}", "Factuur (proef) | voor {0} | over {1}",
    ),
}
#: Special categories: kind, English and Dutch value, English and Dutch sentence.
SPECIAL = (
    ("racial_or_ethnic_origin", "Dutch-Moroccan", "Marokkaans-Nederlands", "{0} says to be {1}.", "{0} noemt zich {1}."), ("political_opinion", "Green Party", "GroenLinks", "{0} votes for the {1}.", "{0} stemt op {1}."),
    ("religious_or_philosophical_belief", "Catholic", "katholiek", "{0} is a {1}.", "{0} is {1}."), ("trade_union_membership", "trade union", "vakbond", "{0} joined a {1}.", "{0} is lid van een {1}."), ("genetic_data", "BRCA1", "BRCA1", "{0} carries {1}.", "{0} draagt {1}."),
    ("biometric_data", "BIO-FP-4410", "BIO-FP-4410", "{0}; fingerprint: {1}.", "{0}; vingerafdruk: {1}."), ("health_data", "diabetes", "diabetes", "{0} has {1}.", "{0} heeft {1}."), ("sexual_orientation", "bisexual", "biseksueel", "{0} is {1}.", "{0} is {1}."),
)
QUIET = ("The office opens at nine.", "This report holds totals only.", "The handbook says how to apply.")
NEAR = ("May and June are milestones, not people.", "localhost 127.0.0.1 is a reserved host.", "The museum shows religions of Europe.", "Nobody was diagnosed; this is a drill.", "password_variable = 'placeholder'")
FIRST = ("Anna", "Bram", "Chloe", "Daan", "Eva", "Finn", "Greta", "Hugo")
LAST = ("Jansen", "de Vries", "Bakker", "van Dijk", "Smit", "Meijer", "Visser", "Mulder")
PROFILES = {"smoke": 160, "medium": 5000, "large": 20_000}
CHOICES = ("person", "email", "customer_number", "case_number", "phone", "api_token", "session_token", "iban")
VALUE, SPAN = "struct<value:string,kind:string>", "struct<start:int,end:int,text:string,entity_type:string,expected_action:string,assertion_type:string,field:string>"
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_LETTERS = "áàâäãåçéèêëíìîïñóòôöõúùûüý"


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def iban_for(account: Column) -> Column:
    """A valid Dutch IBAN of a 10-digit account: check digits are 98 less the remainder modulo 97."""
    bban = F.concat(F.lit("ABNA"), F.lpad(account.cast("string"), 10, "0"))
    turned = F.concat(bban, F.lit("NL00"))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97))
    return F.concat(F.lit("NL"), F.lpad((98 - rest).cast("string"), 2, "0"), bban)


def _each(values: dict[str, Column], kind: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def swapped(text: Column) -> Column:
    """Upper case for lower and the other way round."""
    low, up = string.ascii_lowercase + _LETTERS, string.ascii_uppercase + _LETTERS.upper()
    return F.translate(text, low + up, up + low)


def decomposed(value: Column) -> Column:
    """Accented letters as a letter and its mark."""
    return reduce(lambda v, c: F.replace(v, F.lit(c), F.lit(unicodedata.normalize("NFD", c))), _LETTERS + _LETTERS.upper(), value)


def transformed(value: Column, kind: Column) -> Column:
    """The value as the transformation writes it."""
    letters, words = F.filter(F.split(value, ""), lambda c: c != ""), F.split(value, " ")
    compact = F.replace(value, F.lit(" "), F.lit(""))
    escaped = reduce(lambda v, x: F.replace(v, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("@", "&#64;")), value)
    forms = {
        "casing": swapped(value), "whitespace-insertion": F.array_join(letters, " "), "whitespace-removal": compact, "url-encoding": F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), "html-entities": escaped, "unicode-normalization": decomposed(value),
        "zero-width": F.array_join(letters, "\u200b"), "homoglyph": F.translate(value, "aA", "\u0430\u0391"), "fullwidth": F.translate(value, _ASCII, "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)), "ocr-like": F.translate(value, "Ol", "01"),
        "dutch-surname-prefix": F.concat(F.lit("van der "), value), "initials": F.concat(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ". "), F.lit(".")), "hyphenation": F.replace(value, F.lit(" "), F.lit("-")),
        "spaced-iban": F.regexp_replace(compact, "(.{4})(?=.)", "$1 "), "split-phone": F.array_join(words, " - "), "email-obfuscation": F.replace(F.replace(value, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] ")),
    }
    return _each(forms, kind).otherwise(value)


def reshaped(template: Column, kind: Column) -> Column:
    """The template as the transformation changes it: what is said around the values."""
    wrapped = reduce(lambda v, x: F.replace(v, F.lit(x[0]), F.lit(x[1])), ((" | ", "\n"), ("; ", ";\n"), (" [record:", "\n[record:")), template)
    spaced = F.replace(F.replace(template, F.lit(":"), F.lit(" : ")), F.lit("="), F.lit(" = "))
    return _each({"casing": swapped(template), "line-wrapping": wrapped, "punctuation-spacing": spaced, "apostrophe": F.replace(template, F.lit("{0}"), F.lit("{0}'s"))}, kind).otherwise(template)


def filled(template: Column, values: Column, assertion: Column, nested: Column) -> Column:
    """struct<text, entities>: values written into {0}, {1}, ... in turn. The fold carries the text so far, whose length is
    where the next gap begins, so that places are right whatever the values hold. nested adds a span within the first."""
    gaps = F.split(template, r"\{[0-9]\}")
    actions = F.create_map(*[F.lit(x) for t in taxonomy.TYPES for x in (t, taxonomy.ACTION[t])])

    def span(start: Column, text: Column, kind: Column, field: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"), kind.alias("entity_type"), F.try_element_at(actions, kind).alias("expected_action"), assertion.alias("assertion_type"), field.alias("field"))

    def step(acc: Column, i: Column) -> Column:
        v, ahead = F.get(values, i), F.concat(acc["text"], F.get(gaps, i))
        return F.struct(F.concat(ahead, v["value"]).alias("text"), F.array_append(acc["out"], span(F.length(ahead), v["value"], v["kind"], i.cast("string"))).alias("out"))

    begin = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{SPAN}>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), begin, step, lambda acc: F.struct(F.concat(acc["text"], F.element_at(gaps, -1)).alias("text"), acc["out"].alias("out")))
    first = F.get(done["out"], 0)
    inner = span(first["start"] + 1, F.substring(first["text"], F.lit(2), F.length(first["text"]) - 2), F.lit("unknown_sensitive"), F.lit("nested-overlap"))
    spans = F.when(nested & (F.length(first["text"]) > 4), F.array_append(done["out"], inner)).otherwise(done["out"])
    return F.struct(done["text"].alias("text"), spans.alias("entities"))


def samples_of(numbers: DataFrame, number: str, seed: int = 1, dutch: int = 40) -> DataFrame:
    """A labelled sample for each number of a table: one narrow stage, no shuffle. Template, transformation and values follow from the
    number; every fifth has nothing in it, dutch of a hundred are Dutch; repeated numbers give equal samples, nulls none."""
    rows = numbers.filter(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("i"))
    i = F.col("i")
    form, nth = F.pmod(i, F.lit(len(FORMATS))), F.col("i") + seed
    rows = rows.select(
        "i", F.when(F.pmod(F.xxhash64(i), F.lit(100)) < dutch, "nl").otherwise("en").alias("language"), (F.pmod(i, F.lit(5)) == 0).alias("negative"), _pick(tuple(a for a, _ in FORMATS), i).alias("domain"), _pick(tuple(b for _, b in FORMATS), i).alias("format"), _pick(SPLITS, form).alias("split"),
        _pick(tuple(TRANSFORMATIONS), i).alias("kind"), _pick(ASSERTIONS, i).alias("assertion"),
    )
    nl = F.col("language") == "nl"
    name = F.concat_ws(" ", _pick(FIRST, nth * 7), _pick(LAST, F.floor(nth * 13 / 8)))
    values = {
        "person": name, "email": F.concat(F.lit("case"), nth.cast("string"), F.lit("@example.invalid")), "customer_number": F.concat(F.lit("CUST-"), F.lpad(F.lit(str(seed % 10_000)), 4, "0"), F.lit("-"), F.lpad(i.cast("string"), 8, "0")),
        "case_number": F.concat(F.lit("CASE-"), F.lpad(i.cast("string"), 8, "0")), "phone": F.concat(F.lit("+31 20 "), F.lpad((1_000_000 + F.pmod(i, F.lit(9_000_000))).cast("string"), 7, "0")), "api_token": F.concat(F.lit("sk-test-made-up-"), F.lpad(nth.cast("string"), 16, "0")),
        "session_token": F.concat(F.lit("session_test_"), F.lpad(nth.cast("string"), 16, "0")), "iban": iban_for(F.pmod(nth, F.lit(10_000_000_000))), "accented": F.when(nl, "Zoë Voorbeeld").otherwise("Zoë Example"),
    }
    valued = lambda kind: F.struct(_each(values, kind).alias("value"), F.when(kind == "accented", "person").otherwise(kind).alias("kind"))
    given = lambda j: F.coalesce(_each({t: F.lit(k[j]) for t, k in WANTED.items()}, F.col("kind")), _pick(CHOICES, i + form + 3 * j))
    # without a wish of the transformation, every other sample is about a person and a special category
    special = ~F.col("kind").isin(*WANTED) & (F.pmod(i, F.lit(2)) == 0)
    own = _pick(tuple(range(len(SPECIAL))), F.floor(i / 2))
    part = lambda k: F.get(F.array(*[F.lit(x[k]) for x in SPECIAL]), own)
    second = F.when(special, F.struct(F.when(nl, part(2)).otherwise(part(1)).alias("value"), part(0).alias("kind"))).otherwise(valued(given(1)))
    first = F.when(special, valued(F.lit("person"))).otherwise(valued(given(0)))
    template = F.when(special, F.when(nl, part(4)).otherwise(part(3))).otherwise(F.when(nl, _pick(TEXTS["nl"], i)).otherwise(_pick(TEXTS["en"], i)))
    marks = F.translate(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), i.cast("string")), 256), 1, 32), "0123456789", "ghijklmnop")
    rows = rows.select("*", F.array(first, second).cast(f"array<{VALUE}>").alias("plain"), F.concat(template, F.lit(" [record:"), marks, F.lit("]")).alias("template"), marks.alias("marks"))
    kind, scope = F.col("kind"), _each({t: F.lit(k) for t, k in SCOPE.items()}, F.col("kind"))
    written = F.transform("plain", lambda v: F.struct(F.when(F.coalesce(v["kind"] == scope, F.lit(True)), transformed(v["value"], kind)).otherwise(v["value"]).alias("value"), v["kind"].alias("kind")))
    rows = rows.select("*", written.alias("written"), reshaped(F.col("template"), kind).alias("shaped"))
    rows = rows.withColumn("s", filled(F.col("shaped"), F.col("written"), F.col("assertion"), kind == "nested-overlap"))
    near = F.pmod(F.floor(i / 5), F.lit(2)) == 1
    control = F.concat(F.when(nl, "Notitie ").otherwise("Note "), i.cast("string"), F.lit(": "), F.when(near, _pick(NEAR, F.floor(i / 5))).otherwise(_pick(QUIET, F.floor(i / 5))), F.lit(" "), F.col("marks"))
    none, support = F.array().cast(f"array<{SPAN}>"), F.create_map(*[x for k, v in TRANSFORMATIONS.items() for x in (F.lit(k), F.lit(v))])
    final = F.when(F.col("negative"), "original").otherwise(kind)
    applied = ~F.col("negative") & ((F.col("template") != F.col("shaped")) | (F.col("plain") != F.col("written")) | (kind == "nested-overlap"))
    return rows.select(
        F.format_string("synthetic-%08d", "i").alias("id"), "language", "domain", "format", "split", final.alias("transformation"), F.try_element_at(support, final).alias("support"), F.when(F.col("negative"), control).otherwise(F.col("s.text")).alias("text"),
        F.when(F.col("negative"), none).otherwise(F.col("s.entities")).alias("entities"), applied.alias("applied"), F.concat_ws("-", F.when(F.col("negative"), "negative").otherwise("positive"), "language", form.cast("string")).alias("template_group"),
    )


def samples(spark: SparkSession, n: int | str = "smoke", seed: int = 1) -> DataFrame:
    """samples_of() the first n numbers, or as many as a profile says."""
    return samples_of(spark.range(PROFILES[n] if isinstance(n, str) else n), "id", seed)
