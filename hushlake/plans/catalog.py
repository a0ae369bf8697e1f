"""Every operator as a named query over the driver's tables, with SQL to hold it against where SQL can say it.

Evaluation operators need expected and predicted spans; lineitem gives both: a row is a span of its order, predictions
are the same spans with some shifted and relabelled by arithmetic on the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise, spans, tables, validators
from ..operators import asof, conversations, detect, evaluate, generate, golden, integrity, intervals, language, merge, ner, prepare
from ..streaming.vault import windowed_counts
from . import golden_cases, lexicon, policies, probes, rules, taxonomy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RULE = {r.name: r for r in rules.RULES}
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = f"SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '({_OCTET}\\.){{3}}{_OCTET}'))) AS v FROM documents"


@query(f"SELECT lang, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs, count(DISTINCT left(v, 1) || repeat('•', least(10, length(v) - 2)) || right(v, 1)) AS n_masks FROM ({_IPV4}) GROUP BY lang")
def ipv4_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    found = detect.rule_findings(docs, RULE["ipv4"], "doc_id", "lang")
    return found.groupBy("lang").agg(F.count("*").alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(spans.mask_preview(F.col("text"))).alias("n_masks"))


def _rule_query(name: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = detect.rule_findings(table(spark, d, "documents").select("doc_id", "text"), RULE[name], "doc_id")
        return found.groupBy("doc_id", "text").agg(F.count("*").alias("n"))

    QUERIES[f"rule_{name}"] = run
    if sql:
        ORACLES[f"rule_{name}"] = f"SELECT doc_id, v AS text, count(*) AS n FROM ({sql}) GROUP BY ALL"


def _runs(cls: str, full: str, more: str = "true") -> str:
    return f"SELECT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{cls}+')) AS v FROM documents) WHERE regexp_full_match(v, '{full}') AND {more}"


_BSN = "v <> '000000000' AND (" + " + ".join(f"({9 - i if i < 8 else -1}) * substr(v, {i + 1}, 1)::INT" for i in range(9)) + ") % 11 = 0"
for _name in ("ipv4", "dutch_bsn", "email", "phone", "credit_card", "dutch_postcode"):  # the others do not occur in documents: see found_*
    _rule_query(
        _name,
        {
            "ipv4": f"SELECT doc_id, v FROM ({_IPV4})",
            "dutch_bsn": f"SELECT doc_id, v FROM (SELECT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM documents) WHERE length(v) = 9) WHERE {_BSN}",
        }.get(_name),
    )


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:api[_-]?key|secret|token|passw(?:or)?d)\\s*[:=]\\s*[\"'']?([A-Z0-9_./+=-]{16,})', 1)) AS v FROM documents) GROUP BY doc_id")
def credential_assignments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").rlike(rules.CREDENTIALS[2].guard))
    found = detect.findings(docs.withColumn("c", detect.credential_spans(F.col("text"))), "c", "doc_id")
    return found.filter("rule = 'assigned_secret'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n FROM ({_runs('[A-Za-z0-9]', '(?i)RF[0-9]{{8,25}}').replace('{{', '{').replace('}}', '}')}) GROUP BY doc_id")
def creditor_references(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return detect.findings(docs.withColumn("c", detect.creditor_spans(F.col("text"))), "c", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def prefixed_references(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return detect.findings(docs.withColumn("c", F.concat(detect.prefix_spans(F.col("text")), detect.secret_spans(F.col("text")))), "c", "doc_id")


_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_KIND = f"""CASE WHEN regexp_matches({_HOST}, '\\.(local|internal|localhost)$|intranet|corp|internal|portal') OR {_HOST} = 'localhost'
 OR regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/case-management|/crm/|/portal/|/admin/') THEN 'internal_url'
 WHEN list_has_any(list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1))), {list(rules.QUERY_KEYS)}) OR contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '@') THEN 'sensitive_url_parameter' ELSE 'url' END"""


@query(f"SELECT page_id, {_KIND} AS kind FROM pages")
def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", detect.url_kind(F.col("url")).alias("kind"))


@query()
def url_findings(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return detect.findings(pages.withColumn("c", detect.url_spans(F.col("text"))), "c", "page_id").groupBy("page_id", "entity_type").agg(F.count("*").alias("n"))


@query()
def all_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = merge.merge(detect.detect(table(spark, d, "documents").select("doc_id", "text")))
    return detect.findings(docs, "entities", "doc_id").withColumn("id", spans.span_id(F.struct("start", "end", "entity_type", "source", "text"))).drop("text")


@query()
def merge_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return merge.diagnostics(merge.merge(detect.detect(table(spark, d, "documents").select("doc_id", "text"))), "doc_id")


@query()
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return prepare.analyse(table(spark, d, "documents"))


@query()
def special_assertions(spark: SparkSession, d: str) -> DataFrame:
    return prepare.assertions(table(spark, d, "documents"))


@query()
def prepared_documents(spark: SparkSession, d: str) -> DataFrame:
    return prepare.prepare(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "status", "outcome", "safe_text", "reasons", "n_entities")


@query(f"SELECT * FROM {taxonomy.values_sql()}")
def taxonomy_listing(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.category_listing(spark)


@query(f"SELECT entity_type, category_group, CASE WHEN category_group IN ('Financial') OR severity = 'critical' THEN default_action ELSE 'review' END AS action, 0.3::DOUBLE AS threshold FROM {taxonomy.values_sql()}")
def financial_policy(spark: SparkSession, d: str) -> DataFrame:
    own = policies.rules_table(spark).filter("policy = 'financial_data'")
    return own.join(F.broadcast(taxonomy.taxonomy(spark)), "entity_type").select("entity_type", "category_group", "action", "threshold")


@query(f"""WITH f AS (SELECT 'ipv4' AS entity_type, 1.0 AS confidence FROM ({_IPV4}) UNION ALL SELECT 'date', 0.9 FROM (SELECT unnest(regexp_extract_all(text, '(?i){rules.DATE}')) FROM documents))
SELECT entity_type, CASE WHEN entity_type = 'ipv4' THEN 'redact' ELSE 'review' END AS action, count(*) AS n FROM f WHERE confidence >= 0.3 GROUP BY ALL""")
def findings_by_policy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = detect.rule_findings(docs, RULE["ipv4"], "doc_id").unionByName(detect.rule_findings(docs, RULE["general_date"], "doc_id"))
    return prepare.decided_by_policy(found, policies.rules_table(spark), "default").filter("kept").groupBy("entity_type", "action").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT doc_id, v, row_number() OVER () AS k FROM ({_IPV4})), p AS (SELECT d.doc_id, d.text, s.v FROM (SELECT DISTINCT doc_id, v FROM s) s JOIN documents d USING (doc_id)),
o AS (SELECT doc_id, v, position(v IN text) AS pos FROM p)
SELECT doc_id, v AS text, '[IPV4_' || row_number() OVER (PARTITION BY doc_id ORDER BY pos, v) || ']' AS token FROM o""")
def token_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = detect.rule_findings(table(spark, d, "documents").select("doc_id", "text"), RULE["ipv4"], "doc_id")
    return prepare.suggested_tokens(found).select("doc_id", "text", "token")


# --- functions ---


@query("SELECT c_custkey, substr(c_name, 1, 1) || repeat('•', least(10, length(c_name) - 2)::INT) || right(c_name, 1) AS masked FROM customer")
def masked_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", spans.mask_preview(F.col("c_name")).alias("masked"))


_N16 = "lpad((o_orderkey * 7919)::VARCHAR, 16, '4')"


@query("SELECT o_orderkey, (" + " + ".join(f"(substr(v, {i + 1}, 1)::INT * {2 - i % 2} - CASE WHEN substr(v, {i + 1}, 1)::INT * {2 - i % 2} > 9 THEN 9 ELSE 0 END)" for i in range(16)) + f") % 10 = 0 AS valid FROM (SELECT o_orderkey, {_N16} AS v FROM orders)")
def luhn(spark: SparkSession, d: str) -> DataFrame:
    v = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    return table(spark, d, "orders").select("o_orderkey", validators.luhn_valid(v).alias("valid"))


@query(f"SELECT c_custkey, {_BSN} AS valid FROM (SELECT c_custkey, lpad((c_custkey * 104729)::VARCHAR, 9, '0') AS v FROM customer)")
def bsn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", validators.bsn_valid(F.lpad((F.col("c_custkey") * 104729).cast("string"), 9, "0")).alias("valid"))


@query("SELECT s_suppkey, (('10112310' || lpad((s_suppkey * 7919)::VARCHAR, 10, '0') || '2321' || lpad((s_suppkey % 97)::VARCHAR, 2, '0'))::HUGEINT % 97) = 1 AS valid FROM supplier")
def iban(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("NL"), F.lpad((F.col("s_suppkey") % 97).cast("string"), 2, "0"), F.lit("ABNA"), F.lpad((F.col("s_suppkey") * 7919).cast("string"), 10, "0"))
    return table(spark, d, "supplier").select("s_suppkey", validators.iban_valid(v).alias("valid"))


@query("SELECT c_custkey, true AS valid FROM customer")
def generated_ibans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", validators.iban_valid(generate.iban_for(F.col("c_custkey"))).alias("valid"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\s+', ' ', 'g')) AS h FROM documents")
def collapsed_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(normalise.collapsed(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, regexp_matches(text, '&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);|%[0-9A-Fa-f]{2}|[\\t\\n\\r\\f\\v]|  ') AS needed FROM documents")
def needs_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalise.requires_normalisation(F.col("text")).alias("needed"))


@query()
def normalised_views(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", normalise.normalised_view(F.col("text")).alias("v"))
    return v.select("doc_id", F.length("v.norm").alias("n_chars"), F.size("v.runs").alias("n_runs"))


def _n(words: tuple[str, ...]) -> str:
    return f"len(list_filter(ws, lambda w: list_contains({list(words)}, w)))"


@query(f"""SELECT doc_id, CASE WHEN en >= 2 AND en >= nl + 1 THEN 'en' WHEN nl >= 2 AND nl >= en + 1 THEN 'nl' END AS language FROM (SELECT doc_id, {_n(language.EN)} AS en,
{_n(language.NL)} + CASE WHEN regexp_matches(lower(text), 'ij|sch|oe') THEN 1 ELSE 0 END AS nl FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents))""")
def marker_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", language.detected(F.col("text")).alias("language"))


# --- integrity ---


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicates(table(spark, d, "documents"))


@query("SELECT sha256(t) AS h, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') AS t FROM documents) GROUP BY t HAVING count(*) > 1")
def normalised_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicates(table(spark, d, "documents"), normalised=True)


@query()
def simhashes(spark: SparkSession, d: str) -> DataFrame:
    return integrity.simhash(table(spark, d, "documents"))


@query()
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return integrity.near_pairs(table(spark, d, "documents").select("doc_id", "text", "source"), "source")


@query("SELECT 'user_id' AS group_key, user_id::VARCHAR AS group_value, count(DISTINCT event_type) AS n_splits FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return integrity.split_leakage(table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("user_id")), ["user_id"], "event_type")


@query("SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, bool_and(text IS NOT NULL) AS texts_present, bool_and(length(text) > 0) AS texts_nonempty, bool_and(length(text) <= 100000) AS texts_bounded, count(DISTINCT lang) > 1 AS several_languages FROM documents")
def corpus_booleans(spark: SparkSession, d: str) -> DataFrame:
    return integrity.booleans(table(spark, d, "documents"))


# --- evaluation ---

_E = "SELECT l_orderkey AS doc_id, (l_linenumber * 20)::INT AS start, (l_linenumber * 20 + 5 + l_quantity::INT % 9)::INT AS \"end\", l_returnflag AS label, l_linestatus AS action, l_shipdate FROM lineitem"
_P = "SELECT l_orderkey AS doc_id, (l_linenumber * 20 + CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 0 END)::INT AS start, (l_linenumber * 20 + 5 + l_quantity::INT % 9)::INT AS \"end\", CASE WHEN l_suppkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS label, CASE WHEN l_partkey % 3 = 0 THEN 'O' ELSE l_linestatus END AS action FROM lineitem"
_WITH = f"WITH e AS ({_E}), p AS ({_P})"


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    n, end = F.col("l_linenumber") * 20, (F.col("l_linenumber") * 20 + 5 + F.col("l_quantity").cast("int") % 9).cast("int")
    e = li.select(F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("start"), end.alias("end"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("action"))
    p = li.select(F.col("l_orderkey").alias("doc_id"), (n + F.when(F.col("l_partkey") % 5 == 0, 2).otherwise(0)).cast("int").alias("start"), end.alias("end"), F.when(F.col("l_suppkey") % 7 == 0, "X").otherwise(F.col("l_returnflag")).alias("label"), F.when(F.col("l_partkey") % 3 == 0, "O").otherwise(F.col("l_linestatus")).alias("action"))
    return e, p


_EXACT = f"""{_WITH}, a AS (SELECT doc_id, start, "end", label, count(*) AS ne FROM e GROUP BY ALL), b AS (SELECT doc_id, start, "end", label, count(*) AS np FROM p GROUP BY ALL),
c AS (SELECT doc_id, label, coalesce(ne, 0) AS ne, coalesce(np, 0) AS np FROM a FULL JOIN b USING (doc_id, start, "end", label)),
x AS (SELECT doc_id, label, sum(least(ne, np))::BIGINT AS tp, sum(np - least(ne, np))::BIGINT AS fp, sum(ne - least(ne, np))::BIGINT AS fn FROM c GROUP BY ALL)"""
_RATIOS = "tp / nullif((tp + fp)::DOUBLE, 0) AS precision, tp / nullif((tp + fn)::DOUBLE, 0) AS recall, 2.0::DOUBLE * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0) AS f1, fp / nullif((fp + tn)::DOUBLE, 0) AS fp_rate"


@query(f"{_EXACT} SELECT * FROM x")
def exact_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.exact_counts(*_spans(spark, d))


@query(f"{_EXACT} SELECT *, {_RATIOS} FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, 0::BIGINT AS tn, sum(fn)::BIGINT AS fn FROM x GROUP BY label)")
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.grouped(evaluate.exact_counts(*_spans(spark, d)).withColumn("tn", F.lit(0).cast("long")), "label")


@query(f"""{_EXACT}, y AS (SELECT label, (doc_id % 4)::VARCHAR AS shard, tp, fp, 0 AS tn, fn FROM x)
SELECT *, {_RATIOS} FROM (SELECT CASE WHEN grouping(label) = 0 THEN 'label' ELSE 'shard' END AS axis, coalesce(label, shard) AS value, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn FROM y GROUP BY GROUPING SETS ((label), (shard)))""")
def axis_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.exact_counts(*_spans(spark, d)).withColumn("tn", F.lit(0).cast("long")).withColumn("shard", (F.col("doc_id") % 4).cast("string"))
    return evaluate.multi_axis(c, ["label", "shard"])


# Spans of a line and its prediction all overlap, and no others do: of each label as many match as both sides have.
_MET = f"""{_WITH}, r AS (SELECT doc_id, start // 20 AS line, label, 1 AS e, 0 AS p FROM e UNION ALL SELECT doc_id, start // 20, label, 0, 1 FROM p)"""


@query(f"""{_MET}, g AS (SELECT doc_id, sum(e) AS e, sum(p) AS p FROM r GROUP BY doc_id, line, label) SELECT doc_id, sum(least(e, p))::BIGINT AS tp, sum(p - least(e, p))::BIGINT AS fp, sum(e - least(e, p))::BIGINT AS fn FROM g GROUP BY doc_id""")
def relaxed_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.relaxed_counts(*_spans(spark, d))


@query(f"""{_MET}, g AS (SELECT doc_id, line, sum(e) AS e, sum(p) AS p FROM r GROUP BY doc_id, line) SELECT doc_id, line::INT AS line, least(e, p)::BIGINT AS n FROM g""")
def category_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches whatever their labels: one for each line that has both sides."""
    e, p = _spans(spark, d)
    m = evaluate.greedy_matches(e, p, same_label=False)
    return intervals.dealt(m, "doc_id", like=e).groupBy("doc_id", F.floor(F.col("e_start") / 20).cast("int").alias("line")).agg(F.count("*").alias("n"))


@query(f"""{_EXACT}, m AS (SELECT *, {_RATIOS} FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, 0::BIGINT AS tn, sum(fn)::BIGINT AS fn FROM x GROUP BY label) WHERE tp + fn > 0)
SELECT 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS micro_f1, avg(f1) AS macro_f1, sum(f1 * (tp + fn)) / sum(tp + fn) FILTER (WHERE f1 IS NOT NULL) AS weighted_f1 FROM m""")
def average_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.averages(label_metrics(spark, d))


@query()
def recall_interval(spark: SparkSession, d: str) -> DataFrame:
    per_doc = evaluate.exact_counts(*_spans(spark, d)).groupBy("doc_id").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
    return evaluate.bootstrap_recall(per_doc)


@query(f"{_WITH} SELECT doc_id, start, \"end\", label, action, count(*) - 1 AS n_dropped FROM p GROUP BY ALL")
def deduped_predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.dedupe_predictions(_spans(spark, d)[1])


@query(f"""{_WITH}, a AS (SELECT doc_id, label, count(*) AS ne FROM e GROUP BY ALL), b AS (SELECT doc_id, label, count(*) AS na FROM p GROUP BY ALL),
s AS (SELECT sum(least(ne, na))::BIGINT AS tp, sum(na - least(ne, na))::BIGINT AS fp, sum(ne - least(ne, na))::BIGINT AS fn FROM (SELECT coalesce(ne, 0) AS ne, coalesce(na, 0) AS na FROM a FULL JOIN b USING (doc_id, label)))
SELECT *, coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 1.0) AS precision, coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 1.0) AS recall FROM s""")
def multiset(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.multiset_metrics(*_spans(spark, d), ["doc_id", "label"])


@query(f"""{_WITH}, j AS (SELECT e.label AS expected, p.label AS actual FROM e JOIN p ON e.doc_id = p.doc_id AND e.start = p.start)
SELECT expected, count(*) FILTER (WHERE actual = 'A') AS A, count(*) FILTER (WHERE actual = 'N') AS N, count(*) FILTER (WHERE actual = 'R') AS R, count(*) FILTER (WHERE actual = 'X') AS X FROM j GROUP BY expected""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    e, p = (s.select("doc_id", F.col("start").cast("string").alias("text"), F.col("label").alias("entity_type")) for s in _spans(spark, d))
    return evaluate.confusion(e, p, ["A", "N", "R", "X"])


# Lines are 20 apart, so a prediction overlaps expected spans of its own line number alone: each kind follows from the line's
# own shift and label, and from equal predictions.
_LINES = """SELECT l_orderkey AS doc_id, l_partkey % 5 = 0 AS shifted, l_suppkey % 7 = 0 AS other FROM lineitem"""


@query(f"""{_MET}, l AS ({_LINES}) SELECT DISTINCT doc_id, unnest(CASE WHEN other THEN ['wrong_category', 'overlapping_prediction_conflict'] WHEN shifted THEN ['partial_span', 'overlapping_prediction_conflict'] ELSE [] END) AS failure FROM l
UNION SELECT doc_id, 'policy_decision_defect' FROM r WHERE (doc_id + line) % 12 = 0 GROUP BY doc_id, line, label HAVING sum(e) > 0 AND sum(p) > 0
UNION SELECT doc_id, 'duplicate_prediction' FROM ({_P}) GROUP BY doc_id, start, "end", label HAVING count(*) > 1""")
def failures(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of failure by document; every fourth line is to be masked, of which a third is let through."""
    k = F.col("doc_id") + F.floor(F.col("start") / 20)
    e, p = _spans(spark, d)
    e, p = e.withColumn("action", F.when(k % 4 == 0, "mask").otherwise("allow")), p.withColumn("action", F.when((k % 4 == 0) & (k % 12 != 0), "mask").otherwise("allow"))
    return evaluate.failures(e, p)


@query("""SELECT k AS doc_id, unnest(CASE k % 8 WHEN 0 THEN ['missed_entity'] WHEN 1 THEN [] WHEN 2 THEN ['partial_span', 'overlapping_prediction_conflict'] WHEN 3 THEN ['oversized_span', 'overlapping_prediction_conflict']
WHEN 4 THEN ['wrong_category', 'overlapping_prediction_conflict'] WHEN 5 THEN ['unexpected_false_positive'] WHEN 6 THEN ['duplicate_prediction', 'overlapping_prediction_conflict'] ELSE ['missed_entity', 'unexpected_false_positive'] END
|| CASE WHEN k % 3 = 0 AND k % 8 <> 1 THEN ['unsupported_transformation'] ELSE [] END || CASE WHEN k % 3 = 1 AND k % 8 IN (0, 2, 3, 7) THEN ['normalization_failure'] ELSE [] END) AS failure FROM (SELECT o_orderkey AS k FROM orders)""")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of failure, from one expected span a document and predictions made from its key."""
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    support = F.when(F.col("doc_id") % 3 == 0, "deliberately_unsupported").otherwise("supported")
    samples = k.select("doc_id", F.when(F.col("doc_id") % 3 == 1, "fullwidth").otherwise("original").alias("transformation"), support.alias("support"))
    return evaluate.sample_failures(evaluate.failures(*_kinds_of_failure(spark, d)), samples, ("fullwidth",))


def _kinds_of_failure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    span = lambda a, b, x: f"named_struct('start', {a}, 'end', {b}, 'label', '{x}')"
    right, part, wide, other, far = span(10, 20, "a"), span(12, 20, "a"), span(8, 25, "a"), span(10, 20, "b"), span(40, 50, "a")
    kinds = [(), (right,), (part,), (wide,), (other,), (right, far), (right, right), (far,)]
    made = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN array({', '.join(x)})" for i, x in enumerate(kinds) if x) + " END"
    e = k.select("doc_id", F.lit(10).alias("start"), F.lit(20).alias("end"), F.lit("a").alias("label"))
    return e, k.select("doc_id", F.explode(F.expr(made)).alias("s")).select("doc_id", "s.*")


@query("""SELECT CASE k % 6 WHEN 0 THEN 'negative_controls' WHEN 1 THEN 'standard_clean' WHEN 2 THEN 'supported_adversarial' WHEN 3 THEN 'partially_supported_adversarial' WHEN 4 THEN 'unsupported_challenge' ELSE 'negative_controls' END AS release_group,
count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL""")
def release_groups(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    six = F.col("k") % 6
    kind = F.when(six == 2, "supported").when(six == 3, "partial").when(six == 4, "deliberately_unsupported").otherwise("supported")
    own = k.select(F.when(six.isin(0, 5), 0).otherwise(2).alias("n_entities"), F.when(six.isin(0, 1), "original").otherwise("fullwidth").alias("transformation"), kind.alias("support"))
    return evaluate.release_group(own).groupBy("release_group").agg(F.count("*").alias("n"))


_CHECKS = ("every_expected_span_matches_source_substring", "unicode_codepoint_offsets_are_correct", "transformations_update_annotations", "transformed_records_preserve_expected_semantics", "negative_records_have_no_accidental_generated_entity", "unsupported_transformations_are_labeled_correctly", "release_scoring_groups_are_mutually_exclusive", "exact_and_relaxed_span_math_is_correct", "mixed_entity_documents_are_counted_once", "duplicate_predictions_do_not_inflate_false_positives", "expected_categories_match_detector_taxonomy", "annotation_actions_match_taxonomy")
_FAULTY = ("transformations_update_annotations", "annotation_actions_match_taxonomy", "unsupported_transformations_are_labeled_correctly", "unicode_codepoint_offsets_are_correct", "every_expected_span_matches_source_substring", "negative_records_have_no_accidental_generated_entity")


@query(" UNION ALL ".join(f"SELECT {faulty} AS faulty, '{c}' AS name, {'true' if not faulty else 'false' if c in _FAULTY else 'true'} AS passed" for faulty in (False, True) for c in _CHECKS))
def corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    """The twelve checks on a sound corpus made from keys, and on the same with five kinds of fault in it."""
    out = []
    for faulty in (False, True):
        k = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(faulty).alias("faulty"))
        some = F.col("faulty") & (F.col("doc_id") % 10 == 1)
        none = F.col("doc_id") % 5 == 0
        wrong = F.col("faulty") & (F.col("doc_id") % 20 == 5)
        text = F.when(none, F.when(wrong, "something made up").otherwise("nothing to see")).otherwise(F.concat(F.lit("mail 🙂 a"), F.col("doc_id").cast("string"), F.lit("@x.org")))
        turned = F.col("doc_id") % 2 == 0
        kind = F.when(some & ~turned, "unheard").when(turned, "fullwidth").otherwise("original")
        samples = k.select("doc_id", text.alias("text"), kind.alias("transformation"), F.lit("supported").alias("support"), F.lit(True).alias("semantics_kept"))
        own = samples.join(k.filter(~none).select("doc_id", some.alias("bad")), "doc_id")
        value = F.expr("substring(text, 8)")
        annotations = own.select("doc_id", F.lit(7).alias("start"), (F.length("text") + F.when(F.col("bad"), 1).otherwise(0)).alias("end"), F.lit("email").alias("entity_type"), F.when(F.col("bad"), "allow").otherwise("redact").alias("action"), F.when(F.col("bad"), "other").otherwise(value).alias("span_text"))
        n = F.when(none, 0).otherwise(1)
        counts = k.select("doc_id", n.alias("tp_exact"), n.alias("tp_relaxed"), n.alias("support_exact"), n.alias("support_relaxed"), F.lit(0).alias("n_duplicates"))
        checks = integrity.integrity_checks(samples, annotations, counts, {"fullwidth": "supported"}, {"email": "redact"}, 0, ["nothing to see"])
        out.append(checks.select(F.lit(faulty).alias("faulty"), "name", "passed"))
    return out[0].unionByName(out[1])


@query("""SELECT k AS doc_id, k % 8 IN (2, 3) AS boundary_only, CASE WHEN k % 8 IN (0, 5) THEN 1 ELSE 2 END::BIGINT AS n_failures FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 8 <> 1""")
def boundary_failures(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's failures are all a matter of boundaries."""
    return evaluate.boundary_only(*_kinds_of_failure(spark, d))


@query(f"""{_MET}, g AS (SELECT doc_id, line, label, least(sum(e), sum(p)) AS n FROM r GROUP BY ALL), a AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN (doc_id + line) % 12 <> 0 THEN n ELSE 0 END)::BIGINT AS n_right FROM g WHERE (doc_id + line) % 4 = 0)
SELECT n, n_right, n_right / n::DOUBLE AS accuracy FROM a""")
def action_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often matched spans have the action that every fourth line is to have; the others state none."""
    e, p = _spans(spark, d)
    k = F.col("doc_id") + F.floor(F.col("start") / 20)
    wanted = e.select("doc_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.when(k % 4 == 0, "mask").alias("e_action"))
    given = p.select("doc_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.when((k % 4 == 0) & (k % 12 != 0), "mask").otherwise("allow").alias("p_action"))
    wanted, given = (intervals.dealt(x, *x.columns[:3]).distinct() for x in (wanted, given))
    return evaluate.action_accuracy(evaluate.greedy_matches(e, p), wanted, given)


@query("""WITH d AS (SELECT o_orderkey % 3 = 0 AS eu, o_orderkey % 5 = 0 AS u, o_orderkey % 2 = 0 AS es, o_orderkey % 4 <> 0 AS s, o_orderkey % 7 = 0 AS l FROM orders)
SELECT count(*) AS n, count(*) FILTER (WHERE eu = u) / count(*)::DOUBLE AS unsafe_accuracy, count(*) FILTER (WHERE es = s) / count(*)::DOUBLE AS disposition_accuracy, count(*) FILTER (WHERE s AND l) / count(*) FILTER (WHERE s)::DOUBLE AS approved_leak_rate FROM d""")
def document_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions about documents, as orders' keys make them, against what is wanted."""
    k = F.col("o_orderkey")
    ok = lambda c: F.when(c, "ok").otherwise("blocked")
    rows = table(spark, d, "orders").select((k % 3 == 0).alias("expected_unsafe"), (k % 5 == 0).alias("unsafe"), ok(k % 2 == 0).alias("expected_status"), ok(k % 4 != 0).alias("status"), (k % 7 == 0).alias("leaked"))
    return evaluate.document_decisions(rows)


@query("SELECT count(DISTINCT event_type) AS n_tiers, count(DISTINCT event_type) > 1 AS mixed FROM events")
def mixed_tiers(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tier_check(table(spark, d, "events").select(F.col("event_type").alias("tier")))


@query(f"{_EXACT} SELECT label, sum(fn)::BIGINT AS n FROM x GROUP BY label HAVING sum(fn) > 0")
def missed_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.error_ranking(label_metrics(spark, d), "fn")


@query(f"{_WITH} SELECT o_orderkey AS doc_id, CASE WHEN s.doc_id IS NULL THEN 1 ELSE 0 END AS tn FROM orders LEFT JOIN (SELECT doc_id FROM e UNION SELECT doc_id FROM p) s ON o_orderkey = s.doc_id")
def negatives(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.document_negatives(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), *_spans(spark, d))


# Lines as intervals: by supplier, or all of them on one axis.
_SPOTS = 'SELECT l_suppkey AS doc_id, l_orderkey * 64 + l_linenumber * 8 AS start, l_orderkey * 64 + l_linenumber * 8 + (l_partkey * 37 % 400) AS "end", l_returnflag AS label FROM lineitem'


def _spots(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), at.alias("start"), (at + F.col("l_partkey") * 37 % 400).alias("end"), F.col("l_returnflag").alias("label"))


@query(f'WITH s AS ({_SPOTS}) SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, b.start AS b_start, b."end" AS b_end FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start < b.start AND b.start < a."end" AND a."end" < b."end"')
def partial_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return integrity.partial_overlaps(_spots(spark, d))


@query(f"""WITH s AS ({_SPOTS}) SELECT a.label AS a_label, b.label AS b_label, count(*) AS n, sum(least(a."end", b."end") - greatest(a.start, b.start))::BIGINT AS shared
FROM s a JOIN s b ON a.start < b."end" AND b.start < a."end" WHERE a.label < b.label GROUP BY ALL""")
def overlaps_on_one_axis(spark: SparkSession, d: str) -> DataFrame:
    """All lines lie on one axis, as if they were spans of one document: pairs of different labels and what they share."""
    own = _spots(spark, d).withColumn("axis", F.lit(1))
    l, r = F.col("l"), F.col("r")
    pairs = intervals.overlapping(own, own, ["axis"]).filter(l["label"] < r["label"])
    shared = F.least(l["end"], r["end"]) - F.greatest(l["start"], r["start"])
    return pairs.groupBy(l["label"].alias("a_label"), r["label"].alias("b_label")).agg(F.count("*").alias("n"), F.sum(shared).alias("shared"))


@query(f"""WITH s AS ({_SPOTS}), m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s)
SELECT doc_id, count(*) AS n_spans, count(*) FILTER (WHERE upto IS NULL OR start >= upto) AS n_islands FROM m GROUP BY doc_id""")
def span_islands(spark: SparkSession, d: str) -> DataFrame:
    i = intervals.islands(_spots(spark, d), ["doc_id"])
    return i.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.max("island").alias("n_islands"))


_ASOF = "FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') b ON {}"


@query(f"SELECT a.event_id, b.event_id AS last_id, b.event_type AS last_type, a.value - b.value AS change {_ASOF.format('a.user_id = b.user_id AND a.ts >= b.ts')}")
def last_event_before(spark: SparkSession, d: str) -> DataFrame:
    """Each click with its user's last event of another kind."""
    e = table(spark, d, "events")
    m = asof.asof_join(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), ["user_id"], "ts")
    return m.select("event_id", F.col("r.event_id").alias("last_id"), F.col("r.event_type").alias("last_type"), (F.col("value") - F.col("r.value")).alias("change"))


@query(f"SELECT a.event_id, CASE WHEN a.ts - b.ts <= INTERVAL 2 MINUTE THEN b.event_id END AS last_id {_ASOF.format('a.ts > b.ts')}")
def last_event_of_anyone(spark: SparkSession, d: str) -> DataFrame:
    """The same without a key, as if one held all rows: the event strictly before, if it is two minutes old at most."""
    e = table(spark, d, "events")
    m = asof.asof_join(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), [], "ts", within=F.col("ts") - F.col("r.ts") <= F.expr("INTERVAL 2 MINUTES"), strict=True)
    return m.select("event_id", F.col("r.event_id").alias("last_id"))


@query("SELECT event_type, median(value) AS median, list_sort(list(value))[(floor((count(value) - 1) * 0.95))::INT + 1] AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(table(spark, d, "events"), "event_type", "value")


@query(f"{_EXACT}, m AS (SELECT sum(tp) / sum(tp + fn)::DOUBLE AS recall, sum(tp) / sum(tp + fp)::DOUBLE AS precision FROM x) SELECT *, list_filter([CASE WHEN recall < 0.9 THEN 'recall' END, CASE WHEN precision < 0.5 THEN 'precision' END], lambda z: z IS NOT NULL) AS failures, recall >= 0.9 AND precision >= 0.5 AS passed FROM m")
def release_gates(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.exact_counts(*_spans(spark, d)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    r = c.select((F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return evaluate.gates(r, {"recall": (">=", 0.9), "precision": (">=", 0.5)})


_AXES = {"language": 3, "domain": 4, "split": 2, "source": 5, "tier": 2, "format": 3, "transformation": 6}
_SAID_OF = "CASE l_linenumber % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'third_party' ELSE 'none' END"
_AXIS_ROWS = " UNION ALL ".join([f"SELECT '{a}' AS axis, '{a}' || (k % {n})::VARCHAR AS value, * FROM d" for a, n in _AXES.items()]) + """
UNION ALL SELECT 'mixed', CASE WHEN kinds IS NULL THEN 'negative' WHEN kinds > 1 THEN 'mixed_entities' ELSE 'single_entity_type' END, * FROM d
UNION ALL SELECT 'text_length', CASE WHEN k % 400 < 80 THEN 'short' WHEN k % 400 < 300 THEN 'medium' ELSE 'long' END, * FROM d
UNION ALL SELECT 'assertion_type', t, d.* FROM d JOIN (SELECT DISTINCT l_orderkey AS k, """ + _SAID_OF + """ AS t FROM lineitem) s USING (k)"""


@query(f"""{_EXACT}, per_doc AS (SELECT doc_id AS k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM x GROUP BY doc_id), q AS (SELECT doc_id AS k, count(DISTINCT label) AS kinds FROM e GROUP BY doc_id),
d AS (SELECT o_orderkey AS k, kinds, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, CASE WHEN tp IS NULL THEN 1 ELSE 0 END AS tn, coalesce(fn, 0) AS fn FROM orders LEFT JOIN per_doc z ON o_orderkey = z.k LEFT JOIN q ON o_orderkey = q.k)
SELECT *, {_RATIOS} FROM (SELECT axis, value, count(*)::BIGINT AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn FROM ({_AXIS_ROWS}) GROUP BY ALL)""")
def report_axes(spark: SparkSession, d: str) -> DataFrame:
    """The report along all axes: orders are samples, a third to an eighth of them with each value."""
    e, p = _spans(spark, d)
    said = F.expr(_SAID_OF.replace("l_linenumber", "(start DIV 20)"))
    k = F.col("o_orderkey")
    samples = table(spark, d, "orders").select(k.alias("doc_id"), F.repeat(F.lit("x"), (k % 400).cast("int")).alias("text"), *[F.concat(F.lit(a), (k % n).cast("string")).alias(a) for a, n in _AXES.items()])
    return evaluate.report_axes(samples, e.withColumn("assertion_type", said), p, list(_AXES))


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders), e AS (SELECT k, 'health' AS category, k % 2 = 0 AS negated FROM k WHERE k % 4 <> 3 UNION ALL SELECT k, 'union', false FROM k WHERE k % 8 = 2),
a AS (SELECT k, 'health' AS category, k % 6 = 0 AS negated, k % 5 <> 0 AS linked FROM k WHERE k % 7 <> 0),
c AS (SELECT coalesce(ne, 0) AS ne, coalesce(na, 0) AS na FROM (SELECT category, negated, count(*) AS ne FROM e GROUP BY ALL) FULL JOIN (SELECT category, negated, count(*) AS na FROM a GROUP BY ALL) USING (category, negated)),
m AS (SELECT sum(least(ne, na))::BIGINT AS tp, sum(na - least(ne, na))::BIGINT AS fp, sum(ne - least(ne, na))::BIGINT AS fn FROM c),
j AS (SELECT e.negated AS en, a.negated AS an, linked FROM e LEFT JOIN a USING (k, category))
SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, (SELECT count(*) FILTER (WHERE linked) / count(linked)::DOUBLE FROM j) AS subject_linking_accuracy,
(SELECT count(*) FILTER (WHERE en = an) / count(*)::DOUBLE FROM j) AS negation_accuracy, (SELECT count(*) FILTER (WHERE k % 7 <> 0) / count(*)::DOUBLE FROM k WHERE k % 4 = 3 AND k % 3 = 0) AS general_discussion_false_positive_rate FROM m""")
def assertion_scores(spark: SparkSession, d: str) -> DataFrame:
    """Expected and actual assertions made from keys; a later actual one of the same category decides nothing."""
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    one = k.filter("doc_id % 4 <> 3").select("doc_id", F.lit("health").alias("category"), (F.col("doc_id") % 2 == 0).alias("negated"))
    e = one.unionByName(k.filter("doc_id % 8 = 2").select("doc_id", F.lit("union").alias("category"), F.lit(False).alias("negated")))
    a = k.filter("doc_id % 7 <> 0").select("doc_id", F.lit(4).alias("position"), F.lit("health").alias("category"), (F.col("doc_id") % 6 == 0).alias("negated"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("n_subjects"))
    return evaluate.assertion_metrics(e, a, k.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("n_entities")))


@query(f"{_EXACT}, f AS (SELECT label, 2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1_old FROM x GROUP BY label) SELECT label, f1_old, CASE WHEN label <> 'X' THEN 1.0::DOUBLE END AS f1_new, f1_new - f1_old AS delta FROM f")
def f1_changes(spark: SparkSession, d: str) -> DataFrame:
    """F1 of a label under two sets of predictions, the second being what is expected."""
    e, _ = _spans(spark, d)
    perfect = evaluate.grouped(evaluate.exact_counts(e, e).withColumn("tn", F.lit(0).cast("long")), "label")
    return evaluate.comparison(label_metrics(spark, d), perfect, "label")


@query(f"{_EXACT}, s AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x GROUP BY label) SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, 0::BIGINT AS tn, coalesce(fn, 0) AS fn FROM (VALUES ('A'), ('N'), ('R'), ('Z')) z(label) LEFT JOIN s USING (label)")
def keyed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the labels asked for; one that no span has counts nothing."""
    keys = spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "label string")
    return evaluate.with_expected_keys(label_metrics(spark, d).select("label", "tp", "fp", "tn", "fn"), keys, "label")


@query(f"""{_EXACT}, m AS (SELECT sum(tp) / sum(tp + fn)::DOUBLE AS recall, sum(fp) / sum(tp + fp)::DOUBLE AS miss_rate FROM x)
SELECT recall, miss_rate, list_filter([CASE WHEN recall < 0.95 - 0.01 THEN 'recall' END, CASE WHEN miss_rate > 0.05 + 0.9 THEN 'miss_rate' END], lambda z: z IS NOT NULL) AS regressed FROM m""")
def regressed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A report against a baseline of recall 0.95 (0.01 less is allowed) and miss rate 0.05 (0.9 more is allowed)."""
    c = evaluate.exact_counts(*_spans(spark, d)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    r = c.select((F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (F.col("fp") / (F.col("tp") + F.col("fp"))).alias("miss_rate"))
    base = spark.createDataFrame([(0.95, 0.05)], "recall double, miss_rate double")
    return evaluate.regressions(r, base, {"recall": 0.01, "miss_rate": -0.9})


_NER_TEXT = f"'Row ' || {probes.K} || ' says: ' || CASE k % 6 WHEN 0 THEN 'Jan de Vries left' WHEN 1 THEN 'the public company Acme paid' WHEN 2 THEN 'Acme paid' WHEN 3 THEN 'near Utrecht' WHEN 4 THEN 'an oracle' ELSE 'van der Bakker came' END"
_NER_VALUE = "CASE k % 6 WHEN 0 THEN 'Jan de Vries' WHEN 2 THEN 'Acme' WHEN 3 THEN 'Utrecht' WHEN 5 THEN 'van der Bakker' END"


@query(f"SELECT k, {_NER_VALUE} AS text, CASE k % 6 WHEN 2 THEN 'organization' WHEN 3 THEN 'location' ELSE 'person' END AS entity_type, (11 + length({probes.K}) + CASE WHEN k % 6 = 3 THEN 5 ELSE 0 END)::INT AS start FROM (SELECT c_custkey AS k FROM customer) WHERE k % 6 IN (0, 2, 3, 5)")
def model_spans(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary as a model: whole names with their particles, no organisations called public, no unknown tags."""
    words = {"Jan": "PER", "Bakker": "PER", "Acme": "ORG", "Utrecht": "LOC", "oracle": "MISC"}
    found = ner.model_spans(_keys(spark, d).select("k", F.expr(_NER_TEXT).alias("text")), ner.lexicon(words), "k")
    return ner.surest(found, "k").select("k", "text", "entity_type", "start")


# --- detectors as functions of SQL ---


@query(f"SELECT lang, v AS text, count(*) AS n FROM ({_IPV4}) GROUP BY ALL")
def spans_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """The table function in a LATERAL join, one rule asked for."""
    tables.register(spark)
    docs = table(spark, d, "documents").select("lang", "text")
    return spark.sql("SELECT d.lang, s.text, count(*) AS n FROM {docs} d, LATERAL sensitive_spans(d.text, rules => 'ipv4') s GROUP BY d.lang, s.text", docs=docs)


@query(f"""SELECT k, 'email' AS entity_type, 'user' || {probes.K} || '@example.com' AS text, 'pseudonymize' AS decision, 'high_confidence_structured_pii' AS reason FROM (SELECT c_custkey AS k FROM customer)
UNION ALL SELECT k, 'password', 'secret' || {probes.K}, 'block', 'policy_block' FROM (SELECT c_custkey AS k FROM customer)""")
def entities_by_sql(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    rows = _keys(spark, d).select("k", F.expr(f"'Mail user' || {probes.K} || '@example.com' || chr(10) || 'password: secret' || {probes.K}").alias("text"))
    return spark.sql("SELECT k, s.entity_type, s.text, s.decision, s.reason FROM {rows} r, LATERAL sensitive_entities(r.text, policy => 'default') s", rows=rows)


@query("""SELECT event_id, CASE WHEN e IS NULL OR o IS NULL OR e NOT IN ('prompt', 'tool_call', 'tool_result') THEN 'deny' WHEN o = 'ALLOW' THEN 'allow' WHEN o IN ('REDACTED', 'PSEUDONYMIZED') THEN 'replace' ELSE 'deny' END AS decision
FROM (SELECT event_id, """ + probes.choice("event_id", ("prompt", "tool_call", "tool_result", "other")) + " AS e, NULLIF(" + probes.choice("event_id // 4", ("ALLOW", "REDACTED", "PSEUDONYMIZED", "REVIEW", "BLOCK", "none")) + ", 'none') AS o FROM events)")
def dispatched_events(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on events of hosts by their kind and the outcome of what they carry."""
    e = F.expr(probes.choice("event_id", ("prompt", "tool_call", "tool_result", "other")))
    o = F.expr("NULLIF(" + probes.choice("event_id DIV 4", ("ALLOW", "REDACTED", "PSEUDONYMIZED", "REVIEW", "BLOCK", "none")) + ", 'none')")
    return table(spark, d, "events").select("event_id", conversations.dispatch(e, o).alias("decision"))


# --- the engine on a labelled corpus made from keys ---


def _seen(spark: SparkSession, d: str) -> DataFrame:
    k = _keys(spark, d)
    return golden.observed(k.select(*[F.expr(x).alias(c) for c, x in golden_cases.FIXTURE.items()]))


@query(golden_cases.STAGES_SQL)
def golden_stages(spark: SparkSession, d: str) -> DataFrame:
    """What six stages of the engine find in fixtures, against what is expected of each."""
    return golden.stage_metrics(_seen(spark, d))


@query(golden_cases.FAILED_SQL)
def golden_failures(spark: SparkSession, d: str) -> DataFrame:
    return golden.failed(_seen(spark, d))


@query(golden_cases.CONFUSION_SQL)
def golden_confusion(spark: SparkSession, d: str) -> DataFrame:
    return golden.misclassified(_seen(spark, d))


@query(golden_cases.SUMMARY_SQL)
def golden_summary(spark: SparkSession, d: str) -> DataFrame:
    return golden.summary(_seen(spark, d))


@query(golden_cases.COUNTS_SQL)
def golden_counts(spark: SparkSession, d: str) -> DataFrame:
    return golden.counts(_seen(spark, d))


# --- conversations, generator, windows ---


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_user_messages(spark: SparkSession, d: str) -> DataFrame:
    return conversations.latest_user_message(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


@query()
def safe_payloads(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return conversations.sanitise_payloads(c.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("payload"))).select("conv_id", "turn", "outcome", "safe_payload")


@query()
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    return generate.samples_of(table(spark, d, "orders"), "o_orderkey")


_FORM = probes.choice("k", [f for _, f in generate.FORMATS])
_MADE = f"SELECT k, CASE WHEN k % 5 = 0 THEN 'original' ELSE {probes.choice('k', generate.TRANSFORMATIONS)} END AS transformation, CASE WHEN k % 5 = 0 THEN 0 WHEN {probes.choice('k', generate.TRANSFORMATIONS)} = 'nested-overlap' THEN 3 ELSE 2 END AS entities FROM (SELECT o_orderkey AS k FROM orders)"


@query(f"""SELECT transformation, count(*) AS n, sum(entities)::BIGINT AS n_entities, sum(entities)::BIGINT AS n_right, sum(entities)::BIGINT AS n_inside, sum(entities)::BIGINT AS n_actions, count(*) FILTER (WHERE entities > 0 AND transformation <> 'original') AS n_applied FROM ({_MADE}) GROUP BY ALL""")
def generated_slices(spark: SparkSession, d: str) -> DataFrame:
    """By transformation: samples made, their spans, those whose text is what stands at their place, lie within the text, and
    have the action of their type, and samples that the transformation changed."""
    own = generate.samples_of(table(spark, d, "orders"), "o_orderkey")
    many = lambda test: F.sum(F.size(F.filter("entities", test)).cast("long"))
    actions = F.create_map(*[F.lit(x) for t in taxonomy.TYPES for x in (t, taxonomy.ACTION[t])])
    return own.groupBy("transformation").agg(
        F.count("*").alias("n"), many(lambda e: F.lit(True)).alias("n_entities"), many(lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["text"]).alias("n_right"),
        many(lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length("text"))).alias("n_inside"), many(lambda e: F.element_at(actions, e["entity_type"]) == e["expected_action"]).alias("n_actions"), F.count_if("applied").alias("n_applied"),
    )


@query(f"SELECT {_FORM} AS format, CASE WHEN k % 5 = 0 THEN 'negative' ELSE 'positive' END AS sign, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL")
def generated_formats(spark: SparkSession, d: str) -> DataFrame:
    own = generate.samples_of(table(spark, d, "orders"), "o_orderkey")
    return own.groupBy("format", F.substring_index("template_group", "-", 1).alias("sign")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- rules on rows made for them: hits and near misses from keys ---


def _keys(spark: SparkSession, d: str, share: int = 4096) -> DataFrame:
    """Customers' keys, at most about share of them in a task: a file of millions is still one split, but a text made from a
    key takes up to a millisecond. Their number comes from the file's footers."""
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return k.repartition(max(1, -(-k.count() // share)))


def _probe_query(name: str, p: probes.Probe, spans_of) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _keys(spark, d).select("k", F.expr(p.text).alias("text"))
        return detect.findings(rows.withColumn("c", spans_of(F.col("text"))), "c", "k").filter(F.col("rule") == p.rule).select("k", "start", "text")

    QUERIES[name] = run
    ORACLES[name] = probes.expected_sql(p)


for _p, _label in zip(probes.LABEL_PROBES, rules.LABELS, strict=True):
    _probe_query(f"label_{_label.name.removesuffix('_label')}", _p, lambda t, x=_label: detect.label_spans(t, x))
for _p in probes.PLAIN_PROBES:
    _probe_query(f"found_{_p.rule}", _p, lambda t, x=RULE[_p.rule]: detect.rule_spans(t, x))
for _p, _f in zip(probes.OTHER_PROBES, (detect.prefix_spans, detect.creditor_spans, detect.secret_spans), strict=True):
    _probe_query(f"found_{_p.rule}", _p, _f)


def _scanned(spark: SparkSession, d: str, some: list[probes.Probe]) -> DataFrame:
    """The Arrow stage over all rows made for rules: how many spans each rule finds in them, and how many where it should."""
    keys = _keys(spark, d, 1 << 16)  # once for each rule
    own = [keys.select(F.lit(p.rule).alias("wanted"), F.expr(p.text).alias("text"), F.expr(p.value).alias("value"), F.expr(p.start).alias("at")) for p in some]
    rows = reduce(DataFrame.unionAll, own)
    found = detect.findings(detect.detect(rows), "candidates", "wanted", "value", "at")
    right = F.coalesce((F.col("text") == F.col("value")) & (F.col("start") == F.col("at")), F.lit(False))
    return found.groupBy("wanted", "rule").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))


@query(probes.counts_sql(probes.LABEL_PROBES))
def scanned_labels(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, probes.LABEL_PROBES)


@query(probes.counts_sql([*probes.PLAIN_PROBES, *probes.OTHER_PROBES]))
def scanned_rules(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, [*probes.PLAIN_PROBES, *probes.OTHER_PROBES])


_FIELDS = list(lexicon.FIELD_LABELS)
_FIELD_SQL = f"({probes.choice('k', _FIELDS)})"
_FIELD_TEXT = f"'Record ' || {probes.K} || '. ' || CASE WHEN k % 3 = 0 THEN 'Recorded ' ELSE '' END || {_FIELD_SQL} || CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 2 = 0 THEN ': ' ELSE ' = ' END || CASE WHEN k % 11 = 0 THEN 'Nationality' ELSE 'Value' || {probes.K} END || ' Occupation: x'"


# Labels that are concepts of themselves are said of the whole sentence, without a sign or (membership) behind a colon.
_BARE = f"k % 5 = 0 AND {_FIELD_SQL} IN ('dna profile', 'dna-profiel', 'sexual activity') OR k % 5 <> 0 AND k % 2 = 0 AND {_FIELD_SQL} = 'trade union membership'"


@query(f"""SELECT k, {probes.choice('k', lexicon.FIELD_LABELS.values())} AS category, 'Value' || {probes.K} AS text FROM (SELECT c_custkey AS k FROM customer) WHERE k % 5 <> 0 AND k % 11 <> 0
UNION ALL SELECT k, {probes.choice('k', lexicon.FIELD_LABELS.values())}, substr({_FIELD_TEXT}, length('Record ' || {probes.K} || '. ') + 1) FROM (SELECT c_custkey AS k FROM customer) WHERE {_BARE}""")
def special_fields(spark: SparkSession, d: str) -> DataFrame:
    """Values of special-category fields: bounded by the next header, refused if they are a header, led by a verb or not."""
    found = prepare.assertions(_keys(spark, d).select("k", F.expr(_FIELD_TEXT).alias("text")), "k")
    return found.select("k", "category", F.substring(F.expr(_FIELD_TEXT), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


_CONCEPTS = [(c, x) for c, v in lexicon.CONCEPTS.items() for x in v if x not in lexicon.FIELD_LABELS and c in ("political_opinion", "religious_or_philosophical_belief", "trade_union_membership", "genetic_data", "health_data", "sexual_orientation", "racial_or_ethnic_origin")]
_CONCEPTS = [(c, x) for c, x in _CONCEPTS if x not in lexicon.PARTNERS]
_SAID = f"CASE WHEN k % 7 = 0 THEN 'The article says ' ELSE '' END || 'Maria Jansen ' || CASE WHEN k % 4 = 0 THEN 'is not ' WHEN k % 4 = 1 THEN 'saw ' ELSE 'is ' END || {probes.choice('k', [x for _, x in _CONCEPTS])} || '&#46;'"


@query(f"SELECT k, {probes.choice('k', [c for c, _ in _CONCEPTS])} AS category, k % 4 = 0 AS negated, CAST(0 AS INT) AS start FROM (SELECT c_custkey AS k FROM customer) WHERE k % 7 <> 0 AND (k % 4 <> 1 OR {probes.choice('k', [x for _, x in _CONCEPTS])} IN ('DNA profile', 'DNA-profiel'))")
def said_of_people(spark: SparkSession, d: str) -> DataFrame:
    """Assertions about a named person, in texts whose full stop is written as a character reference."""
    found = prepare.assertions(_keys(spark, d).select("k", F.expr(_SAID).alias("text")), "k")
    return found.select("k", "category", "negated", "start")


_CASES = (
    # text, status, outcome, safe text
    ("'Mail user' || {K} || '@example.com from 10.0.0.' || CAST(k % 200 AS STRING) || ' or user' || {K} || '@example.com'", "ok", "PSEUDONYMIZED", "'Mail [EMAIL_1] from [IPV4_1] or [EMAIL_1]'"),
    ("'Nothing of note: row ' || {K} || '.'", "ok", "ALLOW", "'Nothing of note: row ' || {K} || '.'"),
    ("'password: secret' || {K}", "blocked", "BLOCK", "CAST(NULL AS STRING)"),
    ("'Religion: Taoist' || {K}", "review_required", "REVIEW", "CAST(NULL AS STRING)"),
    ("'ACC-NL-' || lpad({K}, 5, '0') || ' is here. acc-nl- remains'", "blocked", "BLOCK", "CAST(NULL AS STRING)"),
    ("'see [thing ' || {K} || '] there'", "blocked", "BLOCK", "CAST(NULL AS STRING)"),
    ("'Passport' || '" + " " * 59 + "' || ': AB' || lpad({K}, 6, '0')", "ok", "PSEUDONYMIZED", "'Passport" + " " * 59 + ": [PASSPORT_NUMBER_1]'"),
    ("'Name: Jan Smit' || chr(10) || 'Name: Smit'", "ok", "PSEUDONYMIZED", "'Name: [PERSON_1]' || chr(10) || 'Name: [PERSON_1]'"),
    ("'The chemotherapy session ' || {K} || ' was moved'", "ok", "ALLOW", "'The chemotherapy session ' || {K} || ' was moved'"),
)


def _case(i: int) -> str:
    return "CASE " + f"k % {len(_CASES)} " + " ".join(f"WHEN {n} THEN {c[i] if i in (0, 3) else repr(c[i])}" for n, c in enumerate(_CASES)).replace("{K}", probes.K) + " END"


@query(f"SELECT k, {_case(1)} AS status, {_case(2)} AS outcome, {_case(3)} AS safe_text FROM (SELECT c_custkey AS k FROM customer)")
def prepared_cases(spark: SparkSession, d: str) -> DataFrame:
    """Requests of every status, with the safe text that each must give."""
    return prepare.prepare(_keys(spark, d).select("k", F.expr(_case(0)).alias("text"))).select("k", "status", "outcome", "safe_text")


@query(f"SELECT k, {_case(0)} AS restored FROM (SELECT c_custkey AS k FROM customer) WHERE k % {len(_CASES)} IN (0, 1, 6, 8) UNION ALL SELECT k, 'Name: Jan Smit' || chr(10) || 'Name: Jan Smit' FROM (SELECT c_custkey AS k FROM customer) WHERE k % {len(_CASES)} = 7")
def restored_cases(spark: SparkSession, d: str) -> DataFrame:
    """Approved texts with their tokens put back; an alias comes back as the name its token stands for."""
    p = prepare.prepare(_keys(spark, d).select("k", F.expr(_case(0)).alias("text"))).filter("status = 'ok'")
    return prepare.restore(p).select("k", "restored")


@query(f"SELECT {_case(1)} AS status, {_case(2)} AS outcome, count(*) AS n, count(*) FILTER (WHERE {_case(3)} IS NULL) AS n_withheld, 0::BIGINT AS n_faulty FROM (SELECT c_custkey AS k FROM customer) GROUP BY ALL")
def output_states(spark: SparkSession, d: str) -> DataFrame:
    """Statuses and outcomes with the texts withheld, exactly those not approved, and the rows that break an invariant."""
    p = prepare.prepare(_keys(spark, d).select("k", F.expr(_case(0)).alias("text")))
    return p.groupBy("status", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("safe_text").isNull()).alias("n_withheld"), F.count_if(prepare.is_faulty()).alias("n_faulty"))


_TOOLS = ("mcp__mail__send", "mcp_send", "WebFetch", "webfetch", "WebSearch", "google_search", "Read", "Bash", "http_get", "list_files", "connect_db", "Edit")


@query("""SELECT event_id, tool, tool IN ('mcp__mail__send', 'WebFetch', 'WebSearch') AS named, tool NOT IN ('Read', 'Bash', 'list_files', 'Edit') AS marked
FROM (SELECT event_id, """ + probes.choice("event_id", _TOOLS) + """ AS tool FROM events)""")
def outbound_tools(spark: SparkSession, d: str) -> DataFrame:
    tool = F.expr(probes.choice("event_id", _TOOLS))
    e = table(spark, d, "events").select("event_id", tool.alias("tool"))
    return e.select("event_id", "tool", conversations.is_outbound(F.col("tool")).alias("named"), conversations.is_outbound(F.col("tool"), "marked").alias("marked"))
