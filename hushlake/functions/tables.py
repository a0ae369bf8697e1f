"""Detectors as functions of SQL: a table function for LATERAL joins and scalar functions, for sessions that register them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from ..plans import rules as R
from ..plans.policies import BUILT_IN
from . import core
from .scan import scan

SPAN = T.StructType([T.StructField(n, t) for n, t in (
    ("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()), ("entity_type", T.StringType()), ("confidence", T.DoubleType()), ("source", T.StringType()), ("rule", T.StringType()), ("precedence", T.IntegerType()),
)])
DECIDED = T.StructType([*SPAN.fields[:6], T.StructField("decision", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("severity", T.StringType())])
RULES = {r.name for r in R.RULES} | {x.name for x in R.LABELS} | {"configured_prefix", "rf_reference", "secret_prefix", "url", "internal_url", "sensitive_url_parameter"}


def _text(arg: AnalyzeArgument) -> None:
    if not isinstance(arg.dataType, (T.StringType, T.NullType)):
        raise ValueError("text must be a string")


class SensitiveSpans:
    """sensitive_spans(text[, rules => 'a,b']): the candidates of all detection rules in a text, or of the rules named. The
    names are checked when the query is analysed: none at all, or an unknown one, fails it there."""

    @staticmethod
    def analyze(text: AnalyzeArgument, rules: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text)
        if rules is not None:
            names = [x.strip() for x in (rules.value or "").split(",") if x.strip()] if rules.isConstantExpression else []
            if not names:
                raise ValueError("rules must name some rule, as a constant")
            if unknown := set(names) - RULES:
                raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
        return AnalyzeResult(SPAN)

    def eval(self, text: str | None, rules: str | None = None) -> Iterator[tuple]:
        own = {x.strip() for x in rules.split(",")} if rules else None
        for s in scan(text) if text is not None else []:
            if own is None or s["rule"] in own:
                yield tuple(s[n] for n in SPAN.names)


class SensitiveEntities:
    """sensitive_entities(text[, policy => 'gdpr']): merged findings with what the policy decides of each."""

    @staticmethod
    def analyze(text: AnalyzeArgument, policy: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text)
        if policy is not None and (not policy.isConstantExpression or policy.value not in BUILT_IN):
            raise ValueError("policy must be the name of a built-in policy")
        return AnalyzeResult(DECIDED)

    def eval(self, text: str | None, policy: str = "default") -> Iterator[tuple]:
        for e in core.analyse(text or "", BUILT_IN[policy])["entities"]:
            yield tuple(e[n] for n in DECIDED.names)


def table_functions() -> dict[str, UserDefinedTableFunction]:
    return {"sensitive_spans": udtf(SensitiveSpans), "sensitive_entities": udtf(SensitiveEntities)}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL. Each text is read in the task that holds its row."""
    for name, f in table_functions().items():
        spark.udtf.register(name, f)
