"""Conversations, payloads and events of agent hosts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..plans.policies import BUILT_IN, Policy

PAYLOAD = "struct<outcome:string,payload:string>"
# Tools that send data out, by host. "named" hosts name their tools exactly, "marked" ones are told by parts.
OUTBOUND_PREFIX, OUTBOUND_NAMES = "mcp__", ("WebFetch", "WebSearch")
MARKED_PREFIX, MARKED_PARTS = "mcp_", ("http", "web", "search", "fetch", "request", "api", "connect")
TOKEN = r"\[(?:REDACTED|[A-Z][A-Z0-9_]*_[0-9]+)\]"


def latest_user_message(conversations: DataFrame) -> DataFrame:
    """The last message of role user in each conversation; the window needs only its first row, which Spark cuts early."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.filter("role = 'user'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def replace_latest(conversations: DataFrame, safe: DataFrame) -> DataFrame:
    """Safe texts (conv_id, turn, safe_text) put in place of the originals."""
    return conversations.join(safe, ["conv_id", "turn"], "left").withColumn("text", F.coalesce("safe_text", "text")).drop("safe_text")


def is_outbound(name: Column, host: str = "named") -> Column:
    """Whether a tool sends data out; null names don't."""
    if host == "named":
        hit = name.startswith(OUTBOUND_PREFIX) | name.isin(*OUTBOUND_NAMES)
    else:
        low = F.lower(name)
        hit = low.startswith(MARKED_PREFIX)
        for part in MARKED_PARTS:
            hit = hit | low.contains(part)
    return F.coalesce(hit, F.lit(False))


def tokens_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))))


def with_guidance(text: Column, note: str) -> Column:
    """The note behind texts that hold a token, once."""
    return F.when((F.size(tokens_in(text)) > 0) & ~text.contains(note), F.concat(text, F.lit("\n\n" + note))).otherwise(text)


def overall(outcomes: Column) -> Column:
    """One outcome of an array: none stays null, any that isn't let through wins, then REDACTED, then PSEUDONYMIZED."""
    has = lambda *x: F.exists(outcomes, lambda o: o.isin(*x))
    return F.when(F.size(outcomes) == 0, F.lit(None).cast("string")).when(has("BLOCK"), "BLOCK").when(has("REVIEW"), "REVIEW").when(has("REDACTED"), "REDACTED").when(has("PSEUDONYMIZED"), "PSEUDONYMIZED").otherwise("ALLOW")


def sanitise_tree(node, policy: Policy) -> tuple[str, object]:
    """(outcome, node) of a JSON tree: string leaves become safe text, the shape stays; the first leaf that may not pass
    settles the whole."""
    if isinstance(node, str):
        r = core.prepare(node, policy)
        return r["outcome"], r["safe_text"]
    if isinstance(node, list | dict):
        out, worst = [], "ALLOW"
        for x in node if isinstance(node, list) else node.values():
            o, safe = sanitise_tree(x, policy)
            if o in ("BLOCK", "REVIEW"):
                return o, None
            worst = o if worst == "ALLOW" else worst
            out.append(safe)
        return worst, out if isinstance(node, list) else dict(zip(node, out, strict=True))
    return "ALLOW", node


def sanitise_payloads(df: DataFrame, column: str = "payload", policy: str = "default") -> DataFrame:
    """df with outcome and safe_payload; text that isn't JSON is denied."""
    rule = BUILT_IN[policy]

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for p in batch:
            try:
                o, safe = sanitise_tree(json.loads(p), rule)
                rows.append((o, None if o in ("BLOCK", "REVIEW") else json.dumps(safe, ensure_ascii=False)))
            except (TypeError, ValueError, RecursionError):
                rows.append(("BLOCK", None))
        return pd.DataFrame(rows, columns=["outcome", "payload"])

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return df.withColumn("__r", F.pandas_udf(run, PAYLOAD)(F.col(column))).select(*df.columns, "__r.outcome", F.col("__r.payload").alias("safe_payload"))


def dispatch(event: Column, outcome: Column) -> Column:
    """An event's decision: unknown events and results are denied."""
    known = event.isin("prompt", "tool_call", "tool_result")
    return F.when(~F.coalesce(known, F.lit(False)) | outcome.isNull(), "deny").when(outcome == "ALLOW", "allow").when(outcome.isin("REDACTED", "PSEUDONYMIZED"), "replace").otherwise("deny")


def allowed_digests(df: DataFrame, session: str, text: str = "text") -> DataFrame:
    """Memo of texts let through, one row a session and hash."""
    return df.filter("outcome = 'ALLOW'").select(session, F.sha2(text, 256).alias("digest")).dropDuplicates()
