"""What an agent's session remembers: texts that were let through, and a transformation that the next request takes once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import core
from ..plans.policies import BUILT_IN

OUTPUT = "session string, seq long, op string, outcome string, payload string, analysed boolean"


def replaced(node, source: str, safe: str) -> tuple[object, int]:
    """A JSON tree with every occurrence of source in its strings put as safe, and how many strings held it."""
    if isinstance(node, str):
        return (node.replace(source, safe), 1) if source in node else (node, 0)
    if isinstance(node, list | dict):
        parts = [replaced(x, source, safe) for x in (node if isinstance(node, list) else node.values())]
        out = [x for x, _ in parts]
        return out if isinstance(node, list) else dict(zip(node, out, strict=True)), sum(n for _, n in parts)
    return node, 0


def prepared(text: str) -> tuple[str, str | None]:
    r = core.prepare(text, BUILT_IN["default"])
    return r["outcome"], r["safe_text"]


class Memo(StatefulProcessor):
    """Events (session, seq, op, text, payload), by seq within a batch:

    inspect: the outcome of text. One that was let through in this session before isn't analysed again.
    transform: text is prepared, and the next request's strings that hold it get the safe text instead.
    approve: text is let through in the next request.
    request: payload (JSON) takes what transform or approve left behind, once, whether or not it fits: REPLACED with the new
    payload, ALLOW if it holds the approved text, else CHECK, which calls for an inspection of its own.
    """

    def __init__(self, ttl_ms: int, inspect: Callable[[str], tuple[str, str | None]]):
        self.ttl_ms, self.inspect = ttl_ms, inspect

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.allowed = handle.getMapState("allowed", "digest string", "seen boolean", self.ttl_ms)
        self.pending = handle.getValueState("pending", "source string, safe string", self.ttl_ms)
        self.approved = handle.getValueState("approved", "text string", self.ttl_ms)

    def _looked_at(self, text: str) -> tuple[str, str | None, bool]:
        digest = (hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),)
        if self.allowed.containsKey(digest):
            return "ALLOW", text, False
        outcome, safe = self.inspect(text)
        if outcome == "ALLOW":
            self.allowed.updateValue(digest, (True,))
        return outcome, safe, True

    def _taken(self, payload: str | None) -> tuple[str, str | None]:
        pending = self.pending.get() if self.pending.exists() else None
        approved = self.approved.get()[0] if self.approved.exists() else None
        self.pending.clear()
        self.approved.clear()
        try:
            tree = json.loads(payload)
        except (TypeError, ValueError, RecursionError):
            return "BLOCK", None
        if pending:
            new, n = replaced(tree, *pending)
            if n:
                return "REPLACED", json.dumps(new, ensure_ascii=False)
        if approved and replaced(tree, approved, "")[1]:
            return "ALLOW", payload
        return "CHECK", None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, op, text, payload in zip(events["seq"], events["op"], events["text"], events["payload"], strict=True):
            outcome, given, analysed = "BLOCK", None, False
            if op in ("inspect", "transform") and text is not None:
                outcome, safe, analysed = self._looked_at(text)
                if op == "transform" and text and outcome in ("REDACTED", "PSEUDONYMIZED"):
                    self.pending.update((text, safe))
            elif op == "approve" and text:
                self.approved.update((text,))
                outcome = "ALLOW"
            elif op == "request":
                outcome, given = self._taken(payload)
            out.append((key[0], seq, op, outcome, given, analysed))
        yield pd.DataFrame(out, columns=["session", "seq", "op", "outcome", "payload", "analysed"])

    def close(self) -> None:
        pass


def memo(events: DataFrame, ttl_ms: int = 3_600_000, inspect: Callable[[str], tuple[str, str | None]] = prepared) -> DataFrame:
    """A stream of outcomes for events of sessions; what a session remembers goes ttl_ms after it was put there. Only digests
    of texts that were let through are kept. inspect(text) gives (outcome, safe text). Needs the RocksDB state store."""
    return events.groupBy("session").transformWithStateInPandas(Memo(ttl_ms, inspect), OUTPUT, "Append", "ProcessingTime")
