"""Stateful streams: sliding sessions, live grants, audit counts. Each also runs in batch through the same functions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_ttl(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sliding sessions of a stream (user_id, ts): closed once the watermark passes their end."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def audit_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per action and window; late ones beyond the watermark are dropped."""
    g = events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "action").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("from"), "action", "n")


GRANT = "doc_id bigint, recipient string, at timestamp, status string"


def _grant(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    doc, recipient = key
    live: Any = state.get[0] if state.exists else None  # epoch seconds of expiry, or none
    out = []
    if state.hasTimedOut:
        out.append((doc, recipient, pd.Timestamp(live, unit="s"), "expired"))
        live = None
    else:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        for at, action, ttl in zip(rows["at"], rows["action"], rows["ttl"]):
            if live is not None and live <= at.timestamp():
                out.append((doc, recipient, pd.Timestamp(live, unit="s"), "expired"))
                live = None
            if action == "issue":
                if live is not None:
                    out.append((doc, recipient, at, "replaced"))
                live = int(at.timestamp()) + int(ttl)
                out.append((doc, recipient, at, "issued"))
            elif action == "revoke" and live is not None:
                out.append((doc, recipient, at, "revoked"))
                live = None
    if live is None:
        if state.exists:
            state.remove()
    else:
        state.update((live,))
        state.setTimeoutTimestamp(max(live * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["doc_id", "recipient", "at", "status"])


def grants(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What happens to each (doc_id, recipient)'s one live grant in a stream (doc_id, recipient, action, at, seq, ttl)."""
    keyed = events.withWatermark("at", late).groupBy("doc_id", "recipient")
    return keyed.applyInPandasWithState(_grant, GRANT, "expires bigint", "append", GroupStateTimeout.EventTimeTimeout)


def admissions(requests: DataFrame, most: int, late: str = "10 minutes") -> DataFrame:
    """(store, request_id, issued) of a stream (store, request_id, at, seq, ttl), as operators.sharing.admit() gives in batch.

    A store's state is the ends of its live grants, `most` at most. Requests are judged in order of at and seq within a
    micro-batch and, across micro-batches, as they come; a timer drops the state of a store whose grants have all ended.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends = sorted(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"store": [], "request_id": [], "issued": []})
            return
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "seq", "request_id"])
        for name, at, ttl in zip(rows["request_id"], rows["at"], rows["ttl"]):
            now = at.value // 1000
            ends = [e for e in ends if e > now]
            if ok := len(ends) < most:
                ends.append(now + int(ttl) * 1_000_000)
            out.append((key[0], name, ok))
        state.update((ends,))
        state.setTimeoutTimestamp(max(max(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["store", "request_id", "issued"])

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    keyed = requests.withWatermark("at", late).groupBy("store")
    return keyed.applyInPandasWithState(judge, f"store {kinds['store']}, request_id {kinds['request_id']}, issued boolean", "ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
