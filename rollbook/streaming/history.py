"""Bounded chat history per session as keyed state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollbook import fixed_values as fv

OUTPUT = "session_id string, turn long, history string"
STATE = "turns array<long>, lines array<string>"


def session_history_stream(
    messages: DataFrame, n: int = fv.HISTORY_EXCHANGES, watermark: str = "10 minutes", keep_minutes: int | None = None
) -> DataFrame:
    """(session_id, turn, history) after every batch that touches a session.

    `messages` needs session_id (string), turn, role, content and an event time `ts`. State holds the last 2n lines of
    a session and is kept for ever, so late messages count and a resumed session goes on. With `keep_minutes` it is dropped
    when the watermark passes the session's last message by that time. Every Arrow batch is cut to the last 2n messages
    per session before the shuffle, so a busy session does not flood its task.
    """
    size = 2 * n

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, lines = state.get if state.exists else ([], [])
        kept = list(zip(turns, lines))
        newest = None
        for batch in batches:
            rows = zip(batch["turn"], batch["role"].str.title() + ": " + batch["content"])
            kept = heapq.nlargest(size, [*kept, *((int(t), line) for t, line in rows)])
            top = batch["ts"].max()
            newest = top if newest is None else max(newest, top)
        kept.sort()
        state.update(([t for t, _ in kept], [line for _, line in kept]))
        if keep_minutes is not None:
            expiry = int(newest.timestamp() * 1000) + keep_minutes * 60_000
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"session_id": [key[0]], "turn": [kept[-1][0]], "history": ["\n".join(line for _, line in kept)]}
        )

    def latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last = batch.sort_values("turn", kind="stable").groupby("session_id").tail(size)
            # the newest message keeps the newest time of its session, which drives watermark and expiry
            newest = batch.groupby("session_id")["ts"].max()
            is_last = ~last["session_id"].duplicated(keep="last")
            yield last.assign(ts=last["ts"].where(~is_last, last["session_id"].map(newest)))

    columns = messages.select("session_id", "turn", "role", "content", "ts")
    reduced = columns.mapInPandas(latest, columns.schema)
    if keep_minutes is None:
        timeout = GroupStateTimeout.NoTimeout
    else:
        reduced, timeout = reduced.withWatermark("ts", watermark), GroupStateTimeout.EventTimeTimeout
    return reduced.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "update", timeout)
