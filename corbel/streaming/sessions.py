"""Session event logs as streaming state: the latest events of each session, forgotten when it expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corbel.operators.state import EVENTS_PER_SESSION

OUTPUT = "session_id string, events int, last_id bigint, last_payload string, expired boolean"
STATE = "ids array<bigint>, payloads array<string>"


def session_log(events: DataFrame, keep: int = EVENTS_PER_SESSION, ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Per trigger and session with new events: how many of the latest ``keep`` are held, and the last one.

    ``events(session_id, id, payload, created_at)``. Events are ordered by id; repeated ids count once. A session
    without events for ``ttl`` of event time is forgotten and reported once as expired. State is bounded by ``keep`` rows
    a session.
    """
    span = pd.Timedelta(ttl)

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, payloads = state.get if state.exists else ([], [])
        held = dict(zip(ids, payloads, strict=True))
        if state.hasTimedOut:
            last = max(held, default=None)
            state.remove()
            yield pd.DataFrame([(key[0], len(held), last, held.get(last), True)], columns=["session_id", "events", "last_id", "last_payload", "expired"])
            return
        newest = None
        for f in frames:
            held.update(zip(f["id"].tolist(), f["payload"].tolist(), strict=True))
            top = f["created_at"].max()
            newest = top if newest is None or top > newest else newest
        latest = sorted(held)[-keep:]
        state.update((latest, [held[i] for i in latest]))
        ends = int((newest + span).timestamp() * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], len(latest), latest[-1], held[latest[-1]], False)], columns=["session_id", "events", "last_id", "last_payload", "expired"])

    stream = events.where(F.col("session_id").isNotNull() & F.col("id").isNotNull()).withWatermark("created_at", late)
    return stream.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
