"""Directly-follows steps of an event stream, in the order of the events' times whatever the order of their arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "last string, latest long, times array<long>, ties array<long>, labels array<string>"


def follows_stream(events: DataFrame, case: str, activity: str, time: str, delay: str = "1 hour", tie: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """(kind, source, target) of a streaming ``events``: a start or an edge for each event, and an end for each case.

    An event waits in its case's state until the watermark, ``delay`` behind the latest time seen, has passed it: by then
    all that comes before it is there. Events of a case are ordered by time, then by the number ``tie``, then by label.
    Events that come when the watermark has passed them are dropped. A case whose last event the watermark has passed by ``idle_ms``
    ends, and its state goes; the state of a case thus holds the events of ``delay`` at most.
    """
    rows = events.select(F.col(case).cast("string").alias("case_id"), F.col(activity).cast("string").alias("activity"), F.col(time).cast("timestamp").alias("at"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie")).withWatermark("at", delay)
    rows = rows.select("case_id", "activity", "at", F.unix_millis("at").alias("ms"), "tie")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, latest, *waiting = state.get if state.exists else (None, 0, [], [], [])
        passed = state.getCurrentWatermarkMs()
        held = list(zip(*waiting, strict=True))
        for frame in frames:
            held += [e for e in zip(frame["ms"].tolist(), frame["tie"].tolist(), frame["activity"].tolist(), strict=True) if e[0] > passed]
        held.sort(key=lambda e: (e[0], e[1], e[2] or ""))
        out = []
        ready = sum(e[0] <= passed for e in held)
        for ms, _, label in held[:ready]:
            out.append(("start", None, label) if last is None else ("edge", last, label))
            last, latest = label, ms
        held = held[ready:]
        if not held and (last is None or passed >= latest + idle_ms):
            if last is not None:
                out.append(("end", last, None))
            if state.exists:
                state.remove()
        else:
            state.update((last, latest, [e[0] for e in held], [e[1] for e in held], [e[2] for e in held]))
            state.setTimeoutTimestamp(max(passed + 1, held[0][0] if held else latest + idle_ms))
        if out:
            yield pd.DataFrame(out, columns=["kind", "source", "target"])

    return rows.groupBy("case_id").applyInPandasWithState(step, "kind string, source string, target string", _STATE, "append", "EventTimeTimeout")


def follows_counts(steps: DataFrame) -> DataFrame:
    """(kind, source, target, weight): the graph so far of the steps that a stream has given, as a table or a stream."""
    return steps.groupBy("kind", "source", "target").agg(F.count("*").alias("weight"))
