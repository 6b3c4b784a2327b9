"""Structured Streaming forms of the bounded event state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.usage import COUNTERS


def daily_counts(events: DataFrame, watermark: str = "30 days") -> DataFrame:
    """day, name, n of a stream (ts timestamp, name). State is kept for the watermark: calendar days, whereas
    the batch form keeps the newest days that have entries."""
    known = events.withWatermark("ts", watermark).filter(F.col("name").isin(*COUNTERS))
    out = known.groupBy(F.window("ts", "1 day"), "name").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("window.start").alias("day"), "name", "n")


def error_bursts(events: DataFrame, least: int = 3, seconds: int = 10) -> DataFrame:
    """Sliding windows of a stream with at least `least` errors."""
    errors = events.filter("name = 'error'").withWatermark("ts", f"{2 * seconds} seconds")
    out = errors.groupBy(F.window("ts", f"{seconds} seconds", "1 second")).agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least).select("window.start", "window.end", "n")


def live_votes(reads: DataFrame, window_ms: int = 1600, most: int = 4) -> DataFrame:
    """scan_id, read, votes of the winner after each arrival: reads (scan_id, read, at_ms, cas array, names array, conf;
    rejected ones are no reads) of the last window_ms, at most `most`, vote by the rule of the batch form
    (mining.votes): a common identifier if both have some, else a common name or one (6 letters at least) inside the
    other. State is a scan's window, as JSON, dropped when nothing came for a minute."""
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def agree(x: list, y: list) -> bool:
        if x[0] == y[0]:
            return True
        if x[2] and y[2]:
            return not set(x[2]).isdisjoint(y[2])
        inside = any(len(v) >= 6 <= len(w) and (v in w or w in v) for v in x[3] for w in y[3])
        return inside or not set(x[3]).isdisjoint(y[3])

    def some(x) -> list[str]:
        return [] if x is None else list(x)

    def vote(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in parts:
            held += [[int(x.read), int(x.at_ms), some(x.cas), some(x.names), float(x.conf or 0)] for x in pdf.sort_values("at_ms").itertuples()]
        held.sort(key=lambda x: x[1])
        held = [x for x in held if held[-1][1] - x[1] < window_ms][-most:]
        state.update((json.dumps(held),))
        state.setTimeoutDuration(60_000)
        count = [sum(agree(x, y) for y in held) for x in held]
        best = max(range(len(held)), key=lambda k: (count[k], held[k][4] * min(count[k], 12), -k))
        yield pd.DataFrame({"scan_id": [key[0]], "read": [held[best][0]], "votes": [count[best]]})

    return reads.groupBy("scan_id").applyInPandasWithState(
        vote, "scan_id long, read long, votes long", "held string", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
