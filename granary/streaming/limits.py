"""Streams: an accept-or-reject rate limit, windows of events, stale jobs and resumable chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.fold import Step, folded

#: Seconds of the window of the rate limit, and requests that it lets through.
WINDOW_S, LIMIT = 60, 10
#: Requests in a window that each group of routes lets through; other groups count as default.
LIMITS = {"uploads": 20, "classify": 10, "exports": 30, "compute": 5, "default": 200}
#: Rows of one key that a batch may hold beside its state: state is as long as the limit.
ACCEPTED = "key string, event_id long, ts timestamp, accepted boolean"


def admit(times: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool]:
    """Accepted times after one more request, and whether it was accepted; only accepted ones count."""
    times = [t for t in times if t > now - window]
    return (times + [now], True) if len(times) < limit else (times, False)


def rate_limited(events: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """key, event_id, ts, accepted for a stream of (key, event_id, ts): acceptance depends on what was accepted before.

    Idle keys are forgotten after ten windows.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        accepted = []
        for now in rows["ts"].map(pd.Timestamp.timestamp):
            times, ok = admit(times, now, limit, window_s)
            accepted.append(ok)
        state.update((times,))
        state.setTimeoutDuration(10 * window_s * 1000)
        yield rows.assign(accepted=accepted)[["key", "event_id", "ts", "accepted"]]

    return events.groupBy("key").applyInPandasWithState(work, ACCEPTED, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def route_group(method: Column, path: Column) -> Column:
    """The group that limits a request; null for those that are never limited."""
    method, tail = F.upper(method), F.regexp_replace(path, "^.*?/api/v1", "")
    ends = lambda *names: F.rlike(tail, F.lit("(" + "|".join(names) + ")$"))
    post, get = method == "POST", method == "GET"
    return (
        F.when(method == "OPTIONS", None)
        .when(post & ends("/uploads", "/uploads/prepare", "/ingest", "/jobs/validate", "/wwf-ingredients/upload"), "uploads")
        .when(post & ends("/classify"), "classify")
        .when((post & ends("/jobs/export")) | (get & ends("/export")), "exports")
        .when((post & (ends("/jobs/calculate") | (ends("/run") & tail.contains("/scenarios/")))) | (get & ends("/comparisons")), "compute")
        .otherwise("default")
    )


def limit_step(limits: dict[str, int], window_s: int) -> Step:
    """A request of a group at a time in microseconds; the state holds the times that were accepted within the window."""

    def step(times: list[int], event: dict) -> tuple[list[int], tuple]:
        begin = event["at"] - window_s * 1_000_000
        times = [t for t in times if t > begin]
        if len(times) < limits.get(event["group"], limits.get("default", LIMITS["default"])):
            return [*times, event["at"]], (True, 0)
        return times, (False, (times[0] - begin) // 1_000_000 + 1 if times else window_s)

    return step


def limited(requests: DataFrame, order: list[str], limits: dict[str, int] = LIMITS, window_s: int = WINDOW_S) -> DataFrame:
    """Add accepted and retry_after (whole seconds, 0 if accepted) to requests (key, group, at in microseconds): a sliding window for each key and group.

    Only accepted requests count, so each depends on those before it.
    """
    return folded(requests, ["key", "group"], order, [], limit_step(limits, window_s), "accepted boolean, retry_after long")


def limited_stream(requests: DataFrame, limits: dict[str, int] = LIMITS, window_s: int = WINDOW_S) -> DataFrame:
    """The same for a stream of (key, group, event_id, at); keys and groups without a request for a window are forgotten."""
    step = limit_step(limits, window_s)

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at in rows["at"]:
            times, found = step(times, {"group": key[1], "at": int(at)})
            out.append(found)
        state.update((times,))
        state.setTimeoutDuration(window_s * 1000)
        yield rows.assign(accepted=[x for x, _ in out], retry_after=[x for _, x in out])[["key", "group", "event_id", "at", "accepted", "retry_after"]]

    added = "key string, group string, event_id long, at long, accepted boolean, retry_after long"
    return requests.groupBy("key", "group").applyInPandasWithState(work, added, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and sums of value by window and keys; events later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def inactive_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions that end after a gap without events: jobs that went stale."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event for each key: an idempotency key that repeats within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def leases(claims: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """item, holder, expires, held: the last claim of each item."""
    last = claims.groupBy("item").agg(F.max_by(F.struct("holder", "ts"), F.struct("ts", "holder")).alias("x"))
    expires = F.col("x.ts") + F.expr(f"interval {minutes} minutes")
    return last.select("item", "x.holder", expires.alias("expires"), (expires > now).alias("held"))


def consume(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame], DataFrame], sink: str, query_name: str = "chunks"):
    """Start a stream that processes what is pending in chunks, goes on from its checkpoint after a stop, and writes each chunk once."""

    def chunk(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.queryName(query_name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(chunk).start()
