"""Operators with state, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds that a page waits for its target.
DEADLINE_MS = 10_000


def wait_for_target(events: DataFrame, key: str, ts: str, matches: Column, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """key, started and found: the first match from the first event on until the deadline; null if none came."""
    start = events.groupBy(key).agg(F.min(ts).alias("started"))
    hits = events.where(matches).select(F.col(key).alias("_k"), F.col(ts).alias("_t"))
    inside = (F.col("_k") == F.col(key)) & (F.col("_t") <= F.col("started") + F.expr(f"INTERVAL {deadline_ms / 1000} SECONDS"))
    return start.join(hits, inside, "left").groupBy(key, "started").agg(F.min("_t").alias("found"))


def wait_for_target_stream(events: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """From a stream of key and matched: key and outcome, 'found' once on the first match, 'timeout' once if the
    deadline passes before; later events of a key change nothing. The deadline counts from the key's first batch and is
    part of its state, so events without a match do not put it off."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        done, until = state.get if state.exists else (False, now + deadline_ms)
        hit = not state.hasTimedOut and any([bool(p["matched"].any()) for p in parts])
        if done:
            return
        if hit and (now < until or not state.exists):
            outcome = "found"
        elif state.hasTimedOut or now >= until:
            outcome = "timeout"
        else:
            state.update((False, until))
            state.setTimeoutDuration(until - now)
            return
        state.update((True, until))
        yield pd.DataFrame({"key": [k[0]], "outcome": [outcome]})

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, outcome string", "done boolean, until long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The events whose value differs from the one before it of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1).withColumn("_before", before).where(
        F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))
    ).drop("_first", "_before")


def changes_stream(events: DataFrame) -> DataFrame:
    """From a stream of key, seq and value: the rows that differ from the state of their key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last = state.exists, state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, value in zip(rows["seq"], rows["value"], strict=True):
            if not known or value != last:
                out.append((k[0], seq, value))
            known, last = True, value
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "seq", "value"])

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, seq long, value string", "value string", "append", GroupStateTimeout.NoTimeout
    )


def target_status(target: Column, attached: Column) -> Column:
    """What a watcher says: a target found is 'ready'; none and the old one gone is 'waiting'; none and the old one
    still there is no change, null."""
    return F.when(target.isNotNull(), F.lit("ready")).when(~F.coalesce(attached, F.lit(False)), F.lit("waiting"))


def sessions(events: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """events with session: how many openings the key has had; 0 before the first. Sessions are told by their
    openings and not by gaps in time."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("session", F.sum(F.when(opens, 1).otherwise(0)).over(run))


def recording_states(events: DataFrame) -> DataFrame:
    """The state of a recording after each event: recording, transcribing, ready or fallback; idle before any."""
    state = (
        F.when(F.col("kind") == "start", "recording").when(F.col("kind") == "stop", "transcribing")
        .when(F.col("kind") == "transcript", "ready").when(F.col("kind") == "error", "fallback")
    )
    run = Window.partitionBy("recording_id").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("state", F.coalesce(F.last(state, ignorenulls=True).over(run), F.lit("idle")))


def last_write(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that arrived last; a late response overwrites an edit, as the order is that of arrival."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def once(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key."""
    first = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def start_once(starts: DataFrame, key: str) -> DataFrame:
    """Each key's start, whatever the number of starts: over a table, or over a stream, whose state has the keys."""
    return starts.select(key).dropDuplicates([key])


def coalesced_runs(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """key, run, started (seconds): runs that a watcher makes of events at `ts` (seconds from its own start, when it
    runs once): at most one runs and one waits, so any number of events during a run make one more. A fold over each
    key's events in order, in one pass with constant state."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, free, pending = [0.0], seconds, False
        for t in sorted(pdf[ts]):
            if pending and t >= free:
                starts.append(free)
                free, pending = free + seconds, False
            if t >= free:
                starts.append(float(t))
                free = t + seconds
            else:
                pending = True
        if pending:
            starts.append(free)
        return pd.DataFrame({key: pdf[key].iloc[0], "run": range(1, len(starts) + 1), "started": starts})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, ts).groupBy(key).applyInPandas(fold, f"{key} {kind}, run long, started double")


def rebuild_on_change(files: DataFrame, build, checkpoint: str):
    """A stream's micro-batches as coalesced runs: all that came in while one ran is the next one's batch."""
    named = files.where(F.coalesce(F.col("path"), F.lit("")) != "")
    return named.writeStream.foreachBatch(lambda df, n: build(df, n)).option("checkpointLocation", checkpoint)
