"""Streaming forms of the animation recorder: first record of a key, start and end together, two channels, running counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keep_first(stream: DataFrame, key: Sequence[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first record of each key, as records arrive. With a time column, state is kept as long as records may be late."""
    if time is None:
        return stream.dropDuplicates(list(key))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def numbered_first(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, order): of each key the record with the smallest order seen up to now, given out when it changes.

    For update mode: what a micro-batch gives out replaces the rows of its
    keys. State is one record for each key, so it grows with the keys.
    """
    kind = {c: stream.schema[c].dataType.simpleString() for c in (key, value, order)}
    schema = f"{key} {kind[key]}, {value} {kind[value]}, `{order}` {kind[order]}"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for part in parts:
            for v, o in zip(part[value].tolist(), part[order].tolist(), strict=True):
                if best is None or o < best[1]:
                    best = (v, o)
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[0]], order: [best[1]]})

    return stream.groupBy(key).applyInPandasWithState(step, schema, f"v {kind[value]}, o {kind[order]}", "update", GroupStateTimeout.NoTimeout)


def merged_channels(stream: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., channel, n): of two channels, events win over polling for a key. stream has a column channel (event or poll)."""
    best = F.min_by("channel", F.when(F.col("channel") == "event", 0).otherwise(1))
    return stream.groupBy(*key).agg(best.alias("channel"), F.count("*").alias("n"))


def first_of_visit(stream: DataFrame, key: Sequence[str], value: str, order: str, time: str, gap: str, delay: str) -> DataFrame:
    """(key..., begins, ends, value, n): of each visit of a key, the value of the record with the smallest order, and how many records it has.

    A visit ends when no record of its key comes for a gap of time. Then it is
    given out, once, and its state goes: what is held is one record for each
    visit that is still open. Records that come later than `delay` behind the
    newest one are dropped if their visit has ended.
    """
    visit = F.session_window(time, gap).alias("visit")
    first = stream.withWatermark(time, delay).groupBy(*key, visit).agg(F.min_by(value, order).alias(value), F.count("*").alias("n"))
    return first.select(*key, F.col("visit.start").alias("begins"), F.col("visit.end").alias("ends"), value, "n")


def with_ends(starts: DataFrame, ends: DataFrame, key: Sequence[str], within: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Starts with each end of their key that follows within a time, or without one once none can come any more. Both have a column ts, ends a column to.

    Each side is kept until the newest records of both are so far ahead that
    nothing can match it any more, allowing for records that come `delay` late
    (as long as `within`, if not given).
    """
    late = delay or within
    s = starts.withWatermark("ts", late).alias("s")
    e = ends.select(*[F.col(k).alias(f"e_{k}") for k in key], F.col("ts").alias("e_ts"), F.col("to").alias("e_to")).withWatermark("e_ts", late)
    on = [F.col(f"s.{k}") == F.col(f"e_{k}") for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return s.join(e, cond & (F.col("e_ts") >= F.col("s.ts")) & (F.col("e_ts") <= F.col("s.ts") + F.expr(f"interval {within}")), "leftOuter").drop(*[f"e_{k}" for k in key])


def timed(stream: DataFrame, duration: str = "duration") -> DataFrame:
    """Records that take time; how many don't is observed as `dropped`."""
    return stream.observe("recorder", F.count_if(F.coalesce(F.col(duration), F.lit(0)) == 0).alias("dropped")).where(F.coalesce(F.col(duration), F.lit(0)) != 0)


def running_counts(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts since the start, for complete mode."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def replay(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there now into a table in memory, and ends."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
