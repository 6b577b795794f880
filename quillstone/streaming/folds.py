"""Structured Streaming counterparts of the batch folds over event logs.

Each takes and returns a streaming DataFrame; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def without_replays(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, though it may be delivered again within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by kind in tumbling windows; later events than ``late`` are not counted."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    counts = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def unclosed_starts(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Starts to which no outcome came within a time, by an outer join of two streams."""
    starts = events.where("event_type = 'signup'").withWatermark("ts", within).select(F.col("event_id").alias("start_id"), F.col("user_id").alias("start_user"), F.col("ts").alias("started_at"))
    ends = events.where("event_type in ('purchase', 'error')").withWatermark("ts", within).select("user_id", F.col("ts").alias("ended_at"), "event_type")
    near = (F.col("start_user") == F.col("user_id")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    return starts.join(ends, near, "leftOuter").where("user_id is null").select("start_id", "start_user", "started_at")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failing, repairs = state.get if state.exists else (False, 0)
    for batch in batches:
        for kind in batch.sort_values(["ts", "event_id"])["event_type"]:
            if kind == "error":
                failing = True
            elif kind == "purchase":
                repairs += failing
                failing = False
    state.update((failing, repairs))
    yield pd.DataFrame({"user_id": [key[0]], "n_repairs": [repairs]})


def repairs(events: DataFrame) -> DataFrame:
    """Failures later followed by a success, for each user, in the order of arrival; the state is two values a user."""
    return events.groupBy("user_id").applyInPandasWithState(_fold, "user_id long, n_repairs long", "failing boolean, repairs long", "update", GroupStateTimeout.NoTimeout)
