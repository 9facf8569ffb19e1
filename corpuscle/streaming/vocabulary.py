"""The vocabulary's state machine on a stream of events: the same transition as in the batch, over stored state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscle.operators.vocabulary import STATE, Settings, _frame, fold_event


def stream_vocabulary(events: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The changed states of each micro-batch (update mode) from events (key, kind, at, seq, form, chapter, status, gloss).

    State is kept per key as one JSON value, so it is as large as one word's record. Events of one key in a micro-batch
    are applied in order of (at, seq).
    """
    settings = settings or Settings()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for event in rows.to_dict("records"):
            now = fold_event(now, {k: None if isinstance(v, float) and v != v else v for k, v in event.items()}, settings)
        if now is not None:
            state.update((json.dumps(now),))
            yield _frame([now])

    return events.where("key is not null").groupBy("key").applyInPandasWithState(update, STATE, "json string", "update", GroupStateTimeout.NoTimeout)


def stream_progress(visits: DataFrame) -> DataFrame:
    """Chapter progress as a streaming aggregation (complete or update mode)."""
    return visits.groupBy("book", "ch").agg(F.bool_or("done").alias("done"), F.count_if(~F.col("done")).alias("visits"), F.max("at").alias("last_at"))


def once_per_visit(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key, forgotten after the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def write_then_notify(stream: DataFrame, write: Callable[[DataFrame], None], notify: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Write each micro-batch, and only once that has succeeded say so: notify gets the batch's number.

    A batch that is run again after a failure is written and told again, so both must bear that.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(rows)
        notify(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update").start()
