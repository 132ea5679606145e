"""The memory of running dialogues as a stateful stream, and windowed counts of events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.sources.tables import shared_folder

#: Facts a memory keeps, the first ones; fixed value.
FACTS = 12


def fold_turns(turns: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``dialogue_id, n_turns, facts, closed`` after each batch of a stream of turns (update mode).

    Turns have ``dialogue_id, turn_id, ts, role, text, facts``. They wait in the
    state until the watermark (``late`` behind the newest time) has passed them
    and are then taken in order of time and number, so order holds across
    batches; what comes later than that is dropped. A turn that repeats role and
    text of the one before counts once. A dialogue without a turn for
    ``idle_ms`` is closed and its state removed. The state holds the waiting
    turns, the last turn and the facts, so it stays small.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, role, text, facts, waiting, newest = state.get if state.exists else (0, None, None, [], "[]", 0)
        facts, pending = list(facts), json.loads(waiting)
        for b in batches:
            pending += [[int(ts.value // 1_000_000), int(k), r, t, [f for f in fs if f] if fs is not None else []] for ts, k, r, t, fs in zip(b["ts"], b["turn_id"], b["role"], b["text"], b["facts"])]
        passed = state.getCurrentWatermarkMs()
        pending.sort(key=lambda p: p[:2])
        while pending and pending[0][0] <= passed:
            at, _, r, t, said = pending.pop(0)
            newest = max(newest, at)
            if (r, t) == (role, text):
                continue
            n, role, text = n + 1, r, t
            facts += [f for f in dict.fromkeys(said) if f.strip() and f not in facts]
        facts = facts[:FACTS]
        closed = state.hasTimedOut and not pending
        if closed:
            state.remove()
        else:
            state.update((n, role, text, facts, json.dumps(pending), newest))
            state.setTimeoutTimestamp(max(passed + 1, pending[0][0] if pending else newest + idle_ms))
        yield pd.DataFrame({"dialogue_id": [key[0]], "n_turns": [n], "facts": [facts], "closed": [closed]})

    timed = turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("dialogue_id").applyInPandasWithState(
        step, "dialogue_id string, n_turns bigint, facts array<string>, closed boolean", "n bigint, role string, text string, facts array<string>, waiting string, newest bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` per window of event time; rows later than the watermark are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is exhausted, in append mode, as a table in the shared folder.

    Only windows that the watermark has closed are given, as in a running stream.
    """
    out = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def as_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A corpus table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
