"""The streaming twins: feedback events as they arrive, and event-time aggregates with late data dropped.

The batch operators state the meaning; tests hold the streams against them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "payload string, seen int"
_OUT = "idempotency_key string, feedback_id string, payload string, event_index long, result string"


def idempotent(events: DataFrame) -> DataFrame:
    """events: idempotency_key, feedback_id, payload, event_index. Per key the first payload is accepted, the same again is
    a duplicate, another one a conflict. State is one digest per key."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        seen = state.get[1] if state.exists else 0
        out = []
        for row in pd.concat(list(batches)).sort_values("event_index").to_dict("records"):
            if known is None:
                known, result = row["payload"], "accepted"
            else:
                result = "duplicate" if row["payload"] == known else "idempotency_payload_conflict"
            seen += 1
            out.append({"idempotency_key": key[0], "feedback_id": row["feedback_id"], "payload": row["payload"], "event_index": row["event_index"], "result": result})
        state.update((known, seen))
        yield pd.DataFrame(out, columns=["idempotency_key", "feedback_id", "payload", "event_index", "result"])

    return events.groupBy("idempotency_key").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def conflict_keys(events: DataFrame) -> DataFrame:
    """events: card_id, card_version, field, after, event_index. Emits an event whose value differs from the first value
    that its card version and field had."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("event_index").to_dict("records"):
            value = "\u0000null" if row["after"] is None else row["after"]
            if first is None:
                first = value
            elif value != first:
                out.append({"card_id": key[0], "card_version": key[1], "field": key[2], "event_index": row["event_index"]})
        state.update((first,))
        yield pd.DataFrame(out, columns=["card_id", "card_version", "field", "event_index"]).astype({"event_index": "int64"})

    return events.groupBy("card_id", "card_version", "field").applyInPandasWithState(step, "card_id string, card_version string, field string, event_index long", "first string", "append", "NoTimeout")


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and keys; events later than ``late`` behind the newest are dropped. On a batch
    the watermark has no effect."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def append_to_journal(accepted: DataFrame, path: str, checkpoint: str):
    """The append-only journal: each micro-batch is written under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return accepted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
