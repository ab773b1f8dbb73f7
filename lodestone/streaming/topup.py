"""Structured Streaming forms: idempotent top-up, windowed counts, question state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import tables


def top_up_stream(chunks: DataFrame, table: str, key: str, checkpoint: str):
    """Append a stream's new keys to a table; each micro-batch is an anti-join, so
    a batch that is replayed after a failure adds nothing twice."""

    def batch(rows: DataFrame, _batch_id: int) -> None:
        tables.top_up(rows.sparkSession, rows, table, key)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and event-time window; later ones than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def first_by_key(chunks: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def question_state(steps: DataFrame, max_steps: int = 5) -> DataFrame:
    """steps(qid, tool) -> qid, steps, done: a counter per question in the state store."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def advance(key, batches, state):
        n = state.get[0] if state.exists else 0
        n += sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"qid": [key[0]], "steps": [n], "done": [n >= max_steps]})

    return steps.groupBy("qid").applyInPandasWithState(advance, "qid long, steps long, done boolean", "n long", "update", GroupStateTimeout.NoTimeout)
