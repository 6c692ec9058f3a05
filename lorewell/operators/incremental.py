"""Incremental ingestion: line watermarks per session, the gate that defers small deltas, and delta numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE_MS, MIN_LINES = 120_000, 30


def watermarks(deltas: DataFrame) -> DataFrame:
    """(session_id, processed_lines, n_deltas): how far each session has been read."""
    return deltas.where("session_id is not null").groupBy("session_id").agg(F.max("line_end").alias("processed_lines"), F.countDistinct("delta_number").alias("n_deltas"))


def pending(messages: DataFrame, marks: DataFrame, idle_ms: int = IDLE_MS, min_lines: int = MIN_LINES, now_ms: int | None = None) -> DataFrame:
    """(session_id, line_start, line_end, new_lines, delta_number, decision): what each session has beyond its mark.

    ``process`` if the session has new lines and passes the gate; ``deferred_busy`` if it was written to less
    than ``idle_ms`` ago; ``deferred_small`` if there are fewer than ``min_lines``; ``unchanged`` at the mark;
    ``truncated`` if the source is shorter than the mark, which asks for a full reading. 0 switches a condition
    off; without ``now_ms`` the time of the last ingestion of all counts as now.
    """
    ends = messages.where("session_id is not null").groupBy("session_id").agg((F.max("line_no") + 1).alias("total"), F.max(F.unix_millis("ingested_at")).alias("last_ms"))
    now = F.lit(now_ms) if now_ms is not None else F.col("now_ms")
    if now_ms is None:
        ends = ends.crossJoin(ends.agg(F.max("last_ms").alias("now_ms")))  # one row
    j = ends.join(marks, "session_id", "left")
    mark = F.coalesce("processed_lines", F.lit(0))
    new = F.col("total") - mark
    decision = (
        F.when(new < 0, "truncated").when(new == 0, "unchanged")
        .when((F.lit(idle_ms) > 0) & (now - F.col("last_ms") < idle_ms), "deferred_busy").when((F.lit(min_lines) > 0) & (new < min_lines), "deferred_small").otherwise("process")
    )
    start = F.when(new < 0, 0).otherwise(mark)
    return j.select("session_id", start.cast("long").alias("line_start"), F.col("total").alias("line_end"), F.greatest(new, F.lit(0)).alias("new_lines"), (F.coalesce("n_deltas", F.lit(0)) + 1).alias("delta_number"), decision.alias("decision"))


def advanced(marks: DataFrame, done: DataFrame) -> DataFrame:
    """The marks after deltas were processed: (session_id, processed_lines, n_deltas). Applying the same deltas again changes nothing."""
    both = marks.select("session_id", "processed_lines", "n_deltas").unionByName(done.where("decision in ('process', 'truncated')").select("session_id", F.col("line_end").alias("processed_lines"), F.col("delta_number").alias("n_deltas")))
    return both.groupBy("session_id").agg(F.max_by("processed_lines", "n_deltas").alias("processed_lines"), F.max("n_deltas").alias("n_deltas"))


def without(refs: DataFrame, processed: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows that have not been processed."""
    return refs.join(processed.select(key).distinct(), key, "left_anti")
