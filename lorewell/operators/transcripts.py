"""Message rows turned into episodes: description, status, result and tool steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.operators.prefix import running

RUN = 1024
# Fixed spellings of roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "gemini": "assistant", "tool_use": "tool_use", "tool_result": "tool_result", "system": "system"}


def normal_role(role: Column) -> Column:
    """The role behind a spelling; an unknown or missing one is the assistant."""
    r = F.lower(F.trim(role))
    out = None
    for spelled, known in ROLES.items():
        out = F.when(r == spelled, known) if out is None else out.when(r == spelled, known)
    return out.otherwise("assistant")


def delivered(messages: DataFrame) -> DataFrame:
    """One row per (session_id, seq): the first delivery, roles normalised."""
    first = F.min_by(F.struct(normal_role(F.col("role")).alias("role"), "content", "tool_name", "tool_input", "tool_output", "ts", "line_no"), F.struct("ingested_at", "message_id"))
    return messages.where("session_id is not null and seq is not null").groupBy("session_id", "seq").agg(first.alias("m")).select("session_id", "seq", "m.*")


def _has_error(text: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("error"))


def session_episodes(rows: DataFrame) -> DataFrame:
    """One episode per session that has a user message: description, status, result and counts. Input: ``delivered``."""
    user, said = F.col("role") == "user", F.col("role") == "assistant"
    back = F.col("role") == "tool_result"
    body = F.coalesce("tool_output", "content")
    g = rows.groupBy("session_id").agg(
        F.min_by(F.when(user, F.col("content")), F.when(user & F.col("content").isNotNull(), F.col("seq"))).alias("first_user"),
        F.max_by(F.when(said, F.col("content")), F.when(said & F.col("content").isNotNull(), F.col("seq"))).alias("last_said"),
        F.count_if(said).alias("n_said"), F.count_if(back).alias("n_results"), F.count_if(back & _has_error(body)).alias("n_errors"),
        F.count_if(F.col("role") == "tool_use").alias("n_steps"), F.count("*").alias("n_messages"),
    )
    low = F.lower(F.coalesce("last_said", F.lit("")))
    status = (
        F.when(F.col("n_said") == 0, "partial").when(F.contains(low, F.lit("error")) | F.contains(low, F.lit("failed")), "partial")
        .when((F.col("n_results") > 0) & (F.col("n_errors") > F.col("n_results") * 0.5), "partial").otherwise("success")
    )
    return g.where("first_user is not null and first_user <> ''").select(
        "session_id", F.left("first_user", F.lit(500)).alias("description"), status.alias("status"), F.left(F.coalesce("last_said", F.lit("")), F.lit(1000)).alias("result"), "n_steps", "n_messages"
    )


def steps(rows: DataFrame) -> DataFrame:
    """(session_id, step_no, action, output, error) of every tool call, from 0; a session without calls has one step ``conversation``. Input: ``delivered``.

    A result belongs to the call before it; the last result of a call is kept, and the last error of it. Results
    before the first call belong to none. The number of a call is a running count over stretches of ``RUN``
    messages, so a long session is spread over many tasks.
    """
    tool = rows.where("role in ('tool_use', 'tool_result')")
    numbered = running(tool, ["session_id"], F.floor(F.col("seq") / RUN), ["seq"], step=F.when(F.col("role") == "tool_use", 1).otherwise(0)).where("step > 0")
    body = F.coalesce("tool_output", "content")
    back = F.col("role") == "tool_result"
    called = numbered.groupBy("session_id", (F.col("step") - 1).alias("step_no")).agg(
        F.max(F.when(~back, F.coalesce("tool_name", "content"))).alias("action"),
        F.max_by(F.when(back, body), F.when(back, F.col("seq"))).alias("output"),
        F.max_by(F.left(body, F.lit(200)), F.when(back & _has_error(body), F.col("seq"))).alias("error"),
    )
    null = F.lit(None).cast("string")
    silent = rows.groupBy("session_id").agg(F.count_if(F.col("role") == "tool_use").alias("calls")).where("calls = 0")
    return called.unionByName(silent.select("session_id", F.lit(0).cast("long").alias("step_no"), F.lit("conversation").alias("action"), null.alias("output"), null.alias("error")))


def delta_episodes(deltas: DataFrame, rows: DataFrame, lines: int = 256) -> DataFrame:
    """One episode per delta: (session_id, delta_number, line_start, line_end, description, status, result, n_steps, n_messages). Input: ``delivered``.

    The description is the delta's first user message, else a continuation of its session. Deltas and messages meet
    by session and run of ``lines`` lines. Repeated rows of a delta count once; a delta without messages is left out.
    """
    keys = ["session_id", "delta_number", "line_start", "line_end"]
    d = deltas.select(*keys).where("session_id is not null and delta_number is not null and line_end > line_start").distinct()
    d = d.select("*", F.explode(F.sequence(F.floor(F.col("line_start") / lines), F.floor((F.col("line_end") - 1) / lines))).alias("run"))
    met = d.join(rows.withColumn("run", F.floor(F.col("line_no") / lines)), ["session_id", "run"]).where("line_no >= line_start and line_no < line_end")
    user, said, back = F.col("role") == "user", F.col("role") == "assistant", F.col("role") == "tool_result"
    g = met.groupBy(*keys).agg(
        F.min_by(F.coalesce("content", F.lit("")), F.when(user, F.col("seq"))).alias("first_user"), F.count_if(user).alias("n_user"),
        F.max_by(F.when(said, F.col("content")), F.when(said & F.col("content").isNotNull(), F.col("seq"))).alias("last_said"), F.count_if(said).alias("n_said"),
        F.count_if(back).alias("n_results"), F.count_if(back & _has_error(F.coalesce("tool_output", "content"))).alias("n_errors"), F.count_if(F.col("role") == "tool_use").alias("n_steps"), F.count("*").alias("n_messages"),
    )
    low = F.lower(F.coalesce("last_said", F.lit("")))
    status = (
        F.when(F.col("n_said") == 0, "partial").when(F.contains(low, F.lit("error")) | F.contains(low, F.lit("failed")), "partial")
        .when((F.col("n_results") > 0) & (F.col("n_errors") > F.col("n_results") * 0.5), "partial").otherwise("success")
    )
    going_on = F.concat(F.lit("<continuation of session "), "session_id", F.lit(", delta "), F.col("delta_number").cast("string"), F.lit(">"))
    return g.select(*keys, F.when(F.col("n_user") > 0, F.left("first_user", F.lit(500))).otherwise(going_on).alias("description"), status.alias("status"), F.left(F.coalesce("last_said", F.lit("")), F.lit(1000)).alias("result"), "n_steps", "n_messages")
