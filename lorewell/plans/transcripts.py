"""Queries that write the project's messages in each transcript dialect and parse them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators.transcripts import delivered
from lorewell.sources import dialects
from lorewell.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLUMNS = "session_id, seq AS line_no, {role} AS role, {content} AS content, {name} AS tool_name, {input} AS tool_input, {output} AS tool_output, '2026-01-01T00:00:00.000Z' AS ts"
_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' ELSE 'assistant' END"
_SAID = f"SELECT DISTINCT {_COLUMNS.format(role=_ROLE, content='content', name='NULL', input='NULL', output='NULL')} FROM messages WHERE lower(trim(role)) IN ('user', 'human', 'assistant', 'model', 'ai', 'gemini') AND content <> ''"
_CALLS = f"SELECT DISTINCT {_COLUMNS.format(role='lower(trim(role))', content='{0}', name='{0}', input='tool_input', output='NULL')} FROM messages WHERE lower(trim(role)) = 'tool_use'"
_BACK = "SELECT DISTINCT " + _COLUMNS.format(role="lower(trim(role))", content="''", name="NULL", input="NULL", output="tool_output") + " FROM messages WHERE lower(trim(role)) = 'tool_result'"


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _rows(spark, d):
    return delivered(table(spark, d, "messages")).withColumn("path", F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")))


def _out(df):
    return df.select("session_id", F.col("line_no").cast("long").alias("line_no"), "role", "content", "tool_name", "tool_input", "tool_output", "ts")


@_query(f"{_SAID} UNION ALL {_CALLS.format('coalesce(tool_name, ' + chr(39) * 2 + ')')} UNION ALL {_BACK}")
def dialect_a_parsed(spark, d):
    """SRC-02, PRJ-01, PRJ-02, PRJ-03: dialect A."""
    block = F.when(F.col("role") == "tool_use", F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), F.coalesce("tool_name", F.lit("")).alias("name"), F.col("tool_input").alias("input")))))
    block = block.when(F.col("role") == "tool_result", F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("tool_output").alias("content")))))
    block = block.otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))))
    line = F.concat(F.lit('{"type":"'), F.when(F.col("role") == "user", "user").otherwise("assistant"), F.lit('","timestamp":"2026-01-01T00:00:00.000Z","message":{"content":'), block, F.lit("}}"))
    lines = _rows(spark, d).where("role <> 'system'").select("path", F.col("seq").alias("line_no"), line.alias("value"))
    return _out(dialects.parse_a(lines))


@_query(f"{_SAID} UNION ALL {_CALLS.format('tool_name')} UNION ALL {_BACK}")
def dialect_b_parsed(spark, d):
    """SRC-07, PRJ-04, PRJ-06: dialect B."""
    kind = F.when(F.col("role") == "tool_use", "function_call").when(F.col("role") == "tool_result", "function_call_output").otherwise("message")
    payload = F.struct(kind.alias("type"), F.when(kind == "message", F.col("role")).alias("role"), F.when(kind == "message", F.col("content")).alias("content"), F.col("tool_name").alias("name"), F.col("tool_input").alias("arguments"), F.col("tool_output").alias("output"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.lit(1767225600).alias("timestamp"), payload.alias("payload")))
    lines = _rows(spark, d).where("role <> 'system'").select(F.concat(F.lit("/logs/"), F.regexp_replace("session_id", "-", "_"), F.lit(".jsonl")).alias("path"), F.col("seq").alias("line_no"), line.alias("value"), F.col("session_id").alias("sid"))
    parsed = dialects.parse_b(lines.select("path", "line_no", "value"))
    return _out(parsed.withColumn("session_id", F.regexp_replace("session_id", "_", "-")))


@_query(_SAID)
def dialect_d_parsed(spark, d):
    """SRC-13, PRJ-05, PRJ-07: dialect D, nested and flat by turns."""
    flat, nested = F.to_json(F.struct("role", "content", F.lit(1767225600000).alias("ts"))), F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", "content").alias("message"), F.lit("2026-01-01T00:00:00.000Z").alias("timestamp")))
    lines = _rows(spark, d).where("role in ('user', 'assistant')").select("path", F.col("seq").alias("line_no"), F.when(F.col("seq") % 2 == 0, flat).otherwise(nested).alias("value"))
    return _out(dialects.parse_d(lines))


@_query(_SAID)
def dialect_c_parsed(spark, d):
    """SRC-10, PRJ-05: dialect C, one document for each stretch of a session (a whole session is one document only where it is small)."""
    one = F.struct(F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), "content", F.lit("2026-01-01T00:00:00.000Z").alias("timestamp"))
    rows = _rows(spark, d).where("role in ('user', 'assistant') and content <> ''").select("session_id", "seq", F.floor(F.col("seq") / 256).alias("part"), one.alias("m"))
    docs = rows.groupBy("session_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "m"))).alias("x"))
    text = F.to_json(F.struct(F.concat("session_id", F.lit("#"), F.to_json(F.transform("x", lambda e: e["seq"]))).alias("sessionId"), F.transform("x", lambda e: e["m"]).alias("messages")))
    parsed = dialects.parse_c(docs.select(F.lit("/tmp/p/chats/x.json").alias("path"), text.alias("value")))
    # The document's name carries the numbers of its messages, by which lines are counted over the session again.
    at = F.from_json(F.substring_index("session_id", "#", -1), "array<long>")
    return _out(parsed.withColumn("line_no", F.get(at, F.col("line_no"))).withColumn("session_id", F.substring_index("session_id", "#", 1)))
