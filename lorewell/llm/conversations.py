"""Ordered conversations with speaker roles, rebuilt from message rows.

Messages are sessionized by channel: ordered, cut where the channel was silent for longer than a gap calibrated
on the data, given roles, and dropped where replies are not reciprocal. Where rows name a session, that session
is the conversation: its ``seq`` is the order (clocks step back, rows arrive late), a silence does not end it, and
roles are the inferred spellings of the sources. Where there is only a channel, roles follow from who opened the
conversation.

A session or channel may hold a third of all rows, so nothing collects one. A session's rows are summarised in
runs of ``RUN`` numbers, those summaries in runs of ``RUN`` summaries, and so on for ``LEVELS`` levels, each row at
most ``RUN`` small values. A channel is cut into stretches of time of which only the ends meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators.prefix import running

RUN = 1024
#: Summaries of summaries: with four, a session of 10**12 messages has at most ``RUN`` values in any row.
LEVELS = 4
#: Seconds of a channel that are ordered in one task.
STRETCH_S = 600
# Fixed spellings of the roles, after trimming and ignoring case.
USER, ASSISTANT = ("user", "human"), ("assistant", "model", "ai", "gemini")
BLANK = r"^[\s\p{Z}\p{Cf}]*\z"


def role(column: str = "role") -> Column:
    """user, assistant, or the trimmed lower-case spelling; null stays null."""
    r = F.lower(F.trim(F.regexp_replace(F.col(column), r"[\s\p{Z}]+", " ")))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant").otherwise(r)


def is_blank(column: str = "content") -> Column:
    return F.col(column).isNull() | F.col(column).rlike(BLANK)


def session_state(messages: DataFrame) -> DataFrame:
    """(session_id, n, low, high, turns): one row per session that has messages.

    ``n`` counts distinct seq, ``turns`` is the string of each run's first and last speaker (U, A) with X if two
    user messages follow one another inside the run. Rows with a null session are left out; a null seq makes
    its session incomplete.
    """
    speaker = F.when(is_blank(), 0).when(role() == "user", 1).when(role() == "assistant", 2).otherwise(0).cast("tinyint")
    rows = messages.where("session_id is not null").select("session_id", F.coalesce("seq", F.lit(-1)).alias("seq"), speaker.alias("who"))
    runs = rows.groupBy("session_id", F.floor(F.col("seq") / RUN).alias("run")).agg(F.sort_array(F.collect_set(F.struct("seq", "who"))).alias("x"))
    turns = F.concat_ws("", F.transform(F.filter("x", lambda e: e["who"] > 0), lambda e: F.when(e["who"] == 1, "U").otherwise("A")))
    runs = runs.select(
        "session_id", "run", F.size(F.array_distinct(F.transform("x", lambda e: e["seq"]))).alias("n"),
        F.array_min("x")["seq"].alias("low"), F.array_max("x")["seq"].alias("high"), turns.alias("t"),
    )
    short = F.when(F.col("t") == "", "").otherwise(F.concat(F.substring("t", 1, 1), F.when(F.contains("t", F.lit("UU")), "X").otherwise("."), F.when(F.contains("t", F.lit("A")), "a").otherwise(""), F.when(F.contains("t", F.lit("U")), "u").otherwise(""), F.substring("t", -1, 1)))
    runs = runs.select("session_id", "run", "n", "low", "high", short.alias("t"))
    # A summary keeps the first and last speaker, whether both occur, and whether a user message followed a user message.
    for level in range(LEVELS - 1):
        last = level == LEVELS - 2
        up = F.lit(0).cast("long") if last else F.floor(F.col("run") / RUN)
        turns = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("run", "t"))), lambda e: e["t"]))
        merged = runs.groupBy("session_id", up.alias("up")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), turns.alias("t"))
        runs = merged.select("session_id", F.col("up").alias("run"), "n", "low", "high", (F.col("t") if last else _shortened(F.col("t"))).alias("t"))
    return runs.select("session_id", "n", "low", "high", F.col("t").alias("turns"))


def _shortened(t: Column) -> Column:
    """The summary of several summaries one after another."""
    broken = t.rlike("X|UU")
    marks = F.concat(F.when(broken, "X").otherwise("."), F.when(t.rlike("A|a"), "a").otherwise(""), F.when(t.rlike("U|u"), "u").otherwise(""))
    return F.when(t == "", "").otherwise(F.concat(F.substring(t, 1, 1), marks, F.substring(t, -1, 1)))


def _complete() -> Column:
    return (F.col("low") == 0) & (F.col("n") == F.col("high") + 1)


def _answered() -> Column:
    t = F.col("turns")
    has_user, has_assistant = t.rlike("U|u"), t.rlike("A|a")
    return has_user & has_assistant & ~F.contains(t, F.lit("X")) & ~F.contains(t, F.lit("UU")) & ~t.endswith("U")


def judged(session_refs: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, reason): every listed session; reason is null for those to keep, else empty, incomplete or unanswered."""
    return _judged(session_refs, messages).drop("high")


def _judged(session_refs: DataFrame, messages: DataFrame) -> DataFrame:
    listed = session_refs.where("id is not null").select(F.col("id").alias("session_id")).distinct()
    state = listed.join(session_state(messages), "session_id", "left")
    reason = F.when(F.col("n").isNull(), "empty").when(~_complete(), "incomplete").when(~_answered(), "unanswered")
    return state.select("session_id", reason.alias("reason"), "high")


def conversations(session_refs: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages of all sessions that are kept: (session_id, seq, role, content, sent_ms), one row per seq; ``sent_ms`` is when it was ingested.

    Of repeated deliveries the first is taken. Rows are ordered by (session_id, seq), which is unique.
    """
    # Kept sessions are listed once per run of messages, so rows meet them under (session, run) and a long session is spread out.
    keep = _judged(session_refs, messages).where("reason is null")
    keep = keep.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("high") / RUN))).alias("run"))
    first = F.min_by(F.struct(role().alias("role"), "content", F.unix_millis("ingested_at").alias("sent_ms")), F.struct("ingested_at", "message_id"))
    sent = messages.where("session_id is not null and seq is not null").select("session_id", "seq", "role", "content", "ingested_at", "message_id", F.floor(F.col("seq") / RUN).alias("run"))
    rows = sent.join(keep, ["session_id", "run"], "left_semi").groupBy("session_id", "run", "seq").agg(first.alias("m"))
    return rows.select("session_id", "seq", "m.*")


def _paused(messages: DataFrame, channel: str, time: str, keep: list[str]) -> DataFrame:
    """(channel, t, stretch, pause, ``keep``): the seconds since the time before in the channel; null for its first.

    A channel is cut into stretches of ``STRETCH_S`` seconds. Inside one the message before is the window's; the
    first of a stretch looks at the end of the last stretch, and only the stretches' ends meet per channel.
    """
    rows = messages.where(F.col(channel).isNotNull() & F.col(time).isNotNull()).select(F.col(channel).alias("channel"), F.col(time).cast("timestamp").alias("t"), *[F.col(k).alias(f"_{k}") for k in keep])
    rows = rows.withColumn("stretch", F.floor(F.unix_seconds("t") / STRETCH_S))
    ends = rows.groupBy("channel", "stretch").agg(F.max("t").alias("end"))
    ends = ends.select("channel", "stretch", F.lag("end").over(Window.partitionBy("channel").orderBy("stretch")).alias("before"))
    near = F.lag("t").over(Window.partitionBy("channel", "stretch").orderBy("t"))
    return rows.join(ends, ["channel", "stretch"]).select("channel", "t", "stretch", (F.col("t").cast("double") - F.coalesce(near, F.col("before")).cast("double")).alias("pause"), *[f"_{k}" for k in keep])


def calibrated_gap(messages: DataFrame, channel: str, time: str, quantile: float = 0.995, accuracy: int = 10_000) -> DataFrame:
    """(gap_s): the silence that only ``1 - quantile`` of all pauses inside a channel exceed; a one-row table, null without pauses."""
    return _paused(messages, channel, time, []).agg(F.percentile_approx("pause", quantile, accuracy).alias("gap_s"))


def segments(messages: DataFrame, channel: str, time: str, author: str, message: str, quantile: float = 0.995) -> DataFrame:
    """(channel, segment, t, message, author, role, answered): the messages of channels without sessions, in conversations.

    A channel is split, from segment 1 on, where it was silent for longer than the calibrated gap; the number of a
    message's segment is a running count of breaks over stretches. The role is ``opener`` for the author of a
    segment's first message, ``replier`` for every other known one, null for an unknown one. A segment is
    ``answered`` if someone other than its opener wrote in it. Rows with a null channel or time are left out; repeated rows count;
    of messages of the same time the smallest id is the first; an empty table gives nothing.
    """
    gap = calibrated_gap(messages, channel, time, quantile).first()["gap_s"]
    rows = _paused(messages, channel, time, [author, message])
    brk = F.when(F.col("pause").isNull() | (F.col("pause") > F.lit(gap if gap is not None else 0.0)), 1).otherwise(0)
    times = rows.groupBy("channel", "stretch", "t").agg(F.max(brk).alias("brk"))
    numbered = running(times, ["channel"], F.col("stretch"), ["t"], segment=F.col("brk")).select("channel", "stretch", "t", "segment")
    rows = rows.join(numbered, ["channel", "stretch", "t"]).select("channel", "segment", "stretch", "t", F.col(f"_{message}").alias("message"), F.col(f"_{author}").alias("author"))
    first = rows.groupBy("channel", "segment").agg(F.min_by("author", F.struct("t", "message")).alias("opener"), F.min("t").alias("began"))
    others = rows.join(first, ["channel", "segment"]).withColumn("role", F.when(F.col("author").isNull(), None).when(F.col("author") == F.col("opener"), "opener").otherwise("replier"))
    others = others.withColumn("role", F.when(F.col("opener").isNull(), None).otherwise(F.col("role")))
    state = others.groupBy("channel", "segment").agg(F.coalesce(F.bool_or(F.col("role") == "replier"), F.lit(False)).alias("answered"))
    return others.join(state, ["channel", "segment"]).select("channel", "segment", "t", "message", "author", "role", "answered")


def threads(messages: DataFrame, channel: str, time: str, author: str, message: str, quantile: float = 0.995) -> DataFrame:
    """(channel, segment, t, message, author, role) of ``segments``, without the conversations nobody else replied in."""
    return segments(messages, channel, time, author, message, quantile).where("answered").drop("answered")
