"""Timestamps in mixed notations, precisions and zones, brought to one UTC instant in milliseconds.

All of it is built-in SQL: a cascade of anchored patterns takes a text apart, ``to_utc_timestamp`` applies
zone rules (a local time that occurs twice means the first; one that daylight saving skips moves on by
the gap). Sessions without a zone get an offset history: local times are aligned with their ingestion, or
with the zoned times around them in the session's order, and the history of offsets that violates fewest
alignments converts them. Only the choice of a history, over the counted votes of a session's days, is
done in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.store import cut

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"

# Zone abbreviations and their offsets in minutes (fixed values of public time zone data).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600,
    "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?:(Z|z)|(?:UTC|GMT)?\s*([+-])(\d{2}):?(\d{2})?(?::\d{2})?|\(?([A-Za-z]{2,5})\)?)?\s*(?:\[([A-Za-z0-9_+\-/]+)\]|\(([A-Z]{2,5})\))?"
#: Name, pattern of the date, and which of its groups hold year, month, day.
_DATES = [
    ("iso", r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt_]|\s+)", (1, 2, 3)),
    ("slashed_year", r"(\d{4})/(\d{1,2})/(\d{1,2})[,]?(?:[Tt]|\s+)", (1, 2, 3)),
    ("slashed", r"(\d{1,2})/(\d{1,2})/(\d{4}),?\s+", (3, 1, 2)),
    ("dotted", r"(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+", (3, 2, 1)),
    ("mail", r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]([A-Za-z]{3,9})\.?[\s-](\d{4}),?\s+", (3, 2, 1)),
    ("month_first", r"(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+(?:at\s+)?", (3, 1, 2)),
]
_BASIC = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE + r"\z"
_DATE_ONLY = [(r"^(\d{4})-(\d{2})-(\d{2})\z", (1, 2, 3)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", (3, 1, 2)), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\z", (3, 2, 1))]
_NUMBER = r"^[+-]?\d{9,19}(?:\.\d+)?\z"


_NAMES = ["y", "m", "d", "hh", "mi", "ss", "frac", "half", "z", "sign", "zh", "zm", "abbr", "region", "comment"]


def _fields(text: Column) -> Column:
    """The parts of a text in the first notation that fits, in the order of ``_NAMES``; null if none fits.

    Each pattern is matched by one replacement that writes its groups in order; a text that it does not
    fit stays as it is and lacks the leading mark.
    """

    def take(pattern: str, groups: list) -> Column:
        return F.regexp_replace(text, pattern, "|".join(["=", *(f"${g}" if isinstance(g, int) else g for g in groups)]))

    cases = None
    for _, date, ymd in _DATES:
        pattern = "^" + date + _CLOCK + _ZONE + r"\z"
        value = F.split(take(pattern, [*ymd, *range(4, 16)]), r"\|", -1)
        cases = F.when(text.rlike(pattern), value) if cases is None else cases.when(text.rlike(pattern), value)
    cases = cases.when(text.rlike(_BASIC), F.split(take(_BASIC, [1, 2, 3, 4, 5, 6, 7, "", *range(8, 15)]), r"\|", -1))
    for pattern, ymd in _DATE_ONLY:
        cases = cases.when(text.rlike(pattern), F.split(take(pattern, [*ymd, "0", "0", *[""] * 10]), r"\|", -1))
    return cases


def _staged(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """Computes columns behind a generator, which the optimiser neither merges with later uses nor inlines into filters."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def _month(text: Column) -> Column:
    named = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(text, 1, 3))).cast("int")
    return F.when(text.rlike(r"^\d+\z"), text.try_cast("int")).otherwise(F.when(named > 0, named))


def _local_and_offset(f: dict[str, Column]) -> Column:
    """STRUCT<local TIMESTAMP read as UTC, ms INT, offset INT minutes or null, region STRING or null, known BOOLEAN>."""
    hour = f["hh"].try_cast("int")
    half = F.upper(F.substring(f["half"], 1, 1))
    hour = (
        F.when((half == "P") & (hour >= 1) & (hour < 12), hour + 12)
        .when((half == "A") & (hour == 12), F.lit(0))
        .when((half != "") & ((hour > 12) | (hour == 0)), F.lit(None))
        .otherwise(hour)
    )
    second = F.when(f["ss"] == "", F.lit(0)).otherwise(f["ss"].try_cast("int"))
    good = (hour <= 23) & (f["mi"].try_cast("int") <= 59) & (second <= 59)
    day = F.try_make_timestamp(f["y"].try_cast("int"), _month(f["m"]), f["d"].try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    local = F.when(good, F.unix_millis(day) + (hour * 3600 + f["mi"].try_cast("int") * 60 + second).cast("long") * 1000)
    millis = F.rpad(F.substring(f["frac"], 1, 3), 3, "0").try_cast("int")
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    offset = (
        F.when(f["z"] != "", F.lit(0))
        .when(f["sign"] != "", F.when(f["sign"] == "-", -1).otherwise(1) * (f["zh"].try_cast("int") * 60 + F.coalesce(F.nullif(f["zm"], F.lit("")).try_cast("int"), F.lit(0))))
        .when(f["abbr"] != "", F.try_element_at(abbr, F.upper(f["abbr"])))
    )
    return F.struct(
        (local + F.coalesce(millis, F.lit(0))).alias("local_ms"), offset.alias("offset"), F.nullif(f["region"], F.lit("")).alias("region"),
        ((f["z"] == "") & (f["sign"] == "") & (f["abbr"] == "") & (f["region"] == "")).alias("floating"),
    )


def _zoned_ms(local_ms: Column, zone: Column) -> Column:
    """The instant of a local time in a named zone; an unknown zone must be filtered out before."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local_ms), zone))


def _number_ms(text: Column) -> Column:
    """Seconds, milliseconds or microseconds (or nanoseconds) since 1970, told apart by size."""
    n = text.try_cast("decimal(30,9)")
    size = F.abs(n)
    ms = F.when(size < F.lit(10**11), n * 1000).when(size < F.lit(10**14), n).when(size < F.lit(10**17), n / 1000).otherwise(n / 1000000)
    return F.floor(ms).cast("long")


def parse(df: DataFrame, value: str, zone: str | None = None) -> DataFrame:
    """Adds ``instant_ms`` BIGINT (null: no instant), ``local_ms`` and ``floating`` (no zone in the text).

    ``zone`` names a column with an IANA zone that texts without a zone are local to; null there leaves
    such texts without an instant. Nulls, blank texts, texts in no known notation and dates that do not
    exist give null. The three columns must not exist yet; all other columns are kept as they are.
    """
    text = F.regexp_replace(F.col(value), r"^[\s ​﻿]+|[\s ​﻿]+\z", "")
    # Anything that reads as a wrong zone name gives null instead of an error.
    known = lambda z: z.rlike(r"^(?:[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|UTC|GMT)\z")
    given = F.col(zone) if zone else F.lit(None).cast("string")

    def instant(p):
        return (
            F.when(p["local_ms"].isNull(), None)
            .when(p["offset"].isNotNull(), p["local_ms"] - p["offset"].cast("long") * 60000)
            .when(p["region"].isNotNull() & known(p["region"]), _zoned_ms(p["local_ms"], p["region"]))
            .when(p["floating"] & given.isNotNull() & known(given), _zoned_ms(p["local_ms"], given))
        )

    keep = df.columns
    staged = _staged(df, keep, __text=text)
    staged = _staged(staged, [*keep, "__text"], __number=F.col("__text").rlike(_NUMBER), __f=F.when(~F.col("__text").rlike(_NUMBER), _fields(F.col("__text"))))
    part = {n: F.get(F.col("__f"), F.lit(i + 1)) for i, n in enumerate(_NAMES)}
    staged = _staged(staged, [*keep, "__text", "__number"], __p=F.when(F.col("__f").isNotNull(), _local_and_offset(part)))
    return _staged(
        staged, keep,
        instant_ms=F.when(F.col("__number"), _number_ms(F.col("__text"))).otherwise(instant(F.col("__p"))),
        local_ms=F.col("__p.local_ms"),
        floating=F.coalesce(F.col("__p.floating"), F.lit(False)),
    )


def session_zones(session_refs: DataFrame) -> DataFrame:
    """(session_id, zone): one row per session, whichever listing names a zone."""
    return session_refs.groupBy(F.col("id").alias("session_id")).agg(F.max(F.col("metadata")["timezone"]).alias("zone"))


#: Offsets are multiples of this, from -12 to 14 hours.
STEP_MIN = 15
#: A change of offset from one day to the next counts as this many violations.
CHANGE = 3.0
#: A message is ingested within this time, unless it is late.
MAX_DELAY_MS = 3_600_000
RUN = 1024


def aligned(messages: DataFrame, sessions: DataFrame, max_delay_ms: int = MAX_DELAY_MS) -> DataFrame:
    """(session_id, local_ms, low_ms, high_ms): the times without zone of the given sessions and the span their instants must lie in.

    ``messages``: (session_id, seq, ts, ingested_at). The span is that between the zoned times before and after in
    the session's order (looked for within runs of ``RUN`` numbers, so no session is one task), where both exist
    and are at most ``max_delay_ms`` apart; else the ``max_delay_ms`` before ingestion.
    """
    rows = messages.where("ts is not null").select("session_id", "seq", "ts", F.unix_millis("ingested_at").alias("ingested_ms")).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    read = parse(rows, "ts").withColumn("run", F.floor(F.col("seq") / RUN))
    order = Window.partitionBy("session_id", "run").orderBy("seq")
    before = F.last("instant_ms", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("instant_ms", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    read = read.select("session_id", "floating", "local_ms", "ingested_ms", before.alias("before"), after.alias("after")).where("floating and local_ms is not null")
    near = (F.col("after") >= F.col("before")) & (F.col("after") - F.col("before") <= max_delay_ms)
    return read.select("session_id", "local_ms", F.when(near, F.col("before")).otherwise(F.col("ingested_ms") - max_delay_ms).alias("low_ms"), F.when(near, F.col("after")).otherwise(F.col("ingested_ms")).alias("high_ms"))


def estimate_offsets(floating: DataFrame, change: float = CHANGE) -> DataFrame:
    """(session_id, day, offset_min, rows, violations): the offset history of each session, by day of its local times.

    ``floating``: (session_id, local_ms, low_ms, high_ms). Each row votes for the offsets that put its instant into
    its span; all others violate it. Votes are counted per session, day and offset with map-side combining, at
    most some hundred rows a session-day. Of all histories the one with the fewest violations is chosen, a change
    of offset counting as ``change`` of them (dynamic programming over the days), so that single days with few
    rows follow their neighbours; of equals the smallest offset. Rows that no offset satisfies violate every one.
    Rows with a null are left out.
    """
    rows = floating.where("local_ms is not null and low_ms is not null and high_ms is not null").withColumn("day", F.floor(F.col("local_ms") / 86_400_000))
    step = STEP_MIN * 60_000
    first, last = F.ceil((F.col("local_ms") - F.col("high_ms")) / step), F.floor((F.col("local_ms") - F.col("low_ms")) / step)
    low, high = -12 * 60 // STEP_MIN, 14 * 60 // STEP_MIN
    fits = (first <= high) & (last >= low) & (first <= last)
    votes = rows.select("session_id", "day", F.explode(F.when(fits, F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high)))).otherwise(F.array(F.lit(None).cast("long")))).alias("k"), F.lit(1).alias("one"))
    counted = votes.groupBy("session_id", "day", "k").agg(F.count("*").alias("votes"))
    totals = rows.groupBy("session_id", "day").agg(F.count("*").alias("rows"))
    width = high - low + 1

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        days = np.sort(pdf["day"].unique())
        at = np.searchsorted(days, pdf["day"])
        n = np.zeros(len(days), np.int64)
        n[at] = pdf["rows"]
        miss = np.repeat(n[:, None].astype(float), width, axis=1)
        known = pdf["k"].notna().to_numpy()
        miss[at[known], (pdf["k"][known] - low).astype(int)] -= pdf["votes"][known]
        cost, came = miss[0].copy(), np.zeros((len(days), width), np.int64)
        for d in range(1, len(days)):
            cheapest = int(np.argmin(cost))
            stay = cost <= cost[cheapest] + change
            came[d] = np.where(stay, np.arange(width), cheapest)
            cost = np.where(stay, cost, cost[cheapest] + change) + miss[d]
        k = int(np.argmin(cost))
        best = np.zeros(len(days), np.int64)
        for d in range(len(days) - 1, -1, -1):
            best[d] = k
            k = came[d, k]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "day": days, "offset_min": (best + low) * STEP_MIN, "rows": n, "violations": miss[np.arange(len(days)), best].astype(np.int64)})

    return counted.join(totals, ["session_id", "day"]).groupBy("session_id").applyInPandas(history, "session_id string, day long, offset_min int, rows long, violations long")


def converted(floating: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``instant_ms`` to rows (session_id, local_ms, ...) by the offset of their session and day; days without one are left out."""
    rows = floating.withColumn("day", F.floor(F.col("local_ms") / 86_400_000))
    return rows.join(history.select("session_id", "day", "offset_min"), ["session_id", "day"]).withColumn("instant_ms", F.col("local_ms") - F.col("offset_min").cast("long") * 60_000).drop("day")


def stamped_values(session_refs: DataFrame, messages: DataFrame) -> DataFrame:
    """Every time text of the project's tables: (source_field, record_key, session_id, value)."""
    listed = session_refs.select(
        F.col("id").alias("record_key"), F.col("id").alias("session_id"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("source_field"), F.col(c).alias("value")) for c in ("started_at", "ended_at")])),
    ).where(F.col("value").isNotNull()).distinct()
    sent = messages.select(F.lit("ts").alias("source_field"), F.col("message_id").cast("string").alias("record_key"), "session_id", F.col("ts").alias("value"))
    return sent.unionByName(listed.select(*sent.columns))


def normalised(values: DataFrame, session_refs: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Instants of all values that are not canonical yet: (source_field, record_key, value, instant_ms, zone_from).

    ``zone_from`` is ``value`` if the text names its zone or offset, ``session`` if the session does, and ``estimate``
    if neither does and the offset history of the session was estimated from ``messages``; without these such
    values are left out. Canonical values are dropped before the join with the sessions' zones, so the shuffle
    carries only the rest.
    """
    odd = values.where(F.col("value").isNotNull() & ~F.col("value").rlike(CANONICAL))
    zones = session_zones(session_refs)
    read = parse(odd.join(zones, "session_id", "left"), "value", "zone")
    if messages is not None:
        read = cut(read.where("instant_ms is not null or (floating and local_ms is not null)"), "timestamps")
    known = read.where("instant_ms is not null").select("source_field", "record_key", "value", "instant_ms", F.when(F.col("floating"), "session").otherwise("value").alias("zone_from"))
    if messages is None:
        return known
    open_ = read.where("instant_ms is null").select("source_field", "record_key", "session_id", "value", "local_ms")
    history = estimate_offsets(aligned(messages, open_))
    return known.unionByName(converted(open_, history).select("source_field", "record_key", "value", "instant_ms", F.lit("estimate").alias("zone_from")))
