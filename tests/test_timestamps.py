from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lorewell.operators import timestamps

ISO = {
    # text: (zone of the session, instant)
    ("2025-09-09T17:35:35.799Z", None): "2025-09-09T17:35:35.799", (" \t2026-04-17T09:07:41.406Z\n", None): "2026-04-17T09:07:41.406", ("2026-03-09T14:37:08Z", None): "2026-03-09T14:37:08",
    ("2025-10-04t15:22:55z", None): "2025-10-04T15:22:55", ("2025-10-04T15:48:13.319999999Z", None): "2025-10-04T15:48:13.319", ("20260327T163713Z", None): "2026-03-27T16:37:13",
    ("2025-10-05T01:54:13.401+10:00", None): "2025-10-04T15:54:13.401", ("2026-03-29 02:29:04+0900", None): "2026-03-28T17:29:04", ("Mon, 01 Sep 2025 00:51:36 +0200", None): "2025-08-31T22:51:36",
    ("2025-10-05T01:31:31+10:00[Australia/Sydney]", None): "2025-10-04T15:31:31", ("2026-03-06 12:53:16 EST", None): "2026-03-06T17:53:16", ("2025-11-12 02:33:46 CET", "Asia/Tokyo"): "2025-11-12T01:33:46",
    ("1768003829", None): "2026-01-10T00:10:29", ("1777056429.526", None): "2026-04-24T18:47:09.526", ("1759592168633", None): "2025-10-04T15:36:08.633", ("1771753847923707", None): "2026-02-22T09:50:47.923",
    ("2026-05-28T13:10:04.471", "America/Los_Angeles"): "2026-05-28T20:10:04.471", ("2025-11-30 11:46", "Europe/Berlin"): "2025-11-30T10:46:00", ("20.03.2026 19:27:39", "Europe/Helsinki"): "2026-03-20T17:27:39",
    ("02/27/2026 12:07:39 AM", "UTC"): "2026-02-27T00:07:39", ("02/27/2026 12:07:39 PM", "UTC"): "2026-02-27T12:07:39", ("Feb 28, 2026 8:38:29 pm", "Asia/Kolkata"): "2026-02-28T15:08:29",
    # twice: the first; never: moved on by the gap
    ("2025-10-26 02:30:00", "Europe/Berlin"): "2025-10-26T00:30:00", ("2026-03-29 02:30:00", "Europe/Berlin"): "2026-03-29T01:30:00", ("2025-11-02 01:30:00", "America/New_York"): "2025-11-02T05:30:00",
}
NONE = [("2026-05-28T13:10:04.471", None), ("2026-05-28T13:10:04.471", "Nowhere"), ("25:61", "UTC"), ("n/a", "UTC"), ("", "UTC"), (None, "UTC"), ("-", "UTC"), ("NaN", "UTC"), ("unknown", "UTC"), ("Invalid Date", "UTC"), ("2026-02-30 10:00:00", "UTC"), ("13/13/2026 1:00:00 PM", "UTC"), ("2026-01-01 24:30:00", "UTC"), ("123", "UTC"), ("2026-01-01T10:00:00 XYZ", "UTC")]


def ms(iso):
    return round(datetime.fromisoformat(iso).replace(tzinfo=timezone.utc).timestamp() * 1000)


def test_notations(spark):
    rows = [(i, t, z, "kept") for i, (t, z) in enumerate([*ISO, *NONE])]
    df = timestamps.parse(spark.createDataFrame(rows, "i int, t string, z string, text string"), "t", "z")
    assert df.columns == ["i", "t", "z", "text", "instant_ms", "local_ms", "floating"]
    got = {(r.t, r.z): r.instant_ms for r in df.collect()}
    assert got == {k: ms(v) for k, v in ISO.items()} | dict.fromkeys(NONE)


@pytest.mark.parametrize("zone", ["Australia/Sydney", "America/New_York", "Europe/Lisbon", "Asia/Kolkata"])
def test_local_times_of_a_year(spark, zone):
    """Against the standard library, every 37 minutes around the year."""
    df = spark.range(0, 365 * 24 * 60, 37).select(F.date_format(F.timestamp_seconds(F.lit(1756684800) + F.col("id") * 60), "yyyy-MM-dd HH:mm:ss").alias("t"), F.lit(zone).alias("z"))
    for r in timestamps.parse(df, "t", "z").collect():
        want = datetime.fromisoformat(r.t).replace(tzinfo=ZoneInfo(zone), fold=0)
        assert r.instant_ms == round(want.timestamp() * 1000), r


def test_normalised_and_empty(spark):
    refs = spark.createDataFrame([("s", "2026-01-01 10:00", "x", {"timezone": "Asia/Tokyo"}), ("s", "2026-01-01 10:00", "x", {"timezone": "Asia/Tokyo"}), ("q", "2026-01-01 10:00", None, None)], "id string, started_at string, ended_at string, metadata map<string,string>")
    msgs = spark.createDataFrame([(1, "s", "2026-01-01T00:00:00.000Z"), (2, "s", "01.02.2026 00:00:00"), (3, None, "1768003829")], "message_id long, session_id string, ts string")
    got = sorted((r.source_field, r.record_key, r.instant_ms) for r in timestamps.normalised(timestamps.stamped_values(refs, msgs), refs).collect())
    assert got == [("started_at", "s", ms("2026-01-01T01:00:00")), ("ts", "2", ms("2026-01-31T15:00:00")), ("ts", "3", 1768003829000)]
    assert timestamps.normalised(timestamps.stamped_values(refs.limit(0), msgs.limit(0)), refs.limit(0)).count() == 0


def test_estimated_offsets(spark):
    """Sessions of known offsets, written up to half an hour before ingestion, with late rows and a change of offset."""
    rows = []
    for s, offsets in {"a": [600, 660], "b": [-420, -420], "c": [330, 330]}.items():
        for day, off in enumerate(offsets):
            for k in range(40):
                sent = ms("2026-01-05T10:00:00") + day * 86_400_000 + k * 60_000
                late = 3 * 86_400_000 if k % 10 == 0 else (k * 37) % 840_000 + 1000
                rows.append((s, sent + off * 60_000, sent + late))
    rows = [(s, x, t - 3_600_000, t) for s, x, t in rows] + [("a", None, 5, 6), (None, 5, None, 7)]
    got = timestamps.estimate_offsets(spark.createDataFrame(rows, "session_id string, local_ms long, low_ms long, high_ms long"))
    days = {}
    for r in got.orderBy("session_id", "day").collect():
        days.setdefault(r.session_id, []).append((r.offset_min, r.rows, r.violations))
    assert days == {"a": [(600, 40, 4), (660, 40, 4)], "b": [(-420, 40, 4), (-420, 40, 4)], "c": [(330, 40, 4), (330, 40, 4)]}


def test_a_day_with_few_rows_follows_its_neighbours(spark):
    day, rows = 86_400_000, []
    for d, (n, off) in enumerate([(30, 120), (2, 60), (30, 120)]):
        for k in range(n):
            sent = ms("2026-05-04T08:00:00") + d * day + k * 60_000
            rows.append(("s", sent + off * 60_000, sent - 3_000_000, sent + 1000))
    got = timestamps.estimate_offsets(spark.createDataFrame(rows, "session_id string, local_ms long, low_ms long, high_ms long")).orderBy("day").collect()
    assert [r.offset_min for r in got] == [120, 120, 120] and [r.violations for r in got] == [0, 2, 0]


def test_zoneless_session_is_converted_by_its_order(spark):
    """All rows are ingested days later, so only the zoned times around a row tell its offset."""
    base, rows = ms("2026-02-02T09:00:00"), []
    text = lambda t: datetime.fromtimestamp(t / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    for k in range(30):
        t = base + k * 60_000
        rows.append((k, "z", k, text(t) + "Z" if k % 3 == 0 else text(t + 330 * 60_000), datetime(2026, 2, 9, tzinfo=timezone.utc)))
    msgs = spark.createDataFrame(rows, "message_id long, session_id string, seq long, ts string, ingested_at timestamp")
    refs = spark.createDataFrame([("z", None, None, None)], "id string, started_at string, ended_at string, metadata map<string,string>")
    values = timestamps.stamped_values(refs, msgs)
    got = {int(r.record_key): (r.instant_ms, r.zone_from) for r in timestamps.normalised(values, refs, msgs).collect()}
    assert got == {k: (base + k * 60_000, "value" if k % 3 == 0 else "estimate") for k in range(30)}
    assert {r.zone_from for r in timestamps.normalised(values, refs).collect()} == {"value"}
