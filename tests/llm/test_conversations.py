import random
from datetime import datetime, timedelta

from lorewell.llm import conversations as C
from tests.test_operators import messages


def test_judged_and_rebuilt(spark):
    rows = []
    def s(name, *turns, start=0):
        rows.extend((name, start + k, r, t, None, None) for k, (r, t) in enumerate(turns))

    u, a, x = ("Human ", "q"), ("gemini", "r"), ("tool_use", "t")
    s("good", u, x, a, u, ("ai", "ok"))
    s("blank_between", u, ("user", " ​﻿ \n"), a)
    s("late_start", u, a, start=1)
    s("unanswered", u, a, u)
    s("twice", u, u, a)
    s("only_user", u)
    s("only_assistant", a)
    s("blank_answer", u, ("assistant", "\t"))
    rows.append(("gap", 0, "user", "q", None, None))
    rows.append(("gap", 2, "ai", "q", None, None))
    rows.append((None, 0, "ai", "q", None, None))
    rows += rows[:3]
    refs = spark.createDataFrame([(r[0], "s") for r in rows] + [("empty", "s"), (None, "s")], "id string, reason string")
    got = {r.session_id: r.reason for r in C.judged(refs, messages(spark, rows)).collect()}
    assert got == {"good": None, "blank_between": None, "late_start": "incomplete", "unanswered": "unanswered", "twice": "unanswered", "only_user": "unanswered", "only_assistant": "unanswered", "blank_answer": "unanswered", "gap": "incomplete", "empty": "empty"}
    kept = C.conversations(refs, messages(spark, rows)).where("session_id = 'good'").orderBy("seq").collect()
    assert [(r.seq, r.role, r.content) for r in kept] == [(0, "user", "q"), (1, "tool_use", "t"), (2, "assistant", "r"), (3, "user", "q"), (4, "assistant", "ok")]
    assert C.judged(refs.limit(0), messages(spark, rows)).count() == 0
    assert {r.reason for r in C.judged(refs, messages(spark, []))  .collect()} == {"empty"}


def test_runs_do_not_matter(spark, monkeypatch):
    """Short runs, so that turns meet across them, against a plain model."""
    monkeypatch.setattr(C, "RUN", 3)
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(120):
        turns = [rng.choice(["user", "assistant", "assistant", "system"]) for _ in range(rng.randint(1, 14))]
        rows += [(f"s{k}", q, r, "x", None, None) for q, r in enumerate(turns)]
        t = "".join({"user": "U", "assistant": "A", "system": ""}[r] for r in turns)
        want[f"s{k}"] = None if "U" in t and "A" in t and "UU" not in t and not t.endswith("U") else "unanswered"
    refs = spark.createDataFrame([(k,) for k in want], "id string")
    assert {r.session_id: r.reason for r in C.judged(refs, messages(spark, rows)).collect()} == want


def test_levels_of_summaries(spark, monkeypatch):
    """One session much longer than a run of runs."""
    monkeypatch.setattr(C, "RUN", 4)
    rows = [("s", q, ("user", "ai")[q % 2], "x", None, None) for q in range(300)] + [("t", q, "user" if q in (200, 203) else "ai", "x", None, None) for q in range(300) if q not in (201, 202)]
    rows += [("t", q, "system", "x", None, None) for q in (201, 202)]
    refs = spark.createDataFrame([("s",), ("t",)], "id string")
    assert {r.session_id: r.reason for r in C.judged(refs, messages(spark, rows)).collect()} == {"s": None, "t": "unanswered"}


def test_segments(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("c", t0 + timedelta(minutes=k), "ab"[k % 2], k) for k in range(500)] + [("c", t0 + timedelta(hours=40, minutes=k), "b", 1000 + k) for k in range(50)]
    rows += [("c", t0, "a", 0), ("d", t0, "x", 7), ("d", t0 + timedelta(seconds=5), "y", 8), ("d", t0 + timedelta(seconds=6), None, 9), (None, t0, "a", 1), ("d", None, "a", 2), ("e", t0, None, 3), ("e", t0, "z", 4)]
    df = spark.createDataFrame(rows, "room string, at timestamp, who string, id long")
    assert C.calibrated_gap(df, "room", "at", 0.9).first().gap_s == 60.0
    got = C.segments(df, "room", "at", "who", "id", 0.9).collect()
    count = {}
    for r in got:
        count[r.channel, r.segment, r.role, r.answered] = count.get((r.channel, r.segment, r.role, r.answered), 0) + 1
    assert count == {
        ("c", 1, "opener", True): 251, ("c", 1, "replier", True): 250, ("c", 2, "opener", False): 50,
        ("d", 1, "opener", True): 1, ("d", 1, "replier", True): 1, ("d", 1, None, True): 1, ("e", 1, None, False): 2,
    }
    assert {(r.channel, r.segment) for r in C.threads(df, "room", "at", "who", "id", 0.9).collect()} == {("c", 1), ("d", 1)}
    assert C.segments(df.limit(0), "room", "at", "who", "id").count() == 0
