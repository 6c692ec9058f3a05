import json

from pyspark.sql import functions as F

from lorewell.operators import rendering
from lorewell.sources import dialects, stores
from lorewell.streaming import observe

A = [
    {"type": "ai-title", "title": "Generated"},
    {"type": "user", "timestamp": "2026-01-01T10:00:00.000Z", "cwd": "/work/x", "message": {"role": "user", "content": "Fix it"}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:05.000Z", "message": {"content": [{"type": "thinking", "text": "hm"}, {"type": "tool_use", "name": "Read", "input": {"p": 1}}, {"type": "text", "text": "I look"}, {"type": "text", "text": "closer"}]}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:06.000Z", "isSidechain": True, "message": {"content": "aside"}},
    {"type": "user", "message": {"content": [{"type": "text", "text": "more"}, {"type": "tool_result", "content": "dropped"}]}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:15.000Z", "message": {"content": [{"type": "tool_result", "content": [{"x": 1}]}]}},
    {"type": "custom-title", "customTitle": "Chosen"},
]


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def said(df):
    return [(r.role, r.content) for r in df.orderBy("session_id", "line_no", "part").collect()]


def test_dialect_a(spark, tmp_path):
    write(tmp_path / "p/s1.jsonl", [*A, "{broken", ""])
    write(tmp_path / "p/agent-1.jsonl", A)
    lines = dialects.read_lines(spark, str(tmp_path))
    rows = dialects.parse_a(lines)
    assert said(rows) == [("user", "Fix it"), ("assistant", "I look\ncloser"), ("tool_use", "Read"), ("user", "more"), ("tool_result", "")]
    assert [(r.tool_name, r.tool_input, r.tool_output) for r in rows.where("role like 'tool%'").orderBy("line_no").collect()] == [("Read", '{"p":1}', None), (None, None, '[{"x":1}]')]
    assert said(dialects.parse_a(lines.where("line_no >= 4"))) == [("user", "more"), ("tool_result", "")]
    meta = dialects.session_meta(lines)
    r = meta.first()
    assert (r.session_id, r.started_at, r.ended_at, r.cwd, r.title, r.line_count) == ("s1", "2026-01-01T10:00:00.000Z", "2026-01-01T10:00:15.000Z", "/work/x", "Chosen", 9)
    assert [r.session_id for r in dialects.list_sessions(meta, after="2026-01-01").collect()] == ["s1"]
    assert dialects.list_sessions(meta, project="/other").count() == 0
    assert [tuple(r) for r in dialects.detected_projects(meta).collect()] == [("/work/x", 1)]


def test_dialect_b(spark, tmp_path):
    sid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    write(tmp_path / f"rollout-{sid}.jsonl", [
        {"type": "session_meta", "payload": {"id": sid, "cwd": "/w"}}, {"type": "response_item", "timestamp": 1767225600, "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "fetch_page", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "output": "text"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": {"text": "done"}}}, "nonsense",
    ])
    rows = dialects.parse_b(dialects.read_lines(spark, str(tmp_path)))
    assert said(rows) == [("user", "hello"), ("tool_use", "fetch_page"), ("tool_result", ""), ("assistant", "done")]
    assert rows.orderBy("line_no").first().session_id == sid and rows.orderBy("line_no").first().ts == "2026-01-01T00:00:00.000Z"


def test_dialect_c(spark, tmp_path):
    doc = {"sessionId": "g", "messages": [{"type": "user", "content": "q", "timestamp": "1767225600000"}, {"type": "info", "content": "x"}, {"type": "gemini", "content": "a", "toolCalls": [{"name": "fetch_page"}]}, {"type": "gemini", "content": ""}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    assert said(dialects.parse_c(dialects.read_documents(spark, str(tmp_path)))) == [("user", "q"), ("assistant", "a\n[Tool: fetch_page]")]


def test_dialect_d(spark, tmp_path):
    write(tmp_path / "h.jsonl", [{"type": "session", "title": "T"}, {"type": "message", "message": {"role": "user", "content": "q"}, "timestamp": "2026-01-01T00:00:00Z"}, {"role": "bot", "content": [{"text": "a"}, "b"], "ts": 1767225600}, {"role": "user", "content": ""}])
    assert said(dialects.parse_d(dialects.read_lines(spark, str(tmp_path)))) == [("user", "q"), ("assistant", "a\nb")]


def test_listing_b(spark, tmp_path):
    sid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    ask = {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": "a question " * 20}}
    write(tmp_path / "sessions/2026/r1.jsonl", [{"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "one", "cwd": "/w"}}, "broken", ask, {"timestamp": 1767225700, "type": "x"}])
    write(tmp_path / "archived_sessions/r2.jsonl", [{"type": "session_meta", "payload": {"id": "sub", "source": {"subagent": {}}}}, ask])
    write(tmp_path / f"archived_sessions/rollout-{sid}.jsonl", [ask])
    write(tmp_path / "sessions/nameless.jsonl", [ask])
    lines = dialects.read_lines(spark, [str(tmp_path / "sessions"), str(tmp_path / "archived_sessions"), str(tmp_path / "missing")])
    got = {r.session_id: r for r in dialects.session_meta_b(lines).collect()}
    assert set(got) == {"one", sid}
    assert (got["one"].cwd, got["one"].started_at, got["one"].ended_at, got["one"].title) == ("/w", "2026-01-01T00:00:00Z", "2026-01-01T00:01:40.000Z", ("a question " * 20)[:80])
    assert dialects.read_lines(spark, str(tmp_path / "missing")).count() == 0
    assert [r.session_id for r in dialects.list_sessions(dialects.session_meta_b(lines), limit=1).collect()] == [sid]


def test_listing_c(spark, tmp_path):
    for project, root in (("p1", " /work/one \n"), ("p2", None)):
        (tmp_path / f"tmp/{project}/chats").mkdir(parents=True)
        if root:
            (tmp_path / f"tmp/{project}/.project_root").write_text(root)
        (tmp_path / f"tmp/{project}/chats/a.json").write_text(json.dumps({"sessionId": project, "startTime": 1767225600000, "lastUpdated": "2026-01-02T00:00:00Z", "messages": [{"type": "user", "content": " "}, {"type": "user", "content": "first"}]}))
        (tmp_path / f"tmp/{project}/chats/b.json").write_text("{}")
    at = str(tmp_path / "tmp")
    got = {r.session_id: (r.cwd, r.started_at, r.ended_at, r.title) for r in dialects.session_meta_c(dialects.read_documents(spark, at), dialects.project_roots(spark, at)).collect()}
    assert got == {"p1": ("/work/one", "2026-01-01T00:00:00.000Z", "2026-01-02T00:00:00Z", "first"), "p2": (None, "2026-01-01T00:00:00.000Z", "2026-01-02T00:00:00Z", "first")}


def test_listing_d(spark, tmp_path):
    write(tmp_path / "h1.jsonl", [{"type": "init", "id": "own", "directory": "/d", "title": "T", "ts": 1767225600}, {"role": "user", "content": "q", "timestamp": "2026-01-01T05:00:00Z"}, ""])
    write(tmp_path / "h2.jsonl", [{"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "asked"}]}}])
    got = {r.session_id: (r.cwd, r.started_at, r.ended_at, r.title) for r in dialects.session_meta_d(dialects.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"own": ("/d", "2026-01-01T00:00:00.000Z", "2026-01-01T05:00:00Z", "T"), "h2": (None, None, None, "asked")}
    there = dialects.available(spark, {"d": str(tmp_path), "x": str(tmp_path / "none")}).collect()
    assert [(r.source, r.available) for r in there] == [("d", True), ("x", False)]


def test_ends_of_a_long_file(spark):
    rows = [("f", k, json.dumps({"timestamp": f"t{k:05d}"}) if k % 3 else " ") for k in range(5000)]
    r = dialects.session_meta(spark.createDataFrame(rows, "path string, line_no int, value string")).first()
    assert (r.started_at, r.ended_at, r.line_count) == ("t00001", "t04999", 5000)


def test_keyed_store(spark, tmp_path):
    import pytest

    s = stores.KeyedStore(spark, str(tmp_path / "skills"))
    assert s.table() is None
    rows = lambda *r: spark.createDataFrame(list(r), "id string, status string, n int")
    s.save(rows(("a", "draft", 1), ("b", "draft", 1)))
    s.save(rows(("b", "draft", 2), ("c", "draft", 3)))
    s.update(["a"], status="active")
    assert {r.id: (r.status, r.n) for r in s.table().collect()} == {"a": ("active", 1), "b": ("draft", 2), "c": ("draft", 3)}
    assert [r.n for r in s.get("b").collect()] == [2] and s.get("zz").count() == 0 and [r.id for r in s.list(status="active", n=None).collect()] == ["a"]
    with pytest.raises(KeyError):
        s.update(["zz"], status="active")
    s.delete(["a", "zz"])
    assert {r.id for r in stores.KeyedStore(spark, s.path).table().collect()} == {"b", "c"}


def test_stores(spark, tmp_path):
    eps = spark.createDataFrame([("a", "2025-12-31T00:00:00Z"), ("b", "2026-02-01T00:00:00Z"), ("c", None)], "id string, started_at string")
    at = str(tmp_path / "eps")
    stores.save_episodes(eps, at)
    assert {r.id for r in stores.list_episodes(spark, at, eps.schema).collect()} == {"a", "b", "c"}
    later = stores.list_episodes(spark, at, eps.schema, after="2026-01-01")
    assert [r.id for r in later.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(year" in later._jdf.queryExecution().toString()
    log = str(tmp_path / "log")
    schema = "id string, n int"
    assert stores.read_log(spark, log, schema).count() == 0
    for k in range(2):
        stores.append_log(spark.createDataFrame([("x", k)], schema), log)
    assert stores.read_log(spark, log, schema).count() == 2


def test_markdown_store(spark, tmp_path):
    row = ("x", 'A "title": yes', None, None, "project", ["a,b", "ü"], ["e"], 0.5, 1, "active", "c", None, "first\n\nline", "do\n- it", ["when"], None, [])
    x = spark.createDataFrame([row], "id string, title string, domain string, task_type string, scope string, triggers array<string>, source_episode_ids array<string>, confidence double, version int, status string, created_at string, updated_at string, problem string, recommendation string, apply_when array<string>, avoid array<string>, evidence array<string>")
    stores.save_experiences(x, str(tmp_path / "m"))
    r = stores.list_experiences(spark, str(tmp_path / "m"), "project").first()
    assert (r.title, r.confidence, r.triggers, r.problem, r.recommendation, r.apply_when, r.avoid) == (row[1], 0.5, row[5], row[12], row[13], ["when"], [])
    assert rendering.experience_markdown(x.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    from tests.test_operators import messages

    rows = [("s", q, "human" if q % 2 == 0 else "ai", "x", None, None) for q in range(6)]
    src, seen = tmp_path / "in", []
    m = messages(spark, rows + rows[:3])
    m.where("message_id < 4").coalesce(1).write.parquet(str(src))
    m.where("message_id >= 4").coalesce(1).write.mode("append").parquet(str(src))
    stream = observe.first_deliveries(observe.message_stream(spark, str(src), m))
    q = observe.run(stream, lambda df, n: seen.extend((n, r.session_id, r.seq) for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert sorted(x[2] for x in seen) == list(range(6)) and len({x[0] for x in seen}) >= 2
    q = observe.activity(observe.message_stream(spark, str(src), m)).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check2")).start()
    q.awaitTermination()
    assert {r.role: r.n for r in spark.table("act").groupBy("role").agg(F.sum("n").alias("n")).collect()} == {"user": 5, "assistant": 4}
