import random

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import clusters, incremental, patterns, records, rendering, retrieval, transcripts, upserts
from lorewell.operators.prefix import running


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("word,stem", [("readers", "read"), ("running", "run"), ("class", "clas"), ("ings", ""), ("fixed", "fix"), ("css", "cs")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem, word) == stem


def test_text_functions(spark):
    assert one(spark, T.tokens, "Don`t use THE sidebar-overflow, it's 12 or 123") == ["sidebar", "overflow", "it's", "123"]
    assert one(spark, T.tokens, None) == []
    assert [one(spark, T.project_name, p) for p in ("/a/b/c", "C:\\x\\y", "c", "")] == ["b/c", "x/y", "c", ""]
    assert [one(spark, T.normal_path, p) for p in (None, "", "C:\\X")] == ["default", "default", "c:/x"]
    assert [one(spark, T.masked_key, p) for p in ("12345678", "sk-1234567890")] == ["****", "sk-1...7890"]
    assert one(spark, T.xml_escaped, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, T.percent, 0.825, "double") == "83%"
    df = spark.createDataFrame([("frontend", "bugfix", ["layout", "css"]), (None, "", None)], "d string, t string, g array<string>")
    assert [r[0] for r in df.select(T.signature(F.col("d"), F.col("t"), F.col("g"))).collect()] == ["frontend::bugfix::css::layout", "any::"]


def record(title, triggers, rec, problem):
    return (title, triggers, rec, problem)


def test_similarity(spark):
    """Hand-computed: titles share 2 of 3 and 3 stems, triggers 1 of 2, recommendations all, problems none."""
    rows = [("a", "s", "Fix sidebar overflow", ["css", "layout"], "use overflow hidden", None), ("b", "s", "Fixing sidebars layout", ["css"], "overflow hidden", "window"), ("c", "s", None, None, None, None), ("d", "s", "", [], "", "")]
    df = spark.createDataFrame(rows, "id string, scope string, title string, triggers array<string>, recommendation string, problem string")
    s = retrieval.token_sets(df)
    got = {(r.x, r.y): r.s for r in s.alias("a").crossJoin(s.alias("b")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), retrieval.similarity("a", "b").alias("s")).collect()}
    assert got["a", "b"] == pytest.approx(0.4 * 4 / 6 + 0.25 / 2 + 0.2)
    assert got["a", "c"] == got["c", "d"] == 0
    pairs = {(r.id_a, r.id_b): r.score for r in retrieval.similar_pairs(df).collect()}
    assert pairs == {("a", "b"): pytest.approx(0.591667)}
    assert {r.id: r.class_id for r in retrieval.copies_of(df).collect()} == {"a": "a", "b": "b", "c": "c", "d": "c"}
    assert retrieval.similar_pairs(df.limit(0)).count() == 0


def test_retrieval_ranks(spark):
    exps = spark.createDataFrame([(f"e{k}", "active", "web", None, ["css"]) for k in range(10)] + [("z", "draft", "web", None, ["css"]), ("n", "active", None, None, None)], "id string, status string, domain string, task_type string, triggers array<string>")
    tasks = spark.createDataFrame([("t", "Fix CSS bug", "web", None, ["css"]), ("u", None, None, None, None)], "task_id string, description string, domain string, task_type string, tags array<string>")
    got = [(r.task_id, r.rank, r.experience_id, r.score) for r in retrieval.retrieve(exps, tasks, 3).orderBy("rank").collect()]
    assert got == [("t", 1, "e0", 6), ("t", 2, "e1", 6), ("t", 3, "e2", 6)]


def test_running_equals_plain(spark):
    random.seed(1)
    rows = [(random.choice("aab"), k, random.randint(0, 3)) for k in range(300)] + [(None, k, 1) for k in range(5)]
    got = running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], F.floor(F.col("k") / 16), ["k"], total=F.col("v"))
    want, sums = {}, {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[g, k] = sums[g]
    assert {(r.g, r.k): r.total for r in got.collect()} == want


def episode_rows(statuses):
    return [(f"e{k}", s, f"2026-01-0{k + 1}T00:00:00.000Z", "web", "bugfix", ["b", "a"], ([(None, "plan", None)] if k else [(None, "read", None), (None, "plan", None)], None, [("boom", None)] if k == 0 else None)) for k, s in enumerate(statuses)]


EPISODE = "id string, status string, started_at string, domain string, task_type string, tags array<string>, trace struct<steps:array<struct<step_index:int,action:string,error:string>>,tool_calls:array<struct<name:string>>,errors:array<struct<message:string,code:string>>>"


@pytest.mark.parametrize("statuses,promotion,confidence", [(["success"] * 3, "candidate_skill", 0.88), (["success", "failure", "failure"], "none", 0.413333), (["success"] * 3 + ["failure"] * 3, "candidate_skill", 0.65), (["success"], "none", 0.3)])
def test_patterns(spark, statuses, promotion, confidence):
    eps = spark.createDataFrame(episode_rows(statuses), EPISODE)
    r = patterns.mined(eps).first()
    assert (r.signature, r.support, r.promotion, r.confidence, r.recurring_failures) == ("web::bugfix::a::b", len(statuses), promotion, confidence, "boom")
    assert [x.action for x in patterns.common_steps(eps).orderBy("place").collect()] == ["read", "plan"]
    assert patterns.mined(eps.limit(0)).count() == 0


def test_components_against_search(spark):
    random.seed(2)
    links = [(f"n{random.randint(0, 60):02d}", f"n{random.randint(0, 60):02d}") for _ in range(45)] + [("x", "x"), (None, "y"), ("p1", "p0")] + [(f"q{k:02d}", f"q{k + 1:02d}") for k in range(40)]
    got = {r.id: r.component for r in clusters.components(spark.createDataFrame(links, "id_a string, id_b string")).collect()}
    near = {}
    for a, b in links:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want


def test_merge_plan(spark):
    schema = "id string, status string, recommendation string, confidence double, triggers array<string>, source_episode_ids array<string>, evidence array<string>, apply_when array<string>"
    recs = spark.createDataFrame([("a", "active", "short", 0.9, ["x", "y"], ["e1"], None, []), ("b", "active", "much longer", 0.1, ["y", "z", None], ["e2"], ["q"], None), ("c", "active", "much longer", 0.1, None, ["e1"], ["q"], ["w"]), ("d", "active", "x", None, ["t"], None, None, None)], schema)
    whole = clusters.clustered(recs, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id_a string, id_b string"))
    assert {tuple(r) for r in whole.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    plan = {r.id: r for r in clusters.merge_plan(recs, whole).collect()}
    assert {k: (r.role, r.primary_id, r.status) for k, r in plan.items()} == {"a": ("merge", "b", "deprecated"), "b": ("keep", "b", "active"), "c": ("merge", "b", "deprecated")}
    b = plan["b"]
    assert (b.triggers, b.source_episode_ids, b.evidence, b.apply_when) == (["y", "z", "x"], ["e2", "e1"], ["q"], ["w"]) and plan["a"].triggers == ["x", "y"]


def test_copies_below_the_threshold_are_not_linked(spark):
    rows = [("a", "global", "the", None, "alpha beta", ""), ("b", "global", "the", None, "alpha beta", ""), ("c", "global", "Long Title Words", ["t"], "alpha beta", "p"), ("d", "global", "Long Title Words", ["t"], "alpha beta", "p")]
    x = spark.createDataFrame(rows, "id string, scope string, title string, triggers array<string>, recommendation string, problem string")
    assert [tuple(r) for r in retrieval.linked_copies(x).collect()] == [("c", "d")]


def test_best_matches(spark):
    schema = "id string, title string, triggers array<string>, recommendation string, problem string"
    old = spark.createDataFrame([("x", "cache build output", ["cache"], "cache the output folder", "slow builds"), ("y", "retry network calls", ["retry"], "retry with backoff", "flaky network"), ("z", "cache build output", ["cache"], "cache the output folder", "slow builds"), ("n", None, None, None, None)], schema)
    new = spark.createDataFrame([("c1", "caching build outputs", ["cache"], "cache output", "slow build"), ("c2", "unrelated thing", None, None, None), ("c3", None, None, None, None)], schema)
    got = {r.id: (r.match_id, r.score >= 0.4) for r in retrieval.best_matches(new, old).collect()}
    assert got == {"c1": ("x", True)}
    assert retrieval.best_matches(new.limit(0), old).count() == 0 == retrieval.best_matches(new, old.limit(0)).count()


def test_last_processed_by_start(spark):
    rows = [("a", "/P/x", "2026-03-01 10:00:00", 9), ("b", "/p/X", "03/02/2026 9:00:00 AM", 1), ("c", "/p/x", None, 99), ("d", None, "garbage", 5), ("e", "", "1767225600", 2), ("b", "/p/X", "2026-01-01T00:00:00Z", 0)]
    refs = spark.createDataFrame(rows, "id string, project_path string, started_at string, mtime_ms long")
    assert {r.project: (r.last_session_id, r.sessions) for r in upserts.last_processed(refs).collect()} == {"/p/x": ("b", 3), "default": ("e", 2)}


def test_marker_only_moves_on(spark):
    marks = spark.createDataFrame([("p", "s1", 100), ("q", "s2", 50)], "project string, session_id string, started_ms long")
    done = spark.createDataFrame([("p", "early", 99), ("q", "same", 50), ("r", "new", None)], "project string, session_id string, started_ms long")
    assert {r.project: (r.session_id, r.started_ms) for r in upserts.advanced_marker(marks, done).collect()} == {"p": ("s1", 100), "q": ("same", 50), "r": ("new", 0)}


def test_search_words(spark):
    df = spark.createDataFrame([("1", "alpha"), ("2", "beta")], "id string, title string")
    ids = lambda q: [r.id for r in records.search_any(df, q, ["title"]).orderBy("id").collect()]
    assert ids("alpha  zzz") == ["1"] and ids("ALPHA\tbeta") == ["1", "2"] and ids("") == ["1", "2"] and ids(" zzz") == ["1", "2"]


MSG = "message_id long, session_id string, seq long, line_no long, role string, content string, tool_name string, tool_input string, tool_output string, ts string, ingested_at timestamp"


def messages(spark, rows):
    from datetime import datetime, timedelta

    out = [(k, s, q, q, role, content, tool, None, result, None, datetime(2026, 1, 1) + timedelta(seconds=k)) for k, (s, q, role, content, tool, result) in enumerate(rows)]
    return spark.createDataFrame(out, MSG)


def test_session_mapping(spark):
    rows = [
        ("a", 0, "tool_result", "lost", None, "early"), ("a", 1, " Human ", "x" * 600, None, None), ("a", 2, "TOOL_USE", "run", "Read", None), ("a", 3, "tool_result", "", None, "an Error here"),
        ("a", 4, "tool_result", "", None, "fine"), ("a", 5, "tool_use", "", "Edit", None), ("a", 6, "model", "done", None, None), ("a", 6, "model", "done", None, None),
        ("b", 0, "assistant", "hi", None, None), ("c", 0, "user", "go", None, None), ("d", 0, "user", "go", None, None), ("d", 1, "ai", "It FAILED", None, None), (None, 0, "user", "x", None, None),
    ]
    d = transcripts.delivered(messages(spark, rows))
    eps = {r.session_id: r for r in transcripts.session_episodes(d).collect()}
    assert {k: r.status for k, r in eps.items()} == {"a": "success", "c": "partial", "d": "partial"}
    assert len(eps["a"].description) == 500 and eps["a"].n_messages == 7 and eps["a"].n_steps == 2 and eps["a"].result == "done"
    steps = [(r.session_id, r.step_no, r.action, r.output, r.error) for r in transcripts.steps(d).orderBy("session_id", "step_no").collect()]
    assert steps == [("a", 0, "Read", "fine", "an Error here"), ("a", 1, "Edit", None, None), *[(k, 0, "conversation", None, None) for k in "bcd"]]
    deltas = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 4, 7), ("a", 2, 4, 7), ("zz", 1, 0, 9)], "session_id string, delta_number int, line_start long, line_end long")
    got = {(r.session_id, r.delta_number): (r.description[:40], r.status, r.n_steps, r.n_messages) for r in transcripts.delta_episodes(deltas, d).collect()}
    assert got == {("a", 1): ("x" * 40, "partial", 0, 2), ("a", 2): ("<continuation of session a, delta 2>", "success", 1, 3)}


def test_incremental(spark):
    first = messages(spark, [("s", 0, "user", "a", None, None), ("s", 1, "assistant", "b", None, None), ("t", 0, "user", "a", None, None)])
    none = spark.createDataFrame([], "session_id string, processed_lines long, n_deltas long")
    gate = {"idle_ms": 0, "min_lines": 2}
    p1 = incremental.pending(first, none, **gate)
    assert {r.session_id: (r.decision, r.line_start, r.line_end, r.delta_number) for r in p1.collect()} == {"s": ("process", 0, 2, 1), "t": ("deferred_small", 0, 1, 1)}
    marks = incremental.advanced(none, p1)
    assert {r.session_id: r.processed_lines for r in marks.collect()} == {"s": 2}
    assert {r.session_id: r.decision for r in incremental.pending(first, marks, **gate).collect()}["s"] == "unchanged"
    grown = messages(spark, [("s", q, "user", "a", None, None) for q in range(4)])
    p2 = incremental.pending(grown, marks, **gate)
    assert [(r.decision, r.line_start, r.line_end, r.delta_number) for r in p2.collect()] == [("process", 2, 4, 2)]
    marks2 = incremental.advanced(marks, p2)
    again = incremental.advanced(marks2, p2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, marks2.collect())) == [("s", 4, 2)]
    assert incremental.pending(first, marks2, **gate).where("session_id = 's'").first().decision == "truncated"
    assert incremental.pending(first, none, idle_ms=10_000, min_lines=0).first().decision == "deferred_busy"


def test_upserts(spark):
    schema = "id string, title string, recommendation string, triggers array<string>, version int, history array<struct<version:int,recommendation:string,merged_from_episode_id:string,replaced_at:string>>, needs_review boolean, updated_at string"
    x = spark.createDataFrame([("a", "t", "old", ["q"], 1, None, None, "then"), ("b", "t", "same", None, 2, None, False, None)], schema)
    u = spark.createDataFrame([("a", "", "new", None)], "id string, title string, recommendation string, triggers array<string>")
    got = {r.id: r for r in upserts.updated(x, u).collect()}
    assert (got["a"].title, got["a"].recommendation, got["a"].version, got["a"].triggers, got["a"].needs_review) == ("t", "new", 2, ["q"], True)
    assert [tuple(h) for h in got["a"].history] == [(1, "old", None, "then")] and tuple(got["b"]) == ("b", "t", "same", None, 2, None, False, None)
    merged = upserts.upsert(x.select("id", "title"), spark.createDataFrame([("b", "n"), ("c", "n")], "id string, title string"))
    assert {r.id: r.title for r in merged.collect()} == {"a": "t", "b": "n", "c": "n"}


def test_managed_section(spark):
    R = rendering
    docs = [("none", None), ("blank", " \n"), ("inline", f"# Mine\nsays {R.START} inline\n"), ("new", f"a\n  {R.START}\nold $1 \\ text\n{R.END} \nb"), ("older", f"{R.OLD_START}\nx\n{R.OLD_END}\n"), ("same", f"k\n{R.START}\nthe $content\\\n{R.END}")]
    df = spark.createDataFrame([(t, d, "the $content\\", 1, 0) for t, d in docs], "target string, document string, content string, experiences long, skills long")
    got = {r.target: (r.document, r.action) for r in R.synced(df).collect()}
    block = f"{R.START}\nthe $content\\\n{R.END}"
    assert got == {
        "none": (block + "\n", "created"), "blank": (block + "\n", "created"), "inline": (f"# Mine\nsays {R.START} inline\n\n{block}\n", "updated"),
        "new": (f"a\n{block}\nb", "updated"), "older": (block + "\n", "updated"), "same": (docs[5][1], "unchanged"),
    }
    assert [r.s for r in df.where("target in ('new', 'inline')").orderBy("target").select(R.read_section(F.col("document")).alias("s")).collect()] == [None, "old $1 \\ text"]
    empty = df.withColumn("experiences", F.lit(0))
    assert {r.action for r in R.synced(empty).collect()} == {"unchanged"}


def test_prompts_without_anything(spark):
    tasks = spark.createDataFrame([("t",)], "task_id string")
    ranked = spark.createDataFrame([], "task_id string, rank int, experience_id string")
    exps = spark.createDataFrame([("x", "A < B", "do & so", ["w"], ["never"])], "id string, title string, recommendation string, apply_when array<string>, avoid array<string>")
    none = spark.createDataFrame([], "id string, name string, description string")
    assert rendering.prompt_markdown(tasks, ranked, exps, none).first().markdown == ""
    assert rendering.prompt_xml(tasks, ranked, exps).first().xml == "<context>\n</context>"
    hit = spark.createDataFrame([("t", 1, "x")], "task_id string, rank int, experience_id string")
    assert rendering.prompt_markdown(tasks, hit, exps).first().markdown == "## Relevant Past Experiences\n\n### 1. A < B\n\n**When:** w\n\n**Do:** do & so\n\n**Not:** never\n"
    assert '<experience title="A &lt; B">' in rendering.prompt_xml(tasks, hit, exps).first().xml


def test_records(spark):
    eps = spark.createDataFrame([("e1", None), ("e2", "/p/a"), ("e3", "/p/b")], "id string, project_path string")
    exps = spark.createDataFrame([("x", ["gone", "e1", "e3", "e2"]), ("y", None), ("z", [])], "id string, source_episode_ids array<string>")
    assert [tuple(r) for r in records.first_project(exps, eps).collect()] == [("x", "/p/b")]
    assert [r.id for r in records.of_project(exps, eps, F.col("project_path") == "/p/a").collect()] == ["x"]
    df = spark.createDataFrame([("a", "k", "2"), ("b", None, None), ("c", "k", "3")], "id string, domain string, at string")
    assert [r.id for r in records.latest(records.matching(df, domain="", at=None), "at").collect()] == ["c", "a", "b"]
    assert [r.id for r in records.latest(records.matching(df, domain="k"), "at", 1).collect()] == ["c"]


def test_extraction(spark):
    from lorewell.operators import extraction

    good = 'Sure!\n[{"title":"T","triggers":"one","applyWhen":["a","b"],"confidence":"high"},{"title":"U","confidence":0.9},{"title":"V"},{"title":"beyond"}]\nBye'
    rows = spark.createDataFrame([("g", good), ("n", "no json"), ("b", "[{broken]"), ("e", "[]"), ("z", None)], "id string, answer string")
    got = [(r.id, r.place, r.title, r.triggers, r.apply_when, r.confidence) for r in extraction.candidates(rows).orderBy("id", "place").collect()]
    assert got == [("g", 0, "T", ["one"], ["a", "b"], 0.5), ("g", 1, "U", [], [], 0.9), ("g", 2, "V", [], [], 0.5)]
    eps = spark.createDataFrame([("e1", "Fix it", "success", None, ([(0, "Read", None), (1, None, "boom")],)), ("e2", None, None, None, None)], "id string, description string, status string, result string, trace struct<steps:array<struct<step_index:int,action:string,error:string>>>")
    prompts = {r.id: r.prompt for r in extraction.prompts(eps).collect()}
    assert "1. Read\n2.  failed: boom" in prompts["e1"] and "Task: \n" in prompts["e2"]

    def model(prompt):
        if "Fix it" in prompt:
            return '[{"title":"found"}]'
        raise RuntimeError("down")

    found = extraction.candidates(extraction.answered(extraction.prompts(eps), model)).collect()
    assert [(r.id, r.title) for r in found] == [("e1", "found")]
    assert extraction.candidates(extraction.answered(extraction.prompts(eps))).count() == 0
