"""Queries over episodes, experiences, sessions and messages, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import clusters, extraction, incremental, patterns, records, rendering, retrieval, transcripts, upserts
from lorewell.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Pieces of SQL.
E = """e AS (SELECT DISTINCT id, status, started_at, ended_at, task.description AS description, task.domain AS domain, task.task_type AS task_type, task.tags AS tags,
    task.metadata['projectPath'] AS project_path, trace FROM episodes WHERE id IS NOT NULL)"""
X = "x AS (SELECT id AS experience_id, unnest(source_episode_ids) AS episode_id, generate_subscripts(source_episode_ids, 1) AS position FROM experiences)"
FIRST = "f AS (SELECT experience_id, arg_min(project_path, position) AS project_path FROM x JOIN e ON e.id = x.episode_id WHERE project_path IS NOT NULL AND project_path <> '' GROUP BY experience_id)"
NAME = "array_to_string(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda p: p <> '')[-2:], '/')"
SIGN = "array_to_string([coalesce(domain, 'any'), coalesce(task_type, 'any')] || list_sort(coalesce(tags, [])), '::')"
ROLE = """CASE lower(trim(role)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'tool_use' THEN 'tool_use' WHEN 'tool_result' THEN 'tool_result' WHEN 'system' THEN 'system' ELSE 'assistant' END"""
M = f"m AS (SELECT DISTINCT session_id, seq, line_no, {ROLE} AS role, content, tool_name, tool_input, tool_output FROM messages)"
STOP = "'" + "','".join(w.replace("'", "''") for w in T.STOP_WORDS) + "'"
TOKENS = f"list_filter(string_split_regex(replace(lower(coalesce({{0}}, '')), '`', ''''), '[^a-z0-9_'']+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP}))"
CUT = "regexp_replace(t, '(ings?|ed|ers?|s)$', '')"
STEM = f"CASE WHEN length({CUT}) > 1 AND right({CUT}, 1) = left(right({CUT}, 2), 1) THEN left({CUT}, length({CUT}) - 1) ELSE {CUT} END"
STEMS = f"list_distinct(list_transform({TOKENS}, lambda t: {STEM}))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _e(spark: SparkSession, d: str) -> DataFrame:
    return records.episodes(table(spark, d, "episodes"))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.delivered(table(spark, d, "messages"))


@query(f"""WITH {E}, {X}, {FIRST},
    w AS (SELECT project_path, count(*) AS episodes, count(*) FILTER (status = 'success') AS success_count, max(ended_at) AS last_session_at FROM e WHERE project_path <> '' GROUP BY project_path),
    l AS (SELECT project_path, count(*) AS experiences, count(*) FILTER (status = 'active') AS active_experiences FROM f JOIN experiences q ON q.id = f.experience_id GROUP BY project_path)
    SELECT project_path, {NAME.format("project_path")} AS project_name, coalesce(episodes, 0) AS episodes, coalesce(success_count, 0) AS success_count,
        coalesce(experiences, 0) AS experiences, coalesce(active_experiences, 0) AS active_experiences, last_session_at FROM w FULL JOIN l USING (project_path)""")
def stats_by_project(spark, d):
    """AGG-03, JON-02, JON-03, PRJ-20: activity per project."""
    return records.activity_by_project(_e(spark, d), table(spark, d, "experiences"))


@query(f"""WITH {E} SELECT (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM e WHERE status = 'success') AS successes, (SELECT count(*) FROM e WHERE status = 'partial') AS partials,
    (SELECT count(*) FROM e WHERE status = 'failure') AS failures, count(*) AS experiences, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'draft') AS drafts,
    count(*) FILTER (status = 'deprecated') AS deprecated,
    (SELECT count(DISTINCT {SIGN}) FROM e) AS patterns FROM experiences""")
def stats_totals(spark, d):
    """AGG-01, AGG-04: totals and counts by condition; two one-row aggregates."""
    s = lambda v: F.count_if(F.col("status") == v)
    left = _e(spark, d).agg(F.count("*").alias("episodes"), s("success").alias("successes"), s("partial").alias("partials"), s("failure").alias("failures"))
    right = table(spark, d, "experiences").agg(F.count("*").alias("experiences"), s("active").alias("active"), s("draft").alias("drafts"), s("deprecated").alias("deprecated"))
    signs = _e(spark, d).agg(F.countDistinct(T.signature(F.col("domain"), F.col("task_type"), F.col("tags"))).alias("patterns"))
    return left.join(right, F.lit(True)).join(signs, F.lit(True))


@query(f"WITH {E} SELECT 'episodes' AS entity, status, count(*) AS n FROM e GROUP BY status UNION ALL SELECT 'experiences', status, count(*) FROM experiences GROUP BY status")
def stats_by_status(spark, d):
    """AGG-02: dynamic counts by status."""
    return records.counts_by_status(episodes=_e(spark, d), experiences=table(spark, d, "experiences"))


@query(f"""WITH {E}, s AS (SELECT *, {SIGN} AS signature FROM e),
    w AS (SELECT *, row_number() OVER o AS k, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY signature) AS n,
        sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY signature) AS won FROM s WINDOW o AS (PARTITION BY signature ORDER BY started_at, id))
    SELECT signature, max(domain) FILTER (k = 1) AS domain, max(task_type) FILTER (k = 1) AS task_type, count(*) AS support, round(max(won) / count(*), 6) AS success_rate,
        round(CASE WHEN count(*) = 1 THEN 0.3 ELSE 0.7 * max(won) / count(*) + 0.3 * least(count(*) / 5, 1.0) END, 6) AS confidence,
        CASE WHEN bool_or(k >= 3 AND c / k >= 0.6) THEN 'candidate_skill' ELSE 'none' END AS promotion,
        coalesce(max(array_to_string(list_transform(trace.errors, lambda q: q.message), '|')) FILTER (k = 1), '') AS recurring_failures FROM w GROUP BY signature""")
def patterns_mined(spark, d):
    """AGG-05, AGG-06, PRJ-14, MRG-05: one pattern per signature with sticky promotion."""
    return patterns.mined(_e(spark, d))


@query(f"""WITH {E}, s AS (SELECT {SIGN} AS signature, started_at, id, unnest(trace.steps) AS step, generate_subscripts(trace.steps, 1) AS pos FROM e),
    a AS (SELECT signature, step.action AS action, min((started_at, id, pos)) AS first FROM s WHERE step.action IS NOT NULL GROUP BY ALL)
    SELECT signature, row_number() OVER (PARTITION BY signature ORDER BY first, action) AS place, action FROM a""")
def patterns_steps(spark, d):
    """AGG-07: the ordered set union of the steps of a pattern."""
    return patterns.common_steps(_e(spark, d))


@query(f"""WITH {E}, s AS (SELECT {SIGN} AS signature, unnest(trace.tool_calls) AS call FROM e) SELECT signature, call.name AS tool, count(*) AS calls FROM s WHERE call.name IS NOT NULL GROUP BY ALL""")
def patterns_tools(spark, d):
    """AGG-07: the tools of a pattern."""
    return patterns.common_tools(_e(spark, d))


@query("SELECT scope, id, updated_at, count(*) OVER (PARTITION BY scope) AS in_scope FROM experiences WHERE status = 'active'")
def experiences_by_scope(spark, d):
    """AGG-08: experiences with the size of their scope; the counts are aggregated and joined back, as a scope may hold most rows."""
    rows = table(spark, d, "experiences").where("status = 'active'").select("scope", "id", "updated_at")
    return rows.join(rows.groupBy("scope").agg(F.count("*").alias("in_scope")), "scope")


@query(f"WITH {E}, {X}, {FIRST} SELECT coalesce(f.project_path, '__unknown__') AS project, count(*) AS experiences FROM experiences q LEFT JOIN f ON f.experience_id = q.id GROUP BY 1")
def experiences_by_project(spark, d):
    """AGG-09, JON-02: experiences per attributed project, the rest under one name."""
    x = table(spark, d, "experiences")
    first = records.first_project(x, _e(spark, d)).withColumnRenamed("experience_id", "id")
    return x.select("id").join(first, "id", "left").groupBy(F.coalesce("project_path", F.lit("__unknown__")).alias("project")).agg(F.count("*").alias("experiences"))


@query("SELECT id, array_to_string(coalesce(triggers, [])[1:5], ',') AS shown, greatest(len(coalesce(triggers, [])) - 5, 0) AS more FROM experiences")
def experiences_triggers(spark, d):
    """AGG-14: the first five triggers and how many more there are."""
    t = T.empty_if_null(F.col("triggers"))
    return table(spark, d, "experiences").select("id", F.array_join(F.slice(t, 1, 5), ",").alias("shown"), F.greatest(F.size(t) - 5, F.lit(0)).cast("long").alias("more"))


@query(f"WITH {E} SELECT id, status, started_at FROM e WHERE domain = 'backend' AND status = 'success' AND started_at > '2026-01-01' ORDER BY started_at DESC NULLS LAST, id LIMIT 50")
def episodes_listed(spark, d):
    """FLT-01, TOP-06, SRC-15: filtered episodes, newest first; the limit is the request's own."""
    return records.latest(records.matching(_e(spark, d), domain="backend", status="success", task_type=None).where("started_at > '2026-01-01'").select("id", "status", "started_at"), "started_at", 50)


@query("SELECT id, title, updated_at FROM experiences WHERE scope = 'project' AND domain = 'backend' AND status = 'active'")
def experiences_listed(spark, d):
    """FLT-02, SRC-16: experiences of one scope, domain and status."""
    return records.matching(table(spark, d, "experiences"), scope="project", domain="backend", status="active").select("id", "title", "updated_at")


@query("SELECT id FROM experiences WHERE status = 'active' AND (contains(lower(concat_ws(' ', title, problem, recommendation, array_to_string(triggers, ' '), array_to_string(avoid, ' '))), 'sidebar') OR contains(lower(concat_ws(' ', title, problem, recommendation, array_to_string(triggers, ' '), array_to_string(avoid, ' '))), 'webhook'))")
def experiences_search_any(spark, d):
    """FLT-05: active experiences that hold any keyword."""
    return records.search_any(table(spark, d, "experiences").where("status = 'active'"), "Sidebar  webhook", ["title", "problem", "recommendation", "triggers", "avoid"]).select("id")


@query("SELECT id FROM experiences WHERE contains(lower(concat_ws(' ', title, problem, recommendation, array_to_string(triggers, ' '), array_to_string(apply_when, ' '))), 'share one')")
def experiences_search_phrase(spark, d):
    """FLT-06: experiences that hold the whole phrase."""
    return records.search_phrase(table(spark, d, "experiences"), "share one", ["title", "problem", "recommendation", "triggers", "apply_when"]).select("id")


@query("SELECT DISTINCT id, project_path, started_at FROM session_refs WHERE started_at IS NULL OR started_at >= '2026-03-01'")
def sessions_listed(spark, d):
    """FLT-04, TOP-07: sessions from a time on; those without a time pass."""
    s = table(spark, d, "session_refs")
    return s.where("started_at is null or started_at >= '2026-03-01'").select("id", "project_path", "started_at").distinct()


@query("SELECT DISTINCT id FROM session_refs WHERE contains(project_path, 'chogialt') OR contains(project_path, 'riquiaplol')")
def sessions_watched(spark, d):
    """FLT-08: sessions whose path holds any of the filters; a null path fails."""
    cond = F.lit(False)
    for part in ("chogialt", "riquiaplol"):
        cond = cond | F.contains("project_path", F.lit(part))
    return table(spark, d, "session_refs").where(cond).select("id").distinct()


@query()
def projects_last_session(spark, d):
    """PRJ-21, TOP-15, MRG-08, SRC-20: the latest session of each normalised project."""
    return upserts.last_processed(table(spark, d, "session_refs"))


@query("""WITH w AS (SELECT session_id, max(line_end) AS processed_lines, count(DISTINCT delta_number) AS n_deltas FROM deltas WHERE session_id IS NOT NULL GROUP BY session_id),
    t AS (SELECT session_id, max(line_no) + 1 AS total, max(epoch_ms(ingested_at)) AS last_ms FROM messages GROUP BY session_id),
    j AS (SELECT t.session_id, total, coalesce(processed_lines, 0) AS mark, coalesce(n_deltas, 0) + 1 AS delta_number, last_ms, max(last_ms) OVER () AS now_ms FROM t LEFT JOIN w USING (session_id))
    SELECT session_id, CASE WHEN total < mark THEN 0 ELSE mark END AS line_start, total AS line_end, greatest(total - mark, 0) AS new_lines, delta_number,
        CASE WHEN total < mark THEN 'truncated' WHEN total = mark THEN 'unchanged' WHEN now_ms - last_ms < 120000 THEN 'deferred_busy' WHEN total - mark < 30 THEN 'deferred_small' ELSE 'process' END AS decision FROM j""")
def sessions_pending(spark, d):
    """STR-01..03, STR-07, STR-08, FLT-09, FLT-10, JON-08: what each session has beyond its watermark."""
    return incremental.pending(table(spark, d, "messages"), incremental.watermarks(table(spark, d, "deltas")))


@query("SELECT DISTINCT id AS session_id FROM session_refs WHERE id NOT IN (SELECT session_id FROM deltas WHERE session_id IS NOT NULL)")
def sessions_unprocessed(spark, d):
    """FLT-11, SET-05: sessions without any delta."""
    refs = table(spark, d, "session_refs").select(F.col("id").alias("session_id")).distinct()
    return incremental.without(refs, table(spark, d, "deltas"))


@query(f"""WITH {M}, g AS (SELECT session_id, arg_min(content, seq) FILTER (role = 'user' AND content IS NOT NULL) AS first_user, arg_max(content, seq) FILTER (role = 'assistant' AND content IS NOT NULL) AS last_said,
        count(*) FILTER (role = 'assistant') AS n_said, count(*) FILTER (role = 'tool_result') AS n_results, count(*) FILTER (role = 'tool_use') AS n_steps, count(*) AS n_messages,
        count(*) FILTER (role = 'tool_result' AND contains(lower(coalesce(tool_output, content, '')), 'error')) AS n_errors FROM m GROUP BY session_id)
    SELECT session_id, left(first_user, 500) AS description, CASE WHEN n_said = 0 OR contains(lower(coalesce(last_said, '')), 'error') OR contains(lower(coalesce(last_said, '')), 'failed') OR (n_results > 0 AND n_errors > n_results * 0.5) THEN 'partial' ELSE 'success' END AS status,
        left(coalesce(last_said, ''), 1000) AS result, n_steps, n_messages FROM g WHERE first_user <> ''""")
def session_episodes(spark, d):
    """PRJ-09, PRJ-11, PRJ-12, PRJ-13: sessions mapped to episodes."""
    return transcripts.session_episodes(_m(spark, d))


@query(f"""WITH {M}, t AS (SELECT *, sum(CASE WHEN role = 'tool_use' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step FROM m WHERE role IN ('tool_use', 'tool_result'))
    SELECT session_id, CAST(step - 1 AS BIGINT) AS step_no, max(CASE WHEN role = 'tool_use' THEN coalesce(tool_name, content) END) AS action,
        arg_max_null(coalesce(tool_output, content), seq) FILTER (role = 'tool_result') AS output,
        arg_max(left(coalesce(tool_output, content), 200), seq) FILTER (role = 'tool_result' AND contains(lower(coalesce(tool_output, content, '')), 'error')) AS error
    FROM t WHERE step > 0 GROUP BY session_id, step
    UNION ALL SELECT session_id, 0, 'conversation', NULL, NULL FROM m GROUP BY session_id HAVING count(*) FILTER (role = 'tool_use') = 0""")
def session_steps(spark, d):
    """PRJ-10: tool calls with the result that follows them."""
    return transcripts.steps(_m(spark, d))


_TASKS = "t AS (SELECT id AS task_id, description, domain, task_type, list_transform(coalesce(tags, []), lambda g: lower(g)) AS low_tags, lower(concat_ws(' ', coalesce(description, ''), array_to_string(coalesce(tags, []), ' '))) AS hay FROM e WHERE ascii(right(id, 1)) % 10 = 0 AND ascii(left(right(id, 2), 1)) % 10 = 0)"
_RANKED = f"""{E}, {_TASKS}, p AS (SELECT task_id, q.id AS experience_id, CAST((CASE WHEN q.domain <> '' AND q.domain = t.domain THEN 3 ELSE 0 END) + (CASE WHEN q.task_type <> '' AND q.task_type = t.task_type THEN 2 ELSE 0 END)
        + 2 * len(list_filter(coalesce(q.triggers, []), lambda g: contains(hay, lower(g)))) + len(list_filter(coalesce(q.triggers, []), lambda g: list_contains(low_tags, lower(g)))) AS INTEGER) AS score FROM experiences q, t WHERE q.status = 'active'),
    r AS (SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, experience_id) AS INTEGER) AS rank, experience_id, score FROM p WHERE score > 0 QUALIFY rank <= 5)"""


def _tasks(spark, d):
    """The stated query set: the episodes whose id ends in two characters of codes divisible by ten."""
    e = _e(spark, d).where((F.ascii(F.right("id", F.lit(1))) % 10 == 0) & (F.ascii(F.left(F.right("id", F.lit(2)), F.lit(1))) % 10 == 0))
    return e.select(F.col("id").alias("task_id"), "description", "domain", "task_type", "tags")


def _ranked(spark, d):
    return retrieval.retrieve(table(spark, d, "experiences"), _tasks(spark, d))


@query(f"WITH {_RANKED} SELECT * FROM r")
def retrieved(spark, d):
    """JON-01, TOP-01: the five most relevant experiences of each task of a stated query set, against all experiences."""
    return _ranked(spark, d)


@query("SELECT id, title, confidence, array_to_string(triggers, '|') AS triggers, trim(problem) AS problem, trim(recommendation) AS recommendation, array_to_string(coalesce(apply_when, []), '|') AS apply_when FROM experiences")
def markdown_round_trip(spark, d):
    """SNK-02, PRJ-08, RND-06: experiences written as Markdown documents and read back."""
    back = rendering.experience_from_markdown(rendering.experience_markdown(table(spark, d, "experiences")))
    return back.select("id", "title", "confidence", F.array_join("triggers", "|").alias("triggers"), "problem", "recommendation", F.array_join("apply_when", "|").alias("apply_when"))


@query(f"WITH {E}, {X} SELECT q.id, q.confidence FROM experiences q WHERE q.status = 'active' AND q.id IN (SELECT experience_id FROM x JOIN e ON e.id = x.episode_id WHERE lower(e.project_path) = '/users/dev/chogialt/coreiser') ORDER BY confidence DESC, id LIMIT 20")
def project_top(spark, d):
    """JON-04, TOP-03, TOP-05: the most confident active experiences that stem from a project; top 20 is the feature."""
    x = records.of_project(table(spark, d, "experiences").where("status = 'active'"), _e(spark, d), F.lower("project_path") == "/users/dev/chogialt/coreiser")
    return x.select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(20)


@query(f"WITH {E}, {X}, s AS (SELECT id, {SIGN} AS signature, domain, task_type FROM e) SELECT signature, q.id AS experience_id FROM x JOIN s ON s.id = x.episode_id JOIN experiences q ON q.id = x.experience_id WHERE q.domain = s.domain AND q.task_type = s.task_type GROUP BY ALL")
def pattern_experiences(spark, d):
    """JON-05, JON-06, JON-07: experiences of a pattern, by common episodes and equal domain and type."""
    s = _e(spark, d).select(F.col("id").alias("episode_id"), T.signature(F.col("domain"), F.col("task_type"), F.col("tags")).alias("signature"), "domain", "task_type")
    x = table(spark, d, "experiences").select(F.col("id").alias("experience_id"), F.col("domain").alias("xd"), F.col("task_type").alias("xt"))
    j = records.sources_of(table(spark, d, "experiences")).join(s, "episode_id").join(x, "experience_id").where("domain = xd and task_type = xt")
    return j.select("signature", "experience_id").distinct()


@query(f"SELECT id, array_to_string(list_sort({STEMS.format('title')}), ' ') AS stems FROM experiences")
def title_stems(spark, d):
    """PRJ-15, PRJ-16: tokens of titles, stemmed."""
    return table(spark, d, "experiences").select("id", F.array_join(F.array_sort(T.stems(F.col("title"))), " ").alias("stems"))


_SETS = f"""s AS (SELECT id, scope, {STEMS.format('title')} AS a, list_distinct(flatten(list_transform(coalesce(triggers, []), lambda g: {STEMS.format('g')}))) AS b, {STEMS.format('recommendation')} AS c, {STEMS.format('problem')} AS p FROM experiences)"""
_DICE = "CASE WHEN len(x.{0}) > 0 AND len(y.{0}) > 0 THEN 2.0 * len(list_intersect(x.{0}, y.{0})) / (len(x.{0}) + len(y.{0})) ELSE 0 END"
_SIM = f"0.4 * {_DICE.format('a')} + 0.25 * CASE WHEN greatest(len(x.b), len(y.b)) > 0 THEN len(list_intersect(x.b, y.b)) / greatest(len(x.b), len(y.b)) ELSE 0 END + 0.2 * {_DICE.format('c')} + 0.15 * {_DICE.format('p')}"


_CLASS = "k AS (SELECT *, min(id) OVER (PARTITION BY scope, list_sort(a), list_sort(b), list_sort(c), list_sort(p)) AS class_id FROM s)"


@query(f"WITH {_SETS}, {_CLASS} SELECT id, scope, class_id FROM k")
def similar_copies(spark, d):
    """SIM-02: the class of records with equal token sets that each experience belongs to."""
    return retrieval.copies_of(table(spark, d, "experiences")).select("id", "scope", "class_id")


@query(f"WITH {_SETS}, {_CLASS}, h AS (SELECT * FROM k WHERE id = class_id), v AS (SELECT x.scope, x.id AS id_a, y.id AS id_b, round({_SIM}, 6) AS score FROM h x JOIN h y ON x.scope = y.scope AND x.id < y.id) SELECT * FROM v WHERE score >= 0.32")
def similar_pairs(spark, d):
    """SIM-01, SIM-02, SIM-03, JON-09: pairs of classes of one scope of at least the threshold."""
    return retrieval.similar_pairs(table(spark, d, "experiences"))


@query(f"""WITH {_SETS}, q AS (SELECT * FROM s WHERE ascii(right(id, 1)) % 10 = 0 AND ascii(left(right(id, 2), 1)) % 10 = 0), v AS (SELECT y.id AS query_id, x.id, round({_SIM}, 6) AS score FROM s x JOIN q y ON x.id <> y.id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM v WHERE score >= 0.32 QUALIFY rank <= 10""")
def most_similar(spark, d):
    """TOP-02, JON-10: the ten most similar experiences of each of a stated query set, against all."""
    x = table(spark, d, "experiences")
    q = x.where((F.ascii(F.right("id", F.lit(1))) % 10 == 0) & (F.ascii(F.left(F.right("id", F.lit(2)), F.lit(1))) % 10 == 0))
    return retrieval.most_similar(x, q, 10)


@query("""SELECT q.id, coalesce(nullif(c.title, ''), q.title) AS title, coalesce(nullif(c.recommendation, ''), q.recommendation) AS recommendation, CASE WHEN c.id IS NULL THEN q.version ELSE q.version + 1 END AS version,
    len(coalesce(q.history, [])) + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS revisions FROM experiences q LEFT JOIN (SELECT hint_target_id AS id, arg_max(title, candidate_id) AS title, arg_max(recommendation, candidate_id) AS recommendation FROM candidates WHERE hint_target_id IS NOT NULL GROUP BY 1) c ON c.id = q.id""")
def updated_records(spark, d):
    """MRG-03, SNK-03: records replaced by the candidate that names them, with their history."""
    c = table(spark, d, "candidates").where("hint_target_id is not null").groupBy(F.col("hint_target_id").alias("id")).agg(*[F.max_by(x, "candidate_id").alias(x) for x in ("title", "recommendation", "triggers")])
    return upserts.updated(table(spark, d, "experiences"), c).select("id", "title", "recommendation", "version", F.size(F.coalesce("history", F.array())).cast("long").alias("revisions"))


@query("""SELECT id, left(problem, 120) AS problem, left(recommendation, 160) AS recommendation, array_to_string(coalesce(triggers, [])[1:4], '|') AS triggers, array_to_string(list_transform(coalesce(apply_when, [])[1:2], lambda w: left(w, 80)), '|') AS apply_when,
    CASE WHEN length(title) > 20 THEN left(title, 20) || '...' ELSE title END AS short_title, CAST(CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%' AS pct, CASE WHEN length(id) <= 8 THEN '****' ELSE left(id, 4) || '...' || right(id, 4) END AS masked FROM experiences""")
def experiences_compact(spark, d):
    """PRJ-22, PRJ-23, PRJ-25: cut texts, percentages and masked keys."""
    c = F.col
    return table(spark, d, "experiences").select(
        "id", F.left("problem", F.lit(120)).alias("problem"), F.left("recommendation", F.lit(160)).alias("recommendation"), F.array_join(F.slice(T.empty_if_null(c("triggers")), 1, 4), "|").alias("triggers"),
        F.array_join(F.transform(F.slice(T.empty_if_null(c("apply_when")), 1, 2), lambda w: F.left(w, F.lit(80))), "|").alias("apply_when"), T.shortened(c("title"), 20).alias("short_title"),
        T.percent(c("confidence")).alias("pct"), T.masked_key(c("id")).alias("masked"),
    )


@query("""SELECT scope, count(*) AS n, sum(length(coalesce(problem, '')) + length(coalesce(recommendation, ''))) AS chars_before, sum(length(left(coalesce(problem, ''), 120)) + length(left(coalesce(recommendation, ''), 160))) AS chars_after,
    CAST(floor((1 - sum(length(left(coalesce(problem, ''), 120)) + length(left(coalesce(recommendation, ''), 160))) / sum(length(coalesce(problem, '')) + length(coalesce(recommendation, '')))) * 100 + 0.5) AS BIGINT) AS saved_pct FROM experiences GROUP BY scope""")
def compact_savings(spark, d):
    """PRJ-26: how much the cut texts save per scope."""
    n = lambda c, k=None: F.length(F.left(F.coalesce(c, F.lit("")), F.lit(k))) if k else F.length(F.coalesce(c, F.lit("")))
    g = table(spark, d, "experiences").groupBy("scope").agg(F.count("*").alias("n"), F.sum(n("problem") + n("recommendation")).alias("chars_before"), F.sum(n("problem", 120) + n("recommendation", 160)).alias("chars_after"))
    return g.withColumn("saved_pct", F.floor((1 - F.col("chars_after") / F.col("chars_before")) * 100 + 0.5))


@query("SELECT id, confidence, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id) AS n FROM experiences WHERE status = 'active' QUALIFY n = 7")
def experience_nth(spark, d):
    """TOP-08: the seventh of the active experiences by last change; sorted with a limit, not numbered in one task."""
    top = records.latest(table(spark, d, "experiences").where("status = 'active'").select("id", "confidence", "updated_at"), "updated_at", 7)
    return top.orderBy(F.col("updated_at").asc_nulls_first(), F.desc("id")).limit(1).select("id", "confidence", F.lit(7).cast("long").alias("n"))


@query("SELECT candidate_id AS id, CAST(0 AS INTEGER) AS place, title, problem, recommendation, array_to_string(coalesce(triggers, []), '|') AS triggers, array_to_string(coalesce(apply_when, []), '|') AS apply_when, coalesce(confidence, 0.5) AS confidence FROM candidates")
def candidates_read(spark, d):
    """PRJ-17, PRJ-18, PRJ-19, UDF-02: candidates written as a model would answer, and read back."""
    one = F.to_json(F.array(F.struct("title", "problem", "recommendation", "triggers", F.col("apply_when").alias("applyWhen"), "confidence")))
    rows = table(spark, d, "candidates").select(F.col("candidate_id").alias("id"), F.concat(F.lit("Here is what I found:\n"), one, F.lit("\nThat is all.")).alias("answer"))
    out = extraction.candidates(rows)
    return out.select("id", "place", "title", "problem", "recommendation", F.array_join("triggers", "|").alias("triggers"), F.array_join("apply_when", "|").alias("apply_when"), "confidence")


@query("SELECT id AS candidate_id, existing_id FROM (SELECT c.candidate_id AS id, q.id AS existing_id, row_number() OVER (PARTITION BY c.candidate_id ORDER BY q.id) AS n FROM candidates c JOIN experiences q ON lower(trim(q.title)) = lower(trim(c.title)) AND q.scope = c.scope WHERE q.status = 'active') WHERE n = 1")
def same_titles(spark, d):
    """FLT-07 rule 5, SIM-04: the first active record of the same scope and title as a candidate."""
    c = table(spark, d, "candidates").select("candidate_id", "scope", F.lower(F.trim("title")).alias("t"))
    x = table(spark, d, "experiences").where("status = 'active'").groupBy("scope", F.lower(F.trim("title")).alias("t")).agg(F.min("id").alias("existing_id"))
    return c.join(x, ["scope", "t"]).select("candidate_id", "existing_id")
