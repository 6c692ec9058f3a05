"""Queries over what is made of episodes and experiences: skills, prompts, sections, merges, matches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import clusters, extraction, patterns, records, rendering, retrieval, skills, transcripts, upserts
from lorewell.plans import activity
from lorewell.plans.activity import _RANKED, _SETS, _SIM, E, M, _e, _m, _ranked, _tasks
from lorewell.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- skills

_SKILLS = f"""sk AS (SELECT 'skill_' || signature AS id, signature AS name, 'Pattern ' || signature || ' reached ' || support || ' episodes with ' || CAST(CAST(floor(success_rate * 100 + 0.5) AS INTEGER) AS VARCHAR) || '% success' AS description,
    domain, task_type, CASE WHEN coalesce(domain, '') <> '' THEN 'domain' ELSE 'global' END AS scope, list_filter([domain, task_type], lambda x: x IS NOT NULL) AS triggers, '0.1.0' AS version,
    CASE WHEN support >= 5 THEN 'active' ELSE 'draft' END AS status, confidence FROM ({activity.SQL["patterns_mined"]}) WHERE promotion = 'candidate_skill')"""


def _skills(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of all promoted patterns, those of five episodes or more activated."""
    drawn = skills.drafts(patterns.mined(_e(spark, d)))
    return skills.with_status(drawn, drawn.where("support >= 5"), "active").drop("support")


@query(f"WITH {_SKILLS} SELECT id, name, description, domain, task_type, scope, array_to_string(triggers, '|') AS triggers, version, status, confidence FROM sk")
def skills_registered(spark, d):
    """MRG-06, SNK-05, SNK-06: draft skills of patterns, and their activation."""
    return _skills(spark, d).withColumn("triggers", F.array_join("triggers", "|"))


@query(f"WITH {_SKILLS} SELECT id, name, description, task_type FROM sk WHERE status = 'active' AND domain = 'backend'")
def skill_summaries(spark, d):
    """SRC-18, FLT-03: summaries of skills by domain and status."""
    return skills.summaries(_skills(spark, d), domain="backend", status="active").select("id", "name", "description", "task_type")


@query(f"WITH {_SKILLS} SELECT id, name FROM sk WHERE status = 'active' ORDER BY id LIMIT 10")
def skills_top(spark, d):
    """TOP-04: the first ten active skills; the limit is the feature."""
    return skills.top_summaries(_skills(spark, d)).select("id", "name")


@query(f"""WITH {_SKILLS} SELECT id, concat_ws(chr(10), '---', 'name: ' || name, 'description: ' || description, CASE WHEN domain <> '' THEN 'domain: ' || domain END, CASE WHEN task_type <> '' THEN 'taskType: ' || task_type END,
    'triggers: [' || array_to_string(list_transform(triggers, lambda t: '"' || t || '"'), ', ') || ']', 'version: ' || version, 'status: ' || status, '---') || chr(10) || chr(10) || description || chr(10) AS markdown FROM sk""")
def skill_documents(spark, d):
    """RND-06: skills as documents."""
    return skills.skill_markdown(_skills(spark, d))


@query(f"WITH {_SKILLS} SELECT id, 'site' AS target, CASE WHEN status = 'active' THEN 'conflict' ELSE 'written' END AS action FROM sk")
def skills_exported(spark, d):
    """SNK-09, SRC-19: an export to a target where the active skills lie already."""
    s = _skills(spark, d)
    return skills.exported(s, s.where("status = 'active'").select("id", F.lit("site").alias("target")), "site")


# --- prompts, sections and texts

_SHOWN = "sh AS (SELECT * FROM sk WHERE status = 'active' ORDER BY id LIMIT 10)"
_LIST = "array_to_string(coalesce({0}, []), '; ')"
_ESC = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""WITH {_RANKED}, {_SKILLS}, {_SHOWN}, l AS (SELECT task_id, rank, concat_ws(chr(10), '### ' || rank || '. ' || coalesce(title, '') || chr(10), '**When:** ' || {_LIST.format('apply_when')} || chr(10), '**Do:** ' || coalesce(recommendation, '') || chr(10),
        CASE WHEN len(avoid) > 0 THEN '**Not:** ' || {_LIST.format('avoid')} || chr(10) END) AS line FROM r JOIN experiences q ON q.id = r.experience_id),
    b AS (SELECT task_id, '## Relevant Past Experiences' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS body FROM l GROUP BY task_id),
    k AS (SELECT '## Available Skills' || chr(10) || chr(10) || string_agg('- **' || name || '**: ' || description, chr(10) ORDER BY id) || chr(10) AS entries FROM sh)
    SELECT task_id, concat_ws(chr(10), body, entries) AS markdown FROM t LEFT JOIN b USING (task_id) CROSS JOIN k""")
def rendered_markdown(spark, d):
    """RND-01: the prompt block of each task, with skills; tasks without a hit have the skills alone."""
    return rendering.prompt_markdown(_tasks(spark, d), _ranked(spark, d), table(spark, d, "experiences"), skills.top_summaries(_skills(spark, d)))


@query(f"""WITH {_RANKED}, {_SKILLS}, {_SHOWN}, l AS (SELECT task_id, rank, concat_ws(chr(10), '    <experience title="' || {_ESC.format('title')} || '">', '      <when>' || {_ESC.format(_LIST.format('apply_when'))} || '</when>', '      <do>' || {_ESC.format('recommendation')} || '</do>',
        CASE WHEN len(avoid) > 0 THEN '      <not>' || {_ESC.format(_LIST.format('avoid'))} || '</not>' END, '    </experience>') AS line FROM r JOIN experiences q ON q.id = r.experience_id),
    b AS (SELECT task_id, '  <experiences>' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10) || '  </experiences>' AS body FROM l GROUP BY task_id),
    k AS (SELECT '  <skills>' || chr(10) || string_agg('    <skill name="' || {_ESC.format('name')} || '">' || {_ESC.format('description')} || '</skill>', chr(10) ORDER BY id) || chr(10) || '  </skills>' AS entries FROM sh)
    SELECT task_id, concat_ws(chr(10), '<context>', body, entries, '</context>') AS xml FROM t LEFT JOIN b USING (task_id) CROSS JOIN k""")
def rendered_xml(spark, d):
    """RND-02, PRJ-24: the same as XML."""
    return rendering.prompt_xml(_tasks(spark, d), _ranked(spark, d), table(spark, d, "experiences"), skills.top_summaries(_skills(spark, d)))


@query(f"""WITH {_RANKED}, {_SKILLS}, {_SHOWN}, l AS (SELECT task_id, rank, to_json(struct_pack(title := coalesce(title, ''), recommendation := coalesce(recommendation, ''), applyWhen := coalesce(apply_when, []), avoid := coalesce(avoid, []))) AS line FROM r JOIN experiences q ON q.id = r.experience_id),
    b AS (SELECT task_id, string_agg(line, ',' ORDER BY rank) AS body FROM l GROUP BY task_id), k AS (SELECT string_agg(to_json(struct_pack(name := name, description := description)), ',' ORDER BY id) AS entries FROM sh)
    SELECT task_id, '{{"experiences":[' || coalesce(body, '') || '],"skillSummaries":[' || coalesce(entries, '') || ']}}' AS json FROM t LEFT JOIN b USING (task_id) CROSS JOIN k""")
def rendered_json(spark, d):
    """RND-03: the same as one JSON document."""
    return rendering.prompt_json(_tasks(spark, d), _ranked(spark, d), table(spark, d, "experiences"), skills.top_summaries(_skills(spark, d)))


_STAMP = "2026-01-01T00:00:00.000Z"
_CONTENT = f"""{_SKILLS}, {_SHOWN}, tops AS (SELECT * FROM experiences WHERE status = 'active' AND scope = 'global' ORDER BY confidence DESC NULLS LAST, id LIMIT 20),
    c AS (SELECT concat_ws(chr(10), (SELECT '## Learned Experiences' || chr(10) || chr(10) || string_agg(concat_ws(chr(10), '### ' || coalesce(title, ''), '- **When:** ' || {_LIST.format('apply_when')}, '- **Do:** ' || coalesce(recommendation, ''),
        CASE WHEN len(avoid) > 0 THEN '- **Not:** ' || {_LIST.format('avoid')} END, ''), chr(10) ORDER BY confidence DESC NULLS LAST, id) FROM tops),
        (SELECT '## Available Skills' || chr(10) || chr(10) || string_agg('- **' || name || '**: ' || description || CASE WHEN len(triggers) > 0 THEN ' (triggers: ' || array_to_string(triggers, ', ') || ')' ELSE '' END, chr(10) ORDER BY id) || chr(10) FROM sh),
        '_Last synced: {_STAMP}_') AS content)"""
_OLD = "# Notes\n\n  <!-- lessons:start -->\nold\n<!-- lessons:end -->\nkept\n"
_BLOCK = "'<!-- learned:start -->' || chr(10) || content || chr(10) || '<!-- learned:end -->'"


@query(f"""WITH {_CONTENT} SELECT 'empty' AS target, {_BLOCK} || chr(10) AS document, 'created' AS action FROM c UNION ALL SELECT 'plain', 'text' || chr(10) || chr(10) || {_BLOCK} || chr(10), 'updated' FROM c
    UNION ALL SELECT 'older', '# Notes' || chr(10) || chr(10) || {_BLOCK} || chr(10) || 'kept' || chr(10), 'updated' FROM c UNION ALL SELECT 'same', 'a' || chr(10) || {_BLOCK} || chr(10) || 'b', 'unchanged' FROM c""")
def sections_synced(spark, d):
    """RND-04, RND-05, RND-07, SNK-08, TOP-03: the managed section of four documents: empty, plain, with older markers, and up to date."""
    active = table(spark, d, "experiences").where("status = 'active' and scope = 'global'")
    content = rendering.managed_content(active, skills.top_summaries(_skills(spark, d)), _STAMP)
    block = F.concat(F.lit("a\n" + rendering.START + "\n"), "content", F.lit("\n" + rendering.END + "\nb"))
    docs = F.array(*[F.struct(F.lit(t).alias("target"), doc.alias("document")) for t, doc in (("empty", F.lit("")), ("plain", F.lit("text\n \n")), ("older", F.lit(_OLD)), ("same", block))])
    return rendering.synced(content.select("content", "experiences", "skills", F.inline(docs)))


@query("""SELECT id, '## ' || coalesce(title, '') || ' (' || format('{:.2f}', coalesce(confidence, 0)) || ')' || chr(10) || coalesce(recommendation, '') || chr(10) || 'Apply when: ' || array_to_string(coalesce(apply_when, []), ', ') AS text
    FROM experiences WHERE status = 'active' AND contains(lower(concat_ws(' ', title, problem, recommendation, array_to_string(triggers, ' '), array_to_string(avoid, ' '))), 'webhook')""")
def search_texts(spark, d):
    """RND-08: search results as text."""
    return rendering.search_texts(records.search_any(table(spark, d, "experiences").where("status = 'active'"), "webhook", ["title", "problem", "recommendation", "triggers", "avoid"]))


# --- merges and matches

_ORDER = "length(coalesce(recommendation, '')) DESC, coalesce(confidence, 0) DESC, id"
_SCOPED = f"""{_SETS.replace('FROM experiences)', "FROM experiences WHERE status = 'active' AND scope IN ('global', 'project'))")}, v AS MATERIALIZED (SELECT x.id AS id_a, y.id AS id_b FROM s x JOIN s y ON x.scope = y.scope AND x.id < y.id WHERE round({_SIM}, 6) >= 0.32),
    g AS (SELECT id_a AS u, id_b AS v FROM v UNION ALL SELECT id_b, id_a FROM v), r(u, c) AS (SELECT id, id FROM s UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.u WHERE r.c < g.v), k AS (SELECT u AS id, min(c) AS component FROM r GROUP BY u)"""


def _scoped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "experiences").where("status = 'active' and scope in ('global', 'project')")
    return x, clusters.clustered(x, retrieval.links(x))


@query(f"WITH RECURSIVE {_SCOPED} SELECT id, component FROM k")
def similar_clusters(spark, d):
    """CLU-01: clusters of similar active experiences within the global and project scopes, single ones included."""
    return _scoped(spark, d)[1]


@query(f"""WITH RECURSIVE {_SCOPED}, t AS (SELECT k.component, q.*, row_number() OVER (PARTITION BY component ORDER BY {_ORDER.replace(', id', ', q.id')}) AS n, count(*) OVER (PARTITION BY component) AS size FROM k JOIN experiences q ON q.id = k.id),
    f AS (SELECT component, what, v, min(n * 1000 + pl) AS place FROM (SELECT component, n, 't' AS what, unnest(triggers) AS v, generate_subscripts(triggers, 1) AS pl FROM t UNION ALL SELECT component, n, 'e', unnest(evidence), generate_subscripts(evidence, 1) FROM t
        UNION ALL SELECT component, n, 's', unnest(source_episode_ids), generate_subscripts(source_episode_ids, 1) FROM t UNION ALL SELECT component, n, 'a', unnest(apply_when), generate_subscripts(apply_when, 1) FROM t) WHERE v IS NOT NULL GROUP BY ALL),
    u AS (SELECT component, string_agg(v, '|' ORDER BY place) FILTER (what = 't') AS t, string_agg(v, '|' ORDER BY place) FILTER (what = 'e') AS e, string_agg(v, '|' ORDER BY place) FILTER (what = 's') AS s, string_agg(v, '|' ORDER BY place) FILTER (what = 'a') AS a FROM f GROUP BY component)
    SELECT t.id, t.component, h.id AS primary_id, CASE WHEN t.n = 1 THEN 'keep' ELSE 'merge' END AS role, CASE WHEN t.n = 1 THEN t.status ELSE 'deprecated' END AS status,
        CASE WHEN t.n = 1 THEN coalesce(u.t, '') ELSE array_to_string(coalesce(t.triggers, []), '|') END AS triggers, CASE WHEN t.n = 1 THEN coalesce(u.e, '') ELSE array_to_string(coalesce(t.evidence, []), '|') END AS evidence,
        CASE WHEN t.n = 1 THEN coalesce(u.s, '') ELSE array_to_string(coalesce(t.source_episode_ids, []), '|') END AS source_episode_ids, CASE WHEN t.n = 1 THEN coalesce(u.a, '') ELSE array_to_string(coalesce(t.apply_when, []), '|') END AS apply_when
    FROM t JOIN t h ON h.component = t.component AND h.n = 1 LEFT JOIN u ON u.component = t.component WHERE t.size > 1""")
def merge_plan(spark, d):
    """CLU-03, TOP-09, SET-01: what a merge makes of each cluster: the record that stays with united arrays, the others deprecated."""
    plan = clusters.merge_plan(*_scoped(spark, d))
    return plan.select("id", "component", "primary_id", "role", "status", *[F.array_join(c, "|").alias(c) for c in clusters.UNITED])


@query("""WITH c AS (SELECT * FROM candidates WHERE hint_action = 'merge'), h AS (SELECT hint_target_id AS id, count(*) AS merged FROM c JOIN experiences q ON q.id = hint_target_id GROUP BY 1),
    n AS (SELECT hint_target_id AS id, candidate_id AS src, 'e' AS what, unnest(evidence) AS v, generate_subscripts(evidence, 1) AS pl FROM c UNION ALL SELECT hint_target_id, candidate_id, 't', unnest(triggers), generate_subscripts(triggers, 1) FROM c
        UNION ALL SELECT id, '', 'e', unnest(evidence), generate_subscripts(evidence, 1) FROM experiences UNION ALL SELECT id, '', 't', unnest(triggers), generate_subscripts(triggers, 1) FROM experiences),
    f AS (SELECT id, what, v, min((src, pl)) AS place FROM n WHERE v IS NOT NULL GROUP BY ALL),
    u AS (SELECT id, string_agg(v, '|' ORDER BY place) FILTER (what = 'e') AS evidence, string_agg(v, '|' ORDER BY place) FILTER (what = 't') AS triggers FROM f GROUP BY id)
    SELECT h.id, q.recommendation, coalesce(u.evidence, '') AS evidence, coalesce(u.triggers, '') AS triggers, true AS needs_review, merged FROM h JOIN experiences q ON q.id = h.id LEFT JOIN u ON u.id = h.id""")
def merged_by_hint(spark, d):
    """MRG-02, JON-11, SET-01: the records that candidates name, with what these add."""
    m = upserts.merged_by_hint(table(spark, d, "experiences"), table(spark, d, "candidates"))
    return m.withColumns({c: F.array_join(c, "|") for c in ("evidence", "triggers")})


_C = _SETS.replace("s AS (SELECT id, scope,", "cs AS (SELECT candidate_id AS id, scope,").replace("FROM experiences)", "FROM candidates)")


@query(f"WITH {_SETS}, {_C}, v AS (SELECT x.id, y.id AS match_id, round({_SIM}, 6) AS score FROM cs x, s y) SELECT id, match_id, score FROM v WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1")
def candidate_matches(spark, d):
    """JON-10: the most similar experience of every candidate."""
    return retrieval.best_matches(table(spark, d, "candidates").withColumn("id", F.col("candidate_id")), table(spark, d, "experiences"))


@query("""SELECT candidate_id AS id, title, coalesce(nullif(scope, ''), 'global') AS scope, 1 AS version, 'active' AS status, coalesce(confidence, 0.5) AS confidence FROM candidates""")
def candidate_records(spark, d):
    """PRJ-18: candidates as records, with the values of a new one."""
    c = table(spark, d, "candidates")
    return extraction.as_records(c.withColumnRenamed("candidate_id", "id")).select("id", "title", "scope", "version", "status", "confidence")


# --- extraction, deltas and counters

_PROMPT = """concat_ws(chr(10), 'Give at most 3 reusable lessons as a JSON array of objects.', 'Task: ' || coalesce(description, ''), 'Status: ' || coalesce(status, ''),
    array_to_string(list_transform(trace.steps, lambda s, i: i || '. ' || coalesce(s.action, '') || CASE WHEN s.error IS NOT NULL THEN ' failed: ' || s.error ELSE '' END), chr(10)), 'Result: ' || coalesce(result, ''))"""
_E = E.replace("trace FROM", "trace, result FROM")


@query(f"WITH {_E} SELECT id, {_PROMPT} AS prompt FROM e")
def extraction_prompts(spark, d):
    """UDF-02, UDF-03: the request for each episode, as text."""
    return extraction.prompts(_e(spark, d))


def _first_step(prompt: str) -> str:
    """A stand-in for a model, which names the task of the request."""
    task = next((x[6:] for x in prompt.split("\n") if x.startswith("Task: ")), "")
    return "Sure:\n" + json.dumps([{"title": task[:40], "problem": "p", "recommendation": "r", "triggers": "one", "confidence": "0.7"}]) + "\nDone."


@query(f"WITH {_E} SELECT id, CAST(0 AS INTEGER) AS place, left(split_part(coalesce(description, ''), chr(10), 1), 40) AS title, 'one' AS triggers, CAST(0.7 AS DOUBLE) AS confidence FROM e")
def extracted(spark, d):
    """UDF-01, PRJ-17, PRJ-19, TOP-10: every episode asked of a function in place of a model, and its answers read."""
    found = extraction.candidates(extraction.answered(extraction.prompts(_e(spark, d)), _first_step))
    return found.select("id", "place", "title", F.array_join("triggers", "|").alias("triggers"), "confidence")


@query(f"""WITH {M}, d AS (SELECT DISTINCT session_id, delta_number, line_start, line_end FROM deltas),
    g AS (SELECT d.*, arg_min_null(coalesce(content, ''), seq) FILTER (role = 'user') AS first_user, count(*) FILTER (role = 'user') AS n_user, arg_max(content, seq) FILTER (role = 'assistant' AND content IS NOT NULL) AS last_said, count(*) FILTER (role = 'assistant') AS n_said,
        count(*) FILTER (role = 'tool_result') AS n_results, count(*) FILTER (role = 'tool_result' AND contains(lower(coalesce(tool_output, content, '')), 'error')) AS n_errors, count(*) FILTER (role = 'tool_use') AS n_steps, count(*) AS n_messages
        FROM d JOIN m ON m.session_id = d.session_id AND m.line_no >= line_start AND m.line_no < line_end GROUP BY ALL)
    SELECT session_id, delta_number, line_start, line_end, CASE WHEN n_user > 0 THEN left(first_user, 500) ELSE '<continuation of session ' || session_id || ', delta ' || delta_number || '>' END AS description,
        CASE WHEN n_said = 0 OR contains(lower(coalesce(last_said, '')), 'error') OR contains(lower(coalesce(last_said, '')), 'failed') OR (n_results > 0 AND n_errors > n_results * 0.5) THEN 'partial' ELSE 'success' END AS status,
        left(coalesce(last_said, ''), 1000) AS result, n_steps, n_messages FROM g""")
def delta_episodes(spark, d):
    """PRJ-13: each delta mapped to an episode."""
    return transcripts.delta_episodes(table(spark, d, "deltas"), _m(spark, d))


@query(f"""WITH {E}, w AS (SELECT id, domain, task_type, started_at, unnest(trace.errors) AS err FROM e) SELECT domain, task_type, err.code AS code, count(DISTINCT id) AS episodes, min(started_at) AS first_at, max(started_at) AS last_at
    FROM w WHERE err.code IS NOT NULL GROUP BY domain, task_type, err.code HAVING count(DISTINCT id) > 1""")
def repeated_errors(spark, d):
    """DSG-04 (designed only): error codes that several episodes of a type share."""
    w = _e(spark, d).select("id", "domain", "task_type", "started_at", F.explode("trace.errors.code").alias("code")).where("code is not null")
    return w.groupBy("domain", "task_type", "code").agg(F.countDistinct("id").alias("episodes"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")).where("episodes > 1")


@query(f"""WITH {E.replace("task.metadata['projectPath'] AS project_path", "task.metadata['projectPath'] AS project_path, task.metadata['source'] AS source")}, w AS (SELECT source, project_path, count(*) AS sessions, count(*) FILTER (status = 'success') AS complete, count(*) FILTER (status = 'failure') AS errors FROM e GROUP BY ALL)
    SELECT source, sum(sessions)::BIGINT AS sessions, sum(complete)::BIGINT AS complete, sum(errors)::BIGINT AS errors, count(DISTINCT project_path) FILTER (errors > 0) AS projects_with_errors FROM w GROUP BY source""")
def combined_results(spark, d):
    """AGG-10, AGG-11, AGG-12: the counters of each source's projects added up."""
    raw = table(spark, d, "episodes").where("id is not null").groupBy("id").agg(F.first("status").alias("status"), F.first(F.col("task.metadata")["source"]).alias("source"), F.first(F.col("task.metadata")["projectPath"]).alias("project_path"))
    one = raw.groupBy("source", "project_path").agg(F.count("*").alias("sessions"), F.count_if(F.col("status") == "success").alias("complete"), F.count_if(F.col("status") == "failure").alias("errors"))
    return one.groupBy("source").agg(F.sum("sessions").alias("sessions"), F.sum("complete").alias("complete"), F.sum("errors").alias("errors"), F.countDistinct(F.when(F.col("errors") > 0, F.col("project_path"))).alias("projects_with_errors"))
