"""Queries of the training-text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import batch_dedup, contamination, conversations, encoding, near_dup, packing, personal, splitting
from lorewell.sources.tables import table

_TEXTS = ["title", "problem", "recommendation"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Deltas that had to be split."""
    return splitting.oversized(splitting.split_deltas(table(spark, d, "deltas"), table(spark, d, "messages")))


def p2_delta_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_deltas(table(spark, d, "deltas"), table(spark, d, "messages"))


def p2_message_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_messages(table(spark, d, "messages"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select(F.col("candidate_id").alias("id"), batch_dedup.record_words(_TEXTS).alias("words"), F.struct("batch_no", "received_at").alias("turn"))


def _history(spark: SparkSession, d: str) -> batch_dedup.History:
    return batch_dedup.new_history(spark, table(spark, d, "experiences").select("id", batch_dedup.record_words(_TEXTS).alias("words")))


def _repeats(found: DataFrame) -> DataFrame:
    return found.select(F.least("new_id", "old_id").alias("id_a"), F.greatest("new_id", "old_id").alias("id_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that repeat an accepted record, with the records they repeat; all batches as one, in their order."""
    return _repeats(_history(spark, d).add(_candidates(spark, d)))


def p3_reopened(spark: SparkSession, d: str) -> DataFrame:
    """The same in two lots of batches, the second against the history opened again from its path."""
    path, new = _history(spark, d).path, _candidates(spark, d)
    late = F.coalesce(F.col("turn.batch_no") > 6, F.lit(False))
    first = batch_dedup.History.open(spark, path).add(new.where(~late))
    return _repeats(first.unionByName(batch_dedup.History.open(spark, path).add(new.where(late))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar experiences."""
    return near_dup.NearDuplicates(table(spark, d, "experiences"), "id", near_dup.experience_texts()).all_pairs().select("id_a", "id_b")


def p4_linked(spark: SparkSession, d: str) -> DataFrame:
    """Each experience with its class, the copies in it and the classes it is similar to."""
    return near_dup.NearDuplicates(table(spark, d, "experiences"), "id", near_dup.experience_texts()).linked()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each experience with its class and the group of classes that similarity connects."""
    return near_dup.NearDuplicates(table(spark, d, "experiences"), "id", near_dup.experience_texts()).groups()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop."""
    return conversations.judged(table(spark, d, "session_refs"), table(spark, d, "messages")).where("reason is not null").select("session_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The ordered messages of the sessions that are kept."""
    return conversations.conversations(table(spark, d, "session_refs"), table(spark, d, "messages"))


def p5_threads(spark: SparkSession, d: str) -> DataFrame:
    """Forum threads, which have no sessions, split where they were silent for long, with roles, without those nobody answered."""
    return conversations.threads(table(spark, d, "documents"), "thread_id", "posted_at", "author", "doc_id")


def _masked(spark: SparkSession, d: str) -> DataFrame:
    texts = personal.project_texts(table(spark, d, "messages"), table(spark, d, "experiences"))
    return personal.masked(texts, table(spark, d, "people"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of personal information in each record."""
    return _masked(spark, d).select("source_field", "record_key", F.explode("kinds").alias("kind")).distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold personal information, with placeholders."""
    return _masked(spark, d).select("source_field", "record_key", "part", "masked")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document."""
    return packing.pack(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far the containers are from the target proportions, by source."""
    return packing.mixture(packing.pack(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with the evaluation items they contain."""
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim passages and their places."""
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The posts that are left once those with passages are removed."""
    return contamination.without_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items")).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with a garbled part."""
    return encoding.repaired(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled posts with their text as far as it can be restored."""
    return encoding.repaired(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_delta_pieces, p2_message_pieces, p3_found, p3_reopened, p4_found, p4_linked, p4_groups, p5_found, p5_conversations, p5_threads,
        p6_found, p6_masked, p8_containers, p8_mixture, p9_found, p9_passages, p9_kept, p10_found, p10_restored,
    )
}

_ONE_EACH = "SELECT DISTINCT session_id, seq, line_no, role, content FROM messages"

_SET = "list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', title, problem, recommendation, array_to_string(triggers, ' '))), '[^a-z0-9]+'), lambda x: x <> ''))"
# All similar pairs, then one step of recursion for each candidate that resembles an earlier one; "gone" are those that repeat something.
_REPEATS = f"""
        WITH RECURSIVE w AS (
            SELECT id, 0 AS pos, {_SET} AS ws FROM experiences
            UNION ALL SELECT candidate_id, row_number() OVER (ORDER BY batch_no, received_at, candidate_id), {_SET} FROM candidates),
        t AS (SELECT id, pos, len(ws) AS n, unnest(ws) AS word FROM w),
        c AS (
            SELECT a.id AS new_id, a.pos AS pos, b.id AS old_id, b.pos AS old_pos, a.n + b.n AS total, count(*) AS k
            FROM t a JOIN t b ON a.word = b.word AND a.pos > b.pos GROUP BY ALL),
        s AS (SELECT * FROM c WHERE k >= 0.6 * (total - k) - 1e-9),
        known AS (SELECT DISTINCT pos FROM s WHERE old_pos = 0),
        e AS (SELECT pos, list(old_pos) AS olds, row_number() OVER (ORDER BY pos) AS i FROM s WHERE old_pos > 0 AND pos NOT IN (SELECT pos FROM known) GROUP BY pos),
        turns AS (
            SELECT CAST(0 AS BIGINT) AS i, coalesce((SELECT list(pos) FROM known), []) AS gone
            UNION ALL
            SELECT e.i, CASE WHEN len(list_filter(e.olds, lambda o: NOT list_contains(turns.gone, o))) > 0 THEN list_append(turns.gone, e.pos) ELSE turns.gone END
            FROM turns JOIN e ON e.i = turns.i + 1),
        lost AS (SELECT DISTINCT unnest(gone) AS pos FROM turns WHERE i = (SELECT max(i) FROM turns))
        SELECT DISTINCT least(new_id, old_id) AS id_a, greatest(new_id, old_id) AS id_b FROM s WHERE old_pos = 0 OR old_pos NOT IN (SELECT pos FROM lost)"""

_SETS = """
        w AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', title, problem, recommendation)), '[^a-z0-9]+'), lambda x: x <> ''))) AS ws FROM experiences),
        k AS (SELECT id, ws, min(id) OVER (PARTITION BY ws) AS class_id FROM w WHERE len(ws) > 0),
        t AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM k WHERE id = class_id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS total, count(*) AS shared FROM t a JOIN t b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
        v AS (SELECT id_a, id_b FROM c WHERE shared >= 0.6 * (total - shared) - 1e-9),
        g AS (SELECT id_a AS a, id_b AS b FROM v UNION ALL SELECT id_b, id_a FROM v)"""
# The entities that the posts hold, decoded; tags before them.
_PLAIN = "regexp_replace(text, '<[^<>]*>|\\[[^\\[\\]]*\\]', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "`"), ("&#x27;", "`"), ("&apos;", "`"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_char}')"
_WORDS = f"list_filter(string_split_regex(lower({_PLAIN}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_LEAKS = f"""
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), e AS (SELECT item_id, {_WORDS} AS ws FROM eval_items),
        x AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 11], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM d)),
        y AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS p FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM e)),
        l AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (p))"""
_SPELLED = "lower(trim(regexp_replace(role, '[\\s\\p{Z}]+', ' ', 'g')))"

SQL = {
    "p2_found": f"""
        WITH m AS ({_ONE_EACH}), d AS (SELECT DISTINCT session_id, delta_number, line_start, line_end FROM deltas)
        SELECT d.session_id, d.delta_number FROM d JOIN m ON m.session_id = d.session_id AND m.line_no >= d.line_start AND m.line_no < d.line_end
        GROUP BY d.session_id, d.delta_number HAVING sum(length(m.content)) > 3000""",
    "p3_found": _REPEATS,
    "p3_reopened": _REPEATS,
    "p4_linked": f"""
        WITH {_SETS}, n AS (SELECT a AS class_id, count(*) AS links FROM g GROUP BY a)
        SELECT id, class_id, count(*) OVER (PARTITION BY class_id) AS copies, coalesce(links, 0) AS links FROM k LEFT JOIN n USING (class_id)""",
    "p4_groups": f"""
        WITH RECURSIVE {_SETS}, r(u, c) AS (SELECT class_id, class_id FROM k UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.u WHERE r.c < g.b), m AS (SELECT u, min(c) AS group_id FROM r GROUP BY u)
        SELECT id, class_id, group_id FROM k JOIN m ON m.u = k.class_id""",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM l",
    "p9_kept": f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)",
    "p4_found": """
        WITH w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', title, problem, recommendation)), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM experiences),
        t AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM w),
        c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n)
        SELECT id_a, id_b FROM c WHERE k >= 0.6 * (na + nb - k) - 1e-9""",
    "p5_found": f"""
        WITH m AS ({_ONE_EACH}), s AS (SELECT DISTINCT id AS session_id FROM session_refs),
        shape AS (SELECT session_id, count(DISTINCT seq) AS n, min(seq) AS low, max(seq) AS high FROM m GROUP BY session_id),
        said AS (
            SELECT session_id, seq, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'U' WHEN lower(trim(role)) IN ('assistant', 'model', 'ai', 'gemini') THEN 'A' END AS who
            FROM m WHERE NOT (content IS NULL OR regexp_full_match(content, '[\\s\\p{{Z}}\\p{{Cf}}]*'))),
        turns AS (SELECT session_id, string_agg(who, '' ORDER BY seq) AS t FROM said WHERE who IS NOT NULL GROUP BY session_id)
        SELECT s.session_id FROM s LEFT JOIN shape USING (session_id) LEFT JOIN turns USING (session_id)
        WHERE shape.n IS NULL OR low <> 0 OR n <> high + 1 OR t IS NULL OR NOT contains(t, 'U') OR NOT contains(t, 'A') OR contains(t, 'UU') OR t LIKE '%U'""",
}

SQL["p5_conversations"] = f"""
        WITH dropped AS ({SQL["p5_found"]}), kept AS (SELECT DISTINCT id AS session_id FROM session_refs WHERE id NOT IN (SELECT session_id FROM dropped)),
        f AS (SELECT session_id, seq, arg_min({{"role": role, "content": content, "sent_ms": epoch_ms(ingested_at)}}, (ingested_at, message_id)) AS m FROM messages SEMI JOIN kept USING (session_id) GROUP BY session_id, seq)
        SELECT session_id, seq, CASE WHEN {_SPELLED.replace("role", "m.role")} IN ('user', 'human') THEN 'user' WHEN {_SPELLED.replace("role", "m.role")} IN ('assistant', 'model', 'ai', 'gemini') THEN 'assistant' ELSE {_SPELLED.replace("role", "m.role")} END AS role,
            m.content AS content, m.sent_ms AS sent_ms FROM f"""
