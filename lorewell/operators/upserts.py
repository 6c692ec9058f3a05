"""Changes of keyed records expressed as whole-table plans: merge, update, upsert, advance of markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.timestamps import parse


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of ``changes`` in place of those of the same key; new keys are added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def merged_by_hint(experiences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, recommendation, evidence, triggers, needs_review, merged): experiences into which candidates that name them are merged.

    Evidence and triggers become the ordered union, the record's own values first, then those of the candidates by
    their ids; the record's own recommendation stays. Several candidates of one record are merged together, so none
    is lost. Nulls in arrays are dropped.
    """
    into = candidates.where("hint_action = 'merge' and hint_target_id is not null").select(F.col("hint_target_id").alias("id"), F.col("candidate_id").alias("by"), "evidence", "triggers")
    hit = into.groupBy("id").agg(F.count("*").alias("merged"))
    own = experiences.join(hit.select("id"), "id", "left_semi")

    def union(column: str) -> DataFrame:
        values = own.select("id", F.lit("").alias("by"), F.posexplode(column).alias("at", "v")).unionByName(into.select("id", "by", F.posexplode(column).alias("at", "v")))
        firsts = values.where("v is not null").groupBy("id", "v").agg(F.min(F.struct("by", "at")).alias("first"))
        return firsts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]).alias(column))

    both = own.select("id", "recommendation").join(union("evidence"), "id", "left").join(union("triggers"), "id", "left").join(hit, "id")
    return both.select("id", "recommendation", T.empty_if_null(F.col("evidence")).alias("evidence"), T.empty_if_null(F.col("triggers")).alias("triggers"), F.lit(True).alias("needs_review"), "merged")


def updated(experiences: DataFrame, updates: DataFrame) -> DataFrame:
    """Experiences after replacing updates (id, title, recommendation, triggers): the old recommendation goes to the history, the version rises by one.

    Empty or missing fields of an update keep the old value; one update per id (the last by id order of a repeated id is not defined, so ids must be unique).
    """
    u = updates.select("id", F.col("title").alias("u_title"), F.col("recommendation").alias("u_rec"), F.col("triggers").alias("u_trig"), F.lit(True).alias("u"))
    j = experiences.join(u, "id", "left")
    keep = lambda new, old: F.when(F.coalesce(F.col(new), F.lit("")) != "", F.col(new)).otherwise(F.col(old)).alias(old)
    past = F.struct(F.col("version").alias("version"), F.col("recommendation").alias("recommendation"), F.lit(None).cast("string").alias("merged_from_episode_id"), F.col("updated_at").alias("replaced_at"))
    kind = dict(experiences.dtypes)["history"]
    grown = F.when(F.col("u"), F.concat(F.coalesce("history", F.expr(f"cast(array() as {kind})")), F.array(past))).otherwise(F.col("history"))
    trig = F.when(F.size(T.empty_if_null(F.col("u_trig"))) > 0, F.col("u_trig")).otherwise(F.col("triggers"))
    done = {
        "title": keep("u_title", "title"), "recommendation": keep("u_rec", "recommendation"), "triggers": trig.alias("triggers"), "history": grown.alias("history"),
        "version": F.when(F.col("u"), F.col("version") + 1).otherwise(F.col("version")).cast("int").alias("version"), "needs_review": F.when(F.col("u"), True).otherwise(F.col("needs_review")).alias("needs_review"),
    }
    return j.select(*[done.get(c, F.col(c)) for c in experiences.columns])


def last_processed(session_refs: DataFrame) -> DataFrame:
    """(project, last_session_id, sessions): per normalised project the session with the latest start, and how many there are.

    Starts are compared as instants; one that is missing or no time counts as 1970, a local one as UTC. Of a
    session listed twice the later listing counts, of equal starts the larger id.
    """
    one = session_refs.where("id is not null").groupBy("id").agg(F.max_by(F.struct("project_path", "started_at"), F.coalesce("mtime_ms", F.lit(-1))).alias("r")).select("id", "r.*")
    timed = parse(one.withColumn("__utc", F.lit("UTC")), "started_at", "__utc")
    at = F.struct(F.coalesce("instant_ms", F.lit(0)), "id")
    return timed.groupBy(T.normal_path(F.col("project_path")).alias("project")).agg(F.max_by("id", at).alias("last_session_id"), F.count("*").alias("sessions"))


def advanced_marker(markers: DataFrame, done: DataFrame) -> DataFrame:
    """(project, session_id, started_ms): the marker of each project after more sessions were processed; it only moves to a start that is not earlier."""
    rank = F.struct("started_ms", "turn", "session_id")
    both = markers.select("project", "session_id", "started_ms", F.lit(0).alias("turn")).unionByName(done.select("project", "session_id", F.coalesce("started_ms", F.lit(0)).alias("started_ms"), F.lit(1).alias("turn")))
    return both.groupBy("project").agg(F.max_by("session_id", rank).alias("session_id"), F.max("started_ms").alias("started_ms"))
