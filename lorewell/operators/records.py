"""Episodes and experiences as flat tables, and the lookups between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T


def episodes(raw: DataFrame) -> DataFrame:
    """One row per episode: the task's fields as columns. Replayed rows count once; null ids are dropped."""
    return raw.where("id is not null").groupBy("id").agg(
        F.first("status").alias("status"), F.first("started_at").alias("started_at"), F.first("ended_at").alias("ended_at"), F.first("result").alias("result"),
        F.first("task.description").alias("description"), F.first("task.domain").alias("domain"), F.first("task.task_type").alias("task_type"), F.first("task.tags").alias("tags"),
        F.first(F.col("task.metadata")["projectPath"]).alias("project_path"), F.first(F.col("task.metadata")["sessionId"]).alias("session_id"),
        F.first("trace").alias("trace"),
    )


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in every given column. A value that is None or empty filters nothing; a null column matches nothing."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def latest(df: DataFrame, order: str, limit: int | None = None, key: str = "id") -> DataFrame:
    """Newest rows first, rows without a time last, ties by id; no limit if none or 0 is given."""
    df = df.orderBy(F.col(order).desc_nulls_last(), key)
    return df.limit(limit) if limit else df


def sources_of(experiences: DataFrame) -> DataFrame:
    """(experience_id, position, episode_id): source episodes in their order."""
    return experiences.select(F.col("id").alias("experience_id"), F.posexplode("source_episode_ids").alias("position", "episode_id"))


def first_project(experiences: DataFrame, eps: DataFrame) -> DataFrame:
    """(experience_id, project_path): of the first source episode that has a project."""
    known = eps.where("project_path is not null and project_path <> ''").select(F.col("id").alias("episode_id"), "project_path")
    return sources_of(experiences).join(known, "episode_id").groupBy("experience_id").agg(F.min_by("project_path", "position").alias("project_path"))


def of_project(experiences: DataFrame, eps: DataFrame, project: Column) -> DataFrame:
    """Experiences with any source episode of a project that meets the condition."""
    inside = eps.where(project).select(F.col("id").alias("episode_id"))
    keep = sources_of(experiences).join(inside, "episode_id", "left_semi").select(F.col("experience_id").alias("id")).distinct()
    return experiences.join(keep, "id", "left_semi")


def haystack(*columns: str) -> Column:
    """The lower-cased texts that a search looks in; arrays are joined by blanks."""
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))


def search_any(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold any of the query's words, which white space parts; an empty query, or white space at an end, holds for all."""
    found = F.lit(False)
    for word in re.split(r"\s+", query.lower()):
        found = found | F.contains(haystack(*columns), F.lit(word))
    return df.where(found)


def search_phrase(df: DataFrame, phrase: str, columns: list[str]) -> DataFrame:
    return df.where(F.contains(haystack(*columns), F.lit(phrase.lower())))


def activity_by_project(eps: DataFrame, experiences: DataFrame) -> DataFrame:
    """Per project: episodes, successes, experiences, active ones and the last end; rows without a project do not count."""
    worked = eps.where("project_path is not null and project_path <> ''").groupBy("project_path").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("status") == "success").alias("success_count"), F.max("ended_at").alias("last_session_at"),
    )
    learned = first_project(experiences, eps).join(experiences.select(F.col("id").alias("experience_id"), "status"), "experience_id")
    learned = learned.groupBy("project_path").agg(F.count("*").alias("experiences"), F.count_if(F.col("status") == "active").alias("active_experiences"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return worked.join(learned, "project_path", "full_outer").select(
        "project_path", T.project_name(F.col("project_path")).alias("project_name"), zero("episodes"), zero("success_count"), zero("experiences"), zero("active_experiences"), "last_session_at",
    )


def counts_by_status(**tables: DataFrame) -> DataFrame:
    """(entity, status, n) of several tables in one result."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "status", "n")
        out = one if out is None else out.unionByName(one)
    return out
