"""Skills drawn from recurring patterns: drafts, their life cycle, summaries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.records import matching
from lorewell.operators.upserts import upsert

SUMMARY = ["id", "name", "description", "domain", "task_type", "triggers"]
# Fixed values of a new skill.
VERSION, DRAFT = "0.1.0", "draft"


def drafts(patterns: DataFrame) -> DataFrame:
    """One draft skill per promoted pattern (signature, domain, task_type, support, success_rate, confidence, promotion).

    The id follows from the signature, so drawing the same patterns again gives the same skills. The scope is the
    domain's if there is one.
    """
    reason = F.concat(F.lit("Pattern "), "signature", F.lit(" reached "), F.col("support").cast("string"), F.lit(" episodes with "), T.percent(F.col("success_rate")), F.lit(" success"))
    return patterns.where("promotion = 'candidate_skill'").select(
        F.concat(F.lit("skill_"), "signature").alias("id"), F.col("signature").alias("name"), reason.alias("description"), "domain", "task_type",
        F.when(F.coalesce("domain", F.lit("")) != "", "domain").otherwise("global").alias("scope"), F.array_compact(F.array("domain", "task_type")).alias("triggers"),
        F.lit(VERSION).alias("version"), F.lit(DRAFT).alias("status"), "confidence", "support",
    )


def with_status(skills: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The skills of ``ids`` (id) in another state, all else as it was."""
    return upsert(skills, skills.join(ids.select("id").distinct(), "id", "left_semi").withColumn("status", F.lit(status)))


def summaries(skills: DataFrame, **wanted: str | None) -> DataFrame:
    """Only what a prompt needs, of the skills equal in every given field (domain, task_type, status); an empty value filters nothing."""
    return matching(skills, **wanted).select(*SUMMARY)


def top_summaries(skills: DataFrame, limit: int = 10) -> DataFrame:
    """The first active skills by id; the limit is the feature."""
    return summaries(skills, status="active").orderBy("id").limit(limit)


def skill_markdown(skills: DataFrame) -> DataFrame:
    """(id, markdown): front matter and the description as the body; missing fields have no line."""
    line = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c))
    quoted: Column = F.transform(T.empty_if_null(F.col("triggers")), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    front = F.concat_ws(
        "\n", F.lit("---"), line("name", F.col("name")), line("description", F.col("description")), line("domain", F.col("domain")), line("taskType", F.col("task_type")),
        F.concat(F.lit("triggers: ["), F.array_join(quoted, ", "), F.lit("]")), line("version", F.col("version")), line("status", F.col("status")), F.lit("---"),
    )
    return skills.select("id", F.concat(front, F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n")).alias("markdown"))


def exported(skills: DataFrame, delivered: DataFrame, target: str, overwrite: bool = False) -> DataFrame:
    """(id, target, action): what an export to a target does: ``written``, ``overwritten``, or ``conflict`` where one of ``delivered`` (id, target) lies there already."""
    there = delivered.where(F.col("target") == target).select("id", F.lit(True).alias("there")).distinct()
    action = F.when(F.col("there").isNull(), "written").otherwise("overwritten" if overwrite else "conflict")
    return skills.select("id").join(there, "id", "left").select("id", F.lit(target).alias("target"), action.alias("action"))
