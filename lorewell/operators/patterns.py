"""Recurring patterns: one aggregate per signature of episodes, as incremental mining would leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.prefix import running

# When a pattern is promoted.
MIN_SUPPORT, MIN_SUCCESS = 3, 0.6


def mined(eps: DataFrame) -> DataFrame:
    """Per signature: domain, task_type, support, success_rate, confidence, promotion, recurring_failures of the first episode.

    Episodes arrive by (started_at, id). A pattern is promoted once any prefix of at least three episodes has a
    success rate of 0.6, and stays so; the prefixes are running sums over days, not one window per signature.
    """
    e = eps.select("id", "status", "started_at", "domain", "task_type", T.signature(F.col("domain"), F.col("task_type"), F.col("tags")).alias("signature"), F.col("trace.errors.message").alias("failures"))
    won = F.when(F.col("status") == "success", 1).otherwise(0)
    day = F.substring(F.coalesce("started_at", F.lit("")), 1, 10)
    run = running(e, ["signature"], day, ["started_at", "id"], k=F.lit(1), s=won)
    first = F.struct("started_at", "id")
    agg = run.groupBy("signature").agg(
        F.count("*").alias("support"), F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).alias("s"),
        F.min_by("domain", first).alias("domain"), F.min_by("task_type", first).alias("task_type"), F.min_by("failures", first).alias("failures"),
        F.bool_or((F.col("k") >= MIN_SUPPORT) & (F.col("s") / F.col("k") >= MIN_SUCCESS)).alias("promoted"),
    )
    rate = F.col("s") / F.col("support")
    sure = F.when(F.col("support") == 1, 0.3).otherwise(0.7 * rate + 0.3 * F.least(F.col("support") / 5, F.lit(1.0)))
    return agg.select(
        "signature", "domain", "task_type", "support", F.round(rate, 6).alias("success_rate"), F.round(sure, 6).alias("confidence"),
        F.when(F.col("promoted"), "candidate_skill").otherwise("none").alias("promotion"),
        F.array_join(T.empty_if_null(F.col("failures")), "|").alias("recurring_failures"),
    )


def common_steps(eps: DataFrame) -> DataFrame:
    """(signature, place, action): the distinct actions of a signature's episodes in the order they were first seen."""
    e = eps.select("id", "started_at", T.signature(F.col("domain"), F.col("task_type"), F.col("tags")).alias("signature"), F.posexplode("trace.steps").alias("at", "step"))
    seen = e.where("step.action is not null").groupBy("signature", F.col("step.action").alias("action")).agg(F.min(F.struct("started_at", "id", "at")).alias("first"))
    from pyspark.sql import Window

    return seen.select("signature", F.row_number().over(Window.partitionBy("signature").orderBy("first", "action")).alias("place"), "action")


def common_tools(eps: DataFrame) -> DataFrame:
    """(signature, tool, calls): the tools of a signature's episodes."""
    e = eps.select(T.signature(F.col("domain"), F.col("task_type"), F.col("tags")).alias("signature"), F.explode("trace.tool_calls").alias("call"))
    return e.where("call.name is not null").groupBy("signature", F.col("call.name").alias("tool")).agg(F.count("*").alias("calls"))
