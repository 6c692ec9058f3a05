"""Candidates drawn from episodes by an exchangeable text function, and the reading of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most candidates an answer may give; part of the request.
MAX_CANDIDATES = 3
ANSWER = "array<map<string,string>>"


def no_model(prompt: str) -> str:
    """The stand-in for a model: an empty answer."""
    return "[]"


def prompts(eps: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(id, prompt) of episodes (id, description, status, result, trace)."""
    steps = F.array_join(F.transform("trace.steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s["action"], F.lit("")), F.when(s["error"].isNotNull(), F.concat(F.lit(" failed: "), s["error"])).otherwise(""))), "\n")
    return eps.select("id", F.concat_ws("\n", F.lit(f"Give at most {most} reusable lessons as a JSON array of objects."), F.concat(F.lit("Task: "), F.coalesce("description", F.lit(""))), F.concat(F.lit("Status: "), F.coalesce("status", F.lit(""))), steps, F.concat(F.lit("Result: "), F.coalesce("result", F.lit("")))).alias("prompt"))


def answered(rows: DataFrame, model: Callable[[str], str] = no_model) -> DataFrame:
    """(id, answer): the function applied to each prompt in Arrow batches; a call that fails answers ``[]``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append(model(p) or "[]")
                except Exception:  # noqa: BLE001
                    out.append("[]")
            yield pd.DataFrame({"id": b["id"], "answer": out})

    return rows.select("id", "prompt").mapInPandas(run, "id string, answer string")


def bracketed(answer: Column) -> Column:
    """From the first opening to the last closing bracket of a text."""
    return F.regexp_extract(answer, r"(?s)\[.*\]", 0)


def _listed(value: Column) -> Column:
    """A field that should be a list of texts: a list stays, a text becomes a list of one, anything else none."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(value.isNull(), none).when(F.ltrim(value).startswith("["), F.coalesce(F.from_json(value, "array<string>"), none)).when(F.ltrim(value).startswith("{"), none).otherwise(F.array(value))


def candidates(answers: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(id, place, title, problem, recommendation, triggers, apply_when, confidence): the candidates of each answer.

    Text around the JSON array is ignored; an answer without a valid array gives none; only the first ``most`` are
    taken, as the request asked; a confidence that is no number is 0.5.
    """
    items = F.slice(F.coalesce(F.from_json(bracketed(F.col("answer")), ANSWER), F.expr(f"cast(array() as {ANSWER})")), 1, most)
    rows = answers.select("id", F.posexplode(items).alias("place", "c"))
    c = F.col("c")
    return rows.select(
        "id", "place", *[c[k].alias(k) for k in ("title", "problem", "recommendation")], _listed(c["triggers"]).alias("triggers"), _listed(c["applyWhen"]).alias("apply_when"),
        F.coalesce(c["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"),
    )


def as_records(found: DataFrame) -> DataFrame:
    """Candidates as new records: version 1, active, global unless a scope is given, confidence 0.5 unless there is one. Other columns stay."""
    scope = F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("global")) if "scope" in found.columns else F.lit("global")
    return found.withColumns({"scope": scope, "version": F.lit(1), "status": F.lit("active"), "confidence": F.coalesce("confidence", F.lit(0.5))})
