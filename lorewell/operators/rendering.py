"""Rows rendered as Markdown, XML and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T


def _joined(group: list[str], rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    at = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(at, lambda x: x["line"]), "\n").alias(name))


def _listed(column: str) -> Column:
    return F.array_join(T.empty_if_null(F.col(column)), "; ")


def _prompt(tasks: DataFrame, ranked: DataFrame, experiences: DataFrame, skills: DataFrame | None, part: Column, entry: Column) -> DataFrame:
    """(task_id, parts, entries): the texts of each task's ranked experiences, and those of the skills, in their order; null without any."""
    rows = ranked.join(experiences.select(F.col("id").alias("experience_id"), "title", "recommendation", "apply_when", "avoid"), "experience_id")
    parts = rows.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("text")))), lambda x: x["text"]).alias("parts"))
    out = tasks.select("task_id").distinct().join(parts, "task_id", "left")
    if skills is None:
        return out.withColumn("entries", F.expr("cast(null as array<string>)"))
    # One row, of the skills that a prompt may show.
    shown = skills.select("id", entry.alias("text")).groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("entries"))
    return out.join(shown.withColumn("entries", F.when(F.size("entries") > 0, F.col("entries"))), F.lit(True), "left")


def prompt_markdown(tasks: DataFrame, ranked: DataFrame, experiences: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(task_id, markdown): the ranked experiences (task_id, rank, experience_id) and the skills (id, name, description) as a prompt block; empty without either."""
    title = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n"))
    avoid = F.when(F.size(T.empty_if_null(F.col("avoid"))) > 0, F.concat(F.lit("**Not:** "), _listed("avoid"), F.lit("\n")))
    part = F.concat_ws("\n", title, F.concat(F.lit("**When:** "), _listed("apply_when"), F.lit("\n")), F.concat(F.lit("**Do:** "), F.coalesce("recommendation", F.lit("")), F.lit("\n")), avoid)
    entry = F.concat(F.lit("- **"), F.coalesce("name", F.lit("")), F.lit("**: "), F.coalesce("description", F.lit("")))
    rows = _prompt(tasks, ranked, experiences, skills, part, entry)
    block = lambda head, c, end: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.col(c), "\n"), F.lit(end)))
    return rows.select("task_id", F.concat_ws("\n", block("Relevant Past Experiences", "parts", ""), block("Available Skills", "entries", "\n")).alias("markdown"))


def prompt_xml(tasks: DataFrame, ranked: DataFrame, experiences: DataFrame, skills: DataFrame | None = None, root: str = "context") -> DataFrame:
    """(task_id, xml): the same as elements, with escaped texts; the root element is always there."""
    esc = lambda c: T.xml_escaped(F.coalesce(c, F.lit("")))
    element = lambda name, c: F.concat(F.lit(f"      <{name}>"), esc(c), F.lit(f"</{name}>"))
    avoid = F.when(F.size(T.empty_if_null(F.col("avoid"))) > 0, element("not", _listed("avoid")))
    part = F.concat_ws("\n", F.concat(F.lit('    <experience title="'), esc(F.col("title")), F.lit('">')), element("when", _listed("apply_when")), element("do", F.col("recommendation")), avoid, F.lit("    </experience>"))
    entry = F.concat(F.lit('    <skill name="'), esc(F.col("name")), F.lit('">'), esc(F.col("description")), F.lit("</skill>"))
    rows = _prompt(tasks, ranked, experiences, skills, part, entry)
    block = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  <{name}>\n"), F.array_join(F.col(c), "\n"), F.lit(f"\n  </{name}>")))
    return rows.select("task_id", F.concat_ws("\n", F.lit(f"<{root}>"), block("experiences", "parts"), block("skills", "entries"), F.lit(f"</{root}>")).alias("xml"))


def prompt_json(tasks: DataFrame, ranked: DataFrame, experiences: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(task_id, json): experiences in rank order and skill summaries as one JSON document."""
    part = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("recommendation", F.lit("")).alias("recommendation"), T.empty_if_null(F.col("apply_when")).alias("applyWhen"), T.empty_if_null(F.col("avoid")).alias("avoid")))
    entry = F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description")))
    rows = _prompt(tasks, ranked, experiences, skills, part, entry)
    array = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    return rows.select("task_id", F.concat(F.lit('{"experiences":'), array("parts"), F.lit(',"skillSummaries":'), array("entries"), F.lit("}")).alias("json"))


def managed_content(experiences: DataFrame, skills: DataFrame, synced_at: str, most: int = 20, most_skills: int = 10) -> DataFrame:
    """(content, experiences, skills): the section of an instruction file: the most confident experiences and the first skills; the limits are the feature."""
    top = experiences.orderBy(F.desc_nulls_last("confidence"), "id").limit(most)
    avoid = F.when(F.size(T.empty_if_null(F.col("avoid"))) > 0, F.concat(F.lit("- **Not:** "), _listed("avoid")))
    part = F.concat_ws("\n", F.concat(F.lit("### "), F.coalesce("title", F.lit(""))), F.concat(F.lit("- **When:** "), _listed("apply_when")), F.concat(F.lit("- **Do:** "), F.coalesce("recommendation", F.lit(""))), avoid, F.lit(""))
    e = top.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id", part.alias("text")))).alias("e"))
    triggers = F.when(F.size(T.empty_if_null(F.col("triggers"))) > 0, F.concat(F.lit(" (triggers: "), F.array_join("triggers", ", "), F.lit(")"))).otherwise("")
    s = skills.orderBy("id").limit(most_skills).groupBy().agg(F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("- **"), "name", F.lit("**: "), "description", triggers).alias("text")))).alias("s"))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    content = F.concat_ws(
        "\n", F.when(F.size("e") > 0, F.concat(F.lit("## Learned Experiences\n\n"), texts("e"))), F.when(F.size("s") > 0, F.concat(F.lit("## Available Skills\n\n"), texts("s"), F.lit("\n"))), F.lit(f"_Last synced: {synced_at}_")
    )
    return e.join(s, F.lit(True)).select(content.alias("content"), F.size("e").cast("long").alias("experiences"), F.size("s").cast("long").alias("skills"))


def search_texts(found: DataFrame) -> DataFrame:
    """(id, text): each found experience as a paragraph of a search result."""
    sure = F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0)))
    text = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit(" ("), sure, F.lit(")\n"), F.coalesce("recommendation", F.lit("")), F.lit("\nApply when: "), F.array_join(T.empty_if_null(F.col("apply_when")), ", "))
    return found.select("id", text.alias("text"))


def experience_markdown(experiences: DataFrame) -> DataFrame:
    """(id, markdown): each experience as a document with front matter of ``key: JSON`` lines and sections."""
    names = ["id", "title", "domain", "task_type", "scope", "triggers", "source_episode_ids", "confidence", "version", "status", "created_at", "updated_at"]
    pair = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1), F.lit("null")))
    front = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), pair(c)) for c in names])
    section = lambda head, body: F.concat(F.lit(f"\n## {head}\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))
    bullets = lambda c: F.concat_ws("\n", F.transform(T.empty_if_null(F.col(c)), lambda x: F.concat(F.lit("- "), x)))
    return experiences.select(
        "id",
        F.concat(
            F.lit("---\n"), front, F.lit("\n---\n"), section("Problem", F.col("problem")), section("Recommendation", F.col("recommendation")),
            section("Apply When", bullets("apply_when")), section("Avoid", bullets("avoid")), section("Evidence", bullets("evidence")),
        ).alias("markdown"),
    )


def experience_from_markdown(documents: DataFrame) -> DataFrame:
    """The inverse of ``experience_markdown`` for (id, markdown): title, confidence, triggers, problem, recommendation and the lists.

    A front-matter value that is not JSON is taken as it stands; a missing section is empty. Sections end at the
    next heading of the same level.
    """
    doc = F.col("markdown")
    front = F.regexp_extract(doc, r"(?s)^---\n(.*?)\n---\n", 1)
    value = lambda k: F.nullif(F.regexp_extract(front, rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    text = lambda k: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value(k), F.lit("}")), "$.v"), value(k))
    section = lambda h: F.trim(F.regexp_replace(F.regexp_extract(doc, rf"(?s)\n## {h}\n\n(.*?)(?=\n## |\z)", 1), r"^\n+|\n+\z", ""))
    bullets = lambda h: F.transform(F.filter(F.split(section(h), "\n"), lambda x: x.startswith("- ")), lambda x: F.substr(x, F.lit(3)))
    return documents.select(
        "id", text("title").alias("title"), value("confidence").try_cast("double").alias("confidence"), F.from_json(value("triggers"), "array<string>").alias("triggers"),
        section("Problem").alias("problem"), section("Recommendation").alias("recommendation"), bullets("Apply When").alias("apply_when"), bullets("Avoid").alias("avoid"), bullets("Evidence").alias("evidence"),
    )


START, END = "<!-- learned:start -->", "<!-- learned:end -->"
#: Markers of older files; they are read, and replaced when the section is written.
OLD_START, OLD_END = "<!-- lessons:start -->", "<!-- lessons:end -->"


def _section(start: str, end: str) -> str:
    """Everything from the line of one marker to that of the other."""
    return rf"(?ms)^[ \t]*\Q{start}\E[ \t]*$.*?^[ \t]*\Q{end}\E[ \t]*$"


def read_section(document: Column) -> Column:
    """The text between the marker lines, without white space around it; null if there is no section. Older markers count too."""

    def inside(start: str, end: str) -> Column:
        found = F.regexp_extract(document, _section(start, end), 0)
        return F.when(found != "", F.regexp_replace(F.regexp_replace(found, rf"(?s)\A\s*\Q{start}\E\s*|\s*\Q{end}\E\s*\z", ""), r"\A\s+|\s+\z", ""))

    return F.coalesce(inside(START, END), inside(OLD_START, OLD_END))


def written_section(document: Column, content: Column) -> Column:
    """The document with the section replaced, appended, or as the only text if the document is empty."""
    doc = F.coalesce(document, F.lit(""))
    block = F.concat(F.lit(START + "\n"), content, F.lit("\n" + END))
    new, old = F.regexp_extract(doc, _section(START, END), 0), F.regexp_extract(doc, _section(OLD_START, OLD_END), 0)
    return (
        F.when(new != "", F.replace(doc, new, block)).when(old != "", F.replace(doc, old, block))
        .when(doc.rlike(r"\A\s*\z"), F.concat(block, F.lit("\n"))).otherwise(F.concat(F.regexp_replace(doc, r"\s+\z", ""), F.lit("\n\n"), block, F.lit("\n")))
    )


def synced(targets: DataFrame) -> DataFrame:
    """(target, document, action) of targets (target, document, content, experiences, skills): what a sync writes.

    ``unchanged`` if there is nothing to write or the section holds the content already, else ``updated``, or
    ``created`` where the document was empty.
    """
    same = (F.col("experiences") + F.col("skills") == 0) | F.coalesce(read_section(F.col("document")) == F.regexp_replace("content", r"\A\s+|\s+\z", ""), F.lit(False))
    action = F.when(same, "unchanged").when(F.coalesce(F.col("document"), F.lit("")).rlike(r"\A\s*\z"), "created").otherwise("updated")
    return targets.select("target", F.when(same, F.col("document")).otherwise(written_section(F.col("document"), F.col("content"))).alias("document"), action.alias("action"))
