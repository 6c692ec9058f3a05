"""Relevance-ranked retrieval of experiences for tasks, and lexical similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import overlaps
from lorewell.store import cut

TOP_K = 5
#: Tasks of one block; the bound on what is sent to every executor at a time.
BLOCK = 5_000
# The weights of the fields and the least similarity.
WEIGHTS = {"title": 0.4, "triggers": 0.25, "recommendation": 0.2, "problem": 0.15}
THRESHOLD = 0.32


def relevance(exp: str, task: str) -> Column:
    """3 for the domain, 2 for the type, 2 for each trigger inside the task's text, 1 for each that is a tag."""
    e, t = (lambda c: F.col(f"{exp}.{c}")), (lambda c: F.col(f"{task}.{c}"))
    triggers = F.transform(T.empty_if_null(e("triggers")), F.lower)
    return (
        F.when((e("domain") != "") & (e("domain") == t("domain")), 3).otherwise(0)
        + F.when((e("task_type") != "") & (e("task_type") == t("task_type")), 2).otherwise(0)
        + 2 * F.size(F.filter(triggers, lambda x: F.contains(t("hay"), x)))
        + F.size(F.filter(triggers, lambda x: F.array_contains(t("low_tags"), x)))
    )


def retrieve(experiences: DataFrame, tasks: DataFrame, k: int = TOP_K) -> DataFrame:
    """(task_id, rank, experience_id, score): the ``k`` active experiences of the highest positive relevance per task.

    ``tasks``: (task_id, description, domain, task_type, tags), a stated set of queries. They are sent to the
    executors in blocks of at most ``BLOCK`` rows, and each partition of experiences keeps only its best ``k``
    per task before the shuffle.
    """
    low = F.transform(T.empty_if_null(F.col("tags")), F.lower)
    t = tasks.select("task_id", "domain", "task_type", low.alias("low_tags"), F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("tags", F.array()))).alias("hay"))
    n = t.count()
    blocks = max(1, -(-n // BLOCK))
    active = experiences.where("status = 'active'").select("id", "domain", "task_type", "triggers")
    out = None
    for b in range(blocks):
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("task_id"), F.lit(blocks)) == b)
        score = relevance("e", "t")
        scored = active.alias("e").join(F.broadcast(part.alias("t")), score > 0).select(F.col("t.task_id"), F.col("e.id").alias("experience_id"), score.alias("score"))
        out = scored if out is None else out.unionByName(scored)
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "experience_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("task_id", "rank", "experience_id", "score")


def token_sets(records: DataFrame, key: str = "id", keep: tuple = ()) -> DataFrame:
    """(key, keep, title, triggers, recommendation, problem): distinct stems of each field."""
    return records.select(
        F.col(key).alias("id"), *keep, T.stems(F.col("title")).alias("title"), T.stems_of_all(F.col("triggers")).alias("triggers"),
        T.stems(F.col("recommendation")).alias("recommendation"), T.stems(F.col("problem")).alias("problem"),
    )


def similarity(a: str, b: str) -> Column:
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    larger = F.greatest(F.size(x("triggers")), F.size(y("triggers")))
    shared = F.when(larger > 0, T.overlap(x("triggers"), y("triggers")) / larger).otherwise(0.0)
    return (
        WEIGHTS["title"] * T.dice(x("title"), y("title")) + WEIGHTS["triggers"] * shared
        + WEIGHTS["recommendation"] * T.dice(x("recommendation"), y("recommendation")) + WEIGHTS["problem"] * T.dice(x("problem"), y("problem"))
    )


def most_similar(records: DataFrame, queries: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, rank, id, score): per query its ``k`` most similar other records of at least the threshold, of equals the smallest id.

    Queries are a stated set of any size. Both sides meet in blocks (see ``overlaps``); nothing is broadcast and no
    pair is looked at that shares no indexed word.
    """
    scored = _across(queries, records, threshold).where("id_a <> id_b")
    w = Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("id_a").alias("query_id"), "rank", F.col("id_b").alias("id"), "score")


#: Last: what one shared token of a field adds at most to the similarity of records of usual size; only orders the index.
_FIELDS = overlaps.Weights({f: (WEIGHTS[f], f == "triggers", usual) for f, usual in (("title", 0.13), ("triggers", 0.08), ("recommendation", 0.016), ("problem", 0.012))})


def _scored(met: DataFrame, threshold: float) -> DataFrame:
    """The pairs of at least the threshold, with ``score``."""
    total = None
    for k, f in enumerate(_FIELDS.names):
        common, n, m = (F.get(c, F.lit(k)) for c in ("common", "sizes_a", "sizes_b"))
        part = F.when(F.greatest(n, m) > 0, common / F.greatest(n, m)) if f == "triggers" else F.when((n > 0) & (m > 0), 2.0 * common / (n + m))
        total = WEIGHTS[f] * part.otherwise(0.0) if total is None else total + WEIGHTS[f] * part.otherwise(0.0)
    return met.withColumn("score", F.round(total, 6)).where(F.col("score") >= threshold)


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD, scope: str = "scope") -> DataFrame:
    """(scope, id_a, id_b, score): pairs of one scope of at least the threshold, smaller id first.

    Records of equal token sets form a class and meet once, through their smallest id; ``copies_of`` tells the
    class of each. The search is exact.
    """
    return _class_pairs(_keyed(records, scope), threshold, scope)


def _class_pairs(keyed: DataFrame, threshold: float, scope: str) -> DataFrame:
    head = F.min_by(F.struct("id", *WEIGHTS), "id").alias("head")
    classes = cut(keyed.groupBy(scope, "key").agg(head).select(scope, "head.*"), "similar-classes")
    scored = _scored(overlaps.pairs(classes, None, _FIELDS, threshold, scope), threshold)
    return scored.select(F.col("grp").alias(scope), "id_a", "id_b", "score")


def linked_copies(records: DataFrame, threshold: float = THRESHOLD, scope: str = "scope") -> DataFrame:
    """(id_a, id_b): each record with its class, where records of its token sets reach the threshold with one another (a field without tokens adds nothing)."""
    return _class_links(_keyed(records, scope), threshold, scope)


def _class_links(keyed: DataFrame, threshold: float, scope: str) -> DataFrame:
    own = F.lit(0.0)
    for field, weight in WEIGHTS.items():
        own = own + F.when(F.size(field) > 0, weight).otherwise(0.0)
    full = keyed.where(F.round(own, 6) >= threshold).select("id", scope, "key")
    copies = full.join(_class_ids(full, scope), [scope, "key"]).where(F.col("id") != F.col("class_id"))
    return copies.select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"))


def links(records: DataFrame, threshold: float = THRESHOLD, scope: str = "scope") -> DataFrame:
    """(id_a, id_b): the pairs of ``similar_pairs`` and the ``linked_copies``, from token sets that are made once."""
    keyed = cut(_keyed(records, scope), "similar-sets")
    return _class_pairs(keyed, threshold, scope).select("id_a", "id_b").unionByName(_class_links(keyed, threshold, scope))


def _across(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, score) of all pairs of the two tables of at least the threshold."""
    x, y = cut(token_sets(left), "match-left"), cut(token_sets(right), "match-right")
    return _scored(overlaps.pairs(x, y, _FIELDS, threshold), threshold).select("id_a", "id_b", "score")


def best_matches(records: DataFrame, others: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(id, match_id, score): for each record the most similar of ``others`` of at least the threshold, of equals the smallest id."""
    best = _across(records, others, threshold).groupBy(F.col("id_a").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id_b").alias("match_id"))).alias("m"))
    return best.select("id", "m.match_id", (-F.col("m.s")).alias("score"))


def _keyed(records: DataFrame, scope: str) -> DataFrame:
    """Token sets with ``key``: 128 bits that stand for all of them, so that equal sets meet without being shuffled (no token holds a space or bar)."""
    key = F.concat_ws("|", *[F.array_join(F.array_sort(f), " ") for f in WEIGHTS])
    return token_sets(records, keep=(scope,)).withColumn("key", F.unhex(F.md5(key)))


def _class_ids(keyed: DataFrame, scope: str) -> DataFrame:
    return keyed.groupBy(scope, "key").agg(F.min("id").alias("class_id"))


def copies_of(records: DataFrame, scope: str = "scope") -> DataFrame:
    """Token sets with ``class_id``: the smallest id of the scope's records with the same sets."""
    sets = _keyed(records, scope)
    return sets.join(_class_ids(sets, scope), [scope, "key"]).select("id", scope, *WEIGHTS, "class_id")
