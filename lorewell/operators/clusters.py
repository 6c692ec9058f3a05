"""Connected components of a graph given as a table of links, and the merge plan of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.store import cut, drop_table



def _checksum(edges: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and two sums of hashes."""
    h = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    return tuple(edges.agg(F.count("*"), *h).first())


def components(links: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, component): every linked node with the smallest id of its component.

    Alternating large-star and small-star rounds: each node's larger neighbours are linked to the smallest one
    around it, then the smaller ones are, until nothing changes. The number of rounds grows with the logarithm
    of the size of a component, not with its diameter, and no node's neighbourhood is gathered in one row:
    only its minimum is aggregated. Every round's links are written to the shared folder, and those of the round
    before, which nothing reads any more, are removed.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    before = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small, "links")
        now = _checksum(new)
        drop_table(edges)
        edges = new
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def clustered(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): every record with the smallest id it is linked to over any number of links; one without links is its own."""
    found = components(links.select("id_a", "id_b"))
    return records.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Arrays that a merge unites.
UNITED = ("source_episode_ids", "evidence", "apply_when", "triggers")


def merge_plan(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, component, primary_id, role, status, the arrays of ``UNITED``): what a merge makes of the clusters of more than one record.

    The longest recommendation stays, of equals the most confident, then the smallest id; it keeps its status and
    gets the ordered union of each array, its own values first, then those of the others in the same order. The
    others become deprecated and keep their arrays. Aggregated, not ranked in one window, so a large cluster is
    not gathered; only a union itself, which is one record's field, is one row. The heads are chosen without the
    arrays, only records of clusters carry theirs on, and a union meets its own record alone.
    """
    order = F.struct((-F.length(F.coalesce("recommendation", F.lit("")))).alias("n"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "id")
    ranked = clusters.join(records.select("id", order.alias("at")), "id")
    heads = ranked.groupBy("component").agg(F.min("at").alias("head"), F.count("*").alias("k")).where("k > 1").select("component", F.col("head.id").alias("primary_id"))
    members = cut(ranked.join(heads, "component"), "merge-members")
    rows = cut(members.join(records.select("id", "status", *UNITED), "id"), "merge-rows")
    values = [rows.select("primary_id", F.lit(k).alias("what"), "at", F.posexplode(column).alias("k", "v")).where("v is not null") for k, column in enumerate(UNITED)]
    every = values[0]
    for v in values[1:]:
        every = every.unionByName(v)
    firsts = every.groupBy("primary_id", "what", "v").agg(F.min(F.struct("at", "k")).alias("place"))
    joined = [F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == k, F.struct("place", "v")))), lambda x: x["v"]).alias(f"u_{column}") for k, column in enumerate(UNITED)]
    united = firsts.groupBy(F.col("primary_id").alias("id")).agg(*joined)
    first = F.col("id") == F.col("primary_id")
    kept = rows.where(first).join(united, "id", "left")
    none = F.expr("cast(array() as array<string>)")
    head = kept.select("id", "component", "primary_id", F.lit("keep").alias("role"), "status", *[F.coalesce(f"u_{c}", none).alias(c) for c in UNITED])
    others = rows.where(~first).select("id", "component", "primary_id", F.lit("merge").alias("role"), F.lit("deprecated").alias("status"), *[F.coalesce(c, none).alias(c) for c in UNITED])
    return head.unionByName(others)
