"""What a merge plan joins, and what components leave behind."""

from pathlib import Path

from lorewell import store
from lorewell.operators import clusters


def test_a_union_meets_only_its_own_record(spark):
    schema = "id string, status string, recommendation string, confidence double, triggers array<string>, source_episode_ids array<string>, evidence array<string>, apply_when array<string>"
    recs = spark.createDataFrame([(c, "active", c, 0.5, [c], None, None, None) for c in "abcd"], schema)
    plan = clusters.merge_plan(recs, spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "id string, component string"))
    assert plan._jdf.queryExecution().sparkPlan().toString().count("Join") <= 1
    assert {(r.id, r.role, tuple(r.triggers)) for r in plan.collect()} == {("a", "keep", ("a", "b", "c")), ("b", "merge", ("b",)), ("c", "merge", ("c",))}


def test_components_keep_the_links_of_one_round(spark):
    at = Path(store.shared_dir(spark).removeprefix("file://"), "lorewell", spark.sparkContext.applicationId)
    tables = lambda: {p.name for p in at.glob("links-*")}
    before = tables()
    found = clusters.components(spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("x", "y")], "id_a string, id_b string"))
    assert len(tables() - before) == 1
    assert {(r.id, r.component) for r in found.collect()} == {(f"n{k:03d}", "n000") for k in range(41)} | {("x", "x"), ("y", "x")}
