"""Names are found alike, however many are known."""

import pytest

from lorewell.llm import personal as P

TEXTS = {
    "plain": "we saw Olga Petrenko there", "trailing": "we saw Olga Petrenko' there", "wide": "we saw Ｏｌｇａ Ｐｅｔｒｅｎｋｏ there", "alike": "we saw Оlga Реtrenko there",
    "hidden": "we saw Ol\u200bga Pe\u00adtrenko there", "hyphen": "we saw Anna-Maria Kivi there", "dash": "we saw Olga Petrenko-", "low": "then olga petrenko left", "none": "we saw nobody there",
}


@pytest.mark.parametrize("more", [0, 5_100])
def test_any_number_of_names_gives_the_same(spark, more):
    people = spark.createDataFrame([("Olga", "Petrenko"), ("Anna-Maria", "Kivi")], "given_name string, family_name string")
    people = people.unionByName(spark.range(more).selectExpr("concat('Xq', id) given_name", "concat('Zv', id) family_name"))
    texts = spark.createDataFrame([("content", k, 0, t) for k, t in TEXTS.items()], "source_field string, record_key string, part int, text string")
    got = {r.record_key: r.masked for r in P.masked(texts, people).collect()}
    detect = P.Detector(["Olga", "Anna-Maria"], ["Petrenko", "Kivi"])
    assert got == {k: detect.mask(t)[0] for k, t in TEXTS.items() if k != "none"} and set(got) == set(TEXTS) - {"none"}
