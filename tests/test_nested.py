import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorewell.operators import nested


def walked(text):
    """A plain model of what must come out: {path: parent}."""
    out = {}

    def container(v):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v if isinstance(v, (dict, list)) else None

    def walk(v, path, parent, element):
        if isinstance(v, dict):
            if element:
                out[path] = parent
            for k, x in v.items():
                if (c := container(x)) is not None:
                    walk(c, f"{path}.{k}", path if element else parent, False)
        else:
            for i, x in enumerate(v):
                if (c := container(x)) is not None:
                    walk(c, f"{path}[{i}]", parent, True)

    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return out
    if isinstance(v, (dict, list)):
        walk(v, "$", "$", False)
    return out


def shredded(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "$", "extra") for i, t in enumerate(texts)], "k int, payload string, root string, json_path string")
    return {(r.k, r.json_path): r for r in nested.shred(df, ["k"], **kw).collect()}


CASES = [
    '{"a":[{"b":2,"c":[{"d":1},7,{"d":[{"e":null}]}]}]}', "[]", "{}", "[{}]", "null", "3", '"x"', "", None, "{", "{'a':[{}]}", '{"a":[{}]} trailing', '[{"a":1}][{"b":1}]',
    json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(json.dumps([{"a": [{}]}]))))))), json.dumps(json.dumps(json.dumps(json.dumps(json.dumps("text"))))),
    json.dumps(json.dumps([{"a": 1}])), json.dumps(json.dumps(json.dumps([{"a": 1}]))), json.dumps({"s": json.dumps([{"q": [{"r": 1}]}])}), json.dumps({"s": "[{not json"}), json.dumps(["{}", "[]", "plain"]),
    '\n[ {"a" : "x\\ny" , "é": [ {"ü":1} ] } ]',
]


def test_cases(spark):
    got = shredded(spark, CASES)
    want = {(i, p): q for i, t in enumerate(CASES) if t for p, q in walked(t).items()}
    assert {k: r.parent_path for k, r in got.items()} == want


def test_attributes(spark):
    got = shredded(spark, ['{"a":[{"b":2,"t":"x","n":null,"o":{"p":1}}]}'])
    assert dict(got[0, "$.a[0]"].attributes) == {"b": "2", "t": "x", "n": None, "o": '{"p":1}'}


def test_depth_beyond_one_pass(spark):
    text = '{"x":1}'
    for _ in range(25):
        text = '[{"x":' + text + "}]"
    got = shredded(spark, [text], levels=4)
    assert {p: r.parent_path for (_, p), r in got.items()} == walked(text) and len(got) == 25


def test_related_tables(spark):
    text = '[{"b":2,"t":"x","n":null,"o":{"p":1,"l":[3,null,{"q":"r"},[4]]}},5]'
    df = spark.createDataFrame([(1, text, "$")], "k int, payload string, root string")
    fields = {(r.json_path, r.parent_path, r.name, r.value) for r in nested.shred(df, ["k"], kind="fields").collect()}
    assert fields == {("$[0]", "$[0]", "b", "2"), ("$[0]", "$[0]", "t", "x"), ("$[0]", "$[0]", "n", None), ("$[0].o", "$[0]", "p", "1"), ("$[0].o.l[2]", "$[0].o.l[2]", "q", "r")}
    items = {(r.json_path, r.parent_path, r.place, r.value) for r in nested.shred(df, ["k"], kind="items").collect()}
    assert items == {("$", "$", 1, "5"), ("$[0].o.l", "$[0]", 0, "3"), ("$[0].o.l", "$[0]", 1, None), ("$[0].o.l[3]", "$[0]", 0, "4")}


def test_empty_and_repeated(spark):
    assert shredded(spark, []) == {}
    df = spark.createDataFrame([(1, "[{}]", "$"), (1, "[{}]", "$")], "k int, payload string, root string")
    assert nested.shred(df, ["k"]).count() == 2


def test_long_payload(spark):
    assert len(shredded(spark, [json.dumps([{"i": i} for i in range(20_000)])])) == 20_000


values = st.recursive(st.none() | st.integers(-9, 9) | st.text("ab[]{}\"\\ é", max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(values, min_size=1, max_size=12))
def test_any_shape(spark, vs):
    texts = [json.dumps(v) for v in vs]
    assert {k: r.parent_path for k, r in shredded(spark, texts).items()} == {(i, p): q for i, t in enumerate(texts) for p, q in walked(t).items()}


def test_project_payloads(spark):
    m = spark.createDataFrame([(7, '[{"a":1}]', None), (8, None, '{"b":[{}]}')], "message_id long, tool_input string, tool_output string")
    e = spark.createDataFrame([("e1", ([("t", '{"x":[{}]}', "[{}]"), (None, None, "oops")],))] * 2, "id string, trace struct<tool_calls:array<struct<name:string,args:string,result:string>>>")
    rows = nested.message_payloads(m).select("source_field", "record_key", "root", "payload").unionByName(nested.episode_payloads(e))
    got = {(r.source_field, r.record_key, r.json_path) for r in nested.shred(rows, ["source_field", "record_key"]).collect()}
    assert got == {("tool_input", "7", "$[0]"), ("tool_output", "8", "$.b[0]"), ("args", "e1", "$.tool_calls[0].args.x[0]"), ("result", "e1", "$.tool_calls[0].result[0]")}


@pytest.mark.parametrize("text,inner", [('"[1]"', "[1]"), ("[1]", "[1]"), ('"a","b"', None)])
def test_decoded(spark, text, inner):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(nested.decoded(F.col("t")).alias("d")).first().d == inner
