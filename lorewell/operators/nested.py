"""Deeply nested semi-structured payloads turned into flat, linked tables.

The projection is built of higher-order SQL only. A payload becomes an array of container nodes;
each level maps every node to its child containers with nested ``transform`` calls that attach the
ancestor's path and index, ``flatten`` joins the arrays, and one ``inline`` per target table emits
rows. No schema is inferred: objects are read as ``MAP<STRING,STRING>`` and arrays as
``ARRAY<STRING>``, so payloads of any shape go through the same plan, and there is no shuffle.

A string that is itself a JSON object or array counts as that container; at the root it may have
been encoded several times. ``LEVELS`` containers and ``DECODED`` encodings are unrolled in one pass.
Payloads that are deeper, or encoded more often, leave a remainder, which is written and goes through
further passes until nothing is left, so neither has a limit.

Three related tables come out: ``elements`` (array elements that are objects), ``fields`` (the plain
values of objects) and ``items`` (the plain values of arrays). A row of each names its record, its own
path and that of the element it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.store import cut

LEVELS = 16
DECODED = 3
STRICT = {"allowSingleQuotes": "false"}
BLANKS = " \t\r\n"


def _let(value: Column, body) -> Column:
    """Binds a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(text: Column) -> Column:
    return F.substring(F.ltrim(text, F.lit(BLANKS)), 1, 1)


def _parsed(text: Column, kind: str) -> Column:
    """Reads one value of ``kind``; anything beside that value makes the whole invalid."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", STRICT)


def _node(path: Column, parent: Column, element: Column, text: Column) -> Column:
    first = _first(text)
    return F.struct(
        path.alias("path"), parent.alias("parent"), element.alias("element"),
        F.when(first == "{", _parsed(text, "map<string,string>")).alias("o"),
        F.when(first == "[", _parsed(text, "array<string>")).alias("a"),
    )


def _valid(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: F.coalesce(F.size(n["o"]) == 1, F.size(n["a"]) == 1, F.lit(False)))


def _is_container(text: Column) -> Column:
    return F.coalesce(_first(text).isin("{", "["), F.lit(False))


def decoded(text: Column, times: int = DECODED) -> Column:
    """A payload that was encoded as a JSON string as its inner text, after at most ``times`` steps; null if it is not valid."""
    for _ in range(times):
        text = _let(
            text,
            lambda t: F.when(_first(t) == '"', _let(_parsed(t, "string"), lambda u: F.when(F.size(u) == 1, F.get(u, F.lit(0))))).otherwise(t),
        )
    return text


def _children(nodes: Column) -> Column:
    def of_object(n):
        inside = F.map_entries(F.map_filter(F.get(n["o"], F.lit(0)), lambda k, v: _is_container(v)))
        here = F.when(n["element"], n["path"]).otherwise(n["parent"])
        return F.transform(inside, lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), here, F.lit(False), e["value"]))

    def of_array(n):
        at = F.transform(F.get(n["a"], F.lit(0)), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        inside = F.filter(at, lambda e: _is_container(e["v"]))
        return F.transform(inside, lambda e: _node(F.concat(n["path"], F.lit("["), e["i"].cast("string"), F.lit("]")), n["parent"], F.lit(True), e["v"]))

    return _valid(F.flatten(F.transform(nodes, lambda n: F.when(n["o"].isNotNull(), of_object(n)).otherwise(of_array(n)))))


def _emitted(nodes: Column, kind: str) -> Column:
    """The rows that the containers of one level give to a table."""
    if kind in ("paths", "elements"):
        objects = F.filter(nodes, lambda n: n["element"] & n["o"].isNotNull())

        def row(n):
            cells = [n["path"].alias("json_path"), n["parent"].alias("parent_path")]
            if kind == "elements":
                cells.append(F.get(n["o"], F.lit(0)).alias("attributes"))
            return F.struct(*cells)

        return F.transform(objects, row)
    if kind == "fields":

        def of_object(n):
            plain = F.map_entries(F.map_filter(F.get(n["o"], F.lit(0)), lambda k, v: ~_is_container(v)))
            owner = F.when(n["element"], n["path"]).otherwise(n["parent"])
            return F.transform(plain, lambda e: F.struct(n["path"].alias("json_path"), owner.alias("parent_path"), e["key"].alias("name"), e["value"].alias("value")))

        return F.flatten(F.transform(F.filter(nodes, lambda n: n["o"].isNotNull()), of_object))

    def of_array(n):
        at = F.transform(F.get(n["a"], F.lit(0)), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        return F.transform(F.filter(at, lambda e: ~_is_container(e["v"])), lambda e: F.struct(n["path"].alias("json_path"), n["parent"].alias("parent_path"), e["i"].alias("place"), e["v"].alias("value")))

    return F.flatten(F.transform(F.filter(nodes, lambda n: n["a"].isNotNull()), of_array))


def shred(payloads: DataFrame, keys: list[str], payload: str = "payload", root: str = "root", kind: str = "elements", levels: int = LEVELS) -> DataFrame:
    """One of the tables of each payload: ``elements``, the same without attributes (``paths``), ``fields`` or ``items``.

    ``payloads`` has the key columns, the JSON text and the path at which the text sits. All tables have the
    keys, ``json_path`` (of the element; of the object or array that holds the value) and ``parent_path``, the
    path of the nearest enclosing array element that is an object, else the root path (of a field: the element
    itself, if the object is one). ``elements`` has ``attributes``: the object's own fields as text, nested values
    as JSON; ``fields`` has name and value, ``items`` place and value; a JSON null is a null value.

    Nulls, empty texts and texts that are not one valid JSON value give no rows; a key that occurs twice
    in an object gives its containers twice; an empty table gives an empty table; other columns are
    dropped, so their names cannot clash.
    """
    source = payloads.select(*[F.col(k) for k in keys], F.col(root).alias("__root"), F.col(payload).alias("__rest"))
    source = source.where(_first(F.col("__rest")).isin("{", "[", '"'))
    level = source.withColumn("__level", F.lit(None))
    parts = []
    while True:
        # What is a string still goes on as a text; what is a container becomes the first node.
        again = level.select(*keys, "__root", "__level", F.inline(F.array(F.struct(decoded(F.col("__rest")).alias("__rest")))))
        node = _valid(F.transform(F.array("__rest"), lambda t: _node(F.col("__root"), F.col("__root"), F.lit(False), t)))
        nested = F.when(F.col("__rest").isNotNull(), node)
        level = again.select(
            *keys, "__root", (nested if not parts else F.concat(F.coalesce(nested, F.array()), F.coalesce("__level", F.array()))).alias("__level"),
            F.when(_first(F.col("__rest")) == '"', F.col("__rest")).alias("__rest"),
        )
        rows: list[str] = []
        for k in range(levels):
            level = level.select(*keys, "__root", "__rest", *[F.col(c) for c in rows], _emitted(F.col("__level"), kind).alias(f"__r{k}"), _children(F.col("__level")).alias("__level"))
            rows.append(f"__r{k}")
        found = F.flatten(F.filter(F.array(*rows), lambda r: r.isNotNull()))
        done = cut(level.select(*keys, "__root", "__rest", found.alias("__rows"), F.col("__level")), "nested")
        parts.append(done.select(*keys, F.inline("__rows")))
        level = done.where("size(__level) > 0 or __rest is not null").select(*keys, "__root", "__rest", "__level")
        if level.isEmpty():
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def message_payloads(messages: DataFrame) -> DataFrame:
    """The JSON texts of message rows: (source_field, record_key, root, payload)."""
    return messages.select(
        F.col("message_id").cast("string").alias("record_key"), F.lit("$").alias("root"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("source_field"), F.col(c).alias("payload")) for c in ("tool_input", "tool_output")])),
    ).where(F.col("payload").isNotNull())


def episode_payloads(episodes: DataFrame) -> DataFrame:
    """The JSON texts of episodes' tool calls; replayed episodes count once."""
    calls = episodes.select(F.col("id").alias("record_key"), F.col("trace.tool_calls").alias("c")).where(F.size("c") > 0).distinct()
    return calls.select("record_key", F.posexplode("c").alias("i", "call")).select(
        "record_key",
        F.concat(F.lit("$.tool_calls["), F.col("i").cast("string"), F.lit("]")).alias("at"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("source_field"), F.col("call")[c].alias("payload")) for c in ("args", "result")])),
    ).select("source_field", "record_key", F.concat("at", F.lit("."), "source_field").alias("root"), "payload").where(F.col("payload").isNotNull())
