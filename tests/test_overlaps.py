"""Pairs by field overlaps against all pairs, and what they write."""

import random
import tracemalloc

import numpy as np
import pytest

from lorewell.operators import overlaps, retrieval

W = retrieval.WEIGHTS
SCHEMA = "id string, scope string, title string, triggers array<string>, problem string, recommendation string"


def rows(n, seed, edits=0.3):
    r = random.Random(seed)
    words = [f"w{k}q" for k in range(300)]
    draw = lambda k: [words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randint(0, k))]
    out = []
    for k in range(n):
        if out and r.random() < edits:
            old = r.choice(out)
            f = [list(x) for x in old[2:]]
            f[r.randrange(4)] = draw(6)
            out.append((f"i{seed}_{k:04d}", r.choice(["a", "b"]), *f))
        else:
            out.append((f"i{seed}_{k:04d}", r.choice(["a", "b"]), draw(5), draw(4), draw(12), draw(14)))
    return [(i, s, " ".join(t), g, " ".join(p), " ".join(c)) for i, s, t, g, p, c in out]


def score(a, b):
    words = lambda x: set(x if isinstance(x, list) else x.split())
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0
    (t, g, p, c), (u, h, q, d) = [[words(x) for x in r[2:]] for r in (a, b)]
    return round(W["title"] * dice(t, u) + W["triggers"] * (len(g & h) / max(len(g), len(h)) if g or h else 0.0) + W["recommendation"] * dice(c, d) + W["problem"] * dice(p, q), 6)


def block(data, table=None, threshold=0.32):
    names = list(W)
    at = {"title": 2, "triggers": 3, "problem": 4, "recommendation": 5}
    sets = [[np.array(sorted({hash((f, w)) for w in (r[at[f]] if f == "triggers" else r[at[f]].split())}), np.int64) for r in data] for f in names]
    sizes = np.array([[len(s) for s in f] for f in sets], np.int64).T
    columns = [np.concatenate([*f, np.zeros(0, np.int64)]) for f in sets]
    packed = overlaps.packed(columns, sizes, np.ones(overlaps.CELLS) if table is None else table, retrieval._FIELDS, threshold)
    parts = dict(zip(("names", "kinds", "codes", "first"), (x.tobytes() for x in packed), strict=True))
    return overlaps.Block({"ids": [r[0] for r in data], "groups": [r[1] for r in data], "sizes": sizes.astype(np.uint32).tobytes(), **parts})


@pytest.mark.parametrize("step", [1, 50, 1 << 18])
def test_blocks_give_all_pairs_once_whatever_the_steps(monkeypatch, step):
    monkeypatch.setattr(overlaps, "STEP", step)
    monkeypatch.setattr(overlaps, "ROUND", step)
    monkeypatch.setattr(overlaps, "MARKS", 700 * step)
    x, y = rows(120, 1), rows(80, 2)
    y += [(f"c{k}", *r[1:]) for k, r in enumerate(x[:30])]
    a, b = block(x), block(y)
    got = [(i, j) for p, q, _ in overlaps.similar(a, b, retrieval._FIELDS, 0.32) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    want = {(i, j) for i, r in enumerate(x) for j, s in enumerate(y) if r[1] == s[1] and score(r, s) >= 0.32}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    got = [tuple(sorted(z)) for p, q, _ in overlaps.similar(a, None, retrieval._FIELDS, 0.32) for z in zip(p.tolist(), q.tolist(), strict=True)]
    want = {(i, j) for i, r in enumerate(x) for j, s in enumerate(x[:]) if i < j and r[1] == s[1] and score(r, s) >= 0.32}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def no_join(df):
    return "Join" not in df._jdf.queryExecution().sparkPlan().toString()


def test_similar_pairs_write_no_pairs_that_only_meet(spark):
    x = rows(150, 3)
    df = spark.createDataFrame(x, SCHEMA)
    pairs = retrieval.similar_pairs(df)
    assert no_join(pairs)
    heads = {r.class_id for r in retrieval.copies_of(df).collect()}
    x = [r for r in x if r[0] in heads]
    assert {(r.id_a, r.id_b): r.score for r in pairs.collect()} == pytest.approx({(r[0], s[0]): score(r, s) for r in x for s in x if r[0] < s[0] and r[1] == s[1] and score(r, s) >= 0.32})


def test_best_matches_join_no_sets_to_pairs(spark):
    x, y = rows(60, 5), rows(90, 6)
    x += [(f"c{k}", *r[1:]) for k, r in enumerate(y[:20])]
    best = retrieval.best_matches(spark.createDataFrame(x, SCHEMA), spark.createDataFrame(y, SCHEMA))
    assert no_join(best)
    want = {}
    for r in x:
        if over := [(-score(r, s), s[0]) for s in y if score(r, s) >= 0.4]:
            want[r[0]] = (min(over)[1], pytest.approx(-min(over)[0]))
    assert {r.id: (r.match_id, r.score) for r in best.collect()} == want and len(want) > 20


def test_most_similar_joins_no_sets_to_pairs(spark):
    x = rows(150, 7)
    df = spark.createDataFrame(x, SCHEMA)
    top = retrieval.most_similar(df, df.where("id like '%5'"), 2)
    assert no_join(top)
    want = set()
    for r in x:
        best = sorted((-score(r, s), s[0]) for s in x if s[0] != r[0] and score(r, s) >= 0.32)[:2]
        want |= {(r[0], n + 1, s) for n, (_, s) in enumerate(best) if r[0].endswith("5")}
    assert {(r.query_id, r["rank"], r.id) for r in top.collect()} == want and len(want) > 5


def test_what_is_shipped_follows_the_records_and_not_the_partitions(spark, monkeypatch):
    """A record is shipped once for each block of the other side; 40 partitions of a few records are not 40 blocks."""
    x, y = rows(60, 8), rows(120, 9)
    y += [(f"c{k}", *r[1:]) for k, r in enumerate(x[:20])]
    made = lambda data: retrieval.token_sets(spark.createDataFrame(data, SCHEMA).repartition(40))
    shipped = lambda df: sum(len(r.ids) for r in df.collect())
    kind = type(spark.range(1))
    sent, run = [], kind.mapInArrow

    def watched(df, f, schema):
        if "ids" in df.columns and "side" in df.columns:
            sent.append(shipped(df))
        return run(df, f, schema)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    for least, blocks_ in ((None, (1, 1)), (20, (1, 7))):
        if least:
            monkeypatch.setattr(overlaps, "LEAST", least)
        met = overlaps.pairs(made(x), made(y), retrieval._FIELDS, 0.32)
        got = [(r.id_a, r.id_b) for r in met.collect()]
        want = {(r[0], s[0]) for r in x for s in y if score(r, s) >= 0.32}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
        assert sent.pop() == len(x) * blocks_[1] + len(y) * blocks_[0]
    alone = overlaps.pairs(made(y), None, retrieval._FIELDS, 0.32)
    got = [(r.id_a, r.id_b) for r in alone.collect()]
    want = {(r[0], s[0]) for r in y for s in y if r[0] < s[0] and score(r, s) >= 0.32}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert sent.pop() == len(y) * overlaps.numbers(len(y), None)[0] and overlaps.numbers(len(y), None)[0] > 2


def test_dealt_blocks_are_even():
    held = [0] * 3
    records = [(c, n) for c, n in enumerate([10, 1, 1, 1, 9, 8, 4, 3, 3, 3, 2])]
    for chunk, b in overlaps.dealt(records, 3).items():
        held[b] += dict(records)[chunk]
    assert sum(held) == 45 and max(held) - min(held) <= 2
    assert overlaps.numbers(4_000, 320_000) == (1, 24) and overlaps.numbers(0, 0) == (1, 1) and overlaps.numbers(320_000, None) == (7, 1)


def test_frequencies_reach_the_driver_without_an_object_for_each_cell(spark):
    t = spark.range(200_000).selectExpr("array(id, id + 1) as a")
    overlaps.frequencies([t.limit(1)], ["a"])
    tracemalloc.start()
    try:
        n = overlaps.frequencies([t], ["a"])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n[0] == 1 and (n[1:200_000] == 2).all() and n[200_000] == 1 and n.sum() == 400_000
    assert most < 2 * n.nbytes


def test_links_read_the_token_sets_once(spark):
    x = rows(80, 4)
    df = spark.createDataFrame(x + [(f"z{r[0]}", *r[1:]) for r in x[:9]], SCHEMA)
    links = retrieval.links(df)
    assert "regexp" not in links._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(r.id_a, r.id_b) for r in retrieval.similar_pairs(df).collect()} | {(r.id_a, r.id_b) for r in retrieval.linked_copies(df).collect()}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
