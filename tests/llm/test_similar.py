import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import batch_dedup, near_dup, wordsets


def words(t):
    return set(re.findall("[a-z0-9]+", (t or "").lower()))


def similar(a, b, t=0.6):
    return bool(a | b) and len(a & b) / len(a | b) >= t - 1e-9


def edited(rng, text, share):
    out = []
    for w in text.split():
        if rng.random() < share:
            w = rng.choice([f"v{rng.randint(0, 60)}", "", w + "x"])
        out.append(w)
    rng.shuffle(out)
    return " ".join(out)


def corpus(seed, n=140, sizes=(1, 2, 3, 8, 40, 110, 230)):
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        base = " ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.choice(sizes)))
        texts += [base, *[edited(rng, base, rng.choice([0, 0.05, 0.15, 0.3])) for _ in range(rng.randint(0, 4))]]
    return texts[:n]


def pairs_of(texts, t=0.6):
    sets = {k: words(v) for k, v in texts.items() if k is not None}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(sets[a], sets[b], t)}


@pytest.mark.parametrize("seed,t", [(1, 0.6), (2, 0.8), (3, 0.5)])
def test_near_duplicates_against_brute_force(spark, seed, t):
    texts = {f"d{k:03d}": v for k, v in enumerate(corpus(seed))} | {"null": None, "blank": " ?! ", "nul2": None}
    df = spark.createDataFrame([(k, v, 1, "w", 2) for k, v in texts.items()] + [("d000", texts["d000"], 1, "w", 2), (None, "v1", 1, "w", 2)], "id string, text string, n int, words string, class_id int")
    nd = near_dup.NearDuplicates(df, "id", [F.col("text")], t)
    assert {(r.id_a, r.id_b) for r in nd.all_pairs().collect()} == pairs_of(texts, t)
    linked = {r.id: r for r in nd.linked().collect()}
    assert set(linked) == {k for k, v in texts.items() if words(v)}
    for k, r in linked.items():
        assert r.copies == sum(words(v) == words(texts[k]) for v in texts.values())


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    nd = near_dup.NearDuplicates(df, "id", [F.col("text")])
    assert nd.all_pairs().count() == 0 == nd.linked().count()


def test_a_hot_group_of_copies(spark):
    rows = [(f"c{k:04d}", "the very same text of a post") for k in range(300)] + [("x", "quite another one here")]
    nd = near_dup.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", [F.col("text")])
    assert nd.pairs.count() == 0 and nd.linked().where("copies = 300").count() == 300


def test_parts_of_hot_buckets_lose_nothing(spark):
    texts = {f"d{k:03d}": v for k, v in enumerate(corpus(9))}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    nd = near_dup.NearDuplicates(df, "id", [F.col("text")], bucket=2_000, part=300)
    assert {(r.id_a, r.id_b) for r in nd.all_pairs().collect()} == pairs_of(texts)


def test_groups(spark):
    base = [f"w{k}" for k in range(20)]
    rows = [(f"g{k}", " ".join(base[k:] + [f"x{j}" for j in range(k)])) for k in range(8)] + [("z", "alone here"), ("y", "alone here"), ("n", None)]
    got = {r.id: r.group_id for r in near_dup.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", [F.col("text")]).groups().collect()}
    assert got == {f"g{k}": "g0" for k in range(8)} | {"z": "y", "y": "y"}


def test_bitmaps_bound_the_differing_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (set(rng.integers(0, 80, 40).tolist()) for _ in range(2))
        h = [near_dup.mixed(np.array(sorted(s), np.uint64), 7).astype(np.int64) for s in (x, y)]
        e = near_dup._incidence(np.zeros(wordsets.CELLS, np.uint32), 0.6, 1)(np.arange(2), np.concatenate(h), np.cumsum([0, len(h[0]), len(h[1])]))[4]
        assert np.bitwise_count(e.plane[0] ^ e.plane[1]).sum() <= len(x ^ y)


def test_fingerprints_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(2)
    for j in (0.3, 0.6, 0.9):
        common, own = int(round(1000 * j)), 1000 - int(round(1000 * j))
        h = rng.integers(-(2**63), 2**63, common + own, np.int64)
        a, b = h[: common + own // 2], np.concatenate([h[:common], h[common + own // 2 :]])
        p = batch_dedup.fingerprints(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((p[0] == p[1]).mean() - j) < 0.12
        assert abs(((p[0] ^ p[1]) & 1).mean() - (1 - j) / 2) < 0.12


def test_recall_of_the_block_tables():
    """Of pairs at the threshold itself at least 0.99 share a block; the expected share is 0.9999."""
    rng = np.random.default_rng(3)
    sets, bounds = [], [0]
    for _ in range(400):
        h = rng.integers(-(2**63), 2**63, 50, np.int64)
        for s in (h[:40], np.concatenate([h[:30], h[40:]])):  # 30 of 50 words in common
            sets.append(s)
            bounds.append(bounds[-1] + 40)
    p = batch_dedup.fingerprints(np.concatenate(sets), np.array(bounds)).reshape(400, 2, batch_dedup.TABLES, batch_dedup.LEAD)
    assert (p[:, 0] == p[:, 1]).all(axis=2).any(axis=1).mean() >= 0.99


def accepted_in_turn(history, batch):
    """(new, old) of every repeat, candidates taken in order."""
    kept, out = dict(history), set()
    for k, ws in batch:
        hits = {o for o, w in kept.items() if similar(ws, w)}
        out |= {(k, o) for o in hits}
        if not hits and ws:
            kept[k] = ws
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_batches_against_brute_force(spark, seed):
    texts = corpus(seed, 160)
    random.Random(seed).shuffle(texts)
    old = {f"o{k}": words(t) for k, t in enumerate(texts[:60])}
    new = [(f"n{k:03d}", words(t)) for k, t in enumerate(texts[60:])] + [("n900", set())]
    # a chain in which every second one is accepted
    base = [f"c{k}" for k in range(20)]
    new += [(f"n91{k}", set(base[k * 3 :]) | {f"e{k}{j}" for j in range(k * 3)}) for k in range(6)]
    want = accepted_in_turn(old, new)
    frame = lambda rows: spark.createDataFrame([(k, sorted(w), i, 7) for i, (k, w) in enumerate(rows)], "id string, words array<string>, turn int, n int")
    whole = batch_dedup.new_history(spark, frame(list(old.items())))
    assert {(r.new_id, r.old_id) for r in whole.add(frame(new)).collect()} == want
    # the same in three batches, each against a history opened again, compacted in between
    path = batch_dedup.new_history(spark, frame(list(old.items()))).path
    got = set()
    for part in (new[:30], new[30:31], new[31:]):
        step = batch_dedup.History.open(spark, path)
        got |= {(r.new_id, r.old_id) for r in step.add(frame(part)).collect()}
        if len(part) == 1:
            step.compact()
    assert got == want


def test_batches_of_nothing(spark):
    none = spark.createDataFrame([], "id string, words array<string>, turn int")
    h = batch_dedup.new_history(spark, none)
    assert h.add(none).count() == 0
    one = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["y", "x"], 2), ("b", ["q"], 3), (None, ["x"], 0)], "id string, words array<string>, turn int")
    assert [tuple(r) for r in h.add(one).collect()] == [("b", "a", 1.0)]
    assert sorted(r.id for r in h.sets().collect()) == ["a"]


def test_words(spark):
    df = spark.createDataFrame([("É Foo-foo_BAR 12", None)], "a string, b string")
    assert df.select(wordsets.words(F.col("a"), F.col("b")).alias("w")).first().w == ["foo", "bar", "12"]
