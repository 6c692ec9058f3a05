import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import contamination as K
from lorewell.llm import encoding as E
from lorewell.llm import packing as P

# --- packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 100)), max_size=80))
def test_fill_keeps_all_and_fits(items):
    boxes, _ = P.fill(items, 100)
    assert sorted(k for b in boxes for k in b) == list(range(len(items)))
    assert all(sum(items[k][1] for k in b) <= 100 for b in boxes)


def test_fill_leaves_little_and_keeps_the_mixture():
    rng = random.Random(3)
    items = [(rng.choice("aaabbc"), int(rng.paretovariate(1.1) * 20) % 1900 + 5) for _ in range(5000)]
    boxes, _ = P.fill(items, 2048)
    total = sum(n for _, n in items)
    assert len(boxes) <= -(-total // 2048) + 2
    share = Counter()
    for s, n in items:
        share[s] += n / total
    half = Counter()
    for b in boxes[: len(boxes) // 2]:
        for k in b:
            half[items[k][0]] += items[k][1]
    got = {s: n / sum(half.values()) for s, n in half.items()}
    assert all(abs(got[s] - share[s]) < 0.1 for s in share)


def test_pack(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Wörter", "x1", "and", "the"]) for _ in range(rng.choice([3, 30, 300, 5000]))) for _ in range(60)] + [None, "", "<|endoftext|> is text"]
    rows = [(k, t, rng.choice(["hot", "hot", "cold", None]), 9) for k, t in enumerate(texts)] + [(0, texts[0], "hot", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    enc = P._encoding(P.TOKENIZER)
    for shard in (P.SHARD_TOKENS, 4000):
        got = P.pack(docs, 512, shard_tokens=shard).collect()
        size = Counter()
        for r in got:
            size[r.container_id] += r.n_tokens
            assert r.token_end - r.token_start == r.n_tokens <= 512 and r.tokenizer == "byte_bpe_50k.tiktoken"
        assert max(size.values()) <= 512
        for k, t, _, _ in rows[1:-1]:
            n = len(enc.encode_ordinary(t or ""))
            mine = sorted((r.piece, r.token_start, r.token_end) for r in got if r.doc_id == k)
            assert mine[0][1] == 0 and mine[-1][2] == n and all(a[2] == b[1] for a, b in zip(mine, mine[1:]))
            assert len(mine) == max(1, -(-n // 512))
        assert sum(r.n_tokens for r in got if r.doc_id == 0) == 2 * len(enc.encode_ordinary(texts[0]))
    assert P.pack(docs.limit(0), 512).count() == 0


def test_deficits_go_on():
    """A source that had too little in one call leads in the next, and targets are kept while sources last."""
    items = [("a", 10)] * 300 + [("b", 10)] * 300
    boxes, owed = P.fill(items, 100, {"a": 500.0}, {"a": 1, "b": 1})
    first = [sum(items[k][0] == "a" for k in b) for b in boxes[:12]]
    assert first[0] == 10 and sum(first) == 85 and abs(sum(owed.values()) - 500) < 1e-6
    boxes, _ = P.fill(items, 100, None, {"a": 3, "b": 1})
    assert all(abs(sum(items[k][0] == "a" for k in b) - 7.5) <= 1 for b in boxes[:30])


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["tok"] * rng.randint(5, 60)), "abc"[min(2, rng.randint(0, 5))]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard in (P.SHARD_TOKENS, 6000):
        got = P.mixture(P.pack(docs, 256, shard_tokens=shard)).collect()
        assert {r.source for r in got} == {"a", "b", "c"} and abs(sum(r.mean_share for r in got) - 1) < 1e-4 and all(r.deviation < 0.3 for r in got)


# --- evaluation passages


def windows(docs, items, n):
    have = {}
    for i, t in items:
        w = K.words(t)
        for k in range(len(w) - n + 1):
            have.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = K.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in have.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_against_windows(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 12 if seed == 3 else 300)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 60)))) for k in range(25)]
    docs = []
    for k in range(120):
        t = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            t += w[a : a + rng.randint(8, 30)] + [word() for _ in range(5)]
        docs.append((k, rng.choice([" ", "\n> ", "</b> ", ", "]).join(t)))
    docs += [(900, None), (901, ""), docs[0]]
    items += [(90, None), (91, "too short")]
    d, i = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = windows(docs, items, 12)
    index = K.SuffixIndex.build(d, shard=400)
    assert {(r.doc_id, r.item_id) for r in index.leaks(i).collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in K.leaked_items(d.drop("item_id"), i).collect()} == want
    monkeypatch.setattr(K, "BLOCK_WORDS", 200)
    monkeypatch.setattr(K, "STEP", 7)
    assert {(r.doc_id, r.item_id) for r in K.SuffixIndex(spark, index.path).leaks(i).collect()} == want
    assert {r.doc_id for r in K.without_leaks(d, i).collect()} == {x[0] for x in docs} - {x[0] for x in want}


def matched(doc, item, minimum=12):
    text = np.append(K.hashed([item]), np.uint64(0))
    return sorted((int(p), int(q), int(n)) for ps, qs, ns in K.Shard.of([7], [doc]).passages(text, minimum) for p, q, n in zip(ps, qs, ns))


def test_matches_are_maximal():
    item = [f"i{k}" for k in range(40)]
    doc = ["a", *item[3:25], "b", *item[30:40], *item[:14]]
    assert matched(doc, item) == [(1, 3, 22), (34, 0, 14)]
    assert matched(["a"], item) == [] == matched(doc, ["a"])
    assert matched(["x"] * 14, ["x"] * 13) == [(0, 0, 13), (0, 1, 12), (1, 0, 13), (2, 0, 12)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffixes_are_in_order(codes):
    codes = [*codes, -1]
    assert K.suffix_array(np.array(codes)).tolist() == sorted(range(len(codes)), key=lambda k: codes[k:])


def test_words_of_marked_text():
    assert K.words("<p>Don’t &amp; “Stop”[b]it[/b]</p>\n> next—one") == ["don", "t", "stop", "it", "next", "one"]


def test_empty_sets(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert K.leaks(d, i).count() == 0


# --- wrong encodings

GOOD = [
    None, "", "plain", "Ça coûte 20 €, n’est-ce pas… “très” cher — déjà.", "Die Größe für Straßen über Öl", "O CORAÇÃO NÃO PÁRA", "SÃO ÂNGULO É", "±5 % at 20 °C, ½ turn. 10 €/m², £20", "├── src\n└── lib", "╔══╗ box ╚══╝", "√2 ≈ 1.41, μ≈∂x",
    "ВСЁ ВЕРНО. Это было очень хорошо…", "Zażółć gęślą jaźń", "¿Qué? El niño", "Âge et À bientôt", "日本語のテキスト", "10 µm and 5 Ω", "naïve café &eacute; &amp;",
    "äöü", "ÅÄÖ", "ÆØÅ", "CŒUR", "wait…what", "x²y", "a×b", "foo•bar", "price™store", "pаypal", "x²y and a×b", "foo•bar price™store wait…what", "The “fix” didn’t — help… That’s all", "E=mc², 3×4±1, 20°C·h",
]


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_is_left_alone(text):
    assert E.repair(text) == (False, text, True)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250"])
@pytest.mark.parametrize("text", ["Ça coûte 20 €, n’est-ce pas… très cher — déjà.", "Die Größe für Straßen über Öl", "El niño más allá", "Zażółć gęślą jaźń"])
def test_utf8_read_as_single_bytes_comes_back(text, wrong):
    bad = E._read(text.encode("utf-8"), wrong)
    if bad is None:
        pytest.skip("not readable")
    assert E.repair(bad) == (True, text, True)
    mixed = "déjà vu — " + bad + "\n√2 ≈ 1.41 für"
    assert E.repair(mixed) == (True, "déjà vu — " + text + "\n√2 ≈ 1.41 für", True)


def test_twice_garbled():
    text = "l’été déjà — “café”"
    bad = E._read(E._read(text.encode(), "cp1252").encode(), "cp1252")
    assert E.repair(bad) == (True, text, True)


@pytest.mark.parametrize("true,wrong", [("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251")])
def test_cyrillic_single_bytes(true, wrong):
    text = "Это было очень давно, и когда уже или не тогда, как при нас."
    hit, fixed, done = E.repair("Fine line\n" + text.encode(true).decode(wrong))
    assert hit and fixed == "Fine line\n" + text


def test_cyrillic_utf8_read_as_cp1251():
    text = "Это было в нём и тогда"
    assert E.repair(E._read(text.encode(), "cp1251"))[:2] == (True, text)


def test_central_european_single_bytes():
    text = "to będzie także świat który już się śmieje"
    hit, fixed, _ = E.repair(text.encode("cp1250").decode("cp1252"))
    assert hit and fixed == text


def test_marks_of_invented_words():
    """No frequent word tells the pair, only the marks inside the words do."""
    text = "Tąześdast rłeflźdox młglosćlt"
    for true, wrong in (("cp1250", "latin-1"), ("iso8859-2", "latin-1")):
        hit, fixed, done = E.repair("one line\n" + text.encode(true).decode(wrong))
        assert hit and done and fixed == "one line\n" + text


def test_restored_texts_compare_with_their_originals():
    """Held-out sentences through every pair: nothing correct changes, and at least 0.95 of what is told comes back exactly."""
    rng, tried, told, back = random.Random(4), 0, 0, 0
    for text in ("Può darsi che la città sia già più lontana", "Où est passé l’élève de l’été dernier", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Für die große Prüfung müssen wir üben", "Съешь ещё этих мягких французских булок"):
        for wrong in ("cp1252", "latin-1", "cp437", "mac-roman", "cp850"):
            bad = E._read(text.encode(), wrong)
            if bad is None:
                continue
            tried += 1
            before, after = rng.choice(["naïve", "plain", "20 °C"]), rng.choice(["über", "ok", "½"])
            hit, fixed, _ = E.repair(f"{before} {bad} {after}")
            told += hit
            back += fixed == f"{before} {text} {after}"
    assert tried > 15 and told == tried and back >= 0.95 * told


def test_lost_characters_are_reported():
    assert E.repair("gl�p�n ok") == (True, "gl�p�n ok", False)


def test_operator(spark):
    df = spark.createDataFrame([(1, "cafÃ©", 0), (1, "cafÃ©", 0), (2, "café", 0), (3, None, 0), (4, "", 0), (5, "x" * 200_000 + "Ã©", 0)], "doc_id long, text string, restored int")
    got = sorted((r.doc_id, r.restored[-4:], r.complete) for r in E.repaired(df).collect())
    assert got == [(1, "café", True), (1, "café", True), (5, "xxxé", True)]
    assert E.repaired(df.limit(0)).count() == 0
