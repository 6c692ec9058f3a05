import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import splitting as S
from tests.test_operators import messages

texts = st.lists(st.text(st.sampled_from("ab .\n!?é😀"), max_size=60), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(2, 40), st.integers(0, 20), st.text("xyz", max_size=30))
def test_pieces_cover_and_fit(contents, limit, overlap, context):
    overlap = min(overlap, limit - 1)
    got = S.pieces(contents, limit, overlap, context)
    whole, before = "".join(contents), context
    at = 0
    for text, repeated in got:
        assert len(text) <= limit and repeated <= overlap
        assert before.endswith(text[:repeated]) or repeated == 0
        fresh = text[repeated:]
        assert fresh and whole[at : at + len(fresh)] == fresh
        at += len(fresh)
        before += fresh
    assert at == len(whole)
    if whole and len(whole) + min(overlap, len(context)) <= limit:
        assert len(got) == 1


def test_no_two_neighbours_could_be_one():
    random.seed(4)
    contents = ["".join(random.choice("abc. ") for _ in range(random.randint(1, 900))) for _ in range(60)]
    sizes = [len(t) - n for t, n in S.pieces(contents)]
    assert all(a + b > S.LIMIT - S.OVERLAP for a, b in zip(sizes[1:], sizes[2:]))


def test_strong_boundaries_are_kept():
    para = ["x" * 40 + ". " + "y" * 30 + "\n\n" + "z" * 60 + "\n" + "w" * 20]
    assert [t[n:] for t, n in S.pieces(para, 100, 10)] == ["x" * 40 + ". " + "y" * 30 + "\n\n", "z" * 60 + "\n" + "w" * 20]
    assert [t for t, _ in S.pieces(["a" * 60, "b" * 60], 100, 0)] == ["a" * 60, "b" * 60]
    assert S.pieces(["", ""]) == [] == S.pieces([])


def test_long_text_without_boundaries():
    got = S.pieces(["q" * 100_000])
    assert max(len(t) for t, _ in got) <= S.LIMIT and sum(len(t) - n for t, n in got) == 100_000


def test_deltas(spark):
    big = "w" * 1600
    rows = [("s", 0, "user", big, None, None), ("s", 1, "user", None, None, None), ("s", 2, "user", big, None, None), ("s", 2, "user", big, None, None), ("t", 0, "user", big, None, None), ("t", 0, "user", big, None, None)]
    d = spark.createDataFrame([("s", 1, 0, 3), ("s", 1, 0, 3), ("s", 2, 2, 3), ("t", 1, 0, 9), ("s", None, 0, 3), (None, 1, 0, 3), ("s", 3, 3, 3), ("none", 1, 0, 5)], "session_id string, delta_number int, line_start long, line_end long")
    p = S.split_deltas(d, messages(spark, rows))
    assert [(r.session_id, r.delta_number) for r in S.oversized(p).collect()] == [("s", 1)]
    assert sum(r.n_chars - r.n_repeated for r in p.collect()) == 3200
    assert S.split_deltas(d.limit(0), messages(spark, rows)).count() == 0
    assert S.split_messages(messages(spark, rows)).count() == 0


def joined(rows, limit, overlap):
    """The fresh text of the pieces in their order, after checking sizes and overlaps."""
    text = ""
    for r in rows:
        assert len(r.text) <= limit and (r.n_repeated == 0 or text.endswith(r.text[: r.n_repeated]))
        text += r.text[r.n_repeated :]
    assert all(r.n_repeated == overlap for r in rows[1:])
    return text


def test_delta_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(S, "JOIN_LINES", 4)
    rows = [("s", q, "user", f"{q:03d}" * (1 if 20 <= q < 30 else 30), None, None) for q in range(60)]
    d = spark.createDataFrame([("s", 1, 0, 60), ("s", 2, 10, 44), ("s", 3, 0, 17)], "session_id string, delta_number int, line_start long, line_end long")
    p = S.split_deltas(d, messages(spark, rows), 700, 50).orderBy("delta_number", "block", "piece").collect()
    assert {r.block for r in p} > {0}
    for n, a, b in ((1, 0, 60), (2, 10, 44), (3, 0, 17)):
        assert joined([r for r in p if r.delta_number == n], 700, 50) == "".join(x[3] for x in rows[a:b])


def test_the_number_of_lines_does_not_matter(spark):
    """Many short lines are cut like the same messages on few lines, and a small delta of many lines is not cut at all."""
    rows = [("a", q, "user", f"m{q % 10}", None, None) for q in range(5000)] + [("c", q, "user", "x" if q % 5 == 0 else "", None, None) for q in range(5000)]
    d = spark.createDataFrame([("a", 1, 0, 5000), ("c", 1, 0, 5000)], "session_id string, delta_number int, line_start long, line_end long")
    got = S.split_deltas(d, messages(spark, rows)).orderBy("block", "piece").collect()
    assert [(r.text, r.n_repeated) for r in got] == S.pieces([r[3] for r in rows[:5000]]) and {r.session_id for r in got} == {"a"}
