from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing
from textloom.llm import pieces as P

TEXT = st.text(alphabet="اب .\n،؟‌َ", max_size=400)


def test_tokens_of_a_vocabulary(spark):
    """Cuts by tokens: each piece holds at most so many of the whole text's tokens, and the pieces make the text."""
    sums, text = packing.token_sums(), "ماده یک قانون مدنی. the civil code says so.\n" * 40
    counts = sums(text)
    assert counts[0] == 0 and counts[-1] == packing.token_counter(packing.TOKENIZER)(text) and counts == sorted(counts)
    at = P.cuts(text, 50, 10, counts)
    assert all(counts[b] - counts[a] <= 50 for a, b in at) and at[0][0] == 0 and at[-1][1] == len(text) and all(y[0] <= x[1] for x, y in zip(at, at[1:]))
    df = spark.createDataFrame([(1, text), (2, "کوتاه"), (3, None)], "row_id long, text string")
    got = P.split_texts(df, "row_id", "text", 50, 10, sums, True).orderBy("piece_no").collect()
    assert [(r.row_id, r.start, r.end) for r in got] == [(1, a, b) for a, b in at]


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 40), st.integers(0, 30))
def test_pieces_cover(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    at = P.cuts(text, limit, overlap)
    if not text:
        assert at == []
        return
    assert at[0][0] == 0 and at[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in at)
    for (_, b), (c, _) in zip(at, at[1:]):
        assert c == max(b - overlap, c) and (c == b - overlap or b - overlap < c)
    whole = text[: at[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(at, at[1:]))
    assert whole == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(4, 12), st.integers(0, 3))
def test_token_sums(sizes, limit, overlap):
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    at = P.cuts("x" * len(sizes), limit, overlap, sums)
    assert at[-1][1] == len(sizes) and all(sums[b] - sums[a] <= limit for a, b in at)


def test_boundaries():
    text = "یک جمله. جمله دوم است.\n\nپاراگراف دوم که بلند است"
    a, b = P.cuts(text, 40, 0)[0]
    assert text[a:b].endswith("\n\n")
    assert P.cuts("a" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_split(spark):
    df = spark.createDataFrame([(1, "x" * 25, 9), (2, "x" * 10, 9), (3, None, 9), (4, "", 9), (5, "😀" * 11, 9)], "row_id long, text string, piece int")
    rows = P.split_texts(df, "row_id", "text", 10, 0).collect()
    assert sorted((r.row_id, r.piece_no, r.n_pieces) for r in rows) == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (2, 1, 1), (5, 1, 2), (5, 2, 2)]
    assert {r.row_id for r in P.split_texts(df, "row_id", "text", 10, 0, only_larger=True).collect()} == {1, 5}
    assert P.split_texts(df.limit(0), "row_id", "text", 10, 0).count() == 0
