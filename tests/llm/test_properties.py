"""Properties on generated texts and numbers."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import abuse, frequent, language, split, tokens

PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "a", "Word", "don't", "'s", "12", "ü", "日本", "🎉", "!?", "_", "‍", "е", "<|endoftext|>"])
TEXT = st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=120), st.lists(PIECES, max_size=60).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_texts_can_be_cut_at_boundaries_and_seams(text):
    enc = tokens.encoder()[0]
    whole = enc.encode_ordinary(text)
    for p in {*tokens.safe_boundaries(text, 1, len(text), True), *(split._seams(text).tolist() if text else [])}:
        assert enc.encode_ordinary(text[:p]) + enc.encode_ordinary(text[p:]) == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30).map(" ".join), st.sampled_from([(16, 4), (40, 10), (60, 0)]))
def test_pieces_keep_the_limit_and_cover_the_text(text, how):
    limit, overlap = how
    enc, lengths = tokens.encoder()
    pieces = split.split_text(text, enc, lengths, limit, overlap)
    assert (pieces is None) == (len(enc.encode_ordinary(text)) <= limit)
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for lo, hi, n in pieces:
            # a single character can have more tokens than a tiny limit, no more than four
            assert n == len(enc.encode_ordinary(text[lo:hi])) <= max(limit, 4)
        assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(pieces, pieces[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=5), st.sampled_from([1, 2, 7, 64]))
def test_bounds_hold_after_merging(parts, width):
    merged, total = frequent.Sketch(2, width), Counter()
    for p in parts:
        c = Counter(map(str, p))
        total += c
        s = frequent.Sketch(2, width)
        if c:
            s.add(frequent.hashes(list(c)), np.array(list(c.values())))
        merged.merge(s)
    if total:
        low, high = merged.bounds(frequent.hashes(list(total)))
        n = np.array(list(total.values()))
        assert (low <= n).all() and (n <= high).all()
    assert (merged.bounds(frequent.hashes(["absent"]))[0] == 0).all()


MODEL = abuse.train([], [])


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_any_text_is_scored_and_cut(text):
    score, restored = MODEL.text(text)
    assert 0 <= score <= 1 and (restored is None) == (score == 0)
    assert all(len(language.windows(s)[0]) <= language.WINDOW for s in language.sentences(text))
    assert language.n_words(text) >= 0


def test_batches_of_bounded_text():
    import pyarrow as pa

    from rivulet.llm.batches import bounded

    texts = ["aa", None, "", "b" * 50, "ccc", "é" * 4, None, "d" * 7]
    b = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    for most in (1, 5, 10, 60, 1000):
        out = list(bounded([b, b.slice(3, 2), b.slice(0, 0)], most))
        assert [x for o in out for x in o.column(1).to_pylist()] == [*texts, *texts[3:5]]
        assert all(o.num_rows == 1 or sum(len((t or "").encode()) for t in o.column(1).to_pylist()) <= most for o in out)
