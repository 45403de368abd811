import random

import pytest

from rivulet.llm import split, tokens

SCHEMA = "doc_id bigint, text string, ids string, n int"


def texts(seed=1):
    rnd = random.Random(seed)
    pieces = ["word ", "  ", "\n\n", "don't ", "<|endoftext|>", "naïve ", "日本語。", "🎉", "123", "!!! ", "\t", "Ünïcode-Straße ", "a" * 30, "   x"]
    long = ["".join(rnd.choice(pieces) for _ in range(n)) for n in (40, 200, 900, 1500)]
    return [None, "", " ", "hello world", *long, "a" * 3000, " " * 3000 + "b", "x" + "\n" * 2500 + "y", ("lo rem\n" * 700)]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (256, 64), (97, 11)])
def test_encode_equals_whole(spark, chunk, overlap):
    enc = tokens.encoder()[0]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] * 2  # every row twice
    got = tokens.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "ids"]
    out = sorted((r["doc_id"], list(r["ids"])) for r in got.collect())
    assert out == sorted((i, enc.encode_ordinary(t) if t else []) for i, t, _, _ in rows)
    assert all(tokens.decode(ids) == (texts()[i] or "") for i, ids in out)


def test_long_texts_without_an_id(spark):
    enc = tokens.encoder()[0]
    long = [t for t in texts() if t and len(t) > 256]
    rows = [(None, t, "", 1) for t in [*long, long[0], "short"]] + [(1, long[0], "", 1)]
    out = tokens.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=256, overlap=64).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in out) == sorted((str(i), enc.encode_ordinary(t)) for i, t, _, _ in rows)


def test_encode_empty_table_and_arguments(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokens.encode(none).count() == 0 and tokens.measure(none, ["doc_id"]).count() == 0 and split.split(none).count() == 0
    with pytest.raises(ValueError):
        tokens.encode(none, chunk=10, overlap=10)
    with pytest.raises(ValueError):
        split.split(none, limit=64, overlap=64)


def test_against_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = tokens.encoder()[0]
    for s in texts():
        if s:
            assert enc.encode_ordinary(s) == t.encode(s, add_special_tokens=False).ids


def test_measure(spark):
    rows = [(i, t, None, i) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.measure(spark.createDataFrame(rows, SCHEMA), ["doc_id", "n"]).collect()}
    enc = tokens.encoder()[0]
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, _, _ in rows}


def documents():
    rnd = random.Random(4)
    sentence = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "naïve", "日本"]) for _ in range(rnd.randrange(3, 25))) + rnd.choice([". ", "! ", "? "])
    para = lambda: "".join(sentence() for _ in range(rnd.randrange(1, 30))) + "\n\n"
    out = ["".join((f"\n# Title {k}\n" if k % 4 == 0 else "") + para() for k in range(n)) for n in (1, 5, 20, 60)]
    return [*out, "z" * 9000, "日" * 4000, "no stops here " * 2000, "🎉👩‍💻" * 900, "\n".join("x" * 3 for _ in range(3000)), None, "", "short"]


@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (100, 20), (50, 0)])
def test_split(spark, limit, overlap):
    docs = documents()
    enc = tokens.encoder()[0]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(docs)], SCHEMA)
    by: dict[int, list] = {}
    for r in split.split(df, limit=limit, overlap=overlap).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(docs) if t and len(enc.encode_ordinary(t)) > limit}
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert pieces[0]["start"] == 0 and pieces[-1]["end"] == len(docs[i])
        for r in pieces:
            assert docs[i][r["start"] : r["end"]] == r["text"] and len(enc.encode_ordinary(r["text"])) == r["n_tokens"] <= limit
        for a, b in zip(pieces, pieces[1:]):
            assert a["start"] < b["start"] <= a["end"] < b["end"]


def test_split_shares_about_the_overlap_and_cuts_at_sentences(spark):
    docs = documents()[2:4]
    enc = tokens.encoder()[0]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(docs)], SCHEMA)
    rows = sorted(split.split(df).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a["doc_id"] == b["doc_id"]]
    shared = [len(enc.encode_ordinary(docs[a["doc_id"]][b["start"] : a["end"]])) for a, b in pairs]
    assert len(pairs) > 5 and all(40 <= n <= 90 for n in shared)
    at_stops = [docs[a["doc_id"]][: a["end"]].rstrip()[-1] in ".!?" for a, _ in pairs]
    assert sum(at_stops) >= 0.9 * len(pairs)  # the rest end behind a title, which is a line of its own


@pytest.mark.parametrize("size", [1, 7, 100])
def test_stretches_are_encoded_alike(size):
    enc = tokens.encoder()[0]
    for t in [*filter(None, texts()), *filter(None, documents()), "a b", " ", "x\n \n y  z"]:
        parts = list(tokens.stretches(t, size))
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
