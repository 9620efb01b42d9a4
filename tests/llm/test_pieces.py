import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vellumq.llm import pieces

LIMITS = dict(max_words=24, max_chars=180, overlap=3, overlap_chars=45)


def cut(spark, texts, **k):
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], "id int, t string, no int, core string, k int")
    rows = pieces.cut_text(df, "id", "t", **{**LIMITS, **k}).orderBy("id", "piece_no").collect()
    return {i: [r for r in rows if r["id"] == i] for i in range(len(texts))}


def check(text, rows):
    assert [r["piece_no"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert len(r["text"]) <= LIMITS["max_chars"] and len(r["text"].split()) <= LIMITS["max_words"]
        assert r["text"].strip() == "" or r["text"].rstrip() in text
    words = text.split()
    if all(len(w) < 20 for w in words):  # without the fallback to characters pieces are runs of words
        for a, b in zip(rows, rows[1:]):
            assert b["core_from"] == a["word_to"] and 0 <= b["core_from"] - b["word_from"] <= LIMITS["overlap"]
        for r in rows:
            assert r["text"].split() == words[r["word_from"] : r["word_to"]]
        if rows:
            assert rows[-1]["word_to"] == len(words)


def test_small_texts_stay_whole(spark):
    got = cut(spark, ["", "  ", "a b c", None])
    assert [[r["text"] for r in got[i]] for i in range(4)] == [[""], [""], ["a b c"], []]


def test_boundaries_in_order_of_strength(spark):
    s = "one two three four five six seven eight nine ten eleven twelve. " * 4
    got = cut(spark, [s.strip()])[0]
    assert all(r["text"].endswith("twelve.") for r in got) and len(got) > 1
    c = ("w " * 14 + "x, ") * 4
    assert all(r["text"].endswith("x,") for r in cut(spark, [c.strip()])[0])


def test_overlap_is_the_words_before(spark):
    text = " ".join(f"w{i}" for i in range(100))
    got = cut(spark, [text])[0]
    check(text, got)
    assert all(b["core_from"] - b["word_from"] == 3 for b in got[1:])


def test_overlap_of_long_words_shortens_the_core(spark):
    rng = random.Random(9)
    texts = [" ".join(f"{i:03}" + "x" * rng.randrange(low, high) for i in range(60)) for low, high in ((19, 20), (22, 32), (1, 38), (36, 42))]
    got = cut(spark, [*texts, " ".join(f"{i:03}" + "x" * 97 for i in range(9))])
    for i, t in enumerate(texts):
        words = t.split()
        assert got[i][-1]["word_to"] == len(words)
        for r in got[i]:
            assert len(r["text"]) <= LIMITS["max_chars"] and r["text"].split() == words[r["word_from"] : r["word_to"]]
        for a, b in zip(got[i], got[i][1:]):
            assert b["core_from"] == a["word_to"] and b["core_from"] - b["word_from"] == 3
    assert all(len(r["text"]) <= LIMITS["max_chars"] for r in got[4]) and len(got[4]) < 20  # three words don't fit


def test_no_white_space_and_long_words(spark):
    jp, run = "薬を飲んでください。" * 60, "x" * 1000
    got = cut(spark, [jp, run, "ab " + run + " cd"])
    for t, i in ((jp, 0), (run, 1)):
        check(t, got[i])
        assert len(got[i]) > 3
    assert all(r["text"].endswith("。") for r in got[0])


def test_random_texts(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ".", ",", ";"]) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    got = cut(spark, texts)
    for i, t in enumerate(texts):
        check(t, got[i])


def test_cores_join_to_the_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab .,\n\t薬。") for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    got = cut(spark, texts, overlap=0, overlap_chars=0)
    for i, t in enumerate(texts):
        assert "".join("".join(r["text"].split()) for r in got[i]) == "".join(t.split())


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 50), st.integers(16, 400))
def test_patterns_compile(words, chars):
    import re

    assert re.compile(pieces.char_pattern(chars).replace("(?U)", "").replace(r"\z", r"\Z").replace("*+", "*"))
    assert "{0," in pieces.word_pattern(words)


def test_shares_of_regions(spark):
    kind = "chunk_ord long, source_file string, page_start int, text string, regions array<struct<page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    box = lambda i: (float(i), 0.0, 1.0, 1.0)
    c = spark.createDataFrame([(1, "f", 1, " ".join(["a"] * 3 + ["b"] * 50), [(1, box(1)), None, (2, box(2))]), (2, "f", 1, "x y", None), (3, "f", 4, "x y z", [(None, None)])], kind)
    b = spark.createDataFrame([("f", 1, box(1), "a a a a a"), ("f", 2, box(2), "b " * 50), ("f", 1, None, "q")], "source_file string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string")
    got = {(r["chunk_ord"], r["pos"]): (r["from"], r["to"], r["region"]["page"]) for r in pieces.region_spans(c, b).collect()}
    assert got == {(1, 0): (0, 3, 1), (1, 2): (3, 53, 2), (3, 0): (0, 3, 4)}
