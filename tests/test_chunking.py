"""Chunk boundaries, texts and regions on small documents, and against a plain rendering of the rule."""

import random

import pytest
from pyspark.sql import functions as F

from vellumq.operators import chunking

BLOCK = "doc_id string, block_ord int, text string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, source_file string"


def frame(spark, docs):
    """docs: {doc: [(text, page)]}"""
    return spark.createDataFrame([(d, i, t, p, (0.0, float(i), 1.0, i + 1.0), f"{d}.pdf") for d, bs in docs.items() for i, (t, p) in enumerate(bs)], BLOCK)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def cut(spark, docs, target, overlap):
    rows = chunking.chunks_of(frame(spark, docs), target, overlap).orderBy("doc_id", "chunk_no").collect()
    return {d: [r for r in rows if r["doc_id"] == d] for d in docs}


def plain(blocks, target, overlap):
    out, acc, new = [], [], 0
    for t in blocks:
        ws = (t or "").split()
        acc, new = acc + ws, new + len(ws)
        if ws and len(acc) >= target:
            out.append(" ".join(acc))
            acc, new = acc[-overlap:] if overlap else [], 0
    if acc and (not out or new):
        out.append(" ".join(acc))
    return out


def test_size_overlap_and_cover(spark):
    got = cut(spark, {"a": [(words(10, 10 * i), 1) for i in range(10)]}, 40, 10)["a"]
    assert len(got[0]["text"].split()) == 40
    assert got[1]["text"].split()[:10] == got[0]["text"].split()[-10:]
    assert {w for r in got for w in r["text"].split()} == set(words(100).split())


def test_pages_and_regions(spark):
    got = cut(spark, {"a": [(words(30), 1), (words(30, 30), 1), (words(30, 60), 2)]}, 50, 5)["a"]
    assert (got[0]["page_start"], got[0]["page_end"]) == (1, 1)
    assert got[1]["page_end"] == 2
    assert [r["bbox"]["y0"] for r in got[1]["regions"]] == [1.0, 2.0]


def test_no_tail_of_overlap_alone_short_and_empty(spark):
    got = cut(spark, {"a": [(words(50), 1)], "b": [(words(5), 1)], "c": [("", 1), (None, 1), ("  ", 2)]}, 50, 10)
    assert [len(got[d]) for d in "abc"] == [1, 1, 0]


def test_blocks_are_never_split(spark):
    assert len(cut(spark, {"a": [(words(1000), 1)]}, 120, 30)["a"][0]["text"].split()) == 1000


def test_limits(spark):
    with pytest.raises(ValueError):
        chunking.ranges(frame(spark, {"a": [("x", 1)]}), target=10, overlap=10)
    assert [r["text"] for r in cut(spark, {"a": [(words(3), 1), (words(3, 3), 1)]}, 3, 0)["a"]] == [words(3), words(3, 3)]


def test_random_documents(spark):
    rng = random.Random(3)
    docs = {f"d{k}": [(" ".join(f"{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 7, 20, 45]))), 1) for _ in range(rng.randrange(0, 30))] for k in range(25)}
    docs = {d: b for d, b in docs.items() if b}
    got = cut(spark, docs, 20, 6)
    for d, bs in docs.items():
        assert [r["text"] for r in got[d]] == plain([t for t, _ in bs], 20, 6)


def test_null_document_and_clashing_columns(spark):
    df = frame(spark, {"a": [("x y", 1)]}).withColumn("n", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("b_to", F.lit(3))
    df = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("string")))
    assert chunking.chunks_of(df.drop("cell")).count() == 1


def cut_ends(p, target, overlap):
    s, out = 0, []
    for x in p:
        if x - s >= target:
            out.append((s, x))
            s = x - overlap
    if p and (not out or p[-1] > out[-1][1]):
        out.append((s, p[-1]))
    return out


def test_long_documents_in_slices(spark, monkeypatch):
    """Slices smaller than a document: their maps composed give the same cuts as one pass."""
    rng = random.Random(8)
    monkeypatch.setattr(chunking, "SLICE", 64)
    docs = {f"d{k}": [rng.choice([1, 2, 5, 9, 30, 200]) for _ in range(rng.choice([1, 4, 60, 400]))] for k in range(12)}
    rows = spark.createDataFrame([(d, i, n) for d, ns in docs.items() for i, n in enumerate(ns)], "doc_id string, block_ord int, w int")
    for target, overlap in ((20, 6), (3, 0), (120, 119)):
        got = {}
        for r in chunking.ranges(rows, target=target, overlap=overlap, words="w").orderBy("chunk_no").collect():
            got.setdefault(r["doc_id"], []).append((r["word_from"], r["word_to"]))
        for d, ns in docs.items():
            p = [sum(ns[: i + 1]) for i in range(len(ns))]
            assert got[d] == cut_ends(p, target, overlap)
