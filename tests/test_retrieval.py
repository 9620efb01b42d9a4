"""Tokens, BM25, dense search, fusion, reranking and configurations, with the traps of each."""

import math
import random

import numpy as np
import pytest

from vellumq.functions.text import query_prefix, tokens
from vellumq.operators import dense, fusion, lexical
from vellumq.plans import configs

DRUGS = [(0, "Warfarin requires INR monitoring in patients"), (1, "Sertraline may cause serotonin syndrome"), (2, "Atorvastatin lowers LDL cholesterol")]


def chunk_df(spark, rows):
    return spark.createDataFrame(rows, "chunk_ord long, text string")


def question_df(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")


def test_tokens(spark):
    df = spark.createDataFrame([("What is the 2.5 mg dose of the drug?",), ("v1.2.3 Iechä",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens(df.t)).collect()]
    assert got == [["2.5", "mg", "dose", "drug"], ["v1.2", "3", "iech"], None]


def test_bm25_finds_the_chunk(spark):
    got = lexical.bm25(question_df(spark, "INR monitoring for warfarin"), chunk_df(spark, DRUGS), 3).orderBy("rank").collect()
    assert got[0]["chunk_ord"] == 0 and len(got) == 3


def plain_bm25(texts, query):
    tok = lambda t: [w for w in (t or "").lower().split()]
    docs = [tok(t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    return [sum(idf.get(w, 0) * (d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg))) for w in tok(query)) for d in docs]


def test_bm25_fills_with_zero_scores_and_negative_ones_rank_below(spark):
    rng = random.Random(1)
    for _ in range(6):
        texts = [" ".join(rng.choice(["xa", "xb", "xc", "xd"]) for _ in range(rng.randrange(0, 6))) for _ in range(7)]
        if not any(texts):
            continue
        q = "xa xb xa"
        want = plain_bm25(texts, q)
        order = sorted(range(7), key=lambda i: (-round(want[i], 9), i))
        for k in (3, 10):
            got = lexical.bm25(question_df(spark, q), chunk_df(spark, list(enumerate(texts))), k).orderBy("rank").collect()
            assert [r["chunk_ord"] for r in got] == order[:k]
            assert np.allclose([r["score"] for r in got], [want[i] for i in order[:k]])


def test_bm25_without_tokens_nulls_and_empty(spark):
    c = chunk_df(spark, [(5, None), (9, "xa"), (11, "xb")])
    got = lexical.bm25(question_df(spark, "the of", None), c, 2).orderBy("qid", "rank").collect()
    assert [(r["chunk_ord"], r["score"]) for r in got] == [(5, 0.0), (9, 0.0)] * 2
    assert lexical.bm25(question_df(spark, "xa"), chunk_df(spark, []), 2).count() == 0


def letters(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name} {'long' if name == 'chunk_ord' else 'string'}, text string")
    return df.select(name, dense.letter_vector(df.text).alias("embedding"))


def test_dense_more_than_the_corpus_and_confidence(spark):
    q, v = letters(spark, [("q", "serotonin syndrome")], "qid"), letters(spark, DRUGS, "chunk_ord")
    got = dense.search(q, v, 10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["chunk_ord"] == 1
    conf = lexical.confidence(spark.createDataFrame([("q",), ("none",)], "qid string"), dense.search(q, v, 10)).orderBy("qid").collect()
    assert conf[0]["confidence"] == 0.0 and conf[1]["confidence"] == got[0]["score"]


def test_dense_blocks_nulls_ties(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (4, [0.0, 1.0])], "chunk_ord long, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(5)], "qid string, embedding array<float>")
    got = dense.search(q, v, 3, block=2).orderBy("qid", "rank").collect()
    assert [r["chunk_ord"] for r in got] == [1, 3, 2] * 5


def test_letterless_text_is_zero(spark):
    assert set(letters(spark, [("a", "123")], "qid").first()["embedding"]) == {0.0}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid string, chunk_ord long, rank int")


def test_rrf_value_and_order(spark):
    got = fusion.rrf([ranked(spark, [("q", 1, 1), ("q", 2, 2), ("q", 3, 3)]), ranked(spark, [("q", 3, 1), ("q", 1, 2), ("q", 4, 3)])]).orderBy("rank").collect()
    assert [r["chunk_ord"] for r in got][:2] == [1, 3]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_rrf_ties_keep_first_appearance(spark):
    got = fusion.rrf([ranked(spark, [("q", 9, 1)]), ranked(spark, [("q", 2, 1)])]).orderBy("rank").collect()
    assert [r["chunk_ord"] for r in got] == [9, 2]
    got = fusion.rrf([ranked(spark, [("q", 9, 1)]), ranked(spark, [("q", 5, 1)]), ranked(spark, [("q", 2, 1)])]).orderBy("rank").collect()
    assert [r["chunk_ord"] for r in got] == [9, 5, 2]


def test_rrf_query_merges_every_configuration(spark, tmp_path):
    from vellumq.plans import queries

    kind = "config string, qid string, chunk_ord long, rank int"
    rows = [("bm25", "q", 1, 1), ("dense-bge-small", "q", 2, 1), ("hybrid-bge-small", "q", 2, 2), ("a new one", "q", 3, 1), (None, "q", 4, 1)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "hits.parquet"))
    assert [r["chunk_ord"] for r in queries.rrf_fusion(spark, str(tmp_path)).orderBy("rank").collect()] == [2, 3, 1]
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(str(tmp_path / "hits.parquet"))
    assert queries.rrf_fusion(spark, str(tmp_path)).count() == 0


def test_hybrid_confidence_is_the_dense_one(spark):
    c = chunk_df(spark, DRUGS)
    encode = lambda q: q.select("qid", dense.letter_vector(q.question).alias("embedding"))
    r = configs.Retriever("hybrid-bge-small", c, letters(spark, DRUGS, "chunk_ord"), encode)
    q = question_df(spark, "atorvastatin LDL cholesterol")
    hits, conf = r.search(q, 2)
    assert hits.orderBy("rank").first()["chunk_ord"] == 2 and hits.count() == 2
    best = dense.search(encode(dense.prefixed(q, configs.embed_model("hybrid-bge-small"))), r.vectors, 1).first()["score"]
    assert conf.first()["confidence"] == pytest.approx(best)


def test_rerank_and_ties(spark):
    class Serotonin:
        def predict(self, pairs):
            return [1.0 if "serotonin" in t else 0.0 for _, t in pairs]

    c, q = chunk_df(spark, DRUGS), question_df(spark, "LDL cholesterol INR")
    base = lexical.bm25(q, c, 3)
    got = fusion.rerank(base, q, c, 3, Serotonin()).orderBy("rank").collect()
    assert got[0]["chunk_ord"] == 1 and got[0]["score"] == 1.0
    rest = [r["chunk_ord"] for r in base.orderBy("rank").collect() if r["chunk_ord"] != 1]
    assert [r["chunk_ord"] for r in got[1:]] == rest


def test_configs(spark):
    assert len(configs.CONFIGS) == 7 and configs.embed_model("bm25") is None
    with pytest.raises(ValueError, match="index was built with"):
        configs.Retriever("dense-bge-base", chunk_df(spark, DRUGS), letters(spark, DRUGS, "chunk_ord"), lambda q: q, model=configs.embed_model("dense-bge-small"))
    assert query_prefix("BAAI/bge-small-en-v1.5") and not query_prefix("other")


def test_index_round_trip(spark, tmp_path):
    v, c = letters(spark, DRUGS, "chunk_ord"), chunk_df(spark, DRUGS)
    with pytest.raises(FileNotFoundError):
        dense.load_index(spark, str(tmp_path / "none"))
    dense.save_index(v, c, str(tmp_path / "i"), "letters")
    v2, c2, model = dense.load_index(spark, str(tmp_path / "i"))
    assert model == "letters" and c2.count() == 3 and v2.count() == 3
    with pytest.raises(ValueError, match="index was built with"):
        dense.load_index(spark, str(tmp_path / "i"), "another")


def test_best_of_rows_as_sorted_at_once():
    rng = np.random.default_rng(3)
    for k in (1, 3, 40):
        s, o = rng.integers(0, 4, (5, 60)) / 3.0, rng.permutation(60)
        old = None
        for at in range(0, 60, 13):
            old = lexical.merged(old, s[:, at : at + 13], o[at : at + 13], k)
        for r in range(5):
            want = sorted(zip(-np.round(s[r], 9), o))[:k]
            assert [(x, y) for x, y in zip(-np.round(old[2][old[0] == r], 9), old[1][old[0] == r])] == want


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_bm25_shares_bags_and_never_lists_all_matches(spark, rare, monkeypatch):
    rng = random.Random(4)
    words = ["xa", "xb", "xc", "xd", "xe", "xf", "xg"]
    texts = [" ".join(rng.choices(words, weights=[9, 9, 9, 3, 2, 1, 1], k=rng.randrange(1, 9))) for _ in range(80)]
    asked = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in range(30)]
    q = spark.createDataFrame([(f"q{i:02d}", x) for i, x in enumerate(asked)], "qid string, question string")
    monkeypatch.setattr(lexical, "RARE", rare)
    monkeypatch.setattr(lexical, "SHARE", 81)
    monkeypatch.setattr(lexical, "BLOCK", 12)
    written = []
    monkeypatch.setattr(lexical, "saved", lambda df, real=lexical.saved: written.append(real(df)) or written[-1])
    got = lexical.bm25(q, chunk_df(spark, list(enumerate(texts))), 3).orderBy("qid", "rank").collect()
    for i, x in enumerate(asked):
        want = plain_bm25(texts, x)
        mine = [r for r in got if r["qid"] == f"q{i:02d}"]
        assert [r["chunk_ord"] for r in mine] == sorted(range(80), key=lambda j: (-round(want[j], 9), j))[:3]
        assert np.allclose([r["score"] for r in mine], [want[r["chunk_ord"]] for r in mine])
    assert all(w.count() < 500 for w in written if "score" in w.columns)
