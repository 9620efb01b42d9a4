import pytest

from vellumq.operators import answer

CH = "chunk_ord long, source_file string, page_start int, page_end int, text string, regions array<struct<page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"


def chunk_df(spark):
    return spark.createDataFrame([(1, "a.pdf", 1, 2, "First. More", [(1, (1.5, 2.4, 3.0, 4.0))]), (2, "b.pdf", 3, 3, "Second", []), (3, "c.pdf", 4, 4, None, None)], CH)


def test_gate(spark):
    df = spark.createDataFrame([("hybrid-bge-small", 0.7), ("hybrid-bge-small", 0.702), ("bm25", 0.0), ("baseline-minilm", None)], "config string, confidence double")
    assert [r["decision"] for r in answer.gate(df).collect()] == ["abstain", "answer", "answer", "abstain"]


def test_context_and_citations(spark):
    hits = spark.createDataFrame([("q", 2, 1, 0.5), ("q", 1, 2, 0.25), ("q", 3, 3, 0.125)], "qid string, chunk_ord long, rank int, score double")
    got = answer.context(hits, chunk_df(spark), ["qid"]).first()["context"]
    assert got == "[Source: b.pdf, p.3-3]\nSecond\n\n---\n\n[Source: a.pdf, p.1-2]\nFirst. More\n\n---\n\n[Source: c.pdf, p.4-4]\n"
    lines = [r["citation"] for r in answer.citations(hits, chunk_df(spark)).orderBy("rank").collect()]
    assert lines == ["b.pdf p.3-3 [rank score=0.500]", "a.pdf p.1-2, bbox=(2,2,3,4) [rank score=0.250]", "c.pdf p.4-4 [rank score=0.125]"]


def test_retry_schedule():
    waits, calls = [], []

    def fail(n):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise answer.TemporaryError
            return "ok"

        return call

    assert answer.with_retries(fail(3), sleep=waits.append) == "ok" and waits == [2, 4, 8]
    calls.clear()
    with pytest.raises(answer.TemporaryError):
        answer.with_retries(fail(9), sleep=waits.append)
    assert len(calls) == 4
    with pytest.raises(ZeroDivisionError):
        answer.with_retries(lambda: 1 // 0, sleep=waits.append)


def test_abstained_questions_are_not_generated(spark):
    df = spark.createDataFrame([("a", "answer", "[Source: f, p.1-1]\nYes. No", "?"), ("b", "abstain", None, "?")], "qid string, decision string, context string, question string")
    got = {r["qid"]: r["answer"] for r in answer.answers(df, answer.FirstSentence()).collect()}
    assert got == {"a": "Yes", "b": answer.NO_ANSWER}
