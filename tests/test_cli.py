"""Index, retriever, evaluation and command line from chunks to results."""

import json

import pytest

from vellumq import cli
from vellumq.operators import answer, dense
from vellumq.plans import configs, evaluate, pipeline
from vellumq.sources import files

DRUGS = ["Serotonin syndrome may occur with linezolid.", "The usual dose is 50 mg once daily.", "Keep below 25 degrees and away from children.", "Check blood pressure every month."]


def encode(df):
    from pyspark.sql import functions as F

    return df.withColumn("embedding", dense.letter_vector(F.col("text")))


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("out"))
    rows = [("d", i, t, i + 1, None, "d.pdf", "digital") for i, t in enumerate(DRUGS)]
    files.write_documents(spark.createDataFrame(rows, "doc_id string, block_ord int, text string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, source_file string, extraction_method string"), f"{at}/blocks")
    assert pipeline.chunk(spark, at, 5, 0) == 4
    return at


def test_no_index_and_no_model(spark, out, tmp_path, capsys):
    assert pipeline.build_index(spark, str(tmp_path), "hybrid-bge-small", encode) is None
    assert "no chunks" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no embedding model"):
        pipeline.build_index(spark, out, "bm25", encode)
    with pytest.raises(SystemExit, match="build it first"):
        cli.main(["search", str(tmp_path)], [], spark)


def test_search_chat_and_evaluate(spark, out, tmp_path, capsys):
    cli.main(["build-index", out], spark=spark)
    assert "indexed 4 chunks" in capsys.readouterr().out
    with pytest.raises(ValueError, match="index was built with"):
        pipeline.load_retriever(spark, out, "dense-bge-base", encode)
    cli.main(["search", out, "--top-k", "2"], ["which dose daily", "", "never asked"], spark)
    text = capsys.readouterr().out
    assert text.count("confidence=") == 1 and "d.pdf p.2-2 (score=" in text
    cli.main(["chat", out, "--threshold", "0.1"], ["dose daily", "quit"], spark)
    assert "[rank score=" in capsys.readouterr().out
    cli.main(["chat", out, "--threshold", "1.5"], ["dose daily"], spark)
    assert answer.NO_ANSWER in capsys.readouterr().out
    q = [{"id": f"q{i}", "question": t, "answerable": True, "source_file": "d.pdf", "answer": "", "evidence": [t]} for i, t in enumerate(DRUGS)] + [{"id": "n", "question": "zzz", "answerable": False, "why_unanswerable": "not there"}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    cli.main(["evaluate", out, str(tmp_path / "q.json"), str(tmp_path / "r")], spark=spark)
    doc = {r["config"]: r for r in json.loads((tmp_path / "r" / "results.json").read_text())}
    assert set(doc) == {"bm25", "dense-bge-small", "hybrid-bge-small", "hybrid-bge-small+rerank"}
    assert doc["bm25"]["hit_1"] == 1.0 and doc["bm25"]["ms_per_query"] > 0 and doc["bm25"]["mrr_low"] == 1.0 and doc["bm25"]["diff"] is None
    assert "| bm25 | 1.00 |" in (tmp_path / "r" / "results.md").read_text()


def test_plotted_names_each_once():
    rows = [{"config": c, "mrr_10": m, "auc": 0.5} for c, m in ((configs.BASELINE, 0.4), (configs.DEFAULT, 0.9), ("bm25", 0.7))]
    assert evaluate.plotted(rows, configs.DEFAULT) == [configs.BASELINE, configs.DEFAULT]


def test_endpoint_statuses():
    said = {"choices": [{"message": {"content": "fine"}}]}
    seen = []
    end = answer.ChatEndpoint("http://x", "m", "k", lambda url, headers, body: seen.append(json.loads(body)) or (200, json.dumps(said).encode()))
    assert end.generate("i", "p") == "fine" and seen[0]["temperature"] == 0
    for status, kind in ((429, answer.TemporaryError), (503, answer.TemporaryError), (400, ValueError)):
        with pytest.raises(kind):
            answer.ChatEndpoint("http://x", "m", post=lambda *_, s=status: (s, b"{}")).generate("i", "p")


def test_documents_replace_their_earlier_version(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = lambda d, n, x: spark.createDataFrame([(d, i, x) for i in range(n)], "doc_id string, no int, x string")
    files.write_documents(rows("a", 3, "old").unionByName(rows("b", 2, "old")), at, 2)
    files.write_documents(rows("a", 1, "new"), at, 2)
    assert sorted(map(tuple, files.read_documents(spark, at).collect())) == [("a", 0, "new"), ("b", 0, "old"), ("b", 1, "old")]


def test_recognised_pages(spark):
    pages = spark.createDataFrame([("s.pdf", "s", 1, bytearray(b"x")), ("s.pdf", "s", 2, None)], "source_file string, doc_id string, page int, image binary")
    words = {"text": ["two", "words"], "block_num": [1, 1], "par_num": [1, 1], "line_num": [1, 1], "left": [0, 40], "top": [0, 0], "width": [30, 50], "height": [10, 10]}
    got = files.recogniser(lambda image: words)(pages).orderBy("pos").collect()
    assert [(r["page"], r["pos"], r["text"], r["left"]) for r in got] == [(1, 0, "two", 0), (1, 1, "words", 40)]
