"""Sources, sinks, the pipeline with a fake parser, and the stream."""

import json

from pyspark.sql import functions as F

from vellumq.operators import dense
from vellumq.plans import pipeline, report
from vellumq.sources import files
from vellumq.streaming.chunks import chunk_stream


def letters(df):
    return df.withColumn("embedding", dense.letter_vector(F.col("text")))


def test_pipeline_and_reparse(spark, tmp_path):
    def fake(content):
        return [{"text": t, "blocks": [{"text": t, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}] if t else [], "image": None} for t in content.decode().split("\f")]

    src, out = tmp_path / "pdf", str(tmp_path / "out")
    src.mkdir()
    assert pipeline.build(spark, str(src), out, "letters", letters, fake) == 0
    (src / "b.pdf").write_bytes(("word " * 130 + "\f" + "tail " * 30).encode())
    (src / "a.pdf").write_bytes(b"some text that is long enough here")
    (src / "c.PDF").write_bytes(b"not read")
    assert pipeline.build(spark, str(src), out, "letters", letters, fake) == 3
    v, c, model = dense.load_index(spark, f"{out}/index", "letters")
    assert [r["chunk_id"] for r in c.orderBy("chunk_ord").collect()] == ["a_0", "b_0", "b_1"] and v.count() == 3
    # a document that is left out later stays, one that is parsed again is replaced
    (src / "a.pdf").unlink()
    (src / "b.pdf").write_bytes(b"now there is only this line in it")
    assert pipeline.build(spark, str(src), out, "letters", letters, fake) == 2


def test_stale(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    f = files.pdf_files(spark, str(tmp_path))
    old = spark.createDataFrame([("a", "2001-01-01")], "doc_id string, p string").select("doc_id", F.to_timestamp("p").alias("parsed_at"))
    new = old.select("doc_id", F.to_timestamp(F.lit("2999-01-01")).alias("parsed_at"))
    assert files.stale(f, old).count() == 1 and files.stale(f, new).count() == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"text": "x", "page": 1, "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "source_file": None, "extraction_method": "ocr"}]))
    b = files.read_blocks(spark, str(tmp_path / "d.json")).first()
    assert (b["doc_id"], b["block_ord"], b["source_file"], b["bbox"]["x1"]) == ("d", 0, "d", 3.0)
    (tmp_path / "c").mkdir()
    for n, k in (("a", 2), ("b", 1)):
        (tmp_path / "c" / f"{n}.chunks.json").write_text(json.dumps([{"text": f"{n}{i}", "page_start": 1, "page_end": 1, "regions": [], "chunk_id": f"{n}_{i}", "source_file": n} for i in range(k)]))
    got = files.read_chunks(spark, str(tmp_path / "c")).orderBy("chunk_ord").collect()
    assert [(r["chunk_ord"], r["chunk_id"]) for r in got] == [(0, "a_0"), (1, "a_1"), (2, "b_0")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "question": "?", "answerable": False, "why_unanswerable": "no"}]))
    assert files.read_questions(spark, str(tmp_path / "q.json")).first()["evidence"] is None


def test_stream(spark, tmp_path):
    kind = "doc_id string, block_ord int, text string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, source_file string, extraction_method string"
    rows = lambda d, lo, hi: [(d, i, "w " * 50, 1, None, d, "digital") for i in range(lo, hi)]
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (rows("a", 0, 3) + rows("b", 0, 1), rows("a", 3, 6)):
        spark.createDataFrame(part, kind).write.mode("append").parquet(src)
        chunk_stream(spark, src, out, cp).awaitTermination()
    got = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{out}/chunks").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 3, "b": 1}


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None, 0.125)], "x string, y int, z double")
    assert report.markdown(df).splitlines()[2] == "| a\\|b | — | 0.12 |"
