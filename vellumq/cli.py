"""Command line.

    python -m vellumq.cli list
    python -m vellumq.cli query NAME FOLDER [--rows N]
    python -m vellumq.cli ingest PDFS OUT          changed PDFs to OUT/blocks
    python -m vellumq.cli chunk OUT                blocks to OUT/chunks
    python -m vellumq.cli build-index OUT          chunks to OUT/index
    python -m vellumq.cli pipeline PDFS OUT        all three
    python -m vellumq.cli search OUT               questions from standard input, hits
    python -m vellumq.cli chat OUT                 questions from standard input, answers with their sources
    python -m vellumq.cli evaluate OUT QUESTIONS RESULTS

--encoder and --scorer name a class or function, module:attribute, that makes an encoder or pair scorer; without one the
built-in letter counts and token overlap stand in. `chat` asks the endpoint of --url, without one it quotes.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Iterable
from pathlib import Path


def _made(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def _encode(name: str | None):
    from pyspark.sql import functions as F

    from vellumq.operators import dense

    encoder = _made(name)
    if encoder is None:
        return lambda df: df.withColumn("embedding", dense.letter_vector(F.col("text")))
    return lambda df: dense.encoded(df, "text", encoder)


def _asked(lines: Iterable[str]):
    """Questions until an empty one, quit or exit."""
    for line in lines:
        q = line.strip()
        if q.lower() in ("", "quit", "exit"):
            return
        yield q


def _search(spark, retriever, question: str, k: int):
    from pyspark.sql import functions as F

    from vellumq.functions.text import preview
    from vellumq.operators.answer import hit_line
    from vellumq.session import saved

    q = spark.createDataFrame([("q", question)], "qid string, question string")
    hits, conf = retriever.search(q, k)
    hits = saved(hits)
    rows = hits.join(retriever.chunks, "chunk_ord").orderBy("rank").select("rank", hit_line(F.col("source_file"), F.col("page_start"), F.col("page_end"), F.col("score")).alias("hit"), preview(F.col("text")).alias("preview")).collect()
    return q, hits, rows, conf.first()["confidence"]


def main(argv: list[str] | None = None, lines: Iterable[str] | None = None, spark=None) -> None:
    from pyspark.sql import SparkSession

    from vellumq.plans import configs, evaluate, nested, pipeline, queries
    from vellumq.plans.report import markdown
    from vellumq.session import scratch, ship
    from vellumq.sources import files

    known = {**queries.queries(), **nested.queries()}
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(known))
    q.add_argument("folder")
    q.add_argument("--rows", type=int, default=20)
    steps = {n: sub.add_parser(n) for n in ("ingest", "pipeline", "chunk", "build-index", "search", "chat", "evaluate")}
    for n, s in steps.items():
        if n in ("ingest", "pipeline"):
            s.add_argument("pdfs")
        s.add_argument("out")
        s.add_argument("--config", default=configs.DEFAULT, choices=sorted(configs.CONFIGS))
        s.add_argument("--encoder")
        s.add_argument("--scorer")
    steps["search"].add_argument("--top-k", type=int, default=5)
    steps["chat"].add_argument("--threshold", type=float)
    steps["chat"].add_argument("--url")
    steps["chat"].add_argument("--model", default="")
    steps["evaluate"].add_argument("questions")
    steps["evaluate"].add_argument("results")
    a = p.parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(known)))
        return
    spark = spark or SparkSession.builder.appName("vellumq").getOrCreate()
    ship(spark)
    if a.what == "query":
        print(markdown(known[a.name](spark, a.folder), a.rows))
        return
    encode = _encode(a.encoder)
    if a.what in ("ingest", "pipeline"):
        n = pipeline.ingest(spark, a.pdfs, a.out)
        print(f"parsed {n} files")
    if a.what in ("chunk", "pipeline"):
        print(f"{pipeline.chunk(spark, a.out)} chunks")
    if a.what in ("build-index", "pipeline"):
        print(f"indexed {pipeline.build_index(spark, a.out, a.config, encode)} chunks")
    if a.what not in ("search", "chat", "evaluate"):
        return
    try:
        load = lambda name: pipeline.load_retriever(spark, a.out, name, encode, _made(a.scorer))
        retriever = load(a.config) if a.what != "evaluate" else None
        if a.what == "evaluate":
            _, chunks, model = pipeline.dense.load_index(spark, f"{a.out}/index")
    except FileNotFoundError as e:
        raise SystemExit(str(e)) from e
    if a.what == "evaluate":
        fit = [n for n in configs.CONFIGS if configs.embed_model(n) in (None, model)]
        text, doc = evaluate.evaluate(files.read_questions(spark, a.questions), chunks, {n: (lambda n=n: load(n)) for n in fit})
        Path(a.results).mkdir(parents=True, exist_ok=True)
        Path(a.results, "results.md").write_text(text + "\n")
        Path(a.results, "results.json").write_text(doc + "\n")
        print(text)
        return
    for question in _asked(lines if lines is not None else sys.stdin):
        with scratch():
            _answer(spark, retriever, question, a)


def _answer(spark, retriever, question: str, a) -> None:
    from pyspark.sql import functions as F

    from vellumq.operators import answer

    asked, hits, rows, confidence = _search(spark, retriever, question, a.top_k if a.what == "search" else answer.TOP_K)
    if a.what == "search":
        print(f"confidence={confidence:.3f}")
        for r in rows:
            print(f"  #{r['rank']} {r['hit']}\n  {r['preview']!r}")
        return
    threshold = a.threshold if a.threshold is not None else answer.THRESHOLDS.get(a.config)
    if threshold is not None and confidence < threshold:
        print(f"{answer.NO_ANSWER} (confidence {confidence:.3f} < {threshold})")
        return
    generator = answer.ChatEndpoint(a.url, a.model, os.environ.get("CHAT_KEY", "")) if a.url else answer.FirstSentence()
    ctx = answer.context(hits, retriever.chunks, ["qid"])
    got = answer.answers(asked.join(ctx, "qid", "left").withColumn("decision", F.lit("answer")), generator).first()
    print(got["answer"])
    for r in answer.citations(hits, retriever.chunks).orderBy("rank").collect():
        print(f"  {r['citation']}")


if __name__ == "__main__":
    main()
