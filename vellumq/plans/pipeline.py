"""From a folder of PDFs to a searchable index: pages, blocks, chunks, vectors; one table a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.operators import chunking, dense, fusion, pages
from vellumq.operators.running import prefix_sums
from vellumq.plans.configs import Retriever, embed_model
from vellumq.session import dropped, saved, scratch
from vellumq.sources import files


def blocks_of(page_rows: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Blocks of parsed pages: layout blocks where the text layer is good, recognised lines elsewhere.

    `recognise` turns image pages (source_file, doc_id, page, image) into word rows (see operators.pages); without it
    such pages give no blocks.
    """
    p = page_rows.withColumn("route", pages.route(F.col("text")))
    d = p.filter("route = 'digital'").select("source_file", "doc_id", "page", F.posexplode("blocks").alias("n", "b"))
    d = d.select("source_file", "doc_id", "page", "n", F.col("b.text").alias("text"), F.struct("b.x0", "b.y0", "b.x1", "b.y1").alias("bbox"), F.lit("digital").alias("extraction_method")).filter("text != ''")
    if recognise is not None:
        w = recognise(p.filter("route = 'ocr'").select("source_file", "doc_id", "page", "image"))
        o = pages.group_words(w, ["source_file", "doc_id", "page"]).withColumnRenamed("block_ord", "n")
        d = d.unionByName(o.select(*d.columns))
    order = Window.partitionBy("doc_id").orderBy("page", "n")
    return d.withColumn("block_ord", (F.row_number().over(order) - 1).cast("int")).drop("n")


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """chunk_ord over the whole corpus: documents by name, chunks in order; running sums over one row a document."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("every", F.lit(0))
    base = prefix_sums(n, ["every"], ["doc_id"], ["n"]).select("doc_id", (F.col("n_upto") - F.col("n")).alias("base"))
    return chunks.join(base, "doc_id").withColumn("chunk_ord", (F.col("base") + F.col("chunk_no")).cast("long")).drop("base")


def ingest(spark: SparkSession, pdf_dir: str, out: str, parse: files.PageParser = files.pymupdf_pages, recognise=None) -> int:
    """Parses the PDFs that changed since they were last parsed into `out`/blocks; returns their number."""
    found = files.pdf_files(spark, pdf_dir)
    try:
        stamps = saved(spark.read.parquet(f"{out}/parsed").groupBy("doc_id").agg(F.max("parsed_at").alias("parsed_at")))
        todo = files.stale(found.select("path", "modificationTime"), stamps)
    except AnalysisException:  # nothing parsed yet
        todo = found.select(files.stem().alias("doc_id"), "path")
    todo = saved(todo)
    n = todo.count()
    if n:
        at = spark.sql("select current_timestamp() as t").first()["t"]
        pages = files.pages_of(found.join(todo.select("path"), "path", "left_semi"), parse)
        files.write_documents(blocks_of(pages, recognise), f"{out}/blocks")
        todo.select("doc_id", F.lit(at).alias("parsed_at")).write.mode("append").parquet(f"{out}/parsed")
    dropped(todo)
    return n


def chunk(spark: SparkSession, out: str, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> int:
    """Cuts all blocks of `out`/blocks anew into `out`/chunks; returns the number of chunks."""
    with scratch():
        chunks = with_ordinals(saved(chunking.chunks_of(files.read_documents(spark, f"{out}/blocks"), target, overlap)))
        files.write_documents(chunks, f"{out}/chunks")
    return spark.read.parquet(f"{out}/chunks").count()


def build_index(spark: SparkSession, out: str, config: str, encode: Callable[[DataFrame], DataFrame]) -> int | None:
    """Embeds `out`/chunks for a configuration into `out`/index, manifest last. Without chunks says so and returns None;
    a configuration without an embedding model is an error. `encode` adds `embedding` to rows with `text`."""
    try:
        chunks = files.read_documents(spark, f"{out}/chunks")
        n = chunks.count()
    except AnalysisException:
        n = 0
    if not n:
        print(f"no chunks in {out}/chunks: cut some first")
        return None
    model = embed_model(config)
    if model is None:
        raise ValueError(f"{config} has no embedding model: take a dense or hybrid configuration")
    dense.save_index(encode(chunks).select("chunk_ord", "embedding"), chunks, f"{out}/index", model)
    return n


def load_retriever(spark: SparkSession, out: str, config: str, encode: Callable[[DataFrame], DataFrame], scorer: fusion.PairScorer | None = None) -> Retriever:
    """The index of `out` as a retriever of the configuration, BM25 built once. No index, or one of another model, is an
    error. `encode` adds `embedding` to rows with `text`."""
    vectors, chunks, model = dense.load_index(spark, f"{out}/index")

    def questions(q: DataFrame) -> DataFrame:
        return encode(q.withColumnRenamed("question", "text")).select("qid", "embedding")

    return Retriever(config, chunks, vectors, questions, model if embed_model(config) else None, scorer)


def build(spark: SparkSession, pdf_dir: str, out: str, model: str, encode: Callable[[DataFrame], DataFrame], parse: files.PageParser = files.pymupdf_pages, recognise=None, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> int:
    """Parses what changed, cuts, embeds and saves; returns the number of chunks, 0 if there never was a PDF."""
    ingest(spark, pdf_dir, out, parse, recognise)
    try:
        n = chunk(spark, out, target, overlap)
    except AnalysisException:  # no blocks
        return 0
    chunks = files.read_documents(spark, f"{out}/chunks")
    dense.save_index(encode(chunks).select("chunk_ord", "embedding"), chunks, f"{out}/index", model)
    return n
