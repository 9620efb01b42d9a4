"""Files in and out: PDF folders, block and chunk JSON, Parquet by document, staleness of what was parsed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.operators.pages import DPI, MIN_CHARS
from vellumq.operators.running import prefix_sums
from vellumq.schemas import BLOCK, CHUNK, QUESTION
from vellumq.session import dropped, saved

PAGE = "path string, source_file string, doc_id string, page int, text string, blocks array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, image binary"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files named *.pdf (lower case) directly in the folder, as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)


def stem(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


PageParser = Callable[[bytes], list[dict]]


def pymupdf_pages(content: bytes) -> list[dict]:
    """Pages with text, layout blocks and, where the text layer is too thin, a rendered image."""
    import pymupdf  # optional

    out = []
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            text = page.get_text()
            thin = len(text.strip()) < MIN_CHARS
            blocks = [{"text": b[4].strip(), **{k: round(v, 2) for k, v in zip(("x0", "y0", "x1", "y1"), b[:4])}} for b in page.get_text("blocks") if b[4].strip()]
            out.append({"text": text, "blocks": blocks, "image": page.get_pixmap(dpi=DPI).tobytes("png") if thin else None})
    return out


def pages_of(files: DataFrame, parse: PageParser = pymupdf_pages) -> DataFrame:
    """One row for each page; the parser runs where the file's bytes are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = path.rpartition("/")[2]
                rows = [(path, name, name.rpartition(".")[0], i + 1, p["text"], p["blocks"], p.get("image")) for i, p in enumerate(parse(content))]
                yield pd.DataFrame(rows, columns=["path", "source_file", "doc_id", "page", "text", "blocks", "image"])

    return files.select("path", "content").mapInPandas(run, PAGE)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Block JSON, one list a document; source_file falls back to the file's stem, block_ord is the place in the list."""
    one = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    items = one.select(stem().alias("doc_id"), F.posexplode(F.from_json("value", f"array<{BLOCK.simpleString()}>")).alias("block_ord", "b"))
    return items.select("doc_id", "block_ord", "b.text", "b.page", "b.bbox", F.coalesce("b.source_file", "doc_id").alias("source_file"), "b.extraction_method")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk JSON of a folder with chunk_ord: files in order of their names, chunks in order within."""
    one = spark.read.text(folder, wholetext=True, pathGlobFilter="*.chunks.json").select(F.col("_metadata.file_path").alias("path"), "value")
    items = one.select("path", F.posexplode(F.from_json("value", f"array<{CHUNK.simpleString()}>")).alias("no", "c"))
    n = items.groupBy("path").agg(F.count("*").alias("n")).withColumn("every", F.lit(0))
    base = prefix_sums(n, ["every"], ["path"], ["n"]).select("path", (F.col("n_upto") - F.col("n")).alias("base"))
    keep = [f"c.{f.name}" for f in CHUNK.fields if f.name != "chunk_ord"]
    return items.join(base, "path").select(*keep, (F.col("base") + F.col("no")).cast("long").alias("chunk_ord"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("multiLine", "true").json(path).withColumnRenamed("id", "qid")


BUCKETS = 64


def _bucketed(df: DataFrame, path: str, kind: str, buckets: int) -> None:
    spark = df.sparkSession
    new = saved(df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))
    try:
        old = spark.read.format(kind).schema(new.schema).load(path)
    except AnalysisException:  # no such table yet
        old = None
    if old is not None:
        # only the buckets that get documents are read and written again
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        kept = old.filter(F.col("bucket").isin(touched)).join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        both = saved(new.unionByName(kept.select(*new.columns)))
        dropped(new)
        new = both
    # a document may hold a third of the rows: four files a bucket, rows dealt by their content
    dealt = new.repartition("bucket", F.pmod(F.xxhash64(*new.columns), F.lit(4)))
    dealt.write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").save(path)
    dropped(new)


def write_documents(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet in buckets of doc_id: documents in `df` replace their earlier versions, others stay. One table has one
    number of buckets."""
    _bucketed(df, path, "parquet", buckets)


def write_json(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """JSON lines, replaced like `write_documents`."""
    _bucketed(df, path, "json", buckets)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def stale(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files that have not been parsed since they changed; parsed has doc_id, parsed_at."""
    f = files.select(stem().alias("doc_id"), "path", "modificationTime")
    return f.join(parsed, "doc_id", "left").filter(F.col("parsed_at").isNull() | (F.col("parsed_at") <= F.col("modificationTime"))).select("doc_id", "path")


WORDS = "source_file string, doc_id string, page int, pos int, text string, block_num int, par_num int, line_num int, left int, top int, width int, height int"


def tesseract_words(image: bytes) -> dict[str, list]:
    """The recogniser's parallel arrays for a page image."""
    import io

    import pytesseract  # optional
    from PIL import Image

    return pytesseract.image_to_data(Image.open(io.BytesIO(image)), output_type=pytesseract.Output.DICT)


def recogniser(words_of: Callable[[bytes], dict[str, list]] = tesseract_words) -> Callable[[DataFrame], DataFrame]:
    """A step for `plans.pipeline.blocks_of`: image pages to word rows, the recogniser run where the image is."""
    cols = ["text", "block_num", "par_num", "line_num", "left", "top", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for src, doc, page, image in zip(b["source_file"], b["doc_id"], b["page"], b["image"]):
                if image is None:
                    continue
                got = words_of(image)
                yield pd.DataFrame({"source_file": src, "doc_id": doc, "page": page, "pos": range(len(got["text"])), **{c: got[c] for c in cols}}, columns=[x.split()[0] for x in WORDS.split(", ")])

    return lambda pages: pages.select("source_file", "doc_id", "page", "image").mapInPandas(run, WORDS)
