"""From pages to blocks: routing between text layer and recognition, and grouping recognised words into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.functions.text import stripped

#: Characters from which a page's own text layer is trusted; resolution of rendered pages (fixed values).
MIN_CHARS, DPI = 20, 200


def route(text: Column, least: int = MIN_CHARS) -> Column:
    """digital if the page's text, stripped, is long enough, else ocr; a page without text is ocr."""
    return F.when(F.length(stripped(F.coalesce(text, F.lit("")))) >= least, F.lit("digital")).otherwise(F.lit("ocr"))


def line_blocks(df: DataFrame, key: str, text: str, lines_per_page: int = 10) -> DataFrame:
    """One block for each non-blank line of a plain text, with the place a page of `lines_per_page` lines gives it."""
    x = df.filter(F.col(key).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\n")).alias("block_ord", "text"))
    y = (F.col("block_ord") * 12).cast("double")
    x = x.withColumn("text", stripped(F.col("text"))).filter("text != ''")
    return x.select(key, "block_ord", "text", (F.lit(1) + F.floor(F.col("block_ord") / lines_per_page)).cast("int").alias("page"), F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(612.0).alias("x1"), (y + 12).alias("y1")).alias("bbox"))


def group_words(words: DataFrame, page_keys: list[str], dpi: int = DPI) -> DataFrame:
    """Lines of recognised words: (page keys, block_ord, text, bbox in points, extraction_method).

    `words` has pos, text, block_num, par_num, line_num, left, top, width, height. Words of one (block, paragraph,
    line) form a line in order of pos; its box is the union of theirs; lines stand in the order of their first word.
    Blank words open no line. Corners are rounded to two decimals, half up.
    """
    scale = 72.0 / dpi
    w = words.withColumn("text", stripped(F.col("text"))).filter("text != ''")
    g = w.groupBy(*page_keys, "block_num", "par_num", "line_num").agg(
        F.min("pos").alias("first_pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    from pyspark.sql.window import Window

    order = Window.partitionBy(*page_keys).orderBy("first_pos")
    box = F.struct(*[F.round(F.col(c) * scale, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return g.select(*page_keys, (F.row_number().over(order) - 1).alias("block_ord"), "text", box.alias("bbox"), F.lit("ocr").alias("extraction_method"))


def word_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Word rows from the recogniser's parallel arrays."""
    cols = ["text", "block_num", "par_num", "line_num", "left", "top", "width", "height"]
    return df.select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("pos", "w")).select(*keys, "pos", *[F.col("w")[c].alias(c) for c in cols])
