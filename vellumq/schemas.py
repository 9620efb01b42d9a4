"""Schemas of the tables this engine reads and writes."""

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
BLOCK = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("block_ord", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("bbox", BBOX), T.StructField("source_file", T.StringType()), T.StructField("extraction_method", T.StringType()),
])
REGION = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("bbox", BBOX)])
CHUNK = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("regions", T.ArrayType(REGION)),
    T.StructField("chunk_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("chunk_ord", T.LongType()),
])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("answerable", T.BooleanType()), T.StructField("source_file", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("why_unanswerable", T.StringType()),
])
HIT = T.StructType([T.StructField("qid", T.StringType()), T.StructField("chunk_ord", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
