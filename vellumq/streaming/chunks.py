"""Chunking a stream of blocks: each micro-batch's documents are cut anew and replace their earlier chunks.

A document's chunks depend on that document alone, so no state crosses micro-batches; a document whose blocks come in
several batches is cut from all its blocks so far, which the block table keeps.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumq.operators import chunking
from vellumq.schemas import BLOCK
from vellumq.session import dropped, one_per_key, saved, scratch
from vellumq.sources.files import read_documents, write_documents


def chunk_stream(spark: SparkSession, source: str, out: str, checkpoint: str, available_now: bool = True, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> StreamingQuery:
    """Reads block Parquet files as they appear, keeps blocks and chunks by document under `out`."""
    stream = spark.readStream.schema(BLOCK).parquet(source)

    def each(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        docs = batch.select("doc_id").distinct()
        every = batch.withColumn("__version", F.lit(1))
        try:
            old = read_documents(s, f"{out}/blocks").select(*batch.columns).join(docs, "doc_id", "left_semi")
            every = every.unionByName(old.withColumn("__version", F.lit(0)))
        except AnalysisException:  # no block table yet
            pass
        # a block that is sent again replaces its earlier version
        every = saved(one_per_key(every, ["doc_id", "block_ord"], ["__version"]).select(*batch.columns))
        with scratch():
            write_documents(every, f"{out}/blocks")
            write_documents(chunking.chunks_of(every, target, overlap), f"{out}/chunks")
        dropped(every)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
