"""Dense vectors: encoders, exact cosine search, and the index as plain tables with a manifest.

Search is exact. `search` multiplies blocks of chunk vectors with matrices of query vectors in Arrow batches and keeps
a task's best k a query, so only k rows a query and task are shuffled. Query vectors are sent to the executors in
matrices of bounded size, however many queries there are.

Defined results: a null or zero vector scores 0 with everything; vectors of another length than the queries' are an
error; k larger than the corpus returns the whole corpus; ties go to the lower ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.functions.text import query_prefix
from vellumq.operators.lexical import merged, top_k
from vellumq.session import saved

BLOCK, BLOCKS = 2000, 8


class Encoder(Protocol):
    """Turns texts into vectors; loaded once a Python worker. `name` goes to the manifest."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def letter_vector(text: Column) -> Column:
    """Deterministic encoder in SQL: counts of the 26 letters, unit length; all zero for a text without letters."""
    count = lambda low, c: (F.length(low) - F.length(F.translate(low, c, ""))).cast("double")
    return unit(let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*[count(low, c) for c in LETTERS])))


def unit(v: Column) -> Column:
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    return let(v, lambda x: let(norm(x), lambda n: F.transform(x, lambda y: F.when(n > 0, y.cast("double") / n).otherwise(F.lit(0.0)))))


def encoded(df: DataFrame, text: str, encoder: Encoder, batch: int = 32) -> DataFrame:
    """Adds `embedding`: unit vectors of a text column by a Python encoder."""

    @F.pandas_udf("array<float>")
    def enc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            out = []
            for at in range(0, len(p), batch):
                m = np.asarray(encoder.encode(p.iloc[at : at + batch].fillna("").tolist()), dtype=np.float32)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                out += list(np.divide(m, n, out=np.zeros_like(m), where=n > 0))
            yield pd.Series(out, index=p.index)

    return df.withColumn("embedding", enc(F.col(text)))


def search(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, skip_self: bool = False) -> DataFrame:
    """(qid, chunk_ord, rank, score): queries has qid, embedding; vectors has chunk_ord, embedding.

    Query vectors go to the executors in matrices of `block` rows, `BLOCKS` matrices to one pass over the vectors, so
    what is sent at once is bounded; more queries are more passes. A task keeps the best k of each query over all its
    batches, so k rows a query and task are shuffled, and there are as many tasks as cores.
    """
    kind, okind = queries.schema["qid"].dataType.simpleString(), vectors.schema["chunk_ord"].dataType.simpleString()
    q = queries.select("qid", "embedding")
    blocks = max(1, -(-q.count() // block))
    q = saved(q.withColumn("__b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))) if blocks > BLOCKS else q.withColumn("__b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    v, out = vectors.select("chunk_ord", "embedding"), None
    if blocks > BLOCKS:
        v = saved(v)
    # each task gives k rows a query, so no more tasks than there is room for at once
    v = v.coalesce(max(1, queries.sparkSession.sparkContext.defaultParallelism))
    for at in range(0, blocks, BLOCKS):
        rows = q.filter((F.col("__b") >= at) & (F.col("__b") < at + BLOCKS)).collect()  # about `block` times `BLOCKS` rows
        parts = []
        for no in range(at, min(blocks, at + BLOCKS)):
            some = [r for r in rows if r["__b"] == no]
            size = max((len(r["embedding"]) for r in some if r["embedding"] is not None), default=0)
            if some:
                parts.append((np.array([r["qid"] for r in some], dtype=object), np.array([r["embedding"] if r["embedding"] is not None else [0.0] * size for r in some], dtype=np.float64).reshape(len(some), size)))
        if not parts:
            continue
        sent = queries.sparkSession.sparkContext.broadcast(parts)

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            kept = [None] * len(sent.value)
            for b in batches:
                for start in range(0, len(b), 4096):
                    p = b.iloc[start : start + 4096]
                    o = p["chunk_ord"].to_numpy()
                    m = None
                    for i, (ids, matrix) in enumerate(sent.value):
                        if m is None or m.shape[1] != matrix.shape[1]:
                            m = np.array([x if x is not None else np.zeros(matrix.shape[1]) for x in p["embedding"]], dtype=np.float64).reshape(len(p), -1)
                        s = np.round(matrix @ m.T, 9)
                        if skip_self:
                            s[ids[:, None] == o[None, :]] = -np.inf
                        kept[i] = merged(kept[i], s, o, k)
            for (ids, _), x in zip(sent.value, kept):
                if x is not None:
                    r, o, s, _ = x
                    real = s > -np.inf
                    yield pd.DataFrame({"qid": ids[r[real]], "chunk_ord": o[real], "score": s[real]})

        part = v.mapInPandas(best, f"qid {kind}, chunk_ord {okind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"qid {kind}, chunk_ord {okind}, rank int, score double")
    return top_k(out, k).select("qid", "chunk_ord", "rank", "score")


def save_index(vectors: DataFrame, chunks: DataFrame, path: str, model: str) -> None:
    """Vectors, chunks and, last, the manifest: without it there is no index."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    spark = vectors.sparkSession
    n = spark.read.parquet(f"{path}/chunks").count()
    spark.createDataFrame([(model, n)], "embed_model string, num_chunks long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(vectors, chunks, model name); a missing manifest or another model is an error."""
    try:
        m = spark.read.schema("embed_model string, num_chunks long").json(f"{path}/manifest").first()
    except Exception as e:
        raise FileNotFoundError(f"no index in {path}: build it first") from e
    if m is None:
        raise FileNotFoundError(f"no index in {path}: build it first")
    check_model(model, m["embed_model"])
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/chunks"), m["embed_model"]


def check_model(wanted: str | None, built: str) -> None:
    if wanted is not None and wanted != built:
        raise ValueError(f"{wanted} is needed, but the index was built with {built}")


def prefixed(questions: DataFrame, model: str) -> DataFrame:
    """Questions with the instruction their model expects; chunks never get it."""
    return questions.withColumn("question", F.concat(F.lit(query_prefix(model)), "question"))

