"""Merging ranked lists, and re-scoring what they return.

Reciprocal-rank fusion: score = sum over the lists of 1 / (RRF_K + rank). Equal scores keep the order of first
appearance: the first list in rank order, then what only later lists have, in theirs. Sums are taken in list order, so
they come out the same on every run.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.functions.text import tokens

RRF_K, CANDIDATES, RERANKED = 60, 50, 30  # fixed values


def rrf(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, chunk_ord, rank, score) from lists of (qid, chunk_ord, rank)."""
    return rrf_tagged(reduce(DataFrame.unionByName, [x.select("qid", "chunk_ord", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]), k, rrf_k)


def rrf_tagged(tagged: DataFrame, k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """As `rrf`, for one table whose column `list` tells the lists apart and orders them, however many there are.

    Null ranks and lists don't count; a chunk that a list names twice counts with the better rank.
    """
    best = tagged.filter("rank is not null and list is not null").groupBy("qid", "chunk_ord", "list").agg(F.min("rank").alias("rank"))
    g = best.groupBy("qid", "chunk_ord").agg(F.array_sort(F.collect_list(F.struct("list", "rank"))).alias("l"))  # one entry a list
    g = g.withColumn("score", F.aggregate("l", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (F.lit(rrf_k) + x["rank"])))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("l")[0]["list"], F.col("l")[0]["rank"], "chunk_ord")
    out = g.withColumn("rank", F.row_number().over(order))
    return (out.filter(F.col("rank") <= k) if k is not None else out).select("qid", "chunk_ord", "rank", "score")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Fusion of two candidate lists cut at k. Its confidence is the dense list's, not the fused score."""
    return rrf([dense, sparse], k)


class PairScorer(Protocol):
    """Scores (question, text) pairs; loaded once a Python worker."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def overlap_score(question: Column, text: Column) -> Column:
    """Deterministic pair score in SQL: the share of the question's distinct tokens that the text has."""
    q = F.array_distinct(tokens(F.coalesce(question, F.lit(""))))
    both = F.size(F.array_intersect(q, tokens(F.coalesce(text, F.lit("")))))
    return F.when(F.size(q) > 0, both / F.size(q)).otherwise(F.lit(0.0))


def pair_score(scorer: PairScorer, question: Column, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer.predict(list(zip(q.fillna(""), t.fillna(""))))])

    return score(question, text)


def rerank(base: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, scorer: PairScorer | None = None, candidates: int = RERANKED) -> DataFrame:
    """The base list's first `candidates` in order of their pair score; ties keep the base order."""
    c = base.filter(F.col("rank") <= candidates).select("qid", "chunk_ord", F.col("rank").alias("base_rank"))
    c = c.join(questions.select("qid", "question"), "qid").join(chunks.select("chunk_ord", "text"), "chunk_ord")
    s = overlap_score(F.col("question"), F.col("text")) if scorer is None else pair_score(scorer, F.col("question"), F.col("text"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "base_rank")
    return c.withColumn("score", s).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "chunk_ord", "rank", "score")
