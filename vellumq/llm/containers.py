"""Problem 8: filling containers of fixed capacity with whole texts.

Texts are measured in tokens of a public tokenizer; only a text over the capacity is split, at the capacity. Packing
works on the histogram of lengths, which has at most `capacity` entries whatever the number of texts: for the longest
length left, an exact complement is looked up among single lengths, sums of two and sums of three under the counts
still available, and the combination is used as often as the counts allow; what has no exact complement goes best-fit.
The plan, no more than a few patterns a length, is turned into ranges of (length, rank) and texts are assigned by
their rank within the length.

Defined results: a null text is no item; an empty text has 0 tokens and goes to the first container; doc_id repeated
counts once; a text of exactly the capacity fills one container.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.llm.common import prefix_sums
from vellumq.session import one_per_key, saved
from vellumq.sources.tables import table

CAPACITY = 2048
TOKENIZER = os.environ.get("VELLUMQ_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens); the tokenizer file is sent to the executors from the driver."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        for b in batches:
            n = [len(x) for at in range(0, len(b), 64) for x in t.encode_batch_fast(b["t"].iloc[at : at + 64].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"k": b["k"], "n": n})

    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    return some.mapInPandas(count, f"k {kind}, n long").select(F.col("k").alias(key), F.col("n").alias("n_tokens"))


class Sums:
    """Indexes of the sums of two and of three available lengths. A sum's combinations stand in a fixed order behind a
    mark; as counts only fall, a combination that has run out never comes back and the mark passes it for good."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.c = counts
        lengths = np.flatnonzero(counts)
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        keep = (a <= b) & (a + b <= capacity)
        self.pairs = self._index(a[keep], b[keep], capacity)
        # three: a length and the sum of a pair of lengths that are no shorter
        sums = np.flatnonzero(np.diff(self.pairs[0]))
        a, s = np.meshgrid(lengths, sums, indexing="ij")
        keep = (3 * a <= a + s) & (a + s <= capacity)
        self.triples = self._index(a[keep], s[keep], capacity)

    @staticmethod
    def _index(a: np.ndarray, b: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin of each sum, a, b, mark of each sum), the most even combinations first."""
        total = a + b
        order = np.lexsort((-a, total))
        begin = np.searchsorted(total[order], np.arange(capacity + 2))
        return begin, a[order], b[order], begin[:-1].copy()

    def fits(self, parts: list[int]) -> bool:
        return all(self.c[p] >= parts.count(p) for p in parts)

    def pair(self, gap: int, taken: list[int]) -> list[int] | None:
        begin, a, b, mark = self.pairs
        end = int(begin[gap + 1])
        while mark[gap] < end and not (self.c[a[mark[gap]]] and self.c[b[mark[gap]]]):
            mark[gap] += 1
        for i in range(int(mark[gap]), end):
            two = [int(a[i]), int(b[i])]
            if self.fits([*taken, *two]):
                return two
        return None

    def triple(self, gap: int, taken: list[int]) -> list[int] | None:
        begin, a, s, mark = self.triples
        end = int(begin[gap + 1])
        pair_begin, _, _, pair_mark = self.pairs
        while mark[gap] < end and not (self.c[a[mark[gap]]] and pair_mark[s[mark[gap]]] < pair_begin[s[mark[gap]] + 1]):
            mark[gap] += 1
        for i in range(int(mark[gap]), end):
            one = int(a[i])
            if self.fits([*taken, one]) and (two := self.pair(int(s[i]), [*taken, one])):
                return [one, *two]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths with how often each, number of containers filled so)] for a histogram of lengths 1..capacity."""
    c = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        c[n] = k
    sums = Sums(c, capacity)
    out: list[tuple[dict[int, int], int]] = []

    def use(parts: list[int]) -> None:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(int(c[p]) // k for p, k in need.items())
        for p, k in need.items():
            c[p] -= times * k
        out.append((need, times))

    def complement(n: int) -> list[int] | None:
        gap = capacity - n
        if gap == 0:
            return []
        if sums.fits([n, gap]):
            return [gap]
        return sums.pair(gap, [n]) or sums.triple(gap, [n])

    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # room -> patterns
    for n in range(capacity, 0, -1):
        while c[n] and (more := complement(n)) is not None:
            use([n, *more])
    left = c.copy()
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                each = capacity // n
                for k, times in ((each, todo // each), (todo % each, 1)):
                    if k and times:
                        open_.setdefault(capacity - k * n, []).append(({n: k}, times))
                break
            parts, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(times, todo)
            todo -= used
            if times > used:
                open_.setdefault(room, []).append((parts, times - used))
            open_.setdefault(room - n, []).append(({**parts, n: parts.get(n, 0) + 1}, used))
    return out + [x for group in open_.values() for x in group]


def assign(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece_no, n_pieces, token_from, token_to, container)."""
    n = saved(token_counts(df, key, text, tokenizer))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = n.withColumn("n_pieces", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    items = items.withColumn("token_from", F.col("piece_no") * F.lit(capacity).cast("long")).withColumn("token_to", F.least(F.col("token_from") + capacity, F.col("n_tokens")))
    items = items.withColumn("len", F.col("token_to") - F.col("token_from")).drop("n_tokens")
    histogram = {r["len"]: r["n"] for r in items.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    rows, taken, base = [(0, 0, empty, 0, empty)] if empty else [], dict.fromkeys(histogram, 0), 0
    for parts, times in plan(histogram, capacity):
        for size, k in parts.items():
            rows.append((size, taken[size], taken[size] + k * times, base, k))
            taken[size] += k * times
        base += times
    # a pattern uses up a length or a group of open containers: a few rows for each of the `capacity` lengths
    slots = df.sparkSession.createDataFrame(rows, "len long, lo long, hi long, base long, each long")
    ranked = prefix_sums(items.withColumn("one", F.lit(1).cast("long")), ["len"], [key, "piece_no"], ["one"]).withColumn("rank", F.col("one_upto") - 1)
    placed = ranked.join(slots, (ranked["len"] == slots["len"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(key, "piece_no", "n_pieces", "token_from", "token_to", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("container"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "documents").select("doc_id", "text", "fetched_at"), ["doc_id"], ["fetched_at"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return assign(documents(spark, folder), "doc_id", "text").filter("n_pieces > 1 and piece_no = 0").select("doc_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text or piece with its container."""
    return assign(documents(spark, folder), "doc_id", "text")


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents placed, containers over the capacity, and documents whose pieces don't cover them in order, are
    longer than the capacity or are more than they need be; the last two are 0."""
    a = saved(assign(documents(spark, folder), "doc_id", "text"))
    over = a.groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"))
    last = F.max("token_to")
    wrong = (F.min("token_from") != 0) | (F.sum(F.col("token_to") - F.col("token_from")) != last) | (F.count("*") != F.max("n_pieces")) | (F.max("n_pieces") != F.greatest(F.lit(1), F.ceil(last / CAPACITY)))
    docs = a.groupBy("doc_id").agg(wrong.alias("wrong")).agg(F.count("*").alias("documents"), F.count_if("wrong").alias("broken"))
    return docs.crossJoin(over)  # one row each


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are."""
    c = assign(documents(spark, folder), "doc_id", "text").groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return c.groupBy("tokens").agg(F.count("*").alias("containers"))
