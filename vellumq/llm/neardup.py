"""Problem 5: chunks that are nearly the same, by anchor-point covering.

A chunk's set of word shingles gets a fingerprint for each of several tables: a symbol, made of the least shingles
under one or more hashes, and seven one-bit minhashes. The anchors of a table are the words of a covering code over that
mixed alphabet: any symbol, followed by a word of the binary Hamming code of length 7, a perfect covering code of
radius 1. Every fingerprint lies within radius 1 of exactly one anchor, its home; it is replicated to all anchors within
the covering radius plus the threshold of 1 (3.6 on average) and compared, per anchor, with those whose home it is, on
256 minhash bits. An exact Jaccard check on the shingles of both texts follows.

There are as many anchors as shingles, sixteen times over, so anchors grow with the collection. Texts of similarity j
share a symbol of k least shingles with probability j^k; unlike texts are compared only by that chance. `symbols_for`
takes k from the number of texts, so that comparisons by chance stay in proportion where texts share single phrases.

Two texts of similarity 0.6 meet in one table with probability 0.79 * 0.6^k (simulated in the tests); `tables_for` takes
as many tables as leave 3 in 100,000 such pairs unmet, and far fewer above 0.6. The check bits turn away less than 1e-6.

Chunks with the same shingle set form one class; only classes are compared, and a group of copies, of any size, costs
one fingerprint. Defined results: null text and texts with fewer words than a shingle have no pairs; a chunk_ord
repeated counts once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.session import dropped, saved
from vellumq.sources.tables import chunks

SHINGLE, SIMILARITY = 3, 0.6
LENGTH, RADIUS, THRESHOLD, CHECK_BITS = 7, 1, 1, 256
MEET, UNMET = 0.79, 3e-5  # chance that the words of a pair at similarity 0.6 meet; share of such pairs left out
GENERATOR, CHECKS = 0b1011, 3  # x^3 + x + 1 generates the binary Hamming code of length 7; three check bits
_WORD = re.compile(r"[^\W_]+")


def symbols_for(texts: int) -> int:
    """Least shingles to a symbol: 1 up to 200,000 texts, then one more for each twentyfold."""
    return 1 if texts < 200_000 else 2 + int(math.log(texts / 200_000, 20))


def tables_for(symbols: int, similarity: float) -> int:
    return math.ceil(math.log(UNMET) / math.log(1 - MEET * similarity**symbols))


def syndrome(w: np.ndarray) -> np.ndarray:
    """Remainder of words of LENGTH bits by the generator."""
    w = w.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        w ^= ((w >> bit) & 1) * GENERATOR << (bit - CHECKS)
    return w


def anchors_of_words(reach: int = RADIUS + THRESHOLD) -> tuple[list[int], list[list[int]]]:
    """For each word its home anchor and all anchors within reach, named by their message bits."""
    words = np.arange(1 << LENGTH, dtype=np.int64)
    code = [int(c) for c in words[syndrome(words) == 0]]
    apart = lambda a, b: (a ^ b).bit_count()
    home = [min(code, key=lambda c: apart(c, w)) >> CHECKS for w in words.tolist()]
    return home, [[c >> CHECKS for c in code if apart(c, w) <= reach] for w in words.tolist()]


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of n words."""
    import xxhash

    words = _WORD.findall(text.lower())
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    ids = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    k = len(ids) - n + 1
    h = np.full(k, 0x2545F4914F6CDD1D, dtype=np.uint64)
    for j in range(n):
        h = (h ^ ids[j : j + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


class Fingerprints:
    """Minhashes of shingle sets: for each table a symbol and a word of LENGTH bits, and the check bits."""

    def __init__(self, tables: int, symbols: int = 1, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.symbols = tables, symbols
        n = tables * symbols + max(CHECK_BITS, tables * LENGTH)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.weights = 1 << np.arange(LENGTH, dtype=np.int64)

    def of(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(sh), 1024):  # bounded memory for long texts
            m = sh[at : at + 1024, None] * self.a
            m += self.b
            m ^= m >> np.uint64(29)
            least = np.minimum(least, m.min(axis=0))
        cut = self.tables * self.symbols
        bits = ((least[cut:] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(60)).astype(np.int64) & 1
        words = bits[: self.tables * LENGTH].reshape(self.tables, LENGTH) @ self.weights
        symbol = np.zeros(self.tables, dtype=np.uint64)
        for part in least[:cut].reshape(self.symbols, self.tables):
            symbol = (symbol ^ part) * np.uint64(0x9E3779B97F4A7C15)
            symbol ^= symbol >> np.uint64(32)
        return symbol.view(np.int64), words, np.packbits(bits[:CHECK_BITS].astype(np.uint8)).view(np.int64)


CHECK = ["c0", "c1", "c2", "c3"]


def fingerprinted(df: DataFrame, key: str, text: str, n: int = SHINGLE, similarity: float = SIMILARITY, symbols: int = 1) -> DataFrame:
    """(k, digest, size, c0..c3, symbols, words) of the texts that have shingles."""
    tables = tables_for(symbols, similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        prints = Fingerprints(tables, symbols)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                rows = []
                for k, t in zip(part["k"], part["t"]):
                    sh = shingles(t, n)
                    if len(sh):
                        symbol, words, check = prints.of(sh)
                        rows.append((k, xxhash.xxh128_digest(sh.tobytes()), len(sh), *check.tolist(), symbol, words.astype(np.int16)))
                yield pd.DataFrame(rows, columns=["k", "digest", "size", *CHECK, "symbols", "words"])

    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    return some.mapInPandas(run, f"k {kind}, digest binary, size int, {', '.join(c + ' long' for c in CHECK)}, symbols array<bigint>, words array<smallint>")


def most_apart(similarity: float) -> int:
    """Check bits in which a pair may differ: one-bit minhashes differ with probability (1 - j) / 2, five deviations are let through."""
    p = (1 - similarity) / 2
    return int(CHECK_BITS * p + 5 * (CHECK_BITS * p * (1 - p)) ** 0.5)


def met(reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with a < b: texts compared at an anchor and not turned away by their check bits."""
    homes, reaches = anchors_of_words()
    home = F.array(*[F.lit(h).cast("int") for h in homes])
    reach = F.array(*[F.array(*[F.lit(r).cast("int") for r in x]) for x in reaches])
    x = reps.select("k", *CHECK, F.posexplode(F.arrays_zip("symbols", "words")).alias("no", "p")).select("k", *CHECK, "no", F.col("p.symbols").alias("symbol"), (F.col("p.words") + 1).cast("int").alias("at"))
    anchor = lambda message: F.xxhash64("no", "symbol", message)
    here = x.select(F.col("k").alias("x"), *[F.col(c).alias("x" + c) for c in CHECK], anchor(F.element_at(home, F.col("at"))).alias("anchor"))
    there = x.withColumn("message", F.explode(F.element_at(reach, F.col("at")))).select(F.col("k").alias("y"), *[F.col(c).alias("y" + c) for c in CHECK], anchor(F.col("message")).alias("anchor"))
    apart = reduce(add, [F.bit_count(F.col("x" + c).bitwiseXOR(F.col("y" + c))) for c in CHECK])
    near = here.join(there, "anchor").filter((F.col("x") != F.col("y")) & (apart <= most_apart(similarity)))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def class_links(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, shingle: int = SHINGLE, symbols: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: key, rep), (links: a, b, jaccard with a < b between class representatives)."""
    points = saved(fingerprinted(df, key, text, shingle, similarity, symbols_for(df.count()) if symbols is None else symbols))
    classes = points.groupBy("digest").agg(F.min("k").alias("rep"))
    members = saved(points.select("k", "digest").join(classes, "digest").select(F.col("k").alias(key), "rep"))
    reps = points.join(classes.select(F.col("rep").alias("k")), "k", "left_semi")
    pairs = saved(met(reps, similarity))

    @F.pandas_udf("double")
    def jaccard(ta: pd.Series, tb: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in known:
                known[t] = shingles(t, shingle)
            return known[t]

        both = [len(np.intersect1d(of(a), of(b), assume_unique=True)) for a, b in zip(ta, tb)]
        return pd.Series([n / (len(of(a)) + len(of(b)) - n) for n, a, b in zip(both, ta, tb)], dtype=float)

    # only texts that met another are looked up again
    some = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    texts = saved(df.select(key, text).join(some, key, "left_semi").select(F.col(key).alias("k"), F.col(text).alias("t")))
    j = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    links = saved(j.select("a", "b", jaccard("ta", "tb").alias("jaccard")).filter(F.col("jaccard") >= similarity))
    for t in (points, pairs, texts):
        dropped(t)
    return members, links


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group): least node of the connected component, by alternating large and small stars; each round's table
    is removed when the next stands."""
    e, mark = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        new = saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        dropped(e)
        e, before = new, mark
        mark = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    to = e.groupBy("u").agg(F.min("v").alias("g"))
    return nodes.join(to, nodes["node"] == to["u"], "left").select("node", F.coalesce("g", "node").alias("group"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = class_links(chunks(spark, folder), "chunk_ord", "text")
    x = members.select(F.col("rep").alias("a"), F.col("chunk_ord").alias("x"))
    y = members.select(F.col("rep").alias("b"), F.col("chunk_ord").alias("y"))
    between = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("chunk_ord_a"), F.greatest("x", "y").alias("chunk_ord_b"))
    many = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("a"))
    within = x.join(many, "a", "left_semi").join(y, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("chunk_ord_a"), F.col("y").alias("chunk_ord_b"))
    return between.union(within)  # each pair of chunks is in one pair of classes only


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk that has shingles with its class, its group of near-duplicates and its number of links to other texts."""
    members, links = class_links(chunks(spark, folder), "chunk_ord", "text")
    g = components(members.select(F.col("rep").alias("node")).distinct(), links)
    n = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(g.select(F.col("node").alias("rep"), "group"), "rep").join(n, "rep", "left").select("chunk_ord", F.col("rep").alias("class_id"), F.col("group").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
