"""Problem 9: evaluation texts leaking into a corpus, by pigeonhole edit matching.

Each test item is covered by all its windows of `window` words. A window with an error budget of e words is split
into e + 1 pieces; a text within e word edits of the window holds one of them exactly. Texts are scanned once for all
pieces through hashed word n-grams, and every hit is verified with Myers' bit-parallel edit distance of the window
against the text around the hit. Items are a stated set, taken in blocks against all rows.

Words are the longest runs of letters and digits of the lower-cased text. Defined results: null or short texts and
items shorter than the window give nothing; repeated items and documents count once; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.sources.tables import table

WINDOW, ERRORS, BLOCK_CHARS, BLOCKS = 13, 1, 5_000_000, 8
FILTER_BITS, FILTER_MASK = 20, np.uint64((1 << 20) - 1)
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def myers(pattern: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of the pattern (up to 64 symbols) to any stretch of the text."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        peq[x] = peq.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for x in text.tolist():
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def myers_many(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """`myers` for rows of patterns and texts at once; symbols that are no text are -1, which no pattern has."""
    n, m = patterns.shape
    full, top, one = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1)), np.uint64(1)
    bit = one << np.arange(m, dtype=np.uint64)
    pv, mv = np.full(n, full), np.zeros(n, dtype=np.uint64)
    score = np.full(n, m, dtype=np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = np.where(patterns == texts[:, j, None], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = np.minimum(best, score)
    return best


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n ids."""
    k = len(ids) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(k, n, dtype=np.uint64)
    for j in range(n):
        h = (h ^ ids[j : j + k].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Pieces of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int) -> None:
        self.window, self.errors = window, errors
        bounds = np.linspace(0, window, errors + 2).astype(int)
        self.parts = [(int(a), int(b - a)) for a, b in zip(bounds[:-1], bounds[1:])]
        self.vocab: dict[str, int] = {}
        self.ids: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            w = words(text)
            if len(w) >= window:
                self.ids.append((item, np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.int64)))
        self.flat = np.concatenate([x for _, x in self.ids] or [np.zeros(0, np.int64)])
        self.offsets = np.cumsum([0, *(len(x) for _, x in self.ids)])[:-1]
        self.sizes = sorted({n for _, n in self.parts})
        self.tables = {}
        for n in self.sizes:
            keys, where = [], []
            for at, size in self.parts:
                if size != n:
                    continue
                for i, (_, ids) in enumerate(self.ids):
                    starts = np.arange(len(ids) - window + 1)
                    keys.append(_grams(ids, n)[starts + at])
                    where.append(np.stack([np.full(len(starts), i), starts, np.full(len(starts), at)], 1))
            k, w = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(where or [np.zeros((0, 3), np.int64)])
            order = np.argsort(k, kind="stable")
            some = np.zeros(1 << FILTER_BITS, dtype=bool)  # which pieces there are, by their last bits
            some[k & FILTER_MASK] = True
            self.tables[n] = (k[order], w[order], some)

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item, window, place, distance) of every verified window.

        The texts' words stand in one array, kept apart by words of no item, so pieces are looked up for all at once.
        """
        get, apart = self.vocab.get, [0] * self.window
        flat: list[int] = []
        begins, ends = [], []
        for t in texts:
            begins.append(len(flat))
            flat += [get(w, 0) for w in words(t)]
            ends.append(len(flat))
            flat += apart
        ids = np.array(flat, dtype=np.int64)
        found = [np.zeros((0, 3), dtype=np.int64)]
        for n, (keys, where, some) in self.tables.items():
            g = _grams(ids, n)
            if not len(g) or not len(keys):
                continue
            at = np.flatnonzero(some[g & FILTER_MASK])
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            count = hi - lo
            p = np.repeat(at, count)
            which = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            w = where[which]
            found.append(np.stack([w[:, 0], w[:, 1], p - w[:, 2]], 1))
        seen = np.unique(np.concatenate(found), axis=0)
        if not len(seen):
            return []
        item, start, place = seen.T
        starts, stops = np.array(begins), np.array(ends)
        # the text a piece stands in: a place before its begin belongs to a window that runs over it
        no = np.searchsorted(starts, place + self.window - 1, "right") - 1
        at = place[:, None] + np.arange(-self.errors, self.window + self.errors)
        inside = (at >= starts[no][:, None]) & (at < stops[no][:, None])
        around = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], -1)
        pattern = self.flat[(self.offsets[item] + start)[:, None] + np.arange(self.window)]
        d = myers_many(pattern, around)
        ok = np.flatnonzero(d <= self.errors)
        return [(int(no[i]), self.ids[item[i]][0], int(start[i]), int(place[i] - starts[no[i]]), int(d[i])) for i in ok]


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, errors: int = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item, window_no, place, distance): windows of items that stand in texts with up to `errors` word edits.

    The items are collected in blocks of about `block_chars` characters; each block's index is built once, on the
    driver, and sent to the executors. One pass over the texts looks them up in up to `BLOCKS` indexes, so what is sent
    at once is bounded; more items are more passes.
    """
    if not 1 <= window <= 64 or not 0 <= errors < window:
        raise ValueError("windows have 1 to 64 words and fewer errors than words")
    spark = df.sparkSession
    chosen = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").groupBy("i").agg(F.max("t").alias("t"))
    size = chosen.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    out = None
    for at in range(0, blocks, BLOCKS):
        sent = []
        for no in range(at, min(blocks, at + BLOCKS)):
            part = [(r["i"], r["t"]) for r in chosen.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == no).collect()]
            sent.append(spark.sparkContext.broadcast(Index(part, window, errors)))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            indexes = [x.value for x in sent]
            for b in batches:
                for start in range(0, len(b), 256):
                    p = b.iloc[start : start + 256]
                    ks, texts = p["k"].tolist(), p["t"].tolist()
                    rows = [(ks[no], *h) for index in indexes for no, *h in index.hits(texts)]
                    yield pd.DataFrame(rows, columns=["k", "i", "window_no", "place", "distance"])

        found = some.mapInPandas(scan, f"k {kind}, i {item_kind}, window_no long, place long, distance int")
        out = found if out is None else out.union(found)
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key), "window_no", "place", "distance")


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "heldout_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).filter("distance = 0").select("doc_id", "item_id").distinct()


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items with the windows found exactly and within one word edit."""
    x = _all(spark, folder).distinct()
    return x.groupBy("doc_id", "item_id").agg(F.countDistinct("window_no").alias("windows"), F.min("distance").alias("least"), F.countDistinct(F.when(F.col("distance") == 0, F.col("window_no"))).alias("exact"))
