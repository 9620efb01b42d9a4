"""Cutting a document's blocks into overlapping chunks, blocks never split.

Words of blocks are appended in order; once `target` words stand, a chunk of all of them is cut and its last
`overlap` words open the next. What is left at the end is a chunk only if it has a word of its own. In closed form,
with P_i the words up to block i: chunk c is the word range [s_c, e_c), e_c the first P_i with P_i - s_c >= target,
s_(c+1) = e_c - overlap. A chunk's blocks are those whose range meets it.

As the overlap is less than the target, the cut after a cut at P_i depends on P_i alone: it is the first P_j with
P_j >= P_i + target - overlap. So cuts are an orbit of a function on the block ends. Documents fall into slices of
`SLICE` words. Only the ends within `target` words of a slice's beginning can be its first cut; from each the
orbit through the slice is followed, which gives a small map from first cut to last cut. The maps of a document are
composed in order, and each slice then lists its cuts from the one it is entered by. No task holds more than a
slice's block ends, or a document's maps (at most `target` rows a slice); texts, pages and regions join
afterwards by interval.

Defined results: a block without words adds none and is in no chunk; a document without words has no chunk; blocks
without a document key or number are left out; the number identifies a block within its document; white space is what
Java calls Unicode white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.operators.running import partitions, prefix_sums_by_number
from vellumq.session import saved

TARGET, OVERLAP = 120, 30
SLICE = 1 << 17
WORD = r"(?U)[^\s\x1c-\x1f]+"


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def counted(words: str | None) -> Column:
    """Words of a block: a column that has their number, else counted in `text`."""
    n = F.size(split_words(F.col("text"))) if words is None else F.col(words)
    return F.coalesce(F.when(n > 0, n).otherwise(0), F.lit(0)).cast("long")


def block_ranges(blocks: DataFrame, doc: str = "doc_id", order: str = "block_ord", words: str | None = None) -> DataFrame:
    """Adds b_n, b_from, b_to to the blocks that have words: the words of the block within its document."""
    x = blocks.withColumn("b_n", counted(words)).filter(F.col(doc).isNotNull() & (F.col("b_n") > 0))
    return prefix_sums_by_number(x, [doc], order, "b_n", "b_to").withColumn("b_from", F.col("b_to") - F.col("b_n"))


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut so that no group of `keys` is in two of them."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = np.ones(len(b), dtype=bool)
        for k in keys:
            last &= (b[k] == b[k].iloc[-1]).to_numpy()
        at = int(np.argmax(last))
        if at:
            yield b.iloc[:at].reset_index(drop=True)
        held = b.iloc[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _steps(group: np.ndarray, p: np.ndarray, ask: np.ndarray, ask_group: np.ndarray) -> np.ndarray:
    """Row of the first p >= ask in its group, len(p) where there is none; rows are sorted by (group, p)."""
    low = int(min(p.min(), ask.min()))
    wide = int(max(p.max(), ask.max())) - low + 1
    at = np.searchsorted(group * wide + (p - low), ask_group * wide + (ask - low), "left")
    inside = at < len(p)
    inside[inside] = group[at[inside]] == ask_group[inside]
    return np.where(inside, at, len(p))


def _maps(step: int, overlap: int):
    """mapInPandas over sorted (d, slice, p, n): for every end that can be a slice's first cut the last cut and the number of cuts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, ["d", "slice"]):
            p, n, s = (b[c].to_numpy(dtype=np.int64) for c in ("p", "n", "slice"))
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (b["d"].to_numpy()[1:] != b["d"].to_numpy()[:-1])])
            group = np.cumsum(new) - 1
            following = np.append(_steps(group, p, p + step, group), len(p))
            first = np.flatnonzero(p - n < s * SLICE + step + overlap)
            at, count = first.copy(), np.ones(len(first), dtype=np.int64)
            while True:
                ahead = following[at]
                go = ahead < len(p)
                if not go.any():
                    break
                at, count = np.where(go, ahead, at), count + go
            yield pd.DataFrame({"d": b["d"].to_numpy()[first], "slice": s[first], "p": p[first], "last": p[at], "cuts": count})

    return run


def _compose(step: int, start: int):
    """applyInPandas over a document's maps: the cut before each slice and the number of cuts up to it."""

    def run(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["slice", "p"])
        s, p, last, cuts = (m[c].to_numpy(dtype=np.int64) for c in ("slice", "p", "last", "cuts"))
        begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        ends = np.append(begins[1:], len(s))
        e, before, rows = start, 0, []
        for a, z in zip(begins.tolist(), ends.tolist()):
            rows.append((s[a], e, before))
            at = a + int(np.searchsorted(p[a:z], e + step, "left"))
            if at < z:
                e, before = int(last[at]), before + int(cuts[at])
        return pd.DataFrame([(m["d"].iloc[0], *r) for r in rows], columns=["d", "slice", "e", "cuts"])

    return run


def _listed(step: int, overlap: int):
    """mapInPandas over sorted (d, slice, kind, p, e, cuts, ends): the row of kind 0 opens its slice with the cut before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["d", "chunk_no", "word_from", "word_to"]
        for b in _whole_groups(batches, ["d", "slice"]):
            kind = b["kind"].to_numpy()
            head, rows = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(rows):
                continue
            group = (np.cumsum(kind == 0) - 1)[rows]
            p = b["p"].to_numpy(dtype=np.int64)[rows]
            e, no, ends = (b[c].to_numpy(dtype=np.int64)[head] for c in ("e", "cuts", "ends"))
            d = b["d"].to_numpy()[head]
            following = _steps(group, p, p + step, group)
            live = np.arange(len(head))
            at = _steps(group, p, e + step, live)
            out = []
            while True:
                go = at < len(p)
                live, at = live[go], at[go]
                if not len(live):
                    break
                out.append((live, no[live], e[live] - overlap, p[at]))
                e[live], no[live] = p[at], no[live] + 1
                at = following[at]
            # what is left at the end of a document is a chunk if it has a word of its own
            top = np.full(len(head), -1, dtype=np.int64)
            np.maximum.at(top, group, p)
            tail = np.flatnonzero((ends == 1) & (top > np.where(no > 0, e, 0)))
            out.append((tail, no[tail], e[tail] - overlap, top[tail]))
            g, c, f, t = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"d": d[g], "chunk_no": c.astype(np.int32), "word_from": f, "word_to": t}, columns=cols)

    return run


def ranges_of(placed: DataFrame, doc: str = "doc_id", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc, chunk_no, word_from, word_to) of every chunk, from blocks with b_n and b_to (see `block_ranges`)."""
    if not 0 <= overlap < target:
        raise ValueError("the overlap must be at least 0 and less than the target")
    step, kind, n = target - overlap, placed.schema[doc].dataType.simpleString(), partitions(placed)
    x = placed.select(F.col(doc).alias("d"), F.col("b_to").alias("p"), F.col("b_n").alias("n"), F.floor((F.col("b_to") - 1) / SLICE).alias("slice"))
    slices = x.groupBy("d", "slice").agg(F.count("*").alias("rows"))
    every = Window.partitionBy("d")
    slices = slices.withColumn("ends", (F.col("slice") == F.max("slice").over(every)).cast("int")).withColumn("many", F.count("*").over(every) > 1)
    slices = saved(slices.select("d", "slice", "ends", "many"))
    # before the first cut, the state is as if one had been made at `overlap`
    heads = slices.filter("not many").select("d", "slice", F.lit(overlap).cast("long").alias("e"), F.lit(0).cast("long").alias("cuts"), "ends")
    many = slices.filter("many")
    if not many.isEmpty():
        long = x.join(many.select("d", "slice"), ["d", "slice"], "left_semi").select("d", "slice", "p", "n")
        maps = long.repartition(n, "d", "slice").sortWithinPartitions("d", "slice", "p").mapInPandas(_maps(step, overlap), f"d {kind}, slice long, p long, last long, cuts long")
        entered = maps.groupBy("d").applyInPandas(_compose(step, overlap), f"d {kind}, slice long, e long, cuts long")
        heads = heads.unionByName(many.select("d", "slice", "ends").join(entered, ["d", "slice"]))
    none = F.lit(None)
    both = x.select("d", "slice", F.lit(1).alias("kind"), "p", none.cast("long").alias("e"), none.cast("long").alias("cuts"), none.cast("int").alias("ends")).union(
        heads.select("d", "slice", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("p"), "e", "cuts", "ends")
    )
    both = both.withColumn("e", F.coalesce("e", F.lit(0))).withColumn("cuts", F.coalesce("cuts", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(0)))
    got = both.repartition(n, "d", "slice").sortWithinPartitions("d", "slice", "kind", "p").mapInPandas(_listed(step, overlap), f"d {kind}, chunk_no int, word_from long, word_to long")
    return got.withColumnRenamed("d", doc)


def ranges(blocks: DataFrame, doc: str = "doc_id", order: str = "block_ord", target: int = TARGET, overlap: int = OVERLAP, words: str | None = None) -> DataFrame:
    """(doc, chunk_no, word_from, word_to) of every chunk; words are numbered from 0 within the document."""
    slim = blocks.select(doc, order, counted(words).alias("n"))
    return ranges_of(saved(block_ranges(slim, doc, order, "n")), doc, target, overlap)


def members(blocks: DataFrame, doc: str = "doc_id", order: str = "block_ord", target: int = TARGET, overlap: int = OVERLAP, words: str | None = None) -> DataFrame:
    """Chunk ranges joined with their blocks: doc, chunk_no, word_from, word_to, and the block's columns.

    The interval join is an equi-join: both sides are keyed by (doc, stretch of 128 words), so a document that holds
    a large share of all blocks spreads over many keys. `blocks` should have no more columns than are wanted.
    """
    step = 128
    placed = saved(block_ranges(blocks, doc, order, words))
    c = ranges_of(placed, doc, target, overlap).withColumn("cell", F.explode(F.sequence(F.floor(F.col("word_from") / step), F.floor((F.col("word_to") - 1) / step))))
    b = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("b_from") / step), F.floor((F.col("b_to") - 1) / step))))
    j = c.join(b, [doc, "cell"]).filter("b_from < word_to and b_to > word_from")
    # a pair that meets in several cells is kept in the first of them only
    return j.filter(F.col("cell") == F.greatest(F.floor(F.col("word_from") / step), F.floor(F.col("b_from") / step))).drop("cell")


def chunks_of(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with text, page_start, page_end, regions, chunk_id, source_file, doc_id, chunk_no."""
    slim = blocks.select("doc_id", "block_ord", counted(None).alias("words"))
    m = members(slim, "doc_id", "block_ord", target, overlap, "words").select("doc_id", "block_ord", "chunk_no", "word_from", "word_to", "b_from", "b_n")
    m = m.join(blocks.select("doc_id", "block_ord", "text", "page", "bbox", "source_file").filter("text is not null"), ["doc_id", "block_ord"])
    lo, hi = F.greatest(F.col("word_from") - F.col("b_from"), F.lit(0)), F.least(F.col("word_to") - F.col("b_from"), F.col("b_n"))
    part = F.array_join(F.slice(split_words(F.col("text")), (lo + 1).cast("int"), (hi - lo).cast("int")), " ")
    g = m.groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("block_ord", part.alias("part"), F.struct("page", "bbox").alias("region")))).alias("l"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min_by("source_file", "block_ord").alias("source_file"),
    )
    return g.select(
        F.array_join(F.transform("l", lambda x: x["part"]), " ").alias("text"),
        "page_start",
        "page_end",
        F.transform("l", lambda x: x["region"]).alias("regions"),
        F.concat_ws("_", "doc_id", F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.coalesce("source_file", "doc_id").alias("source_file"),
        "doc_id",
        "chunk_no",
    )
