"""Problem 1: one ranking from several differently scaled scores, by outranking net flow.

Each source ranks the items of a group on percentiles of its own scores, so no scale counts. A pair's preference
is linear in the percentile difference up to `strict`, beyond which it is whole. An item's net flow is the mean
preference over all other items minus the mean preference of all others over it, summed over the sources with equal
weights. All pairs are covered exactly without forming one: with the percentiles in order, both flows follow from
prefix counts and prefix sums at p, p - strict and p + strict.

Defined results: repeated rows of (group, source, item) count once, the latest with a usable score; a null or NaN
score says nothing (that source gives the item flow 0 and no one flow against it); an item a source didn't return
shares that source's lowest percentile with the others it didn't return; a source without usable scores is silent;
ties share their mid-percentile; equal flows are ordered by item. Rows with a null group, source or item are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.llm.common import prefix_sums
from vellumq.session import cut
from vellumq.sources.tables import table


def net_flow(df: DataFrame, group: str, source: str, item: str, score: str, at: str | None, strict: float = 0.5) -> DataFrame:
    """(group, item, flow) over every item any source returned for the group."""
    rows = df.select(F.col(group).alias("g"), F.col(source).alias("s"), F.col(item).alias("i"), F.col(score).cast("double").alias("x"), (F.col(at) if at else F.lit(0)).alias("at"))
    rows = rows.filter("g is not null and s is not null and i is not null").withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    h = cut(rows.groupBy("g", "s", "i").agg(F.max_by("x", F.struct(F.col("x").isNotNull(), F.col("at"), F.col("x"))).alias("x")))
    items = h.select("g", "i").distinct().groupBy("g").agg(F.count("*").alias("n"))
    lists = h.groupBy("g", "s").agg(F.count("x").alias("valid"), F.count("*").alias("rows")).join(items, "g")
    # M: items this source speaks about; u: those it left out
    lists = lists.select("g", "s", (F.col("n") - F.col("rows") + F.col("valid")).alias("m"), (F.col("n") - F.col("rows")).alias("u")).filter("m > 0")
    levels = h.filter("x is not null").groupBy("g", "s", "x").agg(F.count("*").alias("w"))
    ranked = prefix_sums(levels, ["g", "s"], ["x"], ["w"]).join(lists, ["g", "s"])
    p = ((F.col("u") + F.col("w_upto") - F.col("w") / 2) / F.col("m")).alias("p")
    named = ranked.select("g", "s", "x", "w", p)
    bottom = lists.filter("u > 0").select("g", "s", F.lit(None).cast("double").alias("x"), F.col("u").alias("w"), (F.col("u") / 2 / F.col("m")).alias("p"))
    points = cut(named.unionByName(bottom))
    data = points.select("g", "s", F.col("p").alias("v"), F.lit(1).alias("kind"), F.col("p").alias("own"), F.col("w").cast("double").alias("c"), (F.col("w") * F.col("p")).alias("cp"))
    probes = [points.select("g", "s", (F.col("p") + d).alias("v"), F.lit(k).alias("kind"), F.col("p").alias("own"), F.lit(0.0).alias("c"), F.lit(0.0).alias("cp")) for d, k in ((-strict, 2), (strict, 0))]
    swept = prefix_sums(data.union(probes[0]).union(probes[1]), ["g", "s"], ["v", "kind", "own"], ["c", "cp"])

    def of(kind: int, col: str) -> F.Column:
        return F.max(F.when(F.col("kind") == kind, F.col(col)))

    at_p = swept.groupBy("g", "s", F.col("own").alias("p")).agg(of(1, "c_upto").alias("c1"), of(1, "cp_upto").alias("s1"), of(1, "c").alias("w"), of(2, "c_upto").alias("c2"), of(2, "cp_upto").alias("s2"), of(0, "c_upto").alias("c3"), of(0, "cp_upto").alias("s3"))
    plus = F.expr(f"c2 + (p * (c1 - w - c2) - (s1 - w * p - s2)) / {strict}")
    minus = F.expr(f"(m - c3) + ((s3 - s1) - p * (c3 - c1)) / {strict}")
    flows = at_p.join(lists, ["g", "s"]).select("g", "s", "p", ((plus - minus) / F.col("m")).alias("flow"))
    by_level = points.join(flows, ["g", "s", "p"])
    base = by_level.filter("x is null").select("g", "s", F.col("flow").alias("low"))
    listed = h.join(by_level.filter("x is not null").select("g", "s", "x", "flow"), ["g", "s", "x"], "left").join(base, ["g", "s"], "left")
    # every item gets the sum of all sources' low flows; a row replaces that of its own source
    delta = F.when(F.col("x").isNull(), 0.0).otherwise(F.col("flow")) - F.coalesce("low", F.lit(0.0))
    start = base.groupBy("g").agg(F.sum("low").alias("start"))
    total = listed.groupBy("g", "i").agg(F.sum(delta).alias("d")).join(start, "g", "left")
    return total.select(F.col("g").alias(group), F.col("i").alias(item), F.round(F.col("d") + F.coalesce("start", F.lit(0.0)), 9).alias("flow"))


def ranking(flows: DataFrame, group: str, item: str) -> DataFrame:
    """Adds rank from 1 within the group, highest flow first, ties by item."""
    one = flows.select(group, item, "flow", (-F.col("flow")).alias("down"), F.lit(1).alias("one"))
    return prefix_sums(one, [group], ["down", item], ["one"]).select(group, item, "flow", F.col("one_upto").cast("bigint").alias("rank"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    f = net_flow(table(spark, folder, "hits"), "qid", "config", "chunk_ord", "score", "searched_at")
    best = F.max_by("chunk_ord", F.struct("flow", -F.col("chunk_ord")))
    return f.groupBy("qid").agg(best.alias("chunk_ord"))


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole combined ranking of every question."""
    f = net_flow(table(spark, folder, "hits"), "qid", "config", "chunk_ord", "score", "searched_at")
    return ranking(f, "qid", "chunk_ord").select("qid", "chunk_ord", F.round("flow", 6).alias("flow"), "rank")


def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in one order of confidence, from the retrievers' confidences on their own scales."""
    r = table(spark, folder, "retrieval_results").withColumn("everything", F.lit(1))
    f = net_flow(r, "everything", "config", "qid", "confidence", "searched_at")
    return ranking(f, "everything", "qid").select("qid", F.round("flow", 6).alias("flow"), "rank")
