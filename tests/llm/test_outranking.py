import math
import random

from pyspark.sql import functions as F

from vellumq.llm.common import prefix_sums
from vellumq.llm.outranking import net_flow, ranking

KIND = "g string, s string, i long, x double, at int, n int, w long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], KIND)


def plain(rows, strict=0.5):
    best = {}
    for g, s, i, x in rows:
        if None not in (g, s, i):
            x = None if x is None or math.isnan(x) else x
            if best.get((g, s, i)) is None:
                best[g, s, i] = x
    out = {}
    for g in {k[0] for k in best}:
        items = {k[2] for k in best if k[0] == g}
        for i in items:
            out[g, i] = 0.0
        for s in {k[1] for k in best if k[0] == g}:
            said = {i: best[g, s, i] for i in items if (g, s, i) in best}
            speak = [i for i in items if said.get(i, 0) is not None]
            if not speak:
                continue
            val = {i: said.get(i, -math.inf) for i in speak}
            p = {i: (sum(val[j] < val[i] for j in speak) + sum(val[j] == val[i] for j in speak) / 2) / len(speak) for i in speak}
            for i in speak:
                out[g, i] += sum(min(1, max(0, p[i] - p[j]) / strict) - min(1, max(0, p[j] - p[i]) / strict) for j in speak) / len(speak)
    return out


def flows(spark, rows, strict=0.5):
    return {(r["g"], r["i"]): r["flow"] for r in net_flow(frame(spark, rows), "g", "s", "i", "x", "at", strict).collect()}


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(4)}", f"s{rng.randrange(3)}", rng.randrange(12), rng.choice([None, math.nan, 1.0, 2.0, rng.random() * 10**rng.randrange(4)])) for _ in range(160)]
    rows = list({(g, s, i): (g, s, i, x) for g, s, i, x in rows}.values())
    for strict in (0.5, 0.2, 1.0):
        want, got = plain(rows, strict), flows(spark, rows, strict)
        assert want.keys() == got.keys()
        assert all(abs(want[k] - got[k]) < 1e-8 for k in want)


def test_scale_does_not_count(spark):
    rows = [("g", "a", i, float(i)) for i in range(6)] + [("g", "b", i, 1000.0 * (5 - i)) for i in range(6)]
    assert {round(v, 9) for v in flows(spark, rows).values()} == {0.0}


def test_nulls_repeats_ties_empty(spark):
    rows = [("g", "a", 1, None), ("g", "a", 2, math.nan), (None, "a", 3, 1.0), ("g", None, 4, 1.0), ("g", "a", None, 1.0)]
    assert flows(spark, rows) == {("g", 1): 0.0, ("g", 2): 0.0}
    twice = [("g", "a", 1, 2.0), ("g", "a", 1, 2.0), ("g", "a", 1, None), ("g", "a", 2, 1.0)]
    once = [("g", "a", 1, 2.0), ("g", "a", 2, 1.0)]
    assert flows(spark, twice) == flows(spark, once)
    assert flows(spark, []) == {}


def test_ranking_ties_by_item(spark):
    f = spark.createDataFrame([("g", 5, 0.0), ("g", 3, 0.0), ("g", 9, 1.0), ("h", 1, -1.0)], "g string, i long, flow double")
    assert sorted((r["g"], r["rank"], r["i"]) for r in ranking(f, "g", "i").collect()) == [("g", 1, 9), ("g", 2, 3), ("g", 3, 5), ("h", 1, 1)]


def test_prefix_sums_of_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 5000).alias("o"), F.lit(1).alias("v"))
    got = prefix_sums(df, ["g"], ["o"], ["v"])
    assert got.filter("v_upto != o + 1").count() == 0 and got.count() == 5000
