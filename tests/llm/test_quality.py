import random

import numpy as np

from vellumq.llm import quality as q
from vellumq.llm.boosting import Boosted


def stat(text):
    return dict(zip(q.STATS, q.statistics([text])[0]))


def test_statistics():
    s = stat("The cat sat.\n- a 12 list\n\nx | y | 3")
    assert s["n_words"] == 12 and s["n_lines"] == 3 and s["bullet_share"] == 1 / 3 and s["line_end_share"] == 1 / 3
    assert s["cell_share"] == 1 / 3 and s["number_word_share"] == 2 / 12 and s["max_word"] == 4
    assert all(v == 0 for v in stat("").values())
    assert stat("a,b")["symbol_ratio"] == 0 and stat("a#b")["symbol_ratio"] == 1 / 3
    assert stat("THE DOSE of")["common_share"] == 2 / 3 and stat("ab1c de 5")["mixed_share"] == 1 / 3
    assert stat("xbcdfgx bcd the")["no_vowel_share"] == 2 / 3 and stat("a . . . . . 4")["dots"] == 1
    assert stat("かなab")["kana_ratio"] == 0.5


def test_batches_agree_with_single_texts():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcdE 1.|\n\t-薬かß#") for _ in range(rng.randrange(0, 200))) for _ in range(80)] + ["", " \n ", "\U0001f600 x"]
    every = q.statistics(texts)
    for t, row in zip(texts, every):
        assert np.allclose(q.statistics([t])[0], row)
        assert row[0] == len(t.split()) and row[3] == max((len(w) for w in t.split()), default=0)


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    m = Boosted().fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    p = m.predict(x)
    assert abs(p.mean() - y.mean()) < 0.05 and p.min() >= 0 and p.max() <= 1


KIND = "block_id long, doc_id string, block_ord int, text string, junk_x int"


def world(spark):
    """Documents of prose and junk like the texts checked by hand, which no training takes as they are."""
    rows, n = [], 0
    for d in range(12):
        for i, (t, y) in enumerate(q.CHECKED):
            # in every second text in front, so that not all prose ends with a stop
            more = f"Dose {d} was given to the patient by the doctor in the morning."
            rows.append((n, f"d{d}", i, f"{t} {d}" if y else f"{t} {more}" if i % 2 else f"{more} {t}", y))
            n += 1
    return spark.createDataFrame(rows, KIND)


def test_blocks_and_chunks(spark):
    b, model = q.block_scores(world(spark))
    rows = b.select("junk", "junk_x", "n_words").collect()
    right = [(r["junk"] > 0.5) == (r["junk_x"] == 1) for r in rows]
    assert np.mean(right) > 0.97
    prose, junk = q.CHECKED[0][0], q.CHECKED[110][0]
    c = spark.createDataFrame([(1, "zz_0", " ".join([prose] * 3)), (2, "zz_1", " ".join([junk.replace("\t", " ")] * 4)), (3, "zz_2", None), (4, "zz_3", "")], "chunk_ord long, chunk_id string, text string")
    got = {r["chunk_ord"]: r["share"] for r in q.chunk_shares(c, b, model).collect()}
    assert got[1] < 0.5 and got.get(4) in (None, 0.0) and 3 not in got


def test_traced_chunks_use_their_blocks(spark):
    b = world(spark).select("block_id", "doc_id", "block_ord", "text")
    s, model = q.block_scores(b)
    from vellumq.operators.chunking import chunks_of

    cols = b.selectExpr("doc_id", "block_ord", "text", "1 as page", "cast(null as struct<x0:double>) as bbox", "doc_id as source_file")
    c = chunks_of(cols).selectExpr("cast(row_number() over (order by chunk_id) as long) as chunk_ord", "chunk_id", "text")
    assert q.chunk_shares(c, s, model).count() == c.count()


def test_holdout_is_not_trained_on(spark):
    """With the checked blocks' labels turned round among the rows, nothing changes: they are left out."""
    from pyspark.sql import functions as F

    w = world(spark)
    with_held = w.unionByName(spark.createDataFrame([(10_000 + i, "h", i, t, y) for i, (t, y) in enumerate(q.CHECKED)], KIND))
    a, b = q.block_scores(w)[0], q.block_scores(with_held)[0]
    assert a.join(b.select("block_id", F.col("junk").alias("other")), "block_id").filter("abs(junk - other) > 1e-12").count() == 0


def test_null_and_empty(spark):
    b = spark.createDataFrame([(1, "d", 0, None, 0), (2, "d", 1, "  ", 0)], KIND)
    s, _ = q.block_scores(b)
    assert [r["junk"] for r in s.collect()] == [0.0, 0.0]
    assert q.block_scores(b.limit(0))[0].count() == 0


def test_rules_run_once_with_the_statistics(spark):
    every = [t for t, _ in q.CHECKED] + ["", " \n ", "薬 かな " * 9, "a 1b 2c 3d", "| 1 | 2 |\n| 3 | 4 |"]
    s = q.with_stats(spark.createDataFrame([(t,) for t in every], "text string"), label=True)
    rows = s.select("weak", q.weak_label().alias("y")).collect()
    assert [r["weak"] for r in rows] == [-1 if r["y"] is None else r["y"] for r in rows] and {r["weak"] for r in rows} == {-1, 0, 1}


def test_chunks_are_joined_with_their_blocks_once(spark):
    b, model = q.block_scores(world(spark))
    c = spark.createDataFrame([(1, "d0_0", "some words"), (2, "zz", "The dose was given.")], "chunk_ord long, chunk_id string, text string")
    out = q.chunk_shares(c, b, model)
    assert out.count() == 2 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_margins_are_those_of_a_walk_down_each_tree():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 1)
    m = Boosted(20).fit(x[:80], x[:80, 0] > x[:80, 1])

    def walk(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = 2 * at + 1 + (row[tree[at][0]] > tree[at][1])
        return tree[at][2]

    assert np.allclose(m.margin(x), [m.start + sum(walk(t, row) for t in m.nodes) for row in x], rtol=0, atol=1e-12)
    assert m.margin(x[:0]).shape == (0,)
