import random

import numpy as np

from vellumq.llm import leaks


def distance(p, t):
    """Least edit distance of p to any stretch of t, by the table."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(0)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        assert leaks.myers(np.array(p), np.array(t, dtype=int)) == distance(p, t)


def test_many_at_once():
    rng = np.random.default_rng(1)
    for m in (1, 13, 64):
        p, t = rng.integers(0, 4, (200, m)), rng.integers(-1, 4, (200, m + 3))
        assert leaks.myers_many(p, t).tolist() == [distance(a.tolist(), b.tolist()) for a, b in zip(p, t)]


def run(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(docs)], "doc long, t string, place int, k string")
    x = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item long, t string, i string")
    return leaks.leaks(d, "doc", "t", x, "item", "t", **k)


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_exact_windows_against_brute_force(spark):
    rng = random.Random(3)
    items = [words(rng, 40) for _ in range(8)]
    docs, want = [], set()
    for i in range(60):
        d = words(rng, rng.randrange(0, 80))
        if i % 2:
            k, n, at = rng.randrange(8), rng.randrange(9, 20), rng.randrange(0, 20)
            d[len(d) // 2 : len(d) // 2] = items[k][at : at + n]
        docs.append(d)
    grams = {}
    for k, x in enumerate(items):
        for j in range(len(x) - 12):
            grams.setdefault(tuple(x[j : j + 13]), set()).add(k)
    for i, d in enumerate(docs):
        for j in range(len(d) - 12):
            want |= {(i, k) for k in grams.get(tuple(d[j : j + 13]), ())}
    texts = [", *".join(d).upper() for d in docs]
    for chars in (10_000, 300, 60):  # one block, several in one pass, several passes
        got = run(spark, texts, [" ".join(x) for x in items], block_chars=chars).filter("distance = 0").select("doc", "item").distinct().collect()
        assert {tuple(r) for r in got} == want and want


def test_one_edit_is_found(spark):
    item = [f"a{i}" for i in range(13)]
    changed = item[:5] + ["zz"] + item[6:]
    dropped = item[:5] + item[6:]
    added = item[:5] + ["zz"] + item[5:]
    two = item[:3] + ["zz"] + item[4:9] + ["yy"] + item[10:]
    got = run(spark, [" ".join(x) for x in (item, changed, dropped, added, two)], [" ".join(item)]).groupBy("doc").min("distance").collect()
    assert {r[0]: r[1] for r in got} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_nulls_short_repeats_empty(spark):
    item = " ".join(f"a{i}" for i in range(13))
    assert run(spark, [None, "", "a1 a2", item], [None, "too short", item]).select("doc", "item").distinct().collect()[0][:2] == (3, 2)
    assert run(spark, [item], []).count() == 0 and run(spark, [], [item]).count() == 0
    assert leaks.words("A_b–c1,Ü 東京2") == ["a", "b", "c1", "ü", "東京2"]
