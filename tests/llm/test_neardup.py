import random

import numpy as np

from vellumq.llm import neardup as nd


def test_code_is_perfect_and_pairs_meet_often_enough():
    home, reach = nd.anchors_of_words()
    words = np.arange(128)
    code = [int(w) for w in words[nd.syndrome(words) == 0]]
    assert len(code) == 16 and len({c >> nd.CHECKS for c in code}) == 16
    assert all(sum((c ^ w).bit_count() <= 1 for c in code) == 1 for w in words.tolist())
    assert all(h in r for h, r in zip(home, reach)) and np.mean([len(r) for r in reach]) == 3.625
    # similarity 0.6: the symbols agree in 0.6 of the tables, a bit differs with probability 0.2
    rng = np.random.default_rng(1)
    x = rng.integers(0, 128, 40_000)
    y = x ^ ((rng.random((40_000, 7)) < 0.2) @ (1 << np.arange(7)))
    one = np.mean([home[a] in reach[b] or home[b] in reach[a] for a, b in zip(x.tolist(), y.tolist())])
    assert abs(one - nd.MEET) < 0.01
    assert [nd.symbols_for(n) for n in (0, 10**5, 10**6, 10**7, 10**9)] == [1, 1, 2, 3, 4]
    assert all((1 - one * 0.6**k) ** nd.tables_for(k, 0.6) < 1e-4 for k in (1, 2, 3))


def test_texts_that_share_nothing_never_meet(spark):
    """Comparisons don't come from chance: anchors grow with the shingles."""
    rng = random.Random(9)
    texts = [" ".join(f"{i}x{rng.randrange(10**6)}" for _ in range(40)) for i in range(1500)]
    reps = nd.fingerprinted(frame(spark, texts), "id", "t")
    assert nd.met(reps, 0.0).count() == 0


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "id long, t string, rep string, size int")


def exact(texts, j=0.6):
    sets = []
    for t in texts:
        w = nd._WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    return {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= j}


def family(rng, n, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = [" ".join(base)]
    for e in edits:
        x = base[:]
        for _ in range(e):
            k = rng.randrange(3)
            i = rng.randrange(len(x))
            if k == 0:
                x[i] = f"w{rng.randrange(3000)}"
            elif k == 1:
                x.insert(i, f"w{rng.randrange(3000)}")
            else:
                del x[i]
        out.append(" ".join(x))
    return out


def test_all_links_and_no_others(spark):
    rng = random.Random(5)
    texts = [t for _ in range(25) for t in family(rng, rng.randrange(30, 150), [0, 1, 2, 4, 6, 8])] + [None, "", "a b", "a b c", "A, b; c!", "a b c"]
    for symbols in (None, 2):
        members, links = nd.class_links(frame(spark, texts), "id", "t", symbols=symbols)
        rep = {r["id"]: r["rep"] for r in members.collect()}
        got = {(r["a"], r["b"]) for r in links.collect()}
        want = {tuple(sorted((rep[a], rep[b]))) for a, b in exact(texts) if rep[a] != rep[b]}
        assert got == want and len(want) > 100
    assert rep[len(texts) - 1] == rep[len(texts) - 2] == len(texts) - 3 and len(texts) - 4 not in rep


def test_copies_cost_one_fingerprint(spark):
    members, links = nd.class_links(frame(spark, ["one two three four five"] * 300), "id", "t")
    assert members.select("rep").distinct().count() == 1 and members.count() == 300 and links.count() == 0
    members, links = nd.class_links(frame(spark, []), "id", "t")
    assert members.count() == 0 and links.count() == 0


def test_components(spark):
    rng = random.Random(2)
    nodes = list(range(60))
    edges = [(i, i + 1) for i in range(0, 30)] + [tuple(sorted(rng.sample(range(31, 60), 2))) for _ in range(18)]
    group = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = nd.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["group"] for r in got.collect()} == group
