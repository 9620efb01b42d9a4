import random
from pathlib import Path

import pytest

from vellumq.llm import containers as c


def total(plan):
    out = {}
    for parts, times in plan:
        for n, k in parts.items():
            out[n] = out.get(n, 0) + k * times
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once_and_fits(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 300])
    counts = {}
    for _ in range(rng.choice([1, 30, 2000])):
        n = min(cap, max(1, int(rng.expovariate(4 / cap)) + 1))
        counts[n] = counts.get(n, 0) + 1
    p = c.plan(counts, cap)
    assert total(p) == counts
    assert all(sum(n * k for n, k in parts.items()) <= cap and times > 0 for parts, times in p)
    used, need = sum(t for _, t in p), sum(n * k for n, k in counts.items())
    assert used <= max(1, 1.35 * need / cap + 1)


def test_exact_complements_come_first():
    assert c.plan({7: 2, 3: 2}, 10) == [({7: 1, 3: 1}, 2)]
    assert c.plan({6: 1, 3: 1, 1: 1}, 10) == [({6: 1, 3: 1, 1: 1}, 1)]
    assert c.plan({5: 1, 2: 1, 1: 3}, 9) == [({5: 1, 2: 1, 1: 2}, 1), ({1: 1}, 1)]
    assert c.plan({5: 4}, 10) == [({5: 2}, 2)] and c.plan({}, 10) == [] and c.plan({10: 3}, 10) == [({10: 1}, 3)]


def test_assignment(spark):
    if not Path(c.TOKENIZER).exists():
        pytest.skip("no tokenizer")
    rng = random.Random(1)
    texts = [" ".join(["word"] * rng.randrange(1, 30)) for _ in range(150)] + ["hot text of one length"] * 100 + ["word " * 100, "", None]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] , "id long, t string, len int, rank int")
    got = c.assign(df, "id", "t", capacity=32).collect()
    size = {}
    for r in got:
        size[r["container"]] = size.get(r["container"], 0) + r["token_to"] - r["token_from"]
    assert max(size.values()) <= 32 and set(size) == set(range(len(size)))
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert len(by) == len(texts) - 1  # null is no item
    assert all(len(v) == v[0]["n_pieces"] for v in by.values())
    whole = by[250]
    assert len(whole) > 1 and sorted((r["token_from"], r["token_to"]) for r in whole)[0] == (0, 32)
    assert all(len(v) == 1 for k, v in by.items() if k != 250)
    assert len(size) <= 1.1 * sum(size.values()) / 32 + 2
    assert c.assign(df.limit(0), "id", "t", capacity=32).count() == 0
