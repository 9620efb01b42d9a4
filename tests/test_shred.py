"""Levels of nested records and the tables rebuilt from them."""

import json
import random

from vellumq.operators import shred
from vellumq.plans import nested

KIND = "id string, regions array<struct<page:int,bbox:struct<x0:double>>>, page_start int, chunk_id string, chunk_ord long, n int, key string"


def typed(spark):
    return spark.createDataFrame(
        [
            ("a", [(1, (2.0,)), None, (None, None), (3, (None,))], 7, "a", 1, 0, "x"),
            ("b", [], 7, "b", 2, 0, "x"),
            ("c", None, 7, "c", 3, 0, "x"),
            ("d", [None], None, "d", 4, 0, "x"),
        ],
        KIND,
    )


def test_levels_tell_missing_empty_and_null_apart(spark):
    from pyspark.sql import functions as F

    df = typed(spark).select("id", F.struct(F.col("regions").alias("a")).alias("r"))
    lv = shred.shred(df, "id", "r", ["a[].page"]).orderBy("key", "seq").collect()
    got = {}
    for r in lv:
        got.setdefault(r["key"], []).append((r["rep"], r["def"], r["value"]))
    assert got == {"a": [(0, 5, "1"), (1, 3, None), (1, 4, None), (1, 5, "3")], "b": [(0, 2, None)], "c": [(0, 1, None)], "d": [(0, 3, None)]}


def test_typed_child(spark):
    got = sorted((r["id"], r["n"], r["page"], r["bbox.x0"]) for r in shred.typed_child(typed(spark).withColumnRenamed("n", "m"), "id", "regions", ["page", "bbox.x0"]).collect())
    assert got == [("a", 0, "1", "2.0"), ("a", 2, None, None), ("a", 3, "3", None)]
    assert shred.leaf_paths(typed(spark).schema["regions"].dataType) == ["[].page", "[].bbox.x0"]


LAYOUTS = [
    ("list", [{"chunk_id": "l0", "page_start": 1, "regions": [{"page": "2", "bbox": [1, 2, 3, 4]}, None, {"bbox": None}]}, {"chunk_id": "l1", "page_start": "5", "regions": {"page": None}}]),
    ("top", {"num_chunks": 1, "chunks": [{"chunk_id": "t0", "page_start": 3, "regions": None}, {"chunk_id": "t1", "regions": [{"page": 9}]}]}),
    ("single", {"chunks": {"chunk_id": "s0", "page_start": 4, "regions": [{}]}}),
    ("pages", {"pages": [{"page": 6, "chunks": [{"chunk_id": "p0", "regions": [{"bbox": {"min": {"x": 1}}}]}]}, {"page": 7, "chunks": []}, {"page": "8", "chunks": [{"chunk_id": "p1", "regions": []}, {"chunk_id": "p2", "regions": [None, {"page": 1}]}]}]}),
    ("deep", {"document": {"sections": [{"chunks": [{"chunk_id": "d0", "page_start": 2, "regions": [{"page": 2}]}]}, {"chunks": None}, {"chunks": [{"chunk_id": "d1", "page_start": 3, "regions": [{"page": "x"}]}]}]}}),
]


def files(spark, docs, bad=()):
    return spark.createDataFrame([(n, json.dumps(d)) for n, d in docs] + list(bad), "file_name string, payload string")


def test_json_layouts(spark):
    got = {(r["chunk_id"], r["n"], r["page"]) for r in nested.json_regions(files(spark, LAYOUTS, [("bad", "{"), ("none", None), ("empty", "[]")]), {"page": ["page"]}).collect()}
    assert got == {("l0", 0, 2), ("l0", 2, 1), ("l1", 0, 5), ("t1", 0, 9), ("s0", 0, 4), ("p0", 0, 6), ("p2", 1, 1), ("d0", 0, 2), ("d1", 0, 3)}


def test_regions_without_a_page_anywhere(spark):
    docs = [
        ("pages", {"pages": [{"page": 6, "chunks": [{"chunk_id": "p0", "regions": [{"bbox": [1, 2, 3, 4]}, None, {}]}, {"chunk_id": "p1", "page_start": 9, "regions": {"bbox": None}}]}]}),
        ("top", {"chunks": [{"chunk_id": "t0", "page_start": 3, "regions": [{}]}, {"chunk_id": "t1", "regions": None}, {"chunk_id": "t2"}, {"chunk_id": "t3", "regions": []}]}),
    ]
    single = [("one", {"chunks": [{"chunk_id": "s0", "page_start": 4, "regions": {"page": 5}}, {"chunk_id": "s1", "page_start": 4, "regions": {}}]})]
    for corners in ({"page": ["page"]}, nested.CORNERS):
        found = lambda d: {(r["chunk_id"], r["n"], r["page"]) for r in nested.json_regions(files(spark, d), corners).collect()}  # noqa: B023, E731
        assert found(docs) == {("p0", 0, 6), ("p0", 2, 6), ("p1", 0, 9), ("t0", 0, 3)}
        assert found(docs[1:]) == {("t0", 0, 3)}
        assert found(single) == {("s0", 0, 5), ("s1", 0, 4)}


def found_in(spark, docs):
    return {(r["chunk_id"], r["n"], r["page"]) for r in nested.json_regions(files(spark, docs), {"page": ["page"]}).collect()}


def test_a_layout_without_region_pages_beside_others(spark):
    """Regions count although no leaf that is asked for stands in them; other files' layouts don't matter."""
    bare = {"pages": [{"page": 3, "chunks": [{"chunk_id": "a_0", "regions": [{"bbox": [1, 2, 3, 4]}, {"bbox": [5, 6, 7, 8]}]}]}]}
    assert found_in(spark, [("a", bare), ("b", [{"chunk_id": "b_0", "regions": [{"page": 1}]}])]) == {("a_0", 0, 3), ("a_0", 1, 3), ("b_0", 0, 1)}


def test_single_record_dynamic_names_and_unrelated_objects(spark):
    docs = [
        ("one", {"chunk_id": "o", "page_start": 2, "regions": {"bbox": None}}),
        ("names", {f"k{i}": {"page": i, "chunks": [{"chunk_id": f"n{i}", "regions": [{}]}]} for i in range(300)}),
        # an object that only shares the list's name
        ("other", {"regions": {"chunks": [{"chunk_id": "x", "page_start": 5, "regions": [None, {"page": 4}]}]}}),
        ("deep", json.loads("[" * 150 + "]" * 150)),
    ]
    assert found_in(spark, docs) == {("o", 0, 2), ("x", 1, 4), *((f"n{i}", 0, i) for i in range(300))}


def test_latest_version_of_a_file_counts(spark):
    df = spark.createDataFrame([("f", json.dumps([{"chunk_id": "old", "regions": [{"page": 1}]}]), 1), ("f", json.dumps([{"chunk_id": "new", "regions": [{"page": 1}]}]), 2), ("g", "[" * 5000, 1)], "file_name string, payload string, at int")
    df = df.selectExpr("file_name", "payload", "timestamp_seconds(at) as loaded_at")
    assert [r["chunk_id"] for r in nested.json_regions(df, {"page": ["page"]}).collect()] == ["new"]


def test_empty_tables(spark):
    none = files(spark, [])
    assert nested.json_regions(none, {"page": ["page"]}).count() == 0
    assert nested.typed_regions(typed(spark).limit(0), ["page"]).count() == 0


def rebuild(entries, tree_paths):
    """Values of every leaf path by its element numbers, from levels alone."""
    out = {}
    state = {}
    for path, _, rep, d, v in entries:
        depth = path.count("[]")
        idx = state.get(path, [-1] * depth)
        if depth:
            if rep == 0:
                idx = [0] * depth
            else:
                idx = idx[: rep - 1] + [idx[rep - 1] + 1] + [0] * (depth - rep)
        state[path] = idx
        if v is not None:
            out[(path, tuple(idx))] = v
    return out


def leaves(x, lists, path="", idx=()):
    if isinstance(x, dict) and not path.endswith("[]") and shred.bare(path) in lists:
        x = [x]
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, lists, f"{path}.{k}" if path else k, idx)
    elif isinstance(x, list):
        for i, y in enumerate(x):
            yield from leaves(y, lists, path + "[]", (*idx, i))
    elif x is not None:
        yield (path, idx), x if isinstance(x, str) else json.dumps(x)


def test_round_trip_of_random_records(spark):
    rng = random.Random(4)

    def make(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            return rng.choice([None, 1, 2.5, "x", True])
        if k < 0.65:
            return {n: make(depth - 1) for n in rng.sample("abcd", rng.randrange(0, 4))}
        return [make(depth - 1) for _ in range(rng.randrange(0, 4))]

    docs = [(f"f{i}", {"r": make(4)}) for i in range(40)]
    paths, lists = shred.layout([d for _, d in docs])
    tree = shred._tree(paths)
    for _, d in docs:
        assert rebuild(shred.stripe(d, tree, lists), paths) == dict(leaves(d, lists))
