from vellumq.operators import pages


def test_words_to_lines(spark):
    row = (["Take", "one", "", "tablet", "Daily"], [1, 1, 1, 1, 2], [1] * 5, [1, 1, 1, 2, 1], [0, 100, 0, 0, 0], [0, 0, 0, 40, 80], [60, 60, 5, 50, 50], [20, 20, 5, 20, 20])
    kinds = "text array<string>, " + ", ".join(f"{c} array<int>" for c in ("block_num", "par_num", "line_num", "left", "top", "width", "height"))
    df = spark.createDataFrame([(3, *row)], "page int, " + kinds)
    got = pages.group_words(pages.word_table(df, ["page"]), ["page"], dpi=144).orderBy("block_ord").collect()
    assert [r["text"] for r in got] == ["Take one", "tablet", "Daily"]
    assert tuple(got[0]["bbox"]) == (0.0, 0.0, 80.0, 10.0)
    assert got[0]["page"] == 3 and got[0]["extraction_method"] == "ocr"


def test_route(spark):
    df = spark.createDataFrame([("x" * 20,), (" \n" + "x" * 19 + " ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(pages.route(df.t)).collect()] == ["digital", "ocr", "ocr", "ocr"]


def test_lines_to_blocks(spark):
    df = spark.createDataFrame([(1, "a\n\n  b \n"), (2, None), (None, "x")], "id int, t string")
    got = pages.line_blocks(df, "id", "t").collect()
    assert [(r["block_ord"], r["text"]) for r in got] == [(0, "a"), (2, "b")]
