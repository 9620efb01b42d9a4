import random

from vellumq.llm import scans as s

KIND = "block_id long, doc_id string, block_ord int, text string, page int, source_file string, extraction_method string, line string, norm string"


def test_confusions():
    assert s.confusion_cost("vvater", "water") == (1, 0) and s.confusion_cost("rnodern", "modern") == (1, 0)
    assert s.confusion_cost("5hou1d", "should") == (2, 0) and s.confusion_cost("water", "water") == (0, 0)
    assert s.confusion_cost("later", "water")[1] == 1 and s.confusion_cost("", "ab") == (0, 2)
    assert s.confusion_cost("lizard", "wizard")[1] == 1 and s.confusion_cost("dinical", "clinical") == (1, 0)


def test_spoil_can_be_explained():
    for i, w in enumerate(("treatment", "children", "should", "water", "clinical")):
        x = s.spoil(w, i)
        assert x is None or x != w and s.confusion_cost(x, w)[1] == 0 and 1 <= s.confusion_cost(x, w)[0] <= 2


SENTENCES = [
    "Patients with severe kidney disease should be treated by a physician every week.", "The recommended starting dose of this medicine is two tablets with water.", "Children should not take the medicine without the advice of their doctor.",
    "Treatment must be stopped when the headache does not go away after three days.", "Physicians who prescribe this medicine should monitor the blood pressure weekly.", "Store the tablets in a well-known place and out of the reach of small children.",
    "No further treatment was needed after the first dose of the active substance.", "The half-life of the substance is about twelve hours in healthy volunteers.",
]


def world(spark):
    """Digital documents with the vocabulary, and scanned ones with known defects."""
    rng = random.Random(1)
    rows, want, n = [], set(), 0
    for d in range(30):
        for i in range(12):
            rows.append((n, f"dig{d}", i, " ".join(rng.choice(SENTENCES) for _ in range(3)), i // 4 + 1, f"dig{d}.pdf", "digital"))
            n += 1
    for d in range(12):
        order = 0
        for page in range(1, 6):
            lines = []
            title = f"Druglabel {'abcdefghijkl'[d] * 3}oxin Prescribing Information"
            lines.append((title, "header"))
            words = " ".join(rng.choice(SENTENCES) for _ in range(6)).split()
            cur = []
            while words:
                w = words.pop(0)
                if len(" ".join(cur + [w])) > 60:
                    lines.append((" ".join(cur), None))
                    cur = []
                cur.append(w)
            lines.append((" ".join(cur), None))
            for k in range(1, len(lines) - 1):
                text, _ = lines[k]
                r = rng.random()
                last = text.split()[-1]
                if r < 0.15 and len(last) > 7 and last.isalpha():
                    head, tail = last[:4], last[4:]
                    lines[k] = (text[: -len(last)] + head + "-", "hyphen")
                    lines[k + 1] = (tail + " " + lines[k + 1][0], lines[k + 1][1])
                elif r < 0.3 and "should" in text:
                    lines[k] = (text.replace("should", rng.choice(["5hould", "sbould", "shoulcl"]), 1), "misread")
            lines.append((f"- {page} -", "pageno"))
            for text, defect in lines:
                rows.append((n, f"scan{d}", order, text, page, f"scan{d}.pdf", "ocr"))
                if defect:
                    want.add((n, defect))
                order += 1
                n += 1
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KIND), want


def test_defects_and_paragraphs(spark):
    b, want = world(spark)
    x, breaks, m = s.repaired(b)
    for name, got in (
        ("header", {r[0] for r in x.filter("header").select("block_id").collect()}),
        ("pageno", {r[0] for r in x.filter("pageno").select("block_id").collect()}),
        ("hyphen", {r[0] for r in breaks.select("block_id").collect()}),
        ("misread", {r[0] for r in m.select("block_id").collect()}),
    ):
        true = {i for i, d in want if d == name}
        assert len(true) >= 8
        hit = len(true & got)
        assert hit >= 0.9 * len(true) and hit >= 0.9 * len(got), (name, len(true), len(got), hit)


def test_nulls_and_empty(spark):
    rows = [(1, None, 0, None, None, None, None, "x", "y"), (2, "a", 0, "", 1, "a", "ocr", "x", "y"), (3, "a", 1, "one line", None, None, "ocr", "x", "y")]
    b = spark.createDataFrame(rows, KIND)
    x, breaks, m = s.repaired(b)
    assert x.count() == 1 and breaks.count() == 0 and m.count() == 0
    x, breaks, m = s.repaired(b.limit(0))
    assert x.count() == breaks.count() == m.count() == 0


def test_few_pages_give_no_model_but_titles_and_corrections(spark):
    rows = []
    for d in "abc":
        for page in (1, 2):
            title = f"Druglabel {d * 3}oxin Prescribing Inform{'ation' if page == 1 else 'atlon'}"
            for i, text in enumerate((title, *SENTENCES[4 * page - 4 : 4 * page])):
                rows.append((len(rows), d, i, text, page, f"{d}.pdf", "ocr", "x", "y"))
    x = s.with_headers(s.scanned_lines(spark.createDataFrame(rows, KIND)))
    assert {r["block_id"] for r in x.filter("header").collect()} == set(range(0, 30, 5))
    v = spark.createDataFrame([("should", 30, 0)], "word string, digital long, scanned long")
    unknown = spark.createDataFrame([("sbould", 1, 0), ("shovel", 1, 0)], "seen string, n long, digital long")
    assert [tuple(r) for r in s.corrections(unknown, v).collect()] == [("sbould", "should")]
