import numpy as np

from vellumq.llm import language as l

EN = ["Tell your doctor if the headache does not go away after taking this medicine.", "The recommended starting dose is one tablet once a day with water.", "Keep this medicine out of the sight and reach of small children.", "Patients with kidney disease should be monitored by their physician every week."]
DE = ["Bitte informieren Sie Ihren Arzt, wenn der Schwindel nach der Einnahme länger anhält.", "Die empfohlene Anfangsdosis beträgt eine Tablette täglich mit etwas Wasser.", "Bewahren Sie das Arzneimittel für Kinder unzugänglich und trocken auf.", "Es liegen keine ausreichenden Daten zur Anwendung während der Schwangerschaft vor."]
JA = ["子供の手の届かないところに、涼しい場所で保管してください。この薬の服用中に頭痛があらわれた場合は、すぐに医師に相談してください。"]
FIGURES = "KK-298\tQZ-7241\t80 mg\tVZ-3224\n320 mg | ZX-2967 | 200 mg\n50.8  20 mg  28.9  VX-9242"


def model():
    texts = (EN + DE + JA * 4) * 5
    return l.train(texts, (["en"] * 4 + ["de"] * 4 + ["ja"] * 4) * 5)


def test_labels(spark):
    df = spark.createDataFrame([("en",), (" EN ",), ("en-US",), ("eng",), ("English",), ("deutsch",), ("日本語",), ("xx",), ("",), (None,), ("n/a",), ("da",)], "t string")
    assert [r[0] for r in df.select(l.label_code(df.t)).collect()] == ["en"] * 5 + ["de", "ja"] + [None] * 5


def test_probabilities_and_held_out():
    m = model()
    p = m.predict(["The children should not take the tablets with their medicine.", "Kinder sollten die Tabletten nicht ohne Wasser einnehmen."])
    assert np.allclose(p.sum(axis=1), 1) and [m.classes[i] for i in p.argmax(axis=1)] == ["en", "de"]
    assert np.mean(m.weights(slice(None)) == 0) > 0.9  # sparse


def test_wrong_labels_are_left_out():
    texts = (EN + DE) * 6
    labels = (["en"] * 4 + ["de"] * 4) * 6
    labels[0], labels[5], labels[13] = "de", "en", "en"
    m = l.train(texts, labels)
    assert [m.classes[i] for i in m.predict(EN + DE).argmax(axis=1)] == ["en"] * 4 + ["de"] * 4


def test_passages():
    m = model()
    got = l.passages_of(m, [" ".join(EN[:2]) + "\n" + " ".join(DE[:2]), FIGURES, "", "Hi.", FIGURES + "\n" + EN[0], JA[0], "x" * 0])
    assert [[r[1] for r in x] for x in got] == [["en", "de"], [], [], [], ["en"], ["ja"], []]
    assert all(0 < r[2] <= 1 and r[3] >= 40 for x in got for r in x)
    long = l.passages_of(m, [" ".join(EN * 3000)])[0]
    assert len(long) == 1 and long[0][3] > 500_000


def test_cases(spark):
    rows = [(1, " ".join(EN), "en"), (2, " ".join(EN), "English"), (3, " ".join(EN), "de"), (4, " ".join(EN), None), (5, " ".join(EN + DE), "en"), (6, FIGURES, None), (7, None, "en"), (8, " ".join(DE), "da"), (9, " ".join(DE), "DE")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, k string, letters int")
    p = l.passages(d, "doc_id", "text", model())
    got = {tuple(r) for r in l.found_languages(d, p).select("doc_id", "lang").collect()}
    assert got == {(3, "en"), (4, "en"), (5, "en"), (5, "de"), (8, "de")}
    assert l.passages(d.limit(0), "doc_id", "text", model()).count() == 0
    assert l.passages(d, "doc_id", "text", l.train([], [])).count() == 0
