"""Problem 10: a language with a confidence for every document and every passage of a mixed one.

A sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3), trained with follow-the-regularised-
leader and elastic-net penalties on sentences that carry a readable label, then calibrated by a temperature on held-out
sentences. The labels are partly wrong, so after a first fit the sentences that contradict it are left out and the
model is fitted anew. Texts are cut into sentences; neighbouring sentences of one language form a passage.

Only training is bounded (about `TRAIN_TEXTS` texts a language, chosen by hash); every sentence of every text is classified.

Defined results: null, empty and letterless texts have no passage, language null and confidence 0; rows of figures
and codes are no running text; a language without any labelled row can't be given. Repeated doc_ids count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.session import cut, one_per_key, saved
from vellumq.sources.tables import table

# Codes and names under which the ten languages are known.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}
TRAIN_TEXTS, PASSAGE_LETTERS = 250, 40
BITS, ORDERS, CHUNK = 16, (1, 2, 3), 150_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")


def label_code(c: Column) -> Column:
    """Two-letter code that a label names, however written; null where it names none of the ten."""
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)])
    return known[F.lower(F.regexp_extract(F.trim(c), r"^(\p{L}+)(?:[-_].*)?$", 1))]


def is_running(text: str) -> bool:
    """Running text is mostly letters, not figures and codes."""
    solid = sum(not x.isspace() for x in text)
    return solid > 0 and sum(x.isalpha() for x in text) >= 0.62 * solid


def sentences(text: str) -> list[str]:
    """Sentences of the running lines of a text, in order; a line break within a sentence is a space."""
    lines = [x if not x.strip() or is_running(x) or not any(y.isdigit() for y in x) or x.rstrip().endswith((".", "。")) else "" for x in text.split("\n")]
    out = []
    for s in _SENTENCE.split("\n".join(lines)):
        s = " ".join(s.split())
        if s and is_running(s):
            out.append(s)
    return out


def letters(text: str) -> int:
    return sum(x.isalpha() for x in text)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed n-gram, count) of the texts, each n-gram once a row, ordered by row."""
    clean = [" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(x + "\0" for x in clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.cumsum(codes == 0) - (codes == 0)
    keys = []
    for n in ORDERS:
        k = len(codes) - n + 1
        if k <= 0:
            continue
        h = np.full(k, 1469598103934665603 + n, dtype=np.uint64)
        inside = np.ones(k, dtype=bool)
        for j in range(n):
            part = codes[j : j + k]
            inside &= part != 0
            h = (h ^ part) * np.uint64(1099511628211)
            h ^= h >> np.uint64(32)
        keys.append(((row[:k].astype(np.uint64) << np.uint64(BITS)) | (h & np.uint64((1 << BITS) - 1)))[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), count.astype(np.float64)


class Model:
    """Multinomial logistic regression, FTRL-proximal with L1 and L2."""

    def __init__(self, classes: list[str], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> None:
        self.classes, self.alpha, self.beta, self.l1, self.l2, self.temperature = classes, alpha, beta, l1, l2, 1.0
        self.z = np.zeros((1 << BITS, len(classes)))
        self.n = np.zeros_like(self.z)
        self.idf = np.ones(1 << BITS)
        self.w: np.ndarray | None = None

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF rows of unit length."""
        row, gram, count = features(texts)
        x = (1 + np.log(count)) * self.idf[gram]
        norm = np.sqrt(np.bincount(row, x * x, minlength=len(texts)))
        return row, gram, x / np.maximum(norm[row], 1e-12)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 4, batch: int = 32) -> "Model":
        row, gram, _ = features(texts)
        df = np.bincount(gram, minlength=1 << BITS)
        self.idf = np.log((1 + len(texts)) / (1 + df)) + 1
        row, gram, x = self.rows(texts)
        starts = np.searchsorted(row, np.arange(len(texts) + 1))
        order = np.random.default_rng(7).permutation(len(texts))
        y = np.eye(len(self.classes))[labels]
        for _ in range(epochs):
            for at in range(0, len(order), batch):
                some = np.sort(order[at : at + batch])
                where = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
                if not len(where):
                    continue
                which = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
                used, inv = np.unique(gram[where], return_inverse=True)
                w = self.weights(used)
                v = x[where]
                wx = w[inv] * v[:, None]
                s = np.stack([np.bincount(which, wx[:, c], minlength=len(some)) for c in range(len(self.classes))], 1)
                gx = v[:, None] * (_softmax(s) - y[some])[which]
                g = np.stack([np.bincount(inv, gx[:, c], minlength=len(used)) for c in range(len(self.classes))], 1)
                new = self.n[used] + g * g
                self.z[used] += g - (np.sqrt(new) - np.sqrt(self.n[used])) / self.alpha * w
                self.n[used] = new
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.w is None:
            self.w = self.weights(slice(None)).astype(np.float32)
        row, gram, x = self.rows(texts)
        out = np.zeros((len(texts), len(self.classes)))
        for c in range(len(self.classes)):
            out[:, c] = np.bincount(row, self.w[gram, c] * x, minlength=len(texts))
        return out

    def predict(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.scores(texts) / self.temperature)

    def calibrate(self, texts: list[str], labels: np.ndarray) -> "Model":
        """Temperature with the least log loss on held-out sentences."""
        s = self.scores(texts)
        grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
        loss = [-np.log(_softmax(s / t)[np.arange(len(labels)), labels] + 1e-9).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_rows(df: DataFrame, text: str, label: Column, per_label: int = TRAIN_TEXTS) -> tuple[list[str], list[str]]:
    """Labelled sentences: four each, spread over the text, of about `per_label` texts a language, chosen by hash."""
    some = df.select(F.col(text).alias("t"), label.alias("y")).filter("t is not null and y is not null")
    counts = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_label / n))]) if counts else F.lit(None)
    picked = some.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < share[F.col("y")] * (1 << 30)) if counts else some

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, y in zip(b["t"], b["y"]):
                s = [x for x in sentences(t) if letters(x) >= PASSAGE_LETTERS // 2]
                # a few sentences spread over the text: long texts don't outweigh others
                rows += [(x, y) for x in s[:: max(1, len(s) // 4)][:4]]
            yield pd.DataFrame(rows, columns=["s", "y"])

    got = picked.mapInPandas(cut_up, "s string, y string").withColumn("h", F.xxhash64("s"))
    rows = sorted((r["h"], r["s"], r["y"]) for r in got.collect())  # at most 4 sentences of about per_label texts a language
    return [r[1] for r in rows], [r[2] for r in rows]


def train(texts: list[str], labels: list[str]) -> Model | None:
    """Fit, leave out what contradicts the fit, fit anew, calibrate on a tenth kept aside."""
    classes = sorted(set(labels))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in labels])
    first = Model(classes).fit(texts, y, epochs=2)
    keep = np.flatnonzero(first.predict(texts).argmax(axis=1) == y)
    if not len(keep):
        return first
    held = keep[keep % 10 == 0]
    rest = np.setdiff1d(keep, held)
    if not len(rest) or not len(held):
        rest = held = keep
    model = Model(classes).fit([texts[i] for i in rest], y[rest])
    return model.calibrate([texts[i] for i in held], y[held])


def passages_of(model: Model, texts: list[str], least: int = PASSAGE_LETTERS) -> list[list[tuple[int, str, float, int, str]]]:
    """For each text its passages (number, language, confidence, letters, text)."""
    split = [sentences(t) for t in texts]
    flat = [s for x in split for s in x]
    prob: list[np.ndarray] = []
    at = 0
    while at < len(flat):  # bounded by characters, so that memory doesn't follow the batch
        end, size = at, 0
        while end < len(flat) and (end == at or size + len(flat[end]) <= CHUNK):
            size += len(flat[end])
            end += 1
        prob.append(model.predict(flat[at:end]))
        at = end
    p = np.concatenate(prob) if prob else np.zeros((0, len(model.classes)))
    out, at = [], 0
    for x in split:
        mine = p[at : at + len(x)]
        at += len(x)
        size = np.array([letters(s) for s in x])
        best = mine.argmax(axis=1) if len(x) else np.zeros(0, dtype=int)
        sure = (size >= 25) & (mine.max(axis=1, initial=0) >= 0.5) if len(x) else np.zeros(0, dtype=bool)
        # a short or doubtful sentence goes with the sure one before it, else with the next
        lang, last = best.copy(), None
        for i in range(len(x)):
            if sure[i]:
                last = best[i]
            elif last is not None:
                lang[i] = last
        first = next((i for i in range(len(x)) if sure[i]), None)
        if first is not None:
            lang[:first] = best[first]
        rows, i = [], 0
        while i < len(x):
            j = i
            while j < len(x) and lang[j] == lang[i]:
                j += 1
            n = int(size[i:j].sum())
            if n >= least:
                conf = float((mine[i:j, lang[i]] * size[i:j]).sum() / max(n, 1))
                rows.append((len(rows), model.classes[lang[i]], conf, n, " ".join(x[i:j])))
            i = j
        out.append(rows)
    return out


def passages(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """(key, passage_no, lang, confidence, letters, text) of every text."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, passage_no int, lang string, confidence double, letters int, text string"
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            found = passages_of(m, b["t"].tolist()) if m is not None else []
            yield pd.DataFrame([(k, *r) for k, rows in zip(b["k"], found) for r in rows], columns=["k", "passage_no", "lang", "confidence", "letters", "text"])

    return some.mapInPandas(run, schema).withColumnRenamed("k", key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, as a table: training and scoring read it, the shuffle that finds it is done once."""
    return saved(one_per_key(table(spark, folder, "documents").select("doc_id", "text", "lang", "fetched_at"), ["doc_id"], ["fetched_at"]))


def model_for(d: DataFrame) -> Model | None:
    return train(*training_rows(d, "text", label_code(F.col("lang"))))


def found_languages(d: DataFrame, p: DataFrame) -> DataFrame:
    """(doc_id, lang): languages of the documents whose label is missing, unreadable, another's, or that mix languages."""
    langs = p.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))
    j = langs.join(d.select("doc_id", label_code(F.col("lang")).alias("label")), "doc_id")
    right = (F.size("langs") == 1) & F.coalesce(F.col("label") == F.col("langs")[0], F.lit(False))
    return j.filter(~right).select("doc_id", F.explode("langs").alias("lang"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    return found_languages(d, passages(d, "doc_id", "text", model_for(d)).select("doc_id", "lang"))


def p10_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage with its language and confidence."""
    d = documents(spark, folder)
    return passages(d, "doc_id", "text", model_for(d)).select("doc_id", "passage_no", "lang", F.round("confidence", 4).alias("confidence"), "letters")


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the language of most of its letters and the confidence for it."""
    d = documents(spark, folder)
    p = cut(passages(d, "doc_id", "text", model_for(d)).select("doc_id", "lang", "confidence", "letters"))
    by = p.groupBy("doc_id", "lang").agg(F.sum("letters").alias("n"), (F.sum(F.col("confidence") * F.col("letters"))).alias("c"))
    top = by.groupBy("doc_id").agg(F.max_by(F.struct("lang", (F.col("c") / F.col("n")).alias("confidence")), F.struct("n", "lang")).alias("b"))
    return d.select("doc_id", "lang").withColumnRenamed("lang", "label").join(top, "doc_id", "left").select("doc_id", "label", F.col("b.lang").alias("lang"), F.round(F.coalesce("b.confidence", F.lit(0.0)), 4).alias("confidence"))
