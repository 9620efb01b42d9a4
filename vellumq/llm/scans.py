"""Problem 6: repairing text read from scanned pages.

Three classifiers and one retrieval work together. Line-pair classifiers (gradient-boosted trees) tell running titles,
by comparing a line at the head of a page with the heads of the source's other pages, and words broken at a line end,
by comparing the joined word, the hyphenated compound and both halves with the vocabulary. Words that no born-digital
block has are looked up through an inverted join on character q-grams; a gradient-boosted ranker, trained on clean
words that the table of confusions has spoiled, chooses the correction or none; where none is retrieved, a classifier
tells misread words and figures from codes. All training sets are bounded
(`SAMPLE` rows each, chosen by hash) and labelled by the data themselves; vocabulary, candidates and lines are complete.

Defined results: only scanned lines with text are judged (a block without a method was read as its page was); garbage
lines have no defect; page numbers and running titles are listed only as such; a line ends inside a word only if a
line follows; null pages count as one page of their source. Repeated block_ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.llm.boosting import Boosted
from vellumq.llm.common import prefix_sums
from vellumq.llm.furniture import with_scanned
from vellumq.llm.quality import block_scores, weak_label
from vellumq.session import cut
from vellumq.sources.tables import blocks

SAMPLE = 1500
HYPHENS = r"[-¬‐­]"
# What recognition makes of a character or pair (as it is, as it is read).
CONFUSIONS = [
    ("l", "1"), ("o", "0"), ("i", "!"), ("s", "5"), ("t", "f"), ("h", "b"), ("e", "c"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("n", "ri"), ("m", "rn"),
    ("rn", "m"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("i", "1"), ("i", "l"), ("l", "i"), ("l", "!"), ("l", "|"), ("i", "|"), ("b", "8"), ("g", "9"), ("b", "6"), ("z", "2"), ("a", "4"), ("ri", "n"), ("ii", "u"), ("vv", "w"),
]
DIGITS = ("OoQlI|!SBZG", "00011115826")
FIGURES = [(t, s) for s, t in zip(*DIGITS)]


def token_core(c: Column) -> Column:
    """A token without the punctuation around it; marks that recognition puts for letters stay."""
    return F.regexp_replace(c, r"""^[("'«„“\[‘*]+|[.,;:)\]"'»”’%?!*]+$|['’]s$""", "")


def as_number(c: Column) -> Column:
    return F.translate(c, *DIGITS)


_READ_AS: dict[str, list[str]] = {}
for _t, _s in CONFUSIONS:
    _READ_AS.setdefault(_t, []).append(_s)


def confusion_cost(seen: str, true: str) -> tuple[int, int]:
    """(confusions, other edits) of the cheapest way from the true word to the one seen; an edit costs ten confusions."""
    lo = 0
    while lo < min(len(seen), len(true)) and seen[lo] == true[lo]:
        lo += 1
    hi = 0
    while hi < min(len(seen), len(true)) - lo and seen[-1 - hi] == true[-1 - hi]:
        hi += 1
    seen, true = seen[lo : len(seen) - hi], true[lo : len(true) - hi]
    n, m, far = len(true), len(seen), 10**6
    cost = [[far] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c >= far:
                continue
            if i < n and j < m:
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c + (0 if true[i] == seen[j] else 10))
            if i < n:
                cost[i + 1][j] = min(cost[i + 1][j], c + 10)
            if j < m:
                cost[i][j + 1] = min(cost[i][j + 1], c + 10)
            for k in (1, 2):
                for s in _READ_AS.get(true[i : i + k], ()) if i + k <= n else ():
                    if seen.startswith(s, j):
                        cost[i + k][j + len(s)] = min(cost[i + k][j + len(s)], c + 1)
    return cost[n][m] % 10, cost[n][m] // 10


def spoil(word: str, seed: int, figures: bool = False) -> str | None:
    """The word, or figure, with one or two characters misread; None where it has nothing to confuse."""
    table = FIGURES if figures else CONFUSIONS[:15]
    rng = np.random.default_rng(abs(seed) % (1 << 32))
    out = word
    for _ in range(1 + (rng.random() < 0.25)):
        spots = [(i, t, s) for t, s in table for i in range(len(out)) if out.startswith(t, i)]
        if not spots:
            break
        i, t, s = spots[int(rng.integers(len(spots)))]
        out = out[:i] + s + out[i + len(t) :]
    return out if out != word else None


def some_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, chosen by hash."""
    n = df.count()
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < min(1.0, most / max(n, 1)) * (1 << 30))


def apply_trees(df: DataFrame, model: Boosted, cols: list[str], name: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(x: pd.DataFrame) -> pd.Series:
        return pd.Series(sent.value.predict(x[cols].to_numpy(dtype=float)))

    return df.withColumn(name, predict(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))


def fit_trees(rows: DataFrame, cols: list[str], trees: int = 50) -> Boosted | None:
    p = rows.select(*[F.col(c).cast("double").alias(c) for c in cols], "y").toPandas().sort_values([*cols, "y"])
    if p["y"].nunique() < 2:
        return None
    x, y = p[cols].to_numpy(), p["y"].to_numpy()
    held = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    m = Boosted(trees=trees).fit(x[~held], y[~held])
    return m.calibrate(x[held], y[held]) if held.any() else m


# -- lines ------------------------------------------------------------------------------------------------------


def scanned_lines(b: DataFrame) -> DataFrame:
    """Scanned lines with their place on the page, garbage and page numbers marked."""
    s, _ = block_scores(with_scanned(b).filter("scanned and text is not null"))
    x = s.withColumn("line", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).filter("line != ''")
    x = x.withColumn("page", F.coalesce("page", F.lit(-1))).withColumn("src", F.coalesce("source_file", "doc_id", F.lit("")))
    # a wrapped remainder of prose may be figures alone: short lines are garbage only by their characters
    odd = (F.col("symbol_ratio") >= 0.3) | (F.col("slash_share") >= 0.5) | (F.col("max_word") >= 100) | ((F.col("no_vowel_share") >= 0.3) & (F.col("common_share") == 0) & (F.col("n_words") >= 4)) | ((F.col("mixed_share") >= 0.6) & (F.col("n_words") >= 3) & (F.col("mean_word") >= 8))
    x = x.withColumn("garbage", (F.col("junk") > 0.5) & ~F.coalesce(weak_label() == 0, F.lit(False)) & ((F.col("n_words") >= 12) | odd))
    down, up = Window.partitionBy("src", "page").orderBy("block_ord"), Window.partitionBy("src", "page").orderBy(F.desc("block_ord"))
    x = x.withColumn("top", F.row_number().over(down)).withColumn("bottom", F.row_number().over(up))
    d = r"[0-9OoQlI|!SBZG]{1,4}"
    shape = rf"^[^\p{{L}}\p{{N}}!|]*(?:(?i:p\S{{3}}|seite|página|pagina|sida|pág\.?)\s+)?({d})(?:\s*(?:of|0f|oi|von|de|sur|di|van|av|/)\s*{d})?[^\p{{L}}\p{{N}}]*$"
    number = as_number(F.regexp_extract("line", shape, 1)).try_cast("int")
    x = x.withColumn("pageno", F.coalesce(F.col("line").rlike(shape) & (number == F.col("page")) & ((F.col("top") <= 2) | (F.col("bottom") <= 4)), F.lit(False)))
    keep = ["block_id", "src", "page", "block_ord", "line", "garbage", "pageno", "top", "bottom", "n_words", "common_share", "upper_ratio"]
    return cut(x.select(*keep))


ALIKE = 0.7  # similarity of two copies of a title where there is no model
HEAD = ["sim", "pages", "odds", "lower", "ends", "hyphen", "n_words", "common_share"]


def with_headers(x: DataFrame) -> DataFrame:
    """Adds `header`: the running title at the head of a page.

    Where the lines give no examples of titles (no source repeats one on three pages) or none of other lines, there is
    no model: a head line is a title if a head line one or two pages away is like it. A source of one page has none then.
    """
    w = Window.partitionBy("src", "page").orderBy("block_ord")
    x = x.withColumn("rank", F.sum((~F.col("pageno")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("norm", F.regexp_replace(F.lower("line"), r"[^\p{L}]+", ""))
    head = x.filter("not pageno and not garbage and rank <= 2 and norm != ''")
    spread = head.select("src", "norm", "page").distinct().groupBy("src", "norm").agg(F.count("*").alias("on"))
    mode = spread.groupBy("src").agg(F.max_by(F.struct("norm", "on"), F.struct("on", "norm")).alias("m")).select("src", F.col("m.norm").alias("mode"), F.col("m.on").alias("mode_on"))
    npages = x.select("src", "page").distinct().groupBy("src").agg(F.count("*").alias("n_pages"))
    body = x.filter("not pageno and not garbage and rank > 2 and norm != ''")
    # words of titles that recur within a source, against words of the body
    sure = head.join(mode.filter("mode_on >= 3"), [head["src"] == mode["src"], head["norm"] == mode["mode"]], "left_semi")
    word = lambda d: d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("word"))
    ca, cb = sure.count(), body.count()
    odds = word(sure).groupBy("word").agg(F.count("*").alias("a")).join(word(body).groupBy("word").agg(F.count("*").alias("b")), "word", "full").select("word", F.log(((F.coalesce("a", F.lit(0)) + 0.5) / (ca + 1)) / ((F.coalesce("b", F.lit(0)) + 0.5) / (cb + 1))).alias("o"))
    seen = head.withColumn("kind", F.lit(0)).unionByName(some_rows(body, "block_id", SAMPLE).withColumn("kind", F.lit(1)))
    each = seen.select("block_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("word")).join(odds, "word")
    mean = each.groupBy("block_id").agg(F.avg("o").alias("odds"))
    f = seen.join(mean, "block_id", "left").join(mode, "src", "left").join(npages, "src")
    other = F.col("mode_on") - (F.col("norm") == F.col("mode")).cast("int")
    f = f.withColumn("pages", F.coalesce(F.col("mode_on") / F.col("n_pages"), F.lit(0.0)))
    f = f.withColumn("sim", F.when(other >= 1, 1 - F.levenshtein("norm", "mode") / F.greatest(F.length("norm"), F.length("mode"))).otherwise(-1.0)).withColumn("pages", F.when(other >= 1, F.col("pages")).otherwise(-1.0))
    f = f.withColumn("odds", F.coalesce("odds", F.lit(0.0))).withColumn("lower", F.col("line").rlike(r"^\p{Ll}").cast("int")).withColumn("ends", F.col("line").rlike(r"[.,;:]$").cast("int")).withColumn("hyphen", F.col("line").rlike(HYPHENS + "$").cast("int"))
    f = cut(f)
    pos = f.filter((F.col("kind") == 0) & (F.col("norm") == F.col("mode")) & (F.col("mode_on") >= 3)).withColumn("y", F.lit(1))
    neg = f.filter("kind = 1").withColumn("y", F.lit(0)).unionByName(f.filter((F.col("kind") == 0) & (F.col("rank") == 2) & (F.col("sim") < 0.5) & F.col("line").rlike(r"^\p{Ll}")).withColumn("y", F.lit(0)))
    t = some_rows(pos, "block_id", SAMPLE).unionByName(some_rows(neg, "block_id", SAMPLE))
    blind = t.withColumn("sim", F.lit(-1.0)).withColumn("pages", F.lit(-1.0))  # as in sources of one page
    model = fit_trees(t.unionByName(blind), HEAD)
    if model is None:
        near = head.select("src", F.explode(F.array(*[F.col("page") + i for i in (-2, -1, 1, 2)])).alias("page"), F.col("norm").alias("other"))
        like = 1 - F.levenshtein("norm", "other") / F.greatest(F.length("norm"), F.length("other"))
        got = head.join(near, ["src", "page"]).groupBy("src", "page", "block_id", "rank").agg(F.max(like).alias("like")).withColumn("p", F.when(F.col("like") >= ALIKE, F.col("like")).otherwise(0.0))
    else:
        got = apply_trees(f.filter("kind = 0"), model, HEAD, "p")
    # of the first two lines at most one is the title: the likelier
    best = got.filter("p > 0.5").groupBy("src", "page").agg(F.max_by("block_id", F.struct("p", -F.col("rank"))).alias("block_id")).select("block_id", F.lit(True).alias("header"))
    return x.join(best, "block_id", "left").withColumn("header", F.coalesce("header", F.lit(False)))


# -- vocabulary -------------------------------------------------------------------------------------------------


def vocabulary(b: DataFrame) -> DataFrame:
    """(word, digital, scanned): how often each token stands in born-digital and in scanned blocks."""
    t = with_scanned(b).filter("text is not null").select("scanned", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("tok"))
    v = t.select("scanned", F.lower(token_core(F.col("tok"))).alias("word")).filter("word != '' and length(word) <= 60")
    return cut(v.groupBy("word").agg(F.sum((~F.col("scanned")).cast("int")).alias("digital"), F.sum(F.col("scanned").cast("int")).alias("scanned")))


PAIR = ["whole", "compound", "left_n", "right_n", "left_len", "right_len"]


def pair_features(p: DataFrame, v: DataFrame) -> DataFrame:
    """Logarithms of how often the joined word, the compound and both halves stand in the text; p has l, r, own."""
    n = v.select("word", (F.col("digital") + F.col("scanned")).alias("n"))
    out = p.withColumn("j", F.concat("l", "r")).withColumn("c", F.concat_ws("-", "l", "r"))
    for key, name in (("j", "whole"), ("c", "compound"), ("l", "left_n"), ("r", "right_n")):
        out = out.join(n.select(F.col("word").alias(key), F.col("n").alias(name)), key, "left")
    less = lambda name: F.log1p(F.greatest(F.lit(0), F.coalesce(F.col(name), F.lit(0)) - F.col("own")))
    out = out.withColumn("whole", less("whole")).withColumn("compound", less("compound"))
    out = out.withColumn("left_n", F.log1p(F.coalesce("left_n", F.lit(0)))).withColumn("right_n", F.log1p(F.coalesce("right_n", F.lit(0))))
    return out.withColumn("left_len", F.length("l")).withColumn("right_len", F.length("r"))


def with_breaks(x: DataFrame, v: DataFrame) -> DataFrame:
    """(block_id, next_id, l, r): lines that end inside a word and the line that it goes on in."""
    text = x.filter("not pageno and not header and not garbage")
    first = F.regexp_extract("line", r"^(\S+)", 1)
    goes_on = F.col("line").rlike(r"^(?:\p{Ll}|[0-9!|]\p{Ll})|^[(]?\p{Lo}")
    after = Window.partitionBy("src", "page").orderBy("block_ord").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(goes_on, F.struct("block_id", first.alias("tok"))), ignorenulls=True)
    y = text.withColumn("here", nxt.over(after))
    top = text.filter(goes_on).groupBy("src", "page").agg(F.min_by(F.struct("block_id", first.alias("tok")), "block_ord").alias("there"))
    ends = y.filter(F.col("line").rlike(r"\p{L}" + HYPHENS + "$"))
    ends = ends.join(top.select("src", (F.col("page") - 1).alias("page"), "there"), ["src", "page"], "left").withColumn("n", F.coalesce("here", "there")).filter("n is not null")
    left = F.regexp_replace(F.regexp_extract("line", r"(\S+)$", 1), HYPHENS + "$", "")
    c = ends.select("block_id", F.col("n.block_id").alias("next_id"), F.lower(token_core(left)).alias("l"), F.lower(token_core(F.col("n.tok"))).alias("r")).filter("l != '' and r != ''")
    c = cut(c.withColumn("own", F.lit(0)))
    # training: words broken anywhere go together, compounds stay apart; the word's own occurrence doesn't count
    whole = some_rows(v.filter("digital >= 1").filter(F.col("word").rlike(r"^\p{L}{5,25}$")), "word", SAMPLE)
    at = F.pmod(F.xxhash64("word", F.lit(1)), F.length("word") - 3) + 2
    pos = whole.select(F.substring("word", F.lit(1), at.cast("int")).alias("l"), F.substring("word", (at + 1).cast("int"), F.lit(60)).alias("r"), F.lit(1).alias("own"), F.lit(1).alias("y"))
    comp = some_rows(v.filter(F.col("word").rlike(r"^\p{L}{2,}-\p{L}{2,}$")), "word", SAMPLE)
    neg = comp.select(F.regexp_extract("word", r"^(.+)-", 1).alias("l"), F.regexp_extract("word", r"-(.+)$", 1).alias("r"), F.lit(1).alias("own"), F.lit(0).alias("y"))
    model = fit_trees(pair_features(pos.union(neg), v), PAIR)
    f = pair_features(c, v)
    joined = (apply_trees(f, model, PAIR, "p") if model else f.withColumn("p", F.when(F.col("compound") > F.col("whole"), 0.0).otherwise(1.0))).filter("p > 0.5")
    return cut(joined.select("block_id", "next_id", "l", "r").dropDuplicates(["block_id"]))


# -- misread words ----------------------------------------------------------------------------------------------

SHARED, CLOSE = 0.34, 20
RANK = ["confusions", "edits", "length", "log_true", "log_seen", "marked", "shared"]


def grams(c: Column) -> Column:
    p = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))))


def candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seen columns, meant, log_true, features): lexicon words that share q-grams with a word and are close to it.

    Up to two misreadings of two characters leave SHARED of a lexicon word's q-grams, so a word that keeps c of its n is
    met by any n - c + 1 of them: the inverted join is on (q-gram, length) of the rarest, and frequent q-grams, which
    would pair everything with everything, stand in it only where a word has no others. Misreadings change the length
    by two at most. `least` is the frequency (as log_true) below which a lexicon word can't be the correction.
    """
    lx = lexicon.select("meant", "log_true", F.length("meant").alias("len"), grams(F.col("meant")).alias("g"))
    each = lx.select("meant", "log_true", "len", F.size("g").alias("ng"), F.posexplode("g").alias("at", "gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("meant").orderBy("df", "gram")
    need = F.greatest(F.lit(1), F.floor(F.col("ng") * SHARED))
    rare = each.join(df, "gram").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("ng") - need + 1).select("meant", "log_true", "len", "at", "gram")
    s = words.withColumn("g", grams(F.col("seen"))).withColumn("len", F.explode(F.expr("sequence(greatest(1, length(seen) - 2), length(seen) + 2)")))
    s = s.select("seen", "len", "least", F.posexplode("g").alias("pos", "gram"))
    hit = s.join(rare, ["gram", "len"]).filter("seen != meant and abs(pos - at) <= 3 and log_true >= least").groupBy("seen", "meant").agg(F.max("log_true").alias("log_true"))
    hit = hit.filter(F.expr("levenshtein(seen, meant, cast(least(4, 2 + length(meant) / 4) as int))") >= 0)
    hit = hit.withColumn("gm", grams(F.col("meant"))).withColumn("gs", grams(F.col("seen"))).withColumn("ng", F.size("gm")).withColumn("sg", F.size("gs"))
    there = lambda x, i: (F.array_position("gs", x) > 0) & (F.abs(F.array_position("gs", x) - 1 - i) <= 3)
    hit = hit.withColumn("common", F.size(F.filter("gm", there))).drop("gm", "gs").filter(F.col("common") >= F.greatest(F.lit(1), F.floor(F.col("ng") * SHARED)))

    @F.pandas_udf("confusions int, edits int")
    def cost(seen: pd.Series, true: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([confusion_cost(a, b) for a, b in zip(seen, true)], columns=["confusions", "edits"]).astype("int32")

    hit = hit.withColumn("cost", cost("seen", "meant")).select("*", "cost.confusions", "cost.edits").filter("edits <= 1 and confusions <= 4")
    out = hit.join(words, "seen").withColumn("length", F.length("seen")).withColumn("shared", F.col("common") / (F.col("ng") + F.col("sg") - F.col("common")))
    return out.withColumn("marked", F.col("seen").rlike(r"[^\p{L}'’-]").cast("int"))


def corrections(unknown: DataFrame, v: DataFrame) -> DataFrame:
    """(seen, meant): the correction of each word that has one. `unknown` has seen, n, digital.

    Noise also gets into born-digital text, so being there doesn't clear a word: what counts is how much more
    frequent the correction is. Without examples for a model, corrections are what confusions alone explain.
    """
    lex = v.filter((F.col("digital") >= 2) | (F.col("scanned") >= 8)).filter(F.col("word").rlike(r"^\p{L}+(?:['’-]\p{L}+)*$") & (F.length("word") >= 2))
    lex = cut(lex.select(F.col("word").alias("meant"), F.log1p(F.col("digital") + F.col("scanned")).alias("log_true")))

    @F.pandas_udf("string")
    def spoiled(word: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([spoil(w, int(h)) for w, h in zip(word, seed)])

    clean = some_rows(lex.filter("log_true >= 2 and length(meant) >= 3"), "meant", SAMPLE)
    bad = clean.select(spoiled("meant", F.xxhash64("meant")).alias("seen"), F.col("meant").alias("truth")).filter("seen is not null")
    bad = bad.join(v.select(F.col("word").alias("seen")), "seen", "left_anti").dropDuplicates(["seen"]).withColumn("log_seen", F.log1p(F.pmod(F.xxhash64("seen"), F.lit(3)) + 1))
    rare = some_rows(v.filter("digital between 1 and 3").filter(F.col("word").rlike(r"^\p{L}{3,}$")), "word", SAMPLE)
    rare = rare.select(F.col("word").alias("seen"), F.lit("").alias("truth"), F.log1p("digital").alias("log_seen"))
    t = candidates(bad.union(rare).withColumn("least", F.lit(0.0)), lex).withColumn("y", (F.col("meant") == F.col("truth")).cast("int"))
    t = t.filter("truth != '' or edits > 0")  # a rare word that confusions alone explain may be noise: no example
    # of the candidates of one word at most CLOSE train: the true one and the closest others
    first = Window.partitionBy("seen").orderBy(F.desc("y"), "edits", "confusions", F.desc("common"), "meant")
    model = fit_trees(t.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= CLOSE), RANK)
    real = unknown.select("seen", F.log1p("n").alias("log_seen"), F.log1p(F.col("n") * F.when(F.col("digital") > 0, 50).otherwise(8)).alias("least"))
    close = candidates(real, lex)
    got = (apply_trees(close, model, RANK, "p") if model else close.withColumn("p", F.when(F.col("edits") == 0, 1 - F.col("confusions") / 10).otherwise(0.0))).filter("p > 0.5")
    return cut(got.groupBy("seen").agg(F.max_by("meant", F.struct("p", "log_true", "meant")).alias("meant")))


def tokens_of(x: DataFrame, breaks: DataFrame) -> DataFrame:
    """(block_id, pos, tok, other, left_len): words of the lines; a broken word stands whole in the line it begins."""
    t = x.filter("not pageno and not header and not garbage").select("block_id", F.posexplode(F.split("line", " ")).alias("pos", "tok"))
    last = F.max("pos").over(Window.partitionBy("block_id"))
    t = t.withColumn("end", F.col("pos") == last)
    t = t.join(breaks.select("block_id", "next_id", F.lit(True).alias("end"), F.col("r")), ["block_id", "end"], "left")
    t = t.join(breaks.select(F.col("next_id").alias("block_id"), F.lit(0).alias("pos"), F.lit(True).alias("taken")).distinct(), ["block_id", "pos"], "left").filter("taken is null")
    left = F.regexp_replace("tok", HYPHENS + "$", "")
    return t.select("block_id", "pos", F.when(F.col("next_id").isNotNull(), F.concat(left, "r")).otherwise(F.col("tok")).alias("tok"), F.col("next_id").alias("other"), F.length(token_core(left)).alias("left_len"))


MARKS = ["digits", "letters", "signs", "ligatures", "between", "leads", "trails", "figure", "upper", "length", "known", "often", "corrected"]
_MARKED = r"\p{L}.*[0-9!|]|[0-9!|].*\p{L}|[ﬁﬂ]|^[!|]+[.,]|^\p{L}{1,2}[.,]\p{L}+$"


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def mark_features(t: DataFrame) -> DataFrame:
    """Features of a token that mixes letters with digits or signs; t has core, n, digital, corrected."""
    c, low = F.col("core"), F.lower("core")
    return (
        t.withColumn("digits", _share(c, r"[^0-9]")).withColumn("letters", _share(c, r"[^\p{L}]")).withColumn("signs", _share(c, r"[^!|]")).withColumn("ligatures", _share(c, "[^ﬁﬂ]"))
        .withColumn("between", F.size(F.regexp_extract_all(low, F.lit(r"\p{Ll}[0-9!|](?=\p{Ll})"), F.lit(0)))).withColumn("leads", low.rlike(r"^[0-9!|]\p{Ll}{3,}").cast("int")).withColumn("trails", low.rlike(r"\p{Ll}{3,}[0-9!|]$").cast("int"))
        .withColumn("figure", (as_number(c).rlike(r"^[0-9][0-9.,/%-]*$")).cast("int")).withColumn("upper", _share(c, r"[^\p{Lu}]")).withColumn("length", F.length(c))
        .withColumn("known", F.log1p(F.col("digital"))).withColumn("often", F.log1p(F.col("n"))).withColumn("corrected", F.col("corrected").cast("int"))
    )


def mark_model(t: DataFrame, v: DataFrame) -> Boosted | None:
    """Trees that tell misread tokens from codes: born-digital words and figures with a character misread, against the
    tokens that mix letters and digits in born-digital text and others of their shapes, moved on in the alphabet."""

    @F.pandas_udf("string")
    def spoiled(word: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([spoil(w, int(h), figures=w[0].isdigit()) for w, h in zip(word, seed)])

    clean = v.filter("digital >= 2").filter(F.col("word").rlike(r"^\p{L}{3,}$|^[0-9][0-9.,/%-]*$"))
    kinds = clean.withColumn("kind", F.col("word").rlike(r"^[0-9]"))
    some = some_rows(kinds.filter("not kind"), "word", SAMPLE).unionByName(some_rows(kinds.filter("kind"), "word", SAMPLE))
    bad = some.select(spoiled("word", F.xxhash64("word", F.lit(3))).alias("core"), (~F.col("kind")).alias("corrected")).filter(F.col("core").rlike(_MARKED))
    bad = bad.withColumn("digital", F.lit(0).cast("long")).withColumn("n", F.pmod(F.xxhash64("core"), F.lit(3)) + 1).withColumn("y", F.lit(1))
    codes = some_rows(t.filter("digital >= 5 and digital >= 0.2 * n").select("core", "n", "digital").dropDuplicates(["core"]), "core", SAMPLE)
    # codes of the same shapes that no other block has: letters and digits moved on
    upper, figures = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    moved = lambda k: F.translate("core", upper + upper.lower() + figures, upper[k:] + upper[:k] + (upper[k:] + upper[:k]).lower() + figures[k % 10 :] + figures[: k % 10])
    alike = codes.select(F.explode(F.array(*[moved(k) for k in range(1, 26)])).alias("core")).filter(as_number(F.col("core")).rlike(r"[A-Za-z]")).dropDuplicates(["core"])
    alike = alike.select("core", (F.pmod(F.xxhash64("core"), F.lit(3)) + 1).alias("n"), F.lit(0).cast("long").alias("digital"))
    good = codes.unionByName(alike).withColumn("corrected", F.lit(False)).withColumn("y", F.lit(0))
    return fit_trees(mark_features(bad.select("core", "n", "digital", "corrected", "y").unionByName(good.select("core", "n", "digital", "corrected", "y"))), MARKS)


def misread_tokens(x: DataFrame, breaks: DataFrame, v: DataFrame) -> DataFrame:
    """(block_id, pos, tok, other, left_len, seen, meant) of the tokens with a wrongly read character.

    A word is misread if the ranker retrieves a correction. Where it retrieves none, a classifier decides on the tokens
    that mix letters with digits or signs, among them figures, whose correction is the figure that the characters are
    read for. Without examples for the classifier, a mixed token is misread if it is a figure once read so.
    """
    t = tokens_of(x, breaks).withColumn("core", token_core(F.col("tok"))).withColumn("seen", F.lower("core"))
    t = t.filter(F.col("seen").rlike(r"[\p{L}!|]"))
    types = t.groupBy("seen").agg(F.count("*").alias("here")).join(v.withColumnRenamed("word", "seen"), "seen", "left")
    types = cut(types.select("seen", F.greatest("here", F.coalesce(F.col("digital") + F.col("scanned"), F.lit(0))).alias("n"), F.coalesce("digital", F.lit(0)).alias("digital")))
    t = cut(t.join(types, "seen"))
    fix = corrections(types.filter(F.col("seen").rlike(r"\p{L}") & (F.length("seen") >= 2)), v)
    t = t.join(fix, "seen", "left").withColumn("corrected", F.col("meant").isNotNull())
    mixed = cut(mark_features(t.filter(F.col("core").rlike(_MARKED))))
    model = mark_model(mixed, v)
    # a token that is frequent in born-digital text, such as a code, is what it means
    mixed = mixed.filter("not (digital >= 5 and digital >= 0.2 * n)")
    mixed = apply_trees(mixed, model, MARKS, "p") if model else mixed.withColumn("p", F.col("figure").cast("double"))
    as_figure = (F.col("figure") == 1) & (F.col("digits") > 0)
    keep = ["block_id", "pos", "tok", "other", "left_len", "core", "seen"]
    odd = mixed.filter("p > 0.5 or corrected = 1").select(*keep, F.when(as_figure | F.col("meant").isNull() & (F.col("figure") == 1), as_number(F.col("core"))).otherwise(F.col("meant")).alias("meant"))
    plain = t.filter(~F.col("core").rlike(_MARKED) & F.col("corrected")).select(*keep, "meant")
    return plain.unionByName(odd)


def repaired(b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, breaks, misread tokens) of the scanned pages."""
    b = cut(b.select("block_id", "doc_id", "block_ord", "text", "page", "source_file", "extraction_method"))
    v = vocabulary(b)
    x = cut(with_headers(scanned_lines(b)))
    breaks = with_breaks(x, v)
    return x, breaks, cut(misread_tokens(x, breaks, v))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    x, breaks, m = repaired(blocks(spark, folder))
    row = lambda d, name, col="block_id": d.select(F.col(col).alias("block_id"), F.lit(name).alias("defect"))
    # a broken word is misread in the part that differs from its correction
    in_left = F.col("other").isNull() | F.col("meant").isNull() | (F.expr("left(lower(core), left_len)") != F.expr("left(meant, left_len)"))
    in_right = F.col("other").isNotNull() & F.col("meant").isNotNull() & (F.expr("right(lower(core), greatest(1, length(core) - left_len))") != F.expr("right(meant, greatest(1, length(core) - left_len))"))
    found = row(x.filter("pageno"), "pageno").union(row(x.filter("header and not pageno"), "header")).union(row(breaks, "hyphen"))
    return found.union(row(m.filter(in_left), "misread")).union(row(m.filter(in_right), "misread", "other")).distinct()


def p6_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Readable paragraphs of each run of scanned pages: without titles, page numbers and garbage, words whole and right."""
    x, breaks, m = repaired(blocks(spark, folder))
    text = x.filter("not pageno and not header and not garbage").select("block_id", "src", "page", "block_ord", "line")
    fixed = F.when(F.col("core").rlike(r"^\p{Lu}"), F.concat(F.upper(F.expr("left(meant, 1)")), F.expr("substring(meant, 2)"))).otherwise(F.col("meant"))
    t = tokens_of(x, breaks).join(m.select("block_id", "pos", "core", "meant"), ["block_id", "pos"], "left")
    t = t.withColumn("word", F.when(F.col("meant").isNotNull(), F.replace("tok", "core", fixed)).otherwise(F.col("tok")))
    line = t.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda z: z["word"]), " ").alias("clean"))
    width = Window.partitionBy("src", "page")
    y = text.join(line, "block_id", "left").withColumn("clean", F.coalesce("clean", F.lit(""))).withColumn("short", F.length("line") < 0.85 * F.max(F.length("line")).over(width))
    y = y.withColumn("closes", (F.col("short") & F.col("line").rlike(r"[.!?。:)]$")).cast("long"))
    pages = x.select("src", "page").distinct().withColumn("one", F.lit(1).cast("long"))
    run = prefix_sums(pages, ["src"], ["page"], ["one"]).select("src", "page", (F.col("page") - F.col("one_upto")).alias("run"))
    z = prefix_sums(y.join(run, ["src", "page"]), ["src", "run"], ["page", "block_ord", "block_id"], ["closes"]).withColumn("para", F.col("closes_upto") - F.col("closes"))
    out = z.groupBy("src", "run", "para").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", "block_ord", "clean"))), lambda q: q["clean"]), lambda s: s != ""), " ").alias("text"), F.min("page").alias("page_from"), F.max("page").alias("page_to"))
    return out.filter("text != ''").select(F.col("src").alias("source_file"), "page_from", "page_to", F.col("para").alias("paragraph_no"), "text")
