"""Problem 2: text statistics of every block and chunk that tell natural prose from tables, lists and garbage.

Statistics are computed on Arrow batches. Rules that are sure of themselves label part of the blocks as prose or junk; gradient-
boosted trees learn the labels from a bounded sample (`TRAIN` junk and `PROSE` prose rows, chosen by hash) and score every block; the
probabilities are calibrated on blocks checked by hand (`checked`), which no training sample holds. A chunk is judged by the words its blocks give it.

Defined results: null or blank text has all statistics 0 and junk probability 0; a block_id or chunk_ord repeated counts
once; a chunk whose words can't be traced to blocks is judged by its own text in stretches of 30 words; ties (exactly
half of the words) are no case.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.llm.boosting import Boosted
from vellumq.llm.checked import CHECKED
from vellumq.operators.chunking import members, split_words
from vellumq.session import saved
from vellumq.sources.tables import blocks, chunks

TRAIN, PROSE, TREES, MIN_WORDS = 3000, 9000, 100, 12

# Frequent function words of the languages in question.
COMMON = set(
    "a an and are as at be been but by can do for from has have if in into is it its may more must not of on or other should than that the their these they this "
    "to was were when which who will with within you your "
    "der die das den dem ein eine einer eines und oder nicht mit bei von zu zur zum im ist sind wird werden kann sollte nach durch auf für wenn sie ihren bitte es an am bis muss sehr "
    "le la les un une des du de et ou ne pas avec par pour dans sur est sont si vous votre ce cette au aux chez qui que se être peut doit dès "
    "el los las una y o no con por para en es son si su este esta del al como más se "
    "os as um uma e não com por para em é são se seu este esta do da dos das ao "
    "il lo gli un una e o non con per in è sono se questo questa del della dei nel al "
    "het een en of niet met bij van te ter is zijn wordt kan moet na door op voor als u uw dit deze "
    "och eller inte med vid av till är som kan bör efter genom på för om du din detta denna den det att "
    "и или не с в на по для если вы это при после во как что".split()
)

STATS = [
    "n_words", "n_lines", "mean_word", "max_word", "words_per_line", "symbol_ratio", "digit_ratio", "letter_ratio", "upper_ratio", "space_ratio",
    "line_end_share", "bullet_share", "short_line_share", "cell_share", "common_share", "number_word_share", "vowel_ratio", "no_vowel_share", "dots", "distinct_share", "kana_ratio", "slash_share", "mixed_share", "odd_letters",
]


_BULLET = re.compile(r"\s*(?:[-–—•*·▪o●■‣]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\([ivx]+\))\s+\S")
_CELLS = re.compile(r"\t| {2,}|\|")
_DOTS = re.compile(r"(?:\. ?){4,}")
_LETTER, _UPPER, _DIGIT, _SPACE, _ODD, _VOWEL, _CONSONANT, _KANA, _MARK, _END, _SELDOM = (1 << i for i in range(11))


@functools.cache
def char_table() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower-case letter (0 for what is no letter) of every character of the basic plane; the last entry
    stands for all beyond it."""
    flags, low = np.zeros(65_537, dtype=np.uint16), np.zeros(65_537, dtype=np.uint64)
    for i in range(65_536):
        c = chr(i)
        kind = unicodedata.category(c)
        f = 0
        if kind[0] == "L":
            lower = c.lower()
            f |= _LETTER | (_UPPER if kind == "Lu" else 0) | (_CONSONANT if lower in "bcdfghjklmnpqrstvwxz" else 0) | (_SELDOM if lower in "jkqvwxyz" else 0)
            if lower in "aeiouyäöüåáéíóúâêôàèìòùãõаеёиоуыэюя" or "぀" <= c <= "ヿ":
                f |= _VOWEL
            low[i] = ord(lower[0])
        if kind[0] == "N":
            f |= _DIGIT
        if c.isspace():
            f |= _SPACE
        if "぀" <= c <= "ヿ":
            f |= _KANA
        if not f & (_LETTER | _DIGIT | _SPACE) and c not in ".,;:()'’%-":
            f |= _ODD
        if c in "/\\<>&#=_{}|~^`@":
            f |= _MARK
        if c in ".!?。！？:;":
            f |= _END
        flags[i] = f
    flags[65_536], low[65_536] = _LETTER, 1
    return flags, low


def _word_hash(words: list[str]) -> np.ndarray:
    return np.array([functools.reduce(lambda h, c: (h * 1_000_003 + ord(c)) % (1 << 61), w, 7) for w in words], dtype=np.uint64)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATS a text. Characters and words of the whole batch are handled as arrays; only what needs a
    pattern on a line runs line by line."""
    n = len(texts)
    flags_of, low_of = char_table()
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.minimum(codes, 65_536)
    f, low = flags_of[at], low_of[at]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=n)
    text = np.repeat(np.arange(n), sizes)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n).astype(float)

    def has(flag: int) -> np.ndarray:
        return (f & flag) != 0

    space = has(_SPACE)
    inside = ~space
    begins = inside & np.concatenate([[True], space[:-1]])
    word = np.cumsum(begins) - 1  # valid where inside
    start = np.flatnonzero(begins)
    n_words = per_text(begins)
    w_text = text[start]
    k = len(start)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word[mask & inside], minlength=k)[:k] if k else np.zeros(0, dtype=np.int64)

    w_len = per_word(inside)
    w_letters = per_word(has(_LETTER))
    letter, digit, cons = has(_LETTER), has(_DIGIT), has(_CONSONANT)
    near = np.zeros(len(f), dtype=bool)
    near[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
    run = cons.copy()
    for step in (1, 2, 3, 4):  # five consonants on end
        run[step:] &= cons[:-step]
        run[:step] = False
    # words by the letters in them: a hash built letter by letter, most words done after few rounds
    order = np.flatnonzero(letter & inside)
    owner = word[order]
    first = np.searchsorted(owner, np.arange(k + 1))
    count = np.diff(first)
    h = np.full(k, 7, dtype=np.uint64)
    known = _common_hashes()
    live = np.flatnonzero((count > 0) & (count <= 40))
    rank = 0
    while len(live):
        h[live] = (h[live] * np.uint64(1_000_003) + low[order[first[live] + rank]]) % np.uint64(1 << 61)
        rank += 1
        live = live[count[live] > rank]
    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    common = (count > 0) & (known[spot] == h) & (per_word(digit) == 0)  # the letters of a code are no word
    by = lambda mask: np.bincount(w_text[mask], minlength=n).astype(float)
    _, once = np.unique(h * np.uint64(0x9E3779B97F4A7C15) + w_text.astype(np.uint64), return_index=True)
    distinct = np.bincount(w_text[once], minlength=n).astype(float)
    longest = np.zeros(n)
    if k:
        owners, where = np.unique(w_text, return_index=True)
        longest[owners] = np.maximum.reduceat(w_len, where)
    lines = np.zeros((5, n))  # lines, ended, bulleted, short, celled
    dots = np.zeros(n)
    for i, t in enumerate(texts):
        if "...." in t or ". . ." in t:
            dots[i] = len(_DOTS.findall(t))
        for line in t.split("\n"):
            s = line.strip()
            if s:
                lines[0, i] += 1
                lines[1, i] += s[-1] in ".!?。！？:;"
                lines[2, i] += _BULLET.match(line) is not None
                lines[3, i] += s.count(" ") < 4 and len(s.split()) <= 4
                lines[4, i] += ("\t" in s or "  " in s or "|" in s) and len(_CELLS.findall(s)) >= 2
    solid, letters = per_text(inside), per_text(letter)
    length = np.maximum(sizes - 1, 1)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    blanks = per_text((codes == 32) | (codes == 9))
    cols = {
        "n_words": n_words,
        "n_lines": lines[0],
        "mean_word": over(solid, n_words),
        "max_word": longest,
        "words_per_line": over(n_words, lines[0]),
        "symbol_ratio": over(per_text(has(_ODD)), solid),
        "digit_ratio": over(per_text(digit), solid),
        "letter_ratio": over(letters, solid),
        "upper_ratio": over(per_text(has(_UPPER)), letters),
        "space_ratio": blanks / length,
        "line_end_share": over(lines[1], lines[0]),
        "bullet_share": over(lines[2], lines[0]),
        "short_line_share": over(lines[3], lines[0]),
        "cell_share": over(lines[4], lines[0]),
        "common_share": over(by(common), n_words),
        "number_word_share": over(by(per_word(digit) > 0), n_words),
        "vowel_ratio": over(per_text(has(_VOWEL)), letters),
        "no_vowel_share": over(by(((w_letters >= 2) & (per_word(cons) == w_letters)) | (per_word(run) > 0)), n_words),
        "dots": dots,
        "distinct_share": over(distinct, n_words),
        "kana_ratio": over(per_text(has(_KANA)), solid),
        "slash_share": over(by(per_word(has(_MARK)) > 0), n_words),
        "mixed_share": over(by(per_word(near) > 0), n_words),
        "odd_letters": over(per_text(has(_SELDOM)), letters),  # a tenth of the letters of prose, near a third of random ones
    }
    return np.stack([cols[s] for s in STATS], 1)


@functools.cache
def _common_hashes() -> np.ndarray:
    return np.sort(_word_hash(sorted(COMMON)))


def with_stats(df: DataFrame, text: str = "text", label: bool = False) -> DataFrame:
    """Adds the columns of STATS for a text column, and as `weak` its weak label (-1 where the rules aren't sure).

    Built-in functions would need some twenty patterns a text and a lambda a word, which measured twelve times slower
    than one pass over Arrow batches.
    """

    @F.pandas_udf(", ".join([*(f"{s} double" for s in STATS), *["weak byte"] * label]))
    def compute(t: pd.Series) -> pd.DataFrame:
        parts = [statistics(t.iloc[i : i + 1000].fillna("").tolist()) for i in range(0, len(t), 1000)]
        out = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(STATS))), columns=STATS)
        if label:
            junk, prose = _rules(lambda name: out[name].to_numpy())
            out["weak"] = np.where(junk & ~prose, 1, np.where(prose & ~junk, 0, -1)).astype(np.int8)
        return out

    return df.withColumn("__s", compute(F.col(text))).select(*df.columns, "__s.*")


def weak_label() -> Column:
    """1 junk, 0 prose, null where the rules aren't sure."""
    junk, prose = _rules(F.col)
    return F.when(junk & ~prose, 1).when(prose & ~junk, 0)


def _rules(c: Callable) -> tuple:
    """Whether the rules call a text junk and whether prose; c gives a statistic by its name, as a column or an array."""
    table_ = (c("cell_share") >= 0.6) & (c("number_word_share") >= 0.3) & (c("n_lines") >= 2)
    list_ = (c("n_lines") >= 3) & (c("bullet_share") >= 0.7) & (c("words_per_line") <= 6) & (c("line_end_share") <= 0.3)
    short = (c("n_lines") >= 5) & (c("short_line_share") >= 0.8) & (c("common_share") <= 0.1)
    contents = (c("dots") >= 2) & (c("common_share") <= 0.2) & (c("n_lines") >= 2)
    noise = (c("symbol_ratio") >= 0.3) | (c("max_word") >= 120) | ((c("no_vowel_share") >= 0.35) & (c("common_share") <= 0.03) & (c("kana_ratio") < 0.05)) | ((c("slash_share") >= 0.4) & (c("common_share") <= 0.05)) | ((c("odd_letters") >= 0.24) & (c("common_share") <= 0.15) & (c("n_words") >= 8))
    code = (c("mixed_share") >= 0.5) & (c("common_share") <= 0.05) & (c("n_words") >= 4)
    junk = (c("n_words") >= 4) & (table_ | list_ | short | contents | code) | (c("n_words") >= 3) & noise | (c("max_word") >= 300)
    prose = (c("common_share") >= 0.25) & (c("digit_ratio") <= 0.1) & (c("bullet_share") <= 0.3) & (c("cell_share") <= 0.2) & (c("symbol_ratio") <= 0.05) & (c("words_per_line") >= 6) & (c("n_words") >= 8)
    # lines of paragraphs: few function words beside names and figures, but nothing of a table, a list or garbage
    words = (c("number_word_share") <= 0.35) & (c("symbol_ratio") <= 0.05) & (c("cell_share") == 0) & (c("bullet_share") == 0) & (c("dots") == 0) & (c("slash_share") <= 0.1) & (c("mixed_share") <= 0.1) & (c("odd_letters") <= 0.18)
    prose = prose | words & (c("common_share") >= 0.1) & (c("words_per_line") >= 6) & (c("n_words") >= 8)
    japanese = (c("kana_ratio") >= 0.3) & (c("symbol_ratio") <= 0.15) & (c("bullet_share") <= 0.3)
    return junk, prose | japanese


def train(stats: DataFrame) -> Boosted:
    """Trees on the labels in `weak` of at most about TRAIN junk and PROSE prose rows, none of them `held`, calibrated on the blocks checked by
    hand. Where the weak labels have one class only, half of the checked blocks train and the other half calibrates."""
    labelled = stats.filter("not held and weak >= 0").select(*STATS, F.col("weak").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, TRAIN / max(n.get(1, 1), 1))).otherwise(min(1.0, PROSE / max(n.get(0, 1), 1)))
    p = labelled.filter(F.pmod(F.xxhash64(*STATS), F.lit(1 << 30)) < share * (1 << 30)).toPandas().sort_values([*STATS, "y"])
    x, y = statistics([t for t, _ in CHECKED]), np.array([label for _, label in CHECKED])
    if p["y"].nunique() < 2:
        return Boosted(TREES).fit(x[::2], y[::2]).calibrate(x[1::2], y[1::2])
    return Boosted(TREES).fit(p[STATS].to_numpy(), p["y"].to_numpy()).calibrate(x, y)


def scored(stats: DataFrame, model: Boosted) -> DataFrame:
    """Adds `junk`, the calibrated probability of a table, a list or garbage; 0 without words."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(cols: pd.DataFrame) -> pd.Series:
        x = cols[STATS].to_numpy()
        return pd.Series(np.where(x[:, 0] > 0, sent.value.predict(x), 0.0))

    return stats.withColumn("junk", predict(F.struct(*STATS)))


def block_scores(b: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, Boosted]:
    """(blocks with STATS and `junk`, the model); `keep`: the columns of b to carry on, else all."""
    held = F.coalesce(F.col("text").isin([t for t, _ in CHECKED]), F.lit(False)).alias("held")
    s = saved(with_stats(b, label=True).select(*(b.columns if keep is None else keep), *STATS, "weak", held))
    model = train(s)
    return scored(s.drop("held", "weak"), model), model


def chunk_shares(c: DataFrame, b: DataFrame, model: Boosted) -> DataFrame:
    """(chunk_ord, share): share of a chunk's words that come from junk blocks.

    `b` has n_words and junk probabilities. Blocks are traced by cutting their document anew; a chunk that comes out
    with another number of words is judged by itself.
    """
    m = members(b.select("doc_id", "block_ord", "n_words", "junk"), words="n_words")
    lo, hi = F.greatest(F.col("word_from"), F.col("b_from")), F.least(F.col("word_to"), F.col("b_to"))
    g = m.groupBy("doc_id", "chunk_no").agg(F.sum(hi - lo).alias("n"), F.sum(F.when(F.col("junk") > 0.5, hi - lo).otherwise(0)).alias("bad"))
    traced = g.select(F.concat_ws("_", "doc_id", F.col("chunk_no").cast("string")).alias("chunk_id"), (F.col("bad") / F.col("n")).alias("share"), "n")
    j = c.select("chunk_ord", "chunk_id", "text").join(traced, "chunk_id", "left").withColumn("same", F.coalesce(F.size(split_words(F.col("text"))) == F.col("n"), F.lit(False)))
    j = saved(j.select("chunk_ord", "share", "same", F.when(F.col("same"), None).otherwise(F.col("text")).alias("text")))  # joined and counted once
    rest = j.filter("not same").filter("text is not null").select("chunk_ord", split_words(F.col("text")).alias("w"))
    parts = rest.select("chunk_ord", F.explode(F.expr("transform(sequence(0, greatest(0, size(w) - 1), 30), i -> slice(w, i + 1, 30))")).alias("p")).select("chunk_ord", F.array_join("p", " ").alias("text"))
    own = scored(with_stats(parts), model).groupBy("chunk_ord").agg(F.try_divide(F.sum(F.when(F.col("junk") > 0.5, F.col("n_words")).otherwise(0)), F.sum("n_words")).alias("share"))
    return j.filter("same").select("chunk_ord", "share").union(own.select("chunk_ord", "share"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # the texts aren't needed once their statistics are there
    b, model = block_scores(blocks(spark, folder).select("block_id", "doc_id", "block_ord", "text"), ["block_id", "doc_id", "block_ord"])
    b = saved(b.select("block_id", "doc_id", "block_ord", "n_words", "junk"))
    bad = b.filter((F.col("n_words") >= MIN_WORDS) & (F.col("junk") > 0.5)).select(F.lit("block").alias("rec_kind"), F.col("block_id").alias("rec_id"))
    c = chunk_shares(chunks(spark, folder), b, model).filter("share > 0.5").select(F.lit("chunk").alias("rec_kind"), F.col("chunk_ord").alias("rec_id"))
    return bad.union(c)


def p2_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and junk probability of every block."""
    b, _ = block_scores(blocks(spark, folder))
    return b.select("block_id", *[F.round(s, 6).alias(s) for s in STATS], F.round("junk", 4).alias("junk"))
