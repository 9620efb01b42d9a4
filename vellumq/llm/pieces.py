"""Problem 4: cutting oversized texts into pieces at natural boundaries, with overlap.

Bounded-quantifier regular expressions consume a text from left to right. Their alternatives are ordered by the
strength of the boundary (the rest fits, paragraph, sentence, clause, word, character), each takes as much as the
limit allows, and together they match every character, so the pieces' cores joined give the text again. A fold over
these cores looks back for each piece's overlap and cuts cores that keep the word limit but not the room that the
overlap leaves under the character limit. Everything runs in SQL functions.

Defined results: null text gives no piece, empty or blank text one piece as it is, a text within both limits one
piece without overlap. The overlap is the last `overlap` words before the piece, however long, as long as they leave
room for a core that ends at a natural place; the core is shortened for them. Where they can't fit, the overlap is as
many of these words as `overlap_chars` hold, if not even one fits the last `overlap_chars` characters. Words are runs
of characters that aren't Unicode white space. No piece exceeds either limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.sources.tables import blocks, chunks

MAX_WORDS, MAX_CHARS, OVERLAP, OVERLAP_CHARS = 240, 1800, 30, 450

_END = r"""[.!?…。！？]["'”’»)\]]*+"""


def word_pattern(most: int) -> str:
    """Up to `most` words; boundaries from `most`/2 words on."""
    few, many = most // 2 - 1, most - 1
    some = rf"(?:\S++\s++){{{few},{many}}}"
    return rf"""(?U)\s++|(?:\S++(?:\s++\S++){{0,{many}}}(?=\s*\z)|{some}\S++(?=[ \t]*\n[ \t]*\n)|{some}\S*?{_END}(?=\s)|{some}\S*?[,;:)\]–—](?=\s)|\S++(?:\s++\S++){{0,{many}}})\s*+"""


def _strong(half: object, near: object, most: object) -> str:
    some = rf"[\s\S]{{{half},{near}}}"
    return rf"""[\s\S]{{1,{most}}}\z|{some}(?:[。！？]|{_END}(?=\s))|{some}[,;:、，)](?=\s|[^\x00-\x7f])|{some}\s"""


def char_pattern(most: int) -> str:
    """Up to `most` characters; boundaries from `most`/2 on, then any white space, then any character."""
    return rf"""(?U){_strong(most // 2, most - 8, most)}|[\s\S]{{1,{most}}}"""


def _found(text: Column, pattern: str, room: Column) -> Column:
    """What `pattern` finds within a row's own room; it names room / 2, room - 8, room and room - 1 as %1$d to %4$d."""
    return F.call_function("regexp_extract", text, F.format_string(pattern, F.floor(room / 2).cast("int"), room - 8, room, room - 1), F.lit(0))


#: Ends of words and of sentences or clauses without white space, at any place in the room.
_NATURAL = r"[\s\S]{0,%4$d}\S(?:(?=\s|\z)|(?<=[。！？、，]))"
_ROOM = rf"""(?U)(?:{_strong("%1$d", "%2$d", "%3$d")}|{_NATURAL}|[\s\S]{{1,%3$d}})\s*+"""
LEAST_ROOM = 16


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(cores: Column, max_chars: int, overlap: int, overlap_chars: int) -> Column:
    """array<struct<back, core>> of the pieces: overlap and core, from cores that keep the word limit."""
    most, lead = max_chars - overlap_chars, max(0, overlap - 1)
    none = F.lit("")

    def natural(rest: Column, room: Column) -> Column:
        return _found(rest, rf"(?U)\A{_NATURAL}", room) != ""

    def room_by(back: Column) -> Column:
        return F.least(F.lit(most), F.lit(max_chars) - F.length(back))

    def step(s: Column) -> Column:
        # `tail` is one character longer than a piece, so words it doesn't hold from their start on never fit
        words = F.regexp_extract(s["tail"], rf"(?U)(?<!\S)(?:\S++\s++){{0,{lead}}}\S++\s*+\z", 0) if overlap else none
        last = F.right(s["tail"], F.lit(overlap_chars))
        fewer = F.regexp_extract(last, rf"(?U)(?<=\s)(?:\S++\s++){{0,{lead}}}\S++\s*+\z", 0)

        def looked(w: Column) -> Column:
            room = room_by(w)
            # a core that would be cut inside a word in any case may be cut there for the overlap, too
            fits = (room >= most) | ((room >= LEAST_ROOM) & (natural(s["rest"], room) | ~natural(s["rest"], F.lit(most))))
            return F.when(fits, w).when(fewer != "", fewer).otherwise(last if overlap else none)

        def cut(back: Column) -> Column:
            room = room_by(back)
            part = F.when(room >= most, F.regexp_extract(s["rest"], char_pattern(most), 0)).otherwise(_found(s["rest"], _ROOM, room))
            return F.struct(back.alias("back"), F.when(F.length(s["rest"]) <= room, s["rest"]).otherwise(part).alias("core"))

        def moved(x: Column) -> Column:
            rest = F.substr(s["rest"], F.length(x["core"]) + 1)
            return F.struct(rest.alias("rest"), F.right(F.concat(s["tail"], x["core"]), F.lit(max_chars + 1)).alias("tail"), F.array_append(s["out"], x).alias("out"))

        return _let(_let(_let(words, looked), cut), moved)

    def through(s: Column, core: Column) -> Column:
        start = F.struct(core.alias("rest"), s["tail"].alias("tail"), s["out"].alias("out"))
        # each step takes a character at least
        return F.aggregate(F.sequence(F.lit(1), F.length(core)), start, lambda a, _: F.when(a["rest"] == "", a).otherwise(step(a)))

    out = F.array().cast("array<struct<back:string,core:string>>")
    return F.aggregate(cores, F.struct(none.alias("rest"), none.alias("tail"), out.alias("out")), through)["out"]


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def cut_cores(df: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(k, no, back, core): each piece's overlap and core; the cores of a text joined in order are the text."""
    if not 0 <= overlap < max_words or not 0 <= overlap_chars < max_chars:
        raise ValueError("the overlap must be smaller than the limits")
    t = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    whole = (word_count(F.col("t")) <= max_words) & (F.length("t") <= max_chars)
    by_words = F.regexp_extract_all("t", F.lit(word_pattern(max_words - overlap)), F.lit(0))
    one = F.array(F.struct(F.lit("").alias("back"), F.col("t").alias("core")))
    return t.select("k", F.posexplode(F.when(whole, one).otherwise(_fold(by_words, max_chars, overlap, overlap_chars))).alias("no", "piece")).select("k", "no", "piece.*")


def cut_text(df: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(key, piece_no, n_pieces, text, word_from, word_to, core_from): pieces in order; word offsets include the overlap."""
    p = cut_cores(df, key, text, max_words, max_chars, overlap, overlap_chars)
    w = Window.partitionBy("k").orderBy("no")
    p = p.withColumn("cw", word_count(F.col("core"))).withColumn("bw", word_count(F.col("back")))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("core_from", F.coalesce(F.sum("cw").over(upto), F.lit(0))).withColumn("n_pieces", F.count("*").over(Window.partitionBy("k")))
    return p.select(F.col("k").alias(key), F.col("no").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), F.regexp_replace(F.concat("back", "core"), r"(?U)\s+\z", "").alias("text"), F.greatest(F.lit(0), F.col("core_from") - F.col("bw")).alias("word_from"), (F.col("core_from") + F.col("cw")).alias("word_to"), F.col("core_from"))


def region_spans(c: DataFrame, b: DataFrame) -> DataFrame:
    """(chunk_ord, pos, region, from, to): the words of a chunk that come from each of its regions.

    A region's block is found by file, page and corners; as a chunk ends with the end of its last block, word
    counts are laid from the end. Regions without a block share the words the others leave over evenly.
    """
    r = c.select("chunk_ord", "source_file", "page_start", word_count(F.col("text")).alias("words"), F.posexplode("regions").alias("pos", "region")).filter("region is not null")
    r = r.withColumn("page", F.coalesce("region.page", "page_start"))
    corners = ["x0", "y0", "x1", "y1"]
    n = b.filter("text is not null and bbox is not null").select("source_file", "page", *[F.col(f"bbox.{x}").alias(x) for x in corners], word_count(F.col("text")).alias("bw")).groupBy("source_file", "page", *corners).agg(F.max("bw").alias("bw"))
    j = r.select("*", *[F.col(f"region.bbox.{x}").alias(x) for x in corners]).join(n, ["source_file", "page", *corners], "left")
    all_of = Window.partitionBy("chunk_ord")
    share = F.greatest(F.lit(1), F.floor((F.col("words") - F.coalesce(F.sum("bw").over(all_of), F.lit(0))) / F.greatest(F.lit(1), F.sum(F.col("bw").isNull().cast("int")).over(all_of))))
    j = j.withColumn("bw", F.coalesce("bw", share))
    after = Window.partitionBy("chunk_ord").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("start", F.col("words") - F.sum("bw").over(after)).withColumn("first", F.col("pos") == F.min("pos").over(all_of))
    return j.select("chunk_ord", "pos", F.struct("page", "region.bbox").alias("region"), F.when(F.col("first"), 0).otherwise(F.greatest(F.lit(0), "start")).alias("from"), (F.col("start") + F.col("bw")).alias("to"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_text(chunks(spark, folder), "chunk_ord", "text").filter("piece_no = 1").select("chunk_ord")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every chunk with the pages and regions of their share."""
    c = chunks(spark, folder)
    p = cut_text(c, "chunk_ord", "text")
    many = p.filter("n_pieces > 1")
    big = c.join(many.select("chunk_ord").distinct(), "chunk_ord", "left_semi")
    s = region_spans(big, blocks(spark, folder))
    hit = many.select("chunk_ord", "piece_no", "word_from", "word_to").join(s, "chunk_ord").filter("from < word_to and to > word_from")
    regions = hit.groupBy("chunk_ord", "piece_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "region"))), lambda x: x["region"]).alias("share"), F.min("region.page").alias("p0"), F.max("region.page").alias("p1"))
    out = p.join(regions, ["chunk_ord", "piece_no"], "left").join(c.select("chunk_ord", "chunk_id", "source_file", "page_start", "page_end", "regions"), "chunk_ord")
    one = F.col("n_pieces") == 1
    return out.select(
        "chunk_ord", "piece_no", "n_pieces", "chunk_id", "source_file", "text",
        F.when(one, F.col("page_start")).otherwise(F.coalesce("p0", "page_start")).alias("page_start"),
        F.when(one, F.col("page_end")).otherwise(F.coalesce("p1", "page_end")).alias("page_end"),
        F.when(one, F.to_json("regions")).otherwise(F.to_json("share")).alias("regions_json"),
    )


def p4_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """One row: chunks with text, and those whose pieces break a rule; all but the first are 0. The cores joined are the
    text, no piece exceeds a limit, and each overlap is what stands before its core, of 30 words at most."""
    c = chunks(spark, folder).select("chunk_ord", "text")
    p = cut_cores(c, "chunk_ord", "text").join(c.withColumnRenamed("chunk_ord", "k"), "k")
    w = Window.partitionBy("k").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start", F.coalesce(F.sum(F.length("core")).over(w), F.lit(0))).withColumn("piece", F.regexp_replace(F.concat("back", "core"), r"(?U)\s+\z", ""))
    big = (word_count(F.col("piece")) > MAX_WORDS) | (F.length("piece") > MAX_CHARS)
    away = F.expr("substring(text, start + 1, length(core))") != F.col("core")
    loose = (F.expr("substring(text, start + 1 - length(back), length(back))") != F.col("back")) | (word_count(F.col("back")) > OVERLAP)
    g = p.groupBy("k").agg(F.max(big.cast("int")).alias("big"), F.max(away.cast("int")).alias("away"), F.max(loose.cast("int")).alias("loose"), (F.sum(F.length("core")) != F.max(F.length("text"))).cast("int").alias("short"))
    n = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return g.agg(F.count("*").alias("chunks"), n("big", "over_a_limit"), n(F.greatest("away", "short"), "not_rejoined"), n("loose", "other_overlap"))
