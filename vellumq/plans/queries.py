"""Queries over the test tables, one or more for each operator; every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.functions.text import preview, tokens
from vellumq.operators import answer, chunking, dense, fusion, lexical, metrics, pages, relevance
from vellumq.plans import configs
from vellumq.session import kept, modified, saved, still_there
from vellumq.sources.tables import blocks, chunks, table

TOP = 10


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    return q.withColumnRenamed("id", "qid")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (config, qid, chunk_ord); the best rank counts, rows without a rank don't."""
    h = table(spark, d, "hits").filter("rank is not null and qid is not null and chunk_ord is not null")
    return h.groupBy("config", "qid", "chunk_ord").agg(F.min("rank").alias("rank"))


def conf(spark: SparkSession, d: str) -> DataFrame:
    """(config, qid, confidence, answerable, positive), confidence null as 0."""
    r = table(spark, d, "retrieval_results").groupBy("config", "qid").agg(F.max_by("confidence", "searched_at").alias("confidence"))
    r = r.withColumn("confidence", F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")))
    q = questions(spark, d).select("qid", "answerable")
    return r.join(q, "qid").select("config", "qid", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "answerable", (~F.col("answerable")).alias("positive"))


def blocks_from_lines(spark: SparkSession, d: str) -> DataFrame:
    b = pages.line_blocks(table(spark, d, "documents"), "doc_id", "text")
    return b.select("doc_id", "block_ord", "text", "page", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))


def page_routing(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).filter("source_file is not null and page is not null")
    p = b.groupBy("source_file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return p.select("source_file", "page", pages.route(F.col("text")).alias("route"))


def ocr_counts(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).filter("source_file is not null")
    is_ocr = F.coalesce(F.lower(F.trim("extraction_method")) == "ocr", F.lit(False))
    return b.groupBy("source_file").agg(F.count("*").alias("n_blocks"), F.count_if(is_ocr).alias("n_ocr"), F.countDistinct(F.when(is_ocr, F.col("page"))).alias("ocr_pages"))


def ocr_line_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents laid out eight to a line, as a recogniser would report them, grouped into lines again."""
    w = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("pos", "text"))
    pos, n = F.col("pos"), F.length("text")
    w = w.select("doc_id", "pos", "text", F.floor(pos / 64).alias("block_num"), F.floor(pos / 32).alias("par_num"), F.floor(pos / 8).alias("line_num"), ((pos % 8) * 70).alias("left"), (F.floor(pos / 8) * 20).alias("top"), (n * 8).alias("width"), F.lit(16).alias("height"))
    g = pages.group_words(w, ["doc_id"], dpi=144)
    return g.select("doc_id", "block_ord", "text", *[F.col("bbox")[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    return chunking.ranges(blocks(spark, d))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks_of(blocks(spark, d)).select("chunk_id", "source_file", "page_start", "page_end", "text")


def chunk_regions(spark: SparkSession, d: str) -> DataFrame:
    r = chunking.chunks_of(blocks(spark, d)).select("chunk_id", F.posexplode("regions").alias("region_no", "r"))
    return r.select("chunk_id", "region_no", F.col("r.page").alias("page"), F.col("r.bbox.x0").alias("x0"), F.col("r.bbox.y0").alias("y0"), F.col("r.bbox.x1").alias("x1"), F.col("r.bbox.y1").alias("y1"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(F.coalesce("text", F.lit("")))
    return chunks(spark, d).select("chunk_ord", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return lexical.idf_table(lexical.token_table(c), lexical.corpus_stats(c)).select("term", "n", F.round("idf", 6).alias("idf"))


def _six(x: DataFrame) -> DataFrame:
    return x.select("qid", "chunk_ord", "rank", F.round("score", 6).alias("score"))


_built: dict[tuple, lexical.Index] = {}


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, lexical.Index]:
    """The chunks and their BM25 index, built once for a folder as long as its table of chunks isn't written again."""
    c = chunks(spark, d)
    key = (spark.sparkContext.applicationId, d, modified(spark, f"{d}/chunks.parquet"))
    if key not in _built or not all(still_there(x) for x in _built[key]):
        _built[key] = tuple(kept(x) for x in lexical.index(c))
    return c, _built[key]


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    c, built = _index(spark, d)
    return lexical.bm25(questions(spark, d), c, k, built)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(_sparse(spark, d, TOP))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of every vector whose id is divisible by 100, among all others."""
    v = _vectors(spark, d)
    q = v.filter("chunk_ord % 100 = 0").select(F.col("chunk_ord").alias("qid"), "embedding")
    return _six(dense.search(q, v, TOP, skip_self=True))


def _letters(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = questions(spark, d).select("qid", dense.letter_vector(F.col("question")).alias("embedding"))
    v = chunks(spark, d).select("chunk_ord", dense.letter_vector(F.col("text")).alias("embedding"))
    return dense.search(q, v, k)


def bow_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(_letters(spark, d, TOP))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(fusion.hybrid(_letters(spark, d, fusion.CANDIDATES), _sparse(spark, d, fusion.CANDIDATES), TOP))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """All retrievers' lists of a question merged; lists in order of the configuration's name."""
    return _six(fusion.rrf_tagged(hits(spark, d).withColumnRenamed("config", "list"), TOP))


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    return _six(fusion.rerank(_sparse(spark, d, fusion.RERANKED), q, c, TOP))


def confidence_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid confidence: the dense list's best score."""
    c = lexical.confidence(questions(spark, d), _letters(spark, d, TOP))
    return c.select("qid", F.round("confidence", 6).alias("confidence"))


def abstain_gate(spark: SparkSession, d: str) -> DataFrame:
    return answer.gate(conf(spark, d)).select("config", "qid", "confidence", "threshold", "decision")


def relevance_exact(spark: SparkSession, d: str) -> DataFrame:
    return relevance.exact(questions(spark, d), chunks(spark, d))


def relevance_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return relevance.fuzzy(questions(spark, d), chunks(spark, d))


def label_errors(spark: SparkSession, d: str) -> DataFrame:
    """A quote that stands in a chunk word by word needs no comparison; the others' questions are looked for in all chunks."""
    q, c = questions(spark, d), chunks(spark, d)
    rest = saved(relevance.unlabelled(q, relevance.fuzzy(q, c, 100.0)).select("qid"))
    left = q.join(rest, "qid", "left_semi")
    return relevance.unlabelled(left, relevance.fuzzy(left, c))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """Only the hits are compared with their question's evidence; chunks that no list names have no rank to give."""
    q, h = questions(spark, d), hits(spark, d)
    return metrics.first_ranks(h, relevance.among(h, q, chunks(spark, d)), q, ["config"])


def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("config", "qid", "rank")


def hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(_ranks(spark, d), ["config"])


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.pr_curve(conf(spark, d), ["config"])
    return c.select("config", F.round("boundary", 6).alias("boundary"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "answered_rate")])


def pick_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.pick_threshold(metrics.pr_curve(conf(spark, d), ["config"]), ["config"])
    return c.select("config", F.round("boundary", 6).alias("boundary"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "answered_rate")])


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(conf(spark, d), ["config"]).select("config", F.round("auc", 6).alias("auc"))


def cv_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cv_f1(metrics.ranked_folds(conf(spark, d), ["config"]), ["config"]).select("config", F.round("cv_f1", 6).alias("cv_f1"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_ci(metrics.reciprocal(_ranks(spark, d)), ["config"], "rr", "qid")


def _mean_diff(ranks: DataFrame) -> DataFrame:
    p = metrics.paired(metrics.reciprocal(ranks), ["config"], configs.BASELINE)
    return p.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff"))


def paired_diff(spark: SparkSession, d: str) -> DataFrame:
    return _mean_diff(saved(_ranks(spark, d)))


def paired_ci(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.paired(metrics.reciprocal(saved(_ranks(spark, d))), ["config"], configs.BASELINE)
    return metrics.bootstrap_ci(p, ["config"], "diff", "qid")


def _kept_and_found(ranks: DataFrame, c: DataFrame) -> DataFrame:
    """Share of answerable questions that are kept at the picked boundary and have evidence in the first four hits."""
    best = metrics.pick_threshold(metrics.pr_curve(c, ["config"]), ["config"]).select("config", "boundary")
    x = ranks.join(c.select("config", "qid", "confidence"), ["config", "qid"]).join(best, "config")
    good = (F.col("boundary").isNull() | (F.col("confidence") > F.col("boundary"))) & F.coalesce(F.col("rank") <= answer.TOP_K, F.lit(False))
    return x.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(good.cast("double")), 6).alias("answered_with_evidence"))


def answered_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _kept_and_found(_ranks(spark, d), conf(spark, d))


def _first_hits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("config", "qid").orderBy("rank", "chunk_ord")
    return hits(spark, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= answer.TOP_K).select("config", "qid", "chunk_ord", F.col("place").alias("rank"))


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return answer.context(_first_hits(spark, d), chunks(spark, d), ["config", "qid"])


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the first hits; the score shown is 1 / (60 + rank)."""
    h = _first_hits(spark, d).withColumn("score", F.lit(1.0) / (F.lit(60) + F.col("rank")))
    return answer.citations(h, chunks(spark, d)).select("config", "qid", "rank", "citation")


def search_preview(spark: SparkSession, d: str) -> DataFrame:
    h = _first_hits(spark, d).join(chunks(spark, d), "chunk_ord")
    return h.select("config", "qid", "rank", "chunk_id", preview(F.col("text")).alias("preview"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Gate, context and the offline generator end to end."""
    g = answer.gate(conf(spark, d)).join(context_assembly(spark, d), ["config", "qid"], "left").join(questions(spark, d).select("qid", "question"), "qid")
    return answer.answers(g, answer.FirstSentence()).select("config", "qid", "decision", "answer")


def labels_review(spark: SparkSession, d: str) -> DataFrame:
    """Every question with the pages and number of the chunks that hold its evidence."""
    q, c = questions(spark, d), chunks(spark, d)
    r = relevance.fuzzy(q, c).join(c.select("chunk_ord", "page_start", "page_end"), "chunk_ord")
    n = r.groupBy("qid").agg(F.count("*").alias("n_chunks"))
    p = r.select("qid", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct().groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ", ").alias("pages"))
    out = q.join(n, "qid", "left").join(p, "qid", "left")
    return out.select("qid", "answerable", "source_file", "answer", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("pages", F.lit("")).alias("pages"), "why_unanswerable")


def config_report(spark: SparkSession, d: str) -> DataFrame:
    """One row of numbers for each configuration."""
    r = saved(_ranks(spark, d))
    c = saved(conf(spark, d))
    best = metrics.pick_threshold(metrics.pr_curve(c, ["config"]), ["config"]).select("config", F.round("f1", 6).alias("abstain_f1"))
    m = metrics.retrieval_metrics(r, ["config"]).select("config", "n", "hit_1", "hit_4", "hit_10", "mrr_10")
    auc = metrics.roc_auc(c, ["config"]).select("config", F.round("auc", 6).alias("auc"))
    cv = metrics.cv_f1(metrics.ranked_folds(c, ["config"]), ["config"]).select("config", F.round("cv_f1", 6).alias("cv_f1"))
    return m.join(best, "config").join(auc, "config").join(cv, "config").join(_kept_and_found(r, c).drop("n"), "config").join(_mean_diff(r).drop("n"), "config")


NAMES = (
    "blocks_from_lines page_routing ocr_counts ocr_line_grouping chunk_bounds chunk_text chunk_regions token_counts bm25_idf bm25_topk dense_topk bow_dense_topk hybrid_topk rrf_fusion rerank_topk "
    "confidence_per_query abstain_gate relevance_exact relevance_fuzzy label_errors first_relevant_rank hit_mrr pr_curve pick_threshold roc_auc cv_f1 bootstrap_ci paired_diff paired_ci "
    "answered_with_evidence context_assembly citations search_preview answers labels_review config_report"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
