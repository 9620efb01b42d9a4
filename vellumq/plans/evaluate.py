"""Evaluation of retrievers on labelled questions: all measures of all configurations in one table, files for people.

Each retriever is timed as its index is built and as it answers all questions in one batch; everything after that runs
over the hits of all configurations at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.operators import answer, metrics, relevance
from vellumq.plans.configs import BASELINE, Retriever
from vellumq.plans.report import spread, table
from vellumq.session import saved

FOUND = 10  # hits looked at for each question


def searched(questions: DataFrame, retrievers: dict[str, Callable[[], Retriever]], k: int = FOUND) -> tuple[DataFrame, DataFrame, dict[str, dict[str, float]]]:
    """(hits with config, confidences with config, seconds): each retriever is made, then asked all questions."""
    n, hits, confs, took = max(1, questions.count()), [], [], {}
    for name, make in retrievers.items():
        began = time.perf_counter()
        r = make()
        made = time.perf_counter()
        h, c = r.search(questions.select("qid", "question"), k)
        h, c = saved(h), saved(c)
        took[name] = {"index_seconds": made - began, "ms_per_query": 1000 * (time.perf_counter() - made) / n}
        hits.append(h.withColumn("config", F.lit(name)))
        confs.append(c.withColumn("config", F.lit(name)))
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, confs), took


def measures(questions: DataFrame, relevant: DataFrame, hits: DataFrame, confidences: DataFrame) -> DataFrame:
    """One row a configuration: hit rates, MRR with interval, difference from the baseline with interval, abstention at
    the picked boundary in sample and cross-validated, AUC, and the share kept and found in the first hits."""
    keys = ["config"]
    ranks = saved(metrics.first_ranks(hits, relevant, questions, keys))
    conf = saved(confidences.join(questions.select("qid", "answerable", (~F.col("answerable")).alias("positive")), "qid"))
    rr = saved(metrics.reciprocal(ranks.withColumn("rank", F.when(F.col("rank") <= metrics.MRR_K, F.col("rank")))))
    ci = metrics.bootstrap_ci(rr, keys, "rr", "qid").select("config", F.col("low").alias("mrr_low"), F.col("high").alias("mrr_high"))
    first = metrics.bootstrap_ci(ranks.withColumn("top", F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))), keys, "top", "qid").select("config", F.col("low").alias("hit_1_low"), F.col("high").alias("hit_1_high"))
    diff = metrics.bootstrap_ci(metrics.paired(rr, keys, BASELINE).filter(F.col("config") != BASELINE), keys, "diff", "qid").select("config", F.col("mean").alias("diff"), F.col("low").alias("diff_low"), F.col("high").alias("diff_high"))
    best = saved(metrics.pick_threshold(metrics.pr_curve(conf, keys), keys))
    cv = metrics.cv_f1(metrics.shuffled_folds(conf, keys), keys)
    x = ranks.join(conf.select("config", "qid", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), ["config", "qid"]).join(best.select("config", "boundary"), "config")
    kept = F.col("boundary").isNull() | (F.col("confidence") > F.col("boundary"))
    good = x.groupBy("config").agg(F.avg((kept & F.coalesce(F.col("rank") <= answer.TOP_K, F.lit(False))).cast("double")).alias("answered_with_evidence"))
    out = metrics.retrieval_metrics(ranks, keys)
    for part in (ci, first, best, cv, metrics.roc_auc(conf, keys), good):
        out = out.join(part, "config")
    return out.join(diff, "config", "left")


def results_table(rows: list[dict], took: dict[str, dict[str, float]]) -> str:
    names = ["Config", "Hit@1", "Hit@4", "Hit@10", "MRR@10 [95% CI]", "MRR minus baseline [95% CI]", "Abstain F1 (in-sample / cross-validated)", "AUC", "Answered with evidence", "ms/query"]
    lines = []
    for r in rows:
        lines.append((r["config"], r["hit_1"], r["hit_4"], r["hit_10"], spread(r["mrr_10"], r["mrr_low"], r["mrr_high"]), spread(r["diff"], r["diff_low"], r["diff_high"], "+"), f"{r['f1']:.2f} / {r['cv_f1']:.2f}", r["auc"], r["answered_with_evidence"], f"{took[r['config']]['ms_per_query']:.0f}"))
    return table(names, lines)


def evaluate(questions: DataFrame, chunks: DataFrame, retrievers: dict[str, Callable[[], Retriever]]) -> tuple[str, str]:
    """(table for people, JSON): raises where a label is broken. The rows, one a configuration, come to the driver, in
    the order of `retrievers`; curves are one row a boundary."""
    questions, relevant = saved(questions), saved(relevance.fuzzy(questions, chunks))
    relevance.require_labels(questions, relevant)
    hits, confidences, took = searched(questions, retrievers)
    found = {r["config"]: r.asDict() for r in measures(questions, relevant, hits, confidences).collect()}
    rows = [found[n] for n in dict.fromkeys(retrievers) if n in found]
    conf = confidences.join(questions.select("qid", (~F.col("answerable")).alias("positive")), "qid")
    curves: dict[str, list] = {}
    for r in metrics.pr_curve(conf, ["config"]).orderBy("config", "boundary").collect():
        curves.setdefault(r["config"], []).append({k: r[k] for k in ("boundary", "precision", "recall", "f1", "answered_rate")})
    doc = [{**r, **took[r["config"]], "pr_curve": curves.get(r["config"], [])} for r in rows]
    return results_table(rows, took), json.dumps(doc, indent=1)


def plotted(rows: list[dict], default: str) -> list[str]:
    """Configurations worth a curve: the baseline, the default and the best by MRR, then AUC, each named once."""
    known = [r["config"] for r in rows]
    best = max(rows, key=lambda r: (r["mrr_10"], r["auc"]), default=None)
    return [n for n in dict.fromkeys([BASELINE, default, best["config"] if best else ""]) if n in known]
