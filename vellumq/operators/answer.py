"""From hits to answers: the abstention gate, context, citations, and a client that retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds picked per configuration, what is said instead of an answer, and the instruction.
THRESHOLDS = {"hybrid-bge-small": 0.702, "dense-bge-small": 0.702, "baseline-minilm": 0.629}
TOP_K, TRIES, DELAY = 4, 4, 2
SEPARATOR = "\n\n---\n\n"
NO_ANSWER = "I don't have enough information"
INSTRUCTION = f'Answer the question from the context below and from nothing else. Where the context does not hold the answer, say "{NO_ANSWER}". Name the source file and the page the answer comes from.'


def threshold_of(config: Column, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    return F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[config]


def gate(conf: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Adds threshold and decision: abstain iff confidence < threshold; without a threshold always answer."""
    t = conf.withColumn("threshold", threshold_of(F.col("config"), thresholds))
    low = F.col("threshold").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) < F.col("threshold"))
    return t.withColumn("decision", F.when(low, "abstain").otherwise("answer"))


def _pages() -> Column:
    return F.concat(F.lit("p."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))


def context(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, context): the hits' texts with their sources, in rank order."""
    part = F.concat(F.lit("[Source: "), F.coalesce("source_file", F.lit("")), F.lit(", "), _pages(), F.lit("]\n"), F.coalesce("text", F.lit("")))
    x = hits.join(chunks.select("chunk_ord", "source_file", "page_start", "page_end", "text"), "chunk_ord").withColumn("part", part)
    return x.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_ord", "part"))), lambda z: z["part"]), SEPARATOR).alias("context"))


def citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds citation: source, pages, the first region's box in whole points (half up) and the score."""
    x = hits.join(chunks.select("chunk_ord", "source_file", "page_start", "page_end", "regions"), "chunk_ord")
    box = F.get(F.col("regions"), F.lit(0))["bbox"]
    corner = lambda c: F.round(box[c], 0).cast("bigint").cast("string")
    where = F.concat(F.lit(", bbox=("), F.concat_ws(",", *[corner(c) for c in ("x0", "y0", "x1", "y1")]), F.lit(")"))
    whole = box.isNotNull() & box["x0"].isNotNull() & box["y0"].isNotNull() & box["x1"].isNotNull() & box["y1"].isNotNull()
    line = F.concat(F.coalesce("source_file", F.lit("")), F.lit(" "), _pages(), F.when(whole, where).otherwise(F.lit("")), F.lit(" [rank score="), F.format_string("%.3f", F.col("score")), F.lit("]"))
    return x.withColumn("citation", line).drop("source_file", "page_start", "page_end", "regions")


def hit_line(source: Column, page_start: Column, page_end: Column, score: Column) -> Column:
    """A hit in one line: source, pages and score."""
    return F.format_string("%s p.%d-%d (score=%.3f)", F.coalesce(source, F.lit("")), page_start, page_end, score)


class Generator(Protocol):
    """Makes an answer from an instruction and a prompt."""

    def generate(self, instruction: str, prompt: str) -> str: ...


class TemporaryError(Exception):
    """Overload or rate limit; worth another try."""


def with_retries(call: Callable[[], str], tries: int = TRIES, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after 2, 4, 8 seconds on a temporary error; other errors and the last one are raised."""
    for n in range(tries):
        try:
            return call()
        except TemporaryError:
            if n == tries - 1:
                raise
            sleep(delay * 2**n)
    raise ValueError("no try allowed")


class ChatEndpoint:
    """A generator behind an HTTP endpoint that takes chat messages and answers with choices; temperature 0, no tools.
    Overload and rate limits are temporary, other errors aren't. `post` sends a body and returns (status, body)."""

    def __init__(self, url: str, model: str, key: str = "", post: Callable[[str, dict[str, str], bytes], tuple[int, bytes]] | None = None) -> None:
        self.url, self.model, self.key, self.post = url, model, key, post

    def generate(self, instruction: str, prompt: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": prompt}]}
        status, got = (self.post or _posted)(self.url, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}, json.dumps(body).encode())
        if status == 429 or status >= 500:
            raise TemporaryError(f"status {status}")
        if status != 200:
            raise ValueError(f"status {status}: {got[:200]!r}")
        return json.loads(got)["choices"][0]["message"]["content"]


def _posted(url: str, headers: dict[str, str], body: bytes) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class FirstSentence:
    """Offline stand-in for a language model: the first sentence of the context."""

    def generate(self, instruction: str, prompt: str) -> str:
        body = prompt.partition("]\n")[2].partition(SEPARATOR)[0].partition("\n\nQuestion:")[0]
        return body.partition(". ")[0].strip() or NO_ANSWER


def answers(gated: DataFrame, generator: Generator) -> DataFrame:
    """Adds answer. Abstained questions never reach the generator; gated has decision, context, question."""
    @F.pandas_udf("string")
    def run(ctx: pd.Series, question: pd.Series) -> pd.Series:
        return pd.Series([with_retries(lambda c=c, q=q: generator.generate(INSTRUCTION, f"Context:\n{c}\n\nQuestion: {q}")) for c, q in zip(ctx.fillna(""), question)])

    asked = gated.filter("decision = 'answer'").withColumn("answer", run("context", "question"))
    return asked.unionByName(gated.filter("decision != 'answer'").withColumn("answer", F.lit(NO_ANSWER)))
