"""Named retrieval configurations and their factory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from vellumq.operators import dense, fusion, lexical

# Names of models and which configuration uses what.
EMBED_MODELS = {
    "minilm": "sentence-transformers/all-MiniLM-L6-v2",
    "bge-small": "BAAI/bge-small-en-v1.5",
    "bge-base": "BAAI/bge-base-en-v1.5",
}
RERANKER = "BAAI/bge-reranker-base"


@dataclass(frozen=True)
class Config:
    name: str
    embed: str | None
    bm25: bool
    rerank: bool


CONFIGS = {
    c.name: c
    for c in (
        Config("baseline-minilm", "minilm", False, False),
        Config("bm25", None, True, False),
        Config("dense-bge-small", "bge-small", False, False),
        Config("dense-bge-base", "bge-base", False, False),
        Config("hybrid-bge-small", "bge-small", True, False),
        Config("hybrid-bge-small+rerank", "bge-small", True, True),
        Config("hybrid-bge-base+rerank", "bge-base", True, True),
    )
}
DEFAULT, BASELINE = "hybrid-bge-small", "baseline-minilm"


def embed_model(name: str) -> str | None:
    key = CONFIGS[name].embed
    return EMBED_MODELS[key] if key else None


class Retriever:
    """search(questions, k) -> (hits, confidence) for a batch of questions, over indexed chunks.

    `vectors` (chunk_ord, embedding) and `encode` (questions -> qid, embedding) are needed where the configuration is
    dense; `model` is the name the vectors were built with. A configuration's index is built once and reused.
    """

    def __init__(self, name: str, chunks: DataFrame, vectors: DataFrame | None = None, encode=None, model: str | None = None, scorer: fusion.PairScorer | None = None, candidates: int | None = None) -> None:
        self.config, self.chunks, self.vectors, self.encode, self.scorer = CONFIGS[name], chunks, vectors, encode, scorer
        self.candidates = candidates
        if self.config.embed:
            dense.check_model(embed_model(name), model if model is not None else embed_model(name))
            if vectors is None or encode is None:
                raise ValueError(f"{name} needs vectors and an encoder for questions")
        self.built = lexical.index(chunks) if self.config.bm25 else None

    def _base(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        c = self.config
        wide = max(k, self.candidates or fusion.CANDIDATES) if c.embed and c.bm25 else k
        found = {}
        if c.embed:
            found["dense"] = dense.search(self.encode(dense.prefixed(questions, embed_model(c.name))), self.vectors, wide)
        if c.bm25:
            found["sparse"] = lexical.bm25(questions, self.chunks, wide, self.built)
        first = found.get("dense", found.get("sparse"))
        hits = fusion.hybrid(found["dense"], found["sparse"], k) if len(found) == 2 else first
        return hits, lexical.confidence(questions, first)

    def search(self, questions: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
        if not self.config.rerank:
            return self._base(questions, k)
        base, _ = self._base(questions, fusion.RERANKED)
        hits = fusion.rerank(base, questions, self.chunks, k, self.scorer)
        return hits, lexical.confidence(questions, hits)
