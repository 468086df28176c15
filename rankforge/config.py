"""Configuration as plain dataclasses (no YAML, no global state)."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# ---- fixed values (must equal the reference's for equal results) ----
# label -> graded relevance
LABEL_GRADES = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}
# instruction put in front of every query before dense encoding
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
# order in which sources add into the fused score (and first-seen tie order)
SOURCE_ORDER = ("dense", "splade", "bm25")
# relevance thresholds
BROAD_MIN_GRADE = 0.10
STRICT_MIN_GRADE = 0.99
# metric cut-offs
RECALL_KS = (50, 100, 200)
NDCG_KS = (10, 20, 50)
# token budget of the encoder in the length profile
TOKEN_BUDGET = 256
# ---- end of fixed values ----


# ---- fixed values: parameters of the reference runs, as defaults ----
@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.5
    b: float = 0.75
    min_df: int = 1
    stem: bool = True


@dataclass(frozen=True)
class RetrievalConfig:
    sources: tuple[str, ...] = ("dense", "bm25", "splade")
    dim: int = 64
    dense_top_k: int = 500
    sparse_top_k: int = 500
    candidate_top_k: int = 200
    rrf_k: int = 60
    weights: Mapping[str, float] = field(
        default_factory=lambda: MappingProxyType({"dense": 1.0, "splade": 0.5, "bm25": 0.3}))
    # T4: pad sparse lists with zero-score documents (lowest ids) up to k
    pad_zero: bool = False
    # ranks are taken on scores rounded to this many digits (ties by id)
    score_digits: int = 9

    def weight(self, source: str) -> float:
        return float(self.weights.get(source, 0.0))


@dataclass(frozen=True)
class EvalConfig:
    recall_ks: tuple[int, ...] = RECALL_KS
    ndcg_ks: tuple[int, ...] = NDCG_KS
# ---- end of fixed values ----
