"""Configuration of a retrieval pipeline: one immutable value, its defaults, merging, and its fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    chunking_strategy: str = "recursive_chars"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedding_model: str = "hash"
    retrieval_method: str = "hybrid"
    retrieval_alpha: float = 0.5
    retrieval_top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    use_query_expansion: bool = False
    query_transformation: str = "none"
    num_variations: int = 3
    use_hyde: bool = False
    hyde_method: str = "standard"
    hyde_num_docs: int = 1
    hyde_weight: float = 0.3
    hyde_prompts: str = "typed"
    use_reranking: bool = True
    reranking_method: str = "cross_encoder"
    reranking_stages: tuple[str, ...] = ("semantic", "keyword", "cross_encoder")
    reranking_mode: str = "fused"
    diversity_alpha: float = 0.5
    use_mmr: bool = False
    scorer: str | None = None
    #: Weights of the trained scorer, from ``ranker.fit``.
    ranker_weights: tuple[float, ...] = ()
    answer_mode: str = "extractive"
    prompt_template: str = "plain"
    language_model: str = "echo"
    conversational: bool = False
    history_turns: int = 3

    #: A change of one of these needs a new index.
    INDEXED = ("chunking_strategy", "chunk_size", "chunk_overlap", "embedding_model")

    @classmethod
    def merged(cls, *overlays: dict) -> Config:
        """Defaults under user values; unknown names are an error."""
        known = {f.name for f in fields(cls)}
        values: dict = {}
        for overlay in overlays:
            if unknown := set(overlay) - known:
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            values |= {k: tuple(v) if isinstance(v, list) else v for k, v in overlay.items()}
        return cls(**values)

    @classmethod
    def from_json(cls, text: str) -> Config:
        known = {f.name for f in fields(cls)}
        return cls.merged({k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    #: Strategies that take a size and an overlap.
    SIZED = ("fixed_tokens", "token", "recursive_chars", "paragraph_chars", "chars")
    #: Candidates that reach the rerankers.
    FETCH = 20

    # What configurations can share, as values: equal values need the work once.

    def chunking(self) -> tuple:
        return (self.chunking_strategy, self.chunk_size, self.chunk_overlap) if self.chunking_strategy in self.SIZED else (self.chunking_strategy, 0, 0)

    def asking(self) -> tuple:
        """How queries become variants."""
        if self.query_transformation not in ("none", "hyde"):
            model = self.language_model if self.query_transformation == "model" else ""
            return self.query_transformation, False, self.num_variations if self.query_transformation == "multi_query" else 0, model
        return "none", self.use_query_expansion, 0, ""

    def hyde(self) -> tuple:
        """How hypothetical documents make a query's vector."""
        on = self.use_hyde or self.query_transformation == "hyde"
        return (self.hyde_method, self.hyde_num_docs, self.hyde_weight, self.hyde_prompts, self.language_model) if on else ()

    def depth(self) -> int:
        """How many documents retrieval passes on."""
        return max(self.FETCH, self.retrieval_top_k) if self.use_reranking else self.retrieval_top_k

    def reranked(self) -> tuple:
        """How candidates are reranked; stages that compare documents by their id alone keep to one chunking."""
        if not self.use_reranking:
            return ()
        own = self.chunking() if self.reranking_method == "multi_stage" else ()
        return self.reranking_method, self.reranking_stages, self.reranking_mode, self.diversity_alpha, self.scorer, self.ranker_weights, self.language_model, self.retrieval_top_k, own

    def fingerprint(self) -> str:
        own = {k: getattr(self, k) for k in self.INDEXED}
        return hashlib.md5(json.dumps(own, sort_keys=True).encode()).hexdigest()

    def needs_rebuild(self, other: Config) -> bool:
        return self.fingerprint() != other.fingerprint() or self.retrieval_method != other.retrieval_method

    def with_(self, **changes) -> Config:
        return replace(self, **changes)
