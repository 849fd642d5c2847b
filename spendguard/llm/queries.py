"""Import every operator, so that its query is registered."""

from spendguard.llm import (  # noqa: F401
    centroids,
    exact_bpe,
    extraction,
    importance,
    jaccard,
    language,
    language_model,
    lattice,
    licenses,
    mixing,
    packing,
    token_counts,
    topk,
)
from spendguard.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
