"""Imports every operator's module, so that its query is registered."""

from flowspark.llm import (  # noqa: F401
    bpe, decontaminate, langid, line_dedup, near_dedup, pii, prefix_trie, simhash, suffix_dedup, topk,
    toxicity, warc, whitening,
)
from flowspark.llm.base import ORACLES, QUERIES  # noqa: F401
