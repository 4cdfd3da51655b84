"""All queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import byte_bpe, embedding_join, html_text, jaccard_join, lloyd, lm_score, media, merkle, packing, secrets, substrings, token_counts, toxicity

_MODULES = (media, secrets, toxicity, lm_score, embedding_join, jaccard_join, token_counts, packing, byte_bpe, html_text, lloyd, merkle, substrings)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
