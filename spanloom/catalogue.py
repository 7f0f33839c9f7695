"""All queries outside the llm subpackage, and the SQL that each must equal."""

from __future__ import annotations

from .plans import assembly, dialogue, interchange, lexical, merging, records, retrieval, review, signals, streams, temporal, texts

MODULES = (lexical, temporal, signals, retrieval, texts, records, assembly, merging, streams, dialogue, review, interchange)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
