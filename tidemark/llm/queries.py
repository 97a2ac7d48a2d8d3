"""All queries of this subpackage, and their SQL."""

from tidemark.llm import fingerprints, jaccard, lines, mixing, neighbours, pii, quality, substrings, tokens

_MODULES = (fingerprints, jaccard, neighbours, substrings, lines, tokens, mixing, quality, pii)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
