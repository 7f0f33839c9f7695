"""All queries of this package and the SQL that matches them."""

from . import bpe, centroids, classifier, fill_middle, html_extract, licenses, media, mixing, pii, quality_rules, simhash, token_counts, toxicity

MODULES = (bpe, quality_rules, token_counts, mixing, pii, media, licenses, classifier, simhash, html_extract, fill_middle, centroids, toxicity)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
