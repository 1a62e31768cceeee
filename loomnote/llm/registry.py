"""The queries and oracle SQL of this subpackage, by name."""

from . import bpe, exact_dedup, fim, golay_simhash, html_mincut, langid, mixing, ordinal_quality, partenum, runs, toxicity, voronoi_knn, warc_fixity

MODULES = (ordinal_quality, voronoi_knn, exact_dedup, mixing, bpe, toxicity, html_mincut, langid, golay_simhash, warc_fixity, partenum, fim, runs)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
