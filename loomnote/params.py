"""Constants of the operators. Those under "fixed values" must be exactly these for results to be right."""

# BM25 and fusion.
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
SIGNAL_CAP = 50
MIN_VECTOR_SCORE = 0.25

# Words without weight in lexical queries.
STOPWORDS = "a an and are as at be by for from in is it no of on or the to with".split()

# Words without weight in title matching.
TITLE_STOPWORDS = "the and for with from into this that have has are was were not no".split()

# Factors of the metadata prior.
STATUS_FACTOR = {"archived": 0.0, "superseded": 0.1}
LIFECYCLE_FACTOR = {"canonical": 1.0, "consolidated": 0.9, "proposed": 0.7, "observed": 0.85, "linked": 0.85, "stale": 0.5, "disputed": 0.3, "dormant": 0.4, "archived": 0.0}
VALIDATION_FACTOR = {"user": 1.2, "auto": 1.05, "challenged": 0.4, "revoked": 0.0, "unvalidated": 1.0}
DEFAULT_CONFIDENCE, RECENCY_DAYS, RECENCY_BOOST = 0.7, 30, 0.1

# Weights of the ranked streams by intent (bm25, vector, exact, graph, graph-spread, metadata).
INTENT_WEIGHTS = {
    "decision": (0.8, 1.0, 1.0, 1.3, 1.1, 1.4),
    "procedure": (0.7, 1.0, 0.9, 1.0, 0.8, 1.3),
    "episodic": (1.2, 1.0, 0.8, 0.7, 0.7, 1.1),
    "preference": (0.9, 1.1, 1.0, 0.6, 0.6, 1.5),
    "current-truth": (0.9, 1.0, 1.0, 1.0, 0.7, 1.6),
    "code-context": (1.4, 0.9, 1.3, 1.0, 0.6, 0.8),
    "open-ended": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
}

# Edge classes, and weights of spreading activation.
REASONING_EDGES = ["uses", "depends_on", "caused_by", "fixed_by", "contradicts", "supersedes", "learned_from", "tested-with"]
PROVENANCE_EDGES = ["derived_from", "mentioned_in", "mentions"]
EDGE_WEIGHTS = {
    "uses": 1.0, "depends_on": 1.0, "caused_by": 0.95, "fixed_by": 0.95, "contradicts": 0.9, "supersedes": 0.85, "learned_from": 0.85,
    "mentioned_in": 0.35, "mentions": 0.35, "derived_from": 0.25, "linked": 0.1, "wikilink": 0.1,
}
ACTIVATION_DECAY, INHIBITION, ACTIVATION_EPSILON, ACTIVATION_ROUNDS = 0.6, 0.15, 0.01, 5

# Intents by pattern, the first match decides.
INTENT_RULES = [
    (r"^how (do|can|to|should) (i|we|you)\b", "procedure", 0.85),
    (r"^what.*\b(decide|decision|chose|chosen)\b", "decision", 0.85),
    (r"^why (did|do|does|is).+\b(instead|over|rather than)\b", "decision", 0.8),
    (r"^when (did|does)\b", "episodic", 0.8),
    (r"\b\d{4}-\d{2}-\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}\b", "episodic", 0.8),
    (r"\b(?:user|i)\b.*\b(prefer|preference|like)\b", "preference", 0.75),
    (r"(?:\b(currently|right now|today|now)\b.*\b(is|are|status)\b|\b(is|are|status)\b.*\b(currently|right now|today|now)\b)", "current-truth", 0.75),
    (r"\b(show me|where is|find)\b.+\b(code|implementation|function|file)\b", "code-context", 0.8),
    (r"\b(error|exception|traceback|crash|fail)\b", "procedure", 0.7),
]

# Shapes of secrets, replaced in this order; $1 is kept.
SECRET_RULES = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"(?i)([\"']?[A-Z0-9_-]*(?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|SECRET|PASSWORD)[\"']?\s*:\s*)(?![\"']?\[REDACTED\])(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\s,}\]]+)", '$1"[REDACTED]"'),
    (r"(?i)\b([A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*\s*=\s*)(?![\"']?\[REDACTED\])(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|\S+)", "$1[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED]"),
    (r"\bgh[posru]_[0-9A-Za-z]{36,}\b", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "[REDACTED]"),
    (r"\b(?:AKIA|ASIA|AGPA|AROA|AIDA|ANPA|ANVA|AIPA|ABIA|ACCA)[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
]
