"""Engine parameters.

Fixed values: weights, thresholds, caps and word lists below define the results
of the engine, so they are stated plainly here and nowhere else.
"""

# -- event types -------------------------------------------------------------
KNOWN_TYPES = [
    "session_start", "session_end", "objective", "decision", "artifact",
    "open_loop", "loop_closed", "checkpoint", "topic_shift", "reflection",
    "error", "assumption", "assumption_invalidated", "observation",
    "hypothesis", "contradiction", "output", "api_call", "command",
    "thread_open", "thread_merge", "thread_split", "attended",
    "concept_formed", "procedure_learned", "snapshot", "concept_retired",
    "branch_open", "branch_merge", "pattern_detected", "proc_executed",
    "procedure_retired", "meta_assessment", "pattern_promoted",
]
COGNITIVE_TYPES = [
    "objective", "decision", "observation", "reflection", "hypothesis",
    "contradiction", "assumption", "assumption_invalidated", "open_loop",
    "loop_closed", "topic_shift", "concept_formed", "procedure_learned",
    "concept_retired",
]
EXECUTION_TYPES = ["artifact", "output", "api_call", "error", "command"]
IMPORTANCE = {
    "objective": 0.90, "decision": 0.85, "reflection": 0.80,
    "open_loop": 0.80, "error": 0.75, "assumption_invalidated": 0.75,
    "artifact": 0.60, "assumption": 0.60, "loop_closed": 0.50,
    "topic_shift": 0.40, "checkpoint": 0.20, "session_start": 0.20,
    "session_end": 0.20,
}
DEFAULT_IMPORTANCE = 0.50
CURATOR = "memory"
CURATOR_TYPES = [
    "concept_formed", "procedure_learned", "concept_retired",
    "assumption_invalidated", "loop_closed", "snapshot", "pattern_detected",
    "procedure_retired", "meta_assessment", "pattern_promoted",
]
MAIN = "main"

# -- decay, salience, retrieval ------------------------------------------------
HALF_LIFE_DAYS = 7.0
W_IMPORTANCE, W_RECENCY, W_RELEVANCE, W_UNRESOLVED, W_LINKED = 0.30, 0.20, 0.25, 0.15, 0.10
GATED_TYPES = ["session_start", "session_end", "checkpoint"]
RERANK_CANDIDATES = 12
SEARCH_K = 6
VECTOR_K = 8
BM25_K1, BM25_B = 1.2, 0.75
DRIFT_WINDOW, DRIFT_THRESHOLD = 5, 0.82
DRIFT_SKIP_TYPES = [
    "attended", "checkpoint", "session_start", "session_end", "thread_open",
    "thread_merge", "thread_split",
]
LENS_BUDGET_CHARS = 6000

# -- graph -----------------------------------------------------------------------
EDGE_WEIGHT = {
    "causal": 1.0, "membership": 0.7, "thread_rel": 0.4, "concept": 0.6,
    "procedure": 0.6, "resonance": 0.5, "pattern": 0.55, "contradiction": 1.0,
}
DORMANT_DAYS = 14.0
RESONANCE_MIN_SHARED, RESONANCE_NORM, RESONANCE_MAX_PER = 2, 4.0, 6
# Concepts of a thread above which it forms no pairs; any value gives the same result.
RESONANCE_HUB = 64

# -- attention -------------------------------------------------------------------
HOPS = 2
BETA, GAMMA, HOP_DECAY, ALPHA = 0.6, 0.5, 0.6, 0.7
CAUSAL_BACK = 0.6
INHIBITION, INHIBITION_ROUNDS = 0.35, 4
UNRESOLVED_SEED, ACTIVE_SEED = 0.9, 0.5
CONCEPT_SEED, PROCEDURE_SEED, PATTERN_SEED = 0.55, 0.6, 0.5
ROLE_SEED, ASSIGNED_SEED = 0.55, 0.65
QUERY_FLOOR, QUERY_GAIN, SUBSTRING_SEED = 0.6, 0.4, 0.7
RESURFACE_BONUS, RESURFACE_FLOOR = 0.25, 0.4
REINFORCE_STEP, REINFORCE_CAP, REINFORCE_TOP = 0.06, 0.30, 3
INCUBATE_GAMMA, INCUBATE_ROUNDS, INCUBATE_SEED = 0.25, 2, 0.30
INCUBATE_FLOOR, INCUBATION_WEIGHT = 0.01, 0.5
OSC_INHIBIT, OSC_LIFT = 0.25, 0.20
ROLE_TYPES = {
    "planner": ["objective", "open_loop", "decision", "reflection", "topic_shift"],
    "coder": ["artifact", "command", "output", "error", "api_call"],
    "researcher": ["observation", "hypothesis", "contradiction", "assumption"],
    "memory": ["contradiction", "assumption", "assumption_invalidated",
               "open_loop", "reflection"],
}

# -- consolidation ---------------------------------------------------------------
PROC_LEARN_RATE = 0.25
STALE_DAYS, LOOP_AGING_DAYS, RESOLVE_MARGIN = 14.0, 7.0, 0.15
ABSTRACT_MIN_SUPPORT, ABSTRACT_MAX_NEW = 3, 12
ABSTRACT_IDF_MIN_DOCS, ABSTRACT_MAX_DF_RATIO = 8, 0.6
ABSTRACT_TYPES = ["objective", "decision", "observation", "hypothesis",
                  "assumption", "error", "artifact", "reflection"]
PROC_MIN_SUPPORT, PROC_MAX_NEW, PROC_MIN_STEPS = 2, 8, 2
PROC_STEP_TYPES = ["command", "artifact", "api_call", "decision"]
PROC_TRIGGER_TYPES = ["objective", "open_loop", "error"]
PROC_RETIRE_SCORE, PROC_RETIRE_MIN_USES, PROC_RETIRE_MAX = 0.25, 3, 10
PRUNE_MAX = 8
PATTERN_MIN_SUPPORT, PATTERN_MAX_NEW, MOTIF_LEN, BOTTLENECK_MIN_DEPS = 2, 10, 3, 3
REASON_TYPES = ["objective", "hypothesis", "observation", "contradiction",
                "decision", "reflection", "open_loop", "loop_closed", "assumption"]
FAILURE_TYPES = ["assumption_invalidated", "contradiction", "error"]
PROMOTE_CONF_FLOOR, PROMOTE_MAX_NEW = 0.70, 8
META_RECALL_FLOOR, META_PROC_FLOOR = 0.34, 0.40
META_POLLUTION_CEIL, META_INSTABILITY_CEIL = 0.60, 0.34
META_POLLUTION_FLOOR, META_CHURN_WINDOW = 0.05, 40
FAILED_OUTCOMES = ["failure", "fail", "error", "0"]

# -- word lists --------------------------------------------------------------------
TOKEN_STOPS = [
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "for", "of", "and",
    "or", "but", "not", "with", "this", "that", "are", "was", "be", "by",
    "from", "as", "into", "about", "used", "can", "will", "has", "have", "had",
    "its", "which", "when", "how", "what",
]
TERM_STOPS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "have", "has",
    "was", "are", "were", "will", "would", "should", "could", "than", "then",
    "them", "they", "their", "what", "when", "where", "which", "while", "about",
    "after", "before", "over", "under", "your", "you", "our", "but", "not",
    "all", "any", "can", "out", "via", "use", "used", "using", "per", "its",
]

# Seqs per block in two-level ordered scans: a block is one bounded task-side
# window, and the per-block summaries of 2**40 events still fit one task.
ORDER_BLOCK = 1 << 20
# References carried inline by one appended event; longer lists span several.
EVIDENCE_CHUNK = 1000
