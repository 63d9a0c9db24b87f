"""Word lists, maps, patterns, thresholds and message texts.

These decide results, so they are stated as plain text in one place.  Every
operator takes them as a parameter with the value here as its default.
"""

# --- fixed values: placeholder strings that mean "missing" ------------------
MISSING_TOKENS = ("", "unknown", "none", "null", "n/a", "na", "-")
EVENT_MISSING_TOKENS = ("?", "", "unknown", "none", "null", "n/a", "na", "-")
PROFILE_MISSING_TOKENS = ("unknown", "none", "n/a", "-", "")

# --- fixed values: priority vocabularies ------------------------------------
ISSUE_PRIORITY = {
    "highest": "P1",
    "blocker": "P1",
    "high": "P2",
    "medium": "P3",
    "low": "P4",
    "lowest": "P4",
}
EVENT_PRIORITY = {
    "1 - critical": "P1",
    "2 - high": "P2",
    "3 - moderate": "P3",
    "4 - low": "P4",
}
BINARY_PRIORITY = {"P1": "High", "P2": "High", "P3": "Low", "P4": "Low"}

# --- fixed values: lifecycle states of the event log ------------------------
INCIDENT_STATES = (
    "New",
    "Active",
    "Awaiting User Info",
    "Awaiting Problem",
    "Awaiting Vendor",
    "Awaiting Evidence",
    "Resolved",
    "Closed",
)

# --- fixed values: timestamp formats (Spark pattern letters) ----------------
EVENT_TS_FORMAT = "d/M/yyyy H:mm"
ISSUE_TS_FORMATS = ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")

# --- fixed values: unified table --------------------------------------------
UNIFIED_COLUMNS = (
    "ticket_id",
    "description",
    "category",
    "category_scheme",
    "priority",
    "resolution",
    "status",
    "source",
)
MIN_DESCRIPTION_WORDS = 3
MIN_RESOLUTION_WORDS = 5
# Known only after a ticket is closed, so never a model feature.
LEAK_COLUMNS = (
    "resolution",
    "status",
    "has_usable_resolution",
    "resolution_word_count",
    "retrievable",
)

# --- fixed values: report thresholds ----------------------------------------
CLASS_SIZES = (2, 5, 10, 20, 50)
LENGTH_QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.99, 0.999, 1.0)
WORD_CAPS = (128, 256, 512, 1024)
CONTENT_FLOORS = (5, 10, 20, 30, 50)

# --- fixed values: text limits ----------------------------------------------
MAX_WORDS = 512
MIN_WORDS_TO_SPLIT = 20
MIN_TICKET_WORDS = 3
MAX_TICKET_WORDS = 2000
MIN_SENTENCE_WORDS = 3
MIN_CONTENT_WORDS = 5
SENTENCE_SHARE = 0.02

# --- fixed values: training and evaluation ----------------------------------
MIN_CLASS_SIZE = 10
TEST_SIZE = 0.2
SEED = 42
N_SPLITS = 5
N_REPEATS = 5
N_PERMUTATIONS = 100
MIN_CALIBRATION_CLASS = 15
LOGREG_MAX_ITER = 1000
LINSVC_MAX_ITER = 5000
CONFIDENCE_FLOORS = {"category": 0.35, "priority": 0.65}
DEFAULT_CONFIDENCE_FLOOR = 0.35

# --- fixed values: retrieval, topics, recommendation ------------------------
TOP_K = 5
SIMILARITY_FLOOR = 0.45
MARGINAL_BAND = 0.10
RECALL_AT = (1, 3, 5, 10)
TOPIC_K_RANGE = tuple(range(3, 16))
TOPIC_RESTARTS = 10
TOPIC_MAX_ITER = 300
TOPIC_TERMS = 6
TOPIC_LABEL_TERMS = 3
MAX_STEPS = 6
MIN_STEP_WORDS = 4
MAX_EVIDENCE = 4
EVIDENCE_DESCRIPTION_CHARS = 600
EVIDENCE_RESOLUTION_CHARS = 1200
FEEDBACK_DESCRIPTION_CHARS = 300
BRIEF_WORDS = 10
HIT_PAYLOAD = (
    "ticket_id",
    "description",
    "category",
    "priority",
    "resolution",
    "source",
)

# --- fixed values: greeting and sign-off fragments, in order of removal -----
EDGE_PATTERNS = (
    r"^\s*(greetings|dears?|hi|hello)\b[,:]?\s*",
    r"\b(best\s+)?regards\s*[,.]?\s*(ph_\w+\s*)*$",
    r"\bthanks?\s+(and\s+)?(regards)?\s*[,.]?\s*$",
)
EDGE_CHARS = " ,.;:"

# --- fixed values: sentences about process, not action ----------------------
PROCESS_PATTERNS = (
    r"\bwe will\b",
    r"\bwe are (following|checking|waiting|communicat)",
    r"\bwaiting (for )?your\b",
    r"\bkind(ly)? reminder\b",
    r"\bplease (advise|confirm|suggest a time|join the below)\b",
    r"\bticket (is |has been )?(assigned|closed|resolved)\b",
    r"\b(close|closing) (this|the) ticket\b",
    r"\bconsider (it|this ticket) (as )?(resolved|closed)\b",
    r"\bopen a new ticket\b",
    r"\bany update\b",
    r"\bwhat is the error\b",
)

# --- fixed values: verbs that make a sentence a step ------------------------
ACTION_VERBS = (
    "check", "verify", "clear", "restart", "reboot", "reset",
    "add", "remove", "delete", "update", "upgrade", "install",
    "reinstall", "configure", "enable", "disable", "try",
    "run", "set", "change", "replace", "apply", "deploy",
    "connect", "login", "log in", "select", "click", "navigate",
    "ensure", "make sure", "send us", "provide", "use",
)

# --- fixed values: message texts --------------------------------------------
ERR_BLANK = "Please describe the issue."
ERR_SHORT_TICKET = (
    "Too short to analyse - %d word(s). Describe the problem in at least %d."
)
ERR_SHORT_DESCRIPTION = "Description too short to analyse."
WARN_NO_HITS = "No historical incidents retrieved."
WARN_ALL_WEAK = (
    "All %d match(es) are weak (below %s). Shown as leads for review, "
    "not as precedents."
)
WARN_FEW_STRONG = (
    "Only %d strong match(es). The recommendation rests on thin evidence."
)
WARN_MARGINAL = (
    "The closest match is only marginally above the similarity threshold."
)
WARN_NO_STEPS = (
    "Strong matches were found, but none of their resolutions contained "
    "actionable steps."
)
WARN_LOW_CONFIDENCE = (
    "The %s prediction is low-confidence and may be unreliable."
)
ALWAYS_ON_WARNINGS = ("category prediction is low-confidence",)
WARN_NOT_GROUNDED = (
    "LLM generation skipped: no match strong enough to ground a "
    "recommendation."
)
WARN_UNAVAILABLE = (
    "LLM unavailable (%s). Showing retrieval-only recommendation."
)
WARN_FAILED = (
    "LLM call failed (%s). Falling back to retrieval-only recommendation."
)
WARN_GENERATED = (
    "AI-generated from historical incidents. Not a verified fix - validate "
    "before applying."
)
ERR_NO_JSON = "no JSON object in response"
EXPLAIN_STEPS = (
    "These steps were taken from %d historical incident(s) with similar "
    "descriptions. They are what engineers did before, not a verified fix "
    "for this case."
)
EXPLAIN_NO_STEPS = (
    "No actionable steps could be extracted from the retrieved incidents."
)
EVIDENCE_BLOCK = (
    "--- INCIDENT %d (similarity %.3f, priority %s) ---\n"
    "REPORTED:\n%s\n\nWHAT ENGINEERS DID:\n%s"
)
PROMPT = (
    "NEW TICKET:\n%s\n\nPREDICTED PRIORITY: %s\n\n"
    "%d similar historical incidents were retrieved:\n\n%s\n\n"
    "Produce the JSON described in your instructions."
)

# --- fixed values: default stop words (Spark's English list, whole words) ---
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing would should could ought a
    an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than
    too very can will just don now cannot
    """.split()
)
