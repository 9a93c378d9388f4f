"""Scoring weights, budgets, retention periods, word lists and patterns.

Everything here must keep its exact value for results to be right.
"""

from __future__ import annotations

# Memory layers, in evaluation order, with token budget and description.
LAYERS = ("L1", "L2", "L3", "L4")
LAYER_BUDGET = {"L1": 4000, "L2": 1000, "L3": 2000, "L4": 500}
LAYER_NAME = {"L1": "working", "L2": "episodic", "L3": "semantic", "L4": "procedural"}
FIXED_BUDGET = {"system_prompt": 2000, "current_message": 1000, "response_headroom": 4000}
TOTAL_BUDGET = 128000

# Relevance weights.
W_RECENCY, W_SEMANTIC, W_IMPORTANCE, W_SIGNAL = 0.25, 0.40, 0.25, 0.10
W_DENSE, W_LEXICAL = 0.6, 0.4
PIN_BOOST = 0.2
DROP_BELOW = 0.20
SECONDS_PER_DAY = 86400.0

# Lexical scoring.
BM25_K1, BM25_B = 1.5, 0.75
STOP_WORDS = (
    "a about all an and are as at be been but by did do for from had has have he her him his "
    "if in into is it its not of on or our out she so than that the their then they this to up "
    "was we what when which who will with your"
).split()

# Diversification and candidate generation.
MMR_LAMBDA = 0.6
TOP_K = 10
OVERFETCH = 3
SKILL_TOP_K = 3

# Chunking.
EXPIRED_REASON = "ttl expired"
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_THRESHOLD = 600, 80, 600
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")

# Working-memory window.
WINDOW_SIZE = 20

# Retention.
BASE_TTL_DAYS = {"L2": 30, "L3": 90}
GRACE_DAYS = 30
TTL_IMPORTANCE_FACTOR = 3.0
EXPIRING_WITHIN_DAYS = 14
IMMUNE_LAYER = "L4"
IMMUNE_TYPE = "skill"

# Collections.
COLLECTION_PREFIX = "ctx_"
SHARED_SLUG = "users"
DEFAULT_SLUG = "default"

# Characters Python's str.strip()/split() treat as whitespace.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same set as a regex class that Java and RE2 both accept.
WS_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Prompt-injection patterns in application order: (pattern, ignore case).
REDACTED = "[REDACTED]"
INJECTION_PATTERNS = (
    (rf"ignore{WS_CLASS}+(all{WS_CLASS}+)?previous{WS_CLASS}+instructions?", True),
    (rf"you{WS_CLASS}+are{WS_CLASS}+now{WS_CLASS}+a", True),
    (rf"(system|assistant|user){WS_CLASS}*:{WS_CLASS}*", True),
    (r"<\|[^\n]*?\|>", False),
    (r"\[INST\]|\[/INST\]", False),
    (rf"###{WS_CLASS}*(instruction|system|prompt)", True),
)

# Parser routing by suffix.
MARKDOWN_SUFFIXES = (".md", ".mdx", ".markdown")
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".cpp", ".c",
    ".rb", ".php", ".swift", ".kt", ".yml", ".yaml", ".toml", ".json",
)
DEFAULT_SECTION = "Introduction"
MARKDOWN_HEADING = rf"^(#{{1,6}}){WS_CLASS}+(.+)$"
CODE_BOUNDARY = (
    r"^(?:export\s+)?(?:async\s+)?"
    r"(?:function|class|def|fn|func|pub fn|pub async fn)\s+(\w+)"
)
HTML_DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form")
HTML_HEADINGS = ("h1", "h2", "h3", "h4")
HTML_BLOCKS = ("p", "li", "pre", "code")
HTML_MAIN_ID = r"content|main|body"
DOCSTRING_CHARS = 200
PARAGRAPHS_PER_CHUNK = 3
LIST_PREVIEW_CHARS = 200

# Allowed enumeration values.
TASK_STATUS = ("pending", "in_progress", "done", "cancelled")
TASK_PRIORITY = ("low", "medium", "high")

# Summaries.
SUMMARY_TOKENS = 500
SUMMARY_IMPORTANCE = 0.8
SUMMARY_PROMPT = (
    "You are a memory summarizer. Given the following conversation messages, produce:\n"
    "1. A concise summary (max {max_tokens} tokens)\n"
    "2. A JSON list of key entities in format: "
    '[{"name": "", "type": "", "value": "", "confidence": 0.9}]\n'
    "\n"
    "Entity types: project, language, preference, decision, fact, person\n"
    "\n"
    "Messages:\n"
    "{messages}\n"
    "\n"
    "Respond in this exact format:\n"
    "SUMMARY: <summary text>\n"
    "ENTITIES: <json array>"
)
