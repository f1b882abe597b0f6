"""Defaults that define the semantics of the operators.

They are only used as keyword defaults, so every job can override them.
"""

# Curation and sampling.
TOP_QUEUES = 10
DATASET_LANGUAGE = "en"
KB_ROWS = 0
TEST_FRACTION = 0.15
TRAIN_MAX_ROWS = 2000
SEED = 42

# Retrieval and grounding.
TOP_K = 3
SIMILARITY_THRESHOLD = 0.35
SNIPPET_CHARS = 300

# Text models.
SUMMARY_MIN_CHARS = 40
TITLE_CHARS = 48

# Operations log.
CACHE_TTL_SECONDS = 3600
FEEDBACK_SUBTASK = "feedback"
DEFAULT_TITLE = "New incident"

# The columns of the stored tables.
RAW_TICKET_COLUMNS = ("subject", "body", "answer", "type", "queue", "priority", "language")
TAG_COLUMNS = tuple(f"tag_{i}" for i in range(1, 9))
KB_COLUMNS = ("ticket_id", "title", "description", "resolution", "category", "type", "priority", "tags")
REQUEST_LOG_COLUMNS = ("id", "ts", "subtask", "model", "latency_ms", "tokens_in", "tokens_out",
                       "cost_usd", "status", "cache_hit", "error", "extra")

# Queues known by default.
DEFAULT_QUEUES = (
    "Billing and Payments", "Customer Service", "General Inquiry", "Human Resources",
    "IT Support", "Product Support", "Returns and Exchanges", "Sales and Pre-Sales",
    "Service Outages and Maintenance", "Technical Support",
)
