"""Dictionaries and thresholds.

Everything here is a parameter: operators take a ``Dictionaries`` object and
bindings pass stand-in values. The defaults below are fixed values that must
equal the reference application's for identical results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference application's behaviour)
# ---------------------------------------------------------------------------

# Known customer accounts, in match-priority order (first hit wins, so a longer
# name must come before a name it contains).
KNOWN_CUSTOMERS = (
    "Steelpoint Manufacturing", "Vanta Health Systems", "Crestline Wealth Group",
    "Crestline Wealth", "Coastal Living Co", "Maplewood Goods", "Helix Data",
    "Redwood Clinical", "Quantum Edge", "Trailhead Marketplace", "Axiom Labs",
    "Keystone Health", "Northstar Pharma", "Summit Trust", "Brightpath Commerce",
    "Ridgeline Logistics", "Bridgeport Health", "Clearwater Medical",
    "Blackridge Investments", "Ironworks Corp", "Harborview Banking",
    "Nimbus Platform", "Cobalt Software", "Pinnacle Insurance", "Pineridge Systems",
    "Silverline Brands", "Forge Industries", "Meridian Capital", "Atlas Precision",
    "Ironclad Financial", "Frostbyte AI", "Stratos Cloud", "Nova Retail Group",
)
COMPETITORS = ("Okta", "Duo", "Ping", "Entra")
PRODUCTS = ("Aegis Identity", "Aegis Detect", "Aegis Comply", "Aegis Protect",
            "Aegis Sentinel", "Aegis Compliance")
PRODUCT_PREFIX = "Aegis "
# First labels of mail domains that never name a customer.
IGNORED_DOMAINS = ("aegiscloud", "aegis", "gmail", "outlook", "hotmail", "yahoo")
UNKNOWN_CUSTOMER = "Unknown Customer"

# Call-type rules on the lower-cased title.
SUPPORT_TITLE_KEYWORDS = ("support case",)
INTERNAL_TITLE_KEYWORDS = ("sprint planning", "all hands", "team sync", "internal",
                           "soc 2", "audit prep", "planning discussion", "wrap")
# Speaker names that always count as staff.
STAFF_NAME_HINTS = ("sarah chen", "support agent", "engineer", "account manager")

# Deadline patterns, tried in this order, case-insensitive; "{1}" is group 1.
DEADLINE_PATTERNS = (
    (r"this week", "End of Week"),
    (r"by friday", "Friday"),
    (r"next week", "Next Week"),
    (r"within (\d+)\s*(business\s*)?days", "In {1} days"),
    (r"before the (\w+)\s*billing", "Before {1} billing"),
)
NO_DEADLINE = "N/A"
UNASSIGNED = "Unassigned"
DEFAULT_STATUS = "Open"
VALID_STATUSES = ("Open", "Closed", "Blocked")

# Churn-risk keywords (lower-case substrings of a sentence).
RISK_KEYWORDS = ("cancel", "pricing", "billing", "frustrated", "unresolved", "slow",
                 "crash", "broken")
# Case-sensitive topic patterns for the issue and feature lists.
ISSUE_TOPIC_PATTERNS = ("error", "failure", "outage", "bug", "latency", "delay", "dispute")
FEATURE_TOPIC_PATTERNS = ("request", "integration", "template", "upgrade", "automation")

# Question routing: first matching route wins (lower-case substrings).
ROUTES = (
    ("billing", ("billing", "summit trust", "invoice", "gregory", "fisk")),
    ("churn", ("churn", "risk", "unhappy", "complain")),
    ("competitors", ("competitor", "okta", "entra", "ping")),
)
DEFAULT_ROUTE = "search"

CALL_TYPES = ("Support", "Internal", "External")
TURN_SENTIMENTS = ("negative", "neutral", "positive")
# Risk tiers: right-closed bins (0,30], (30,60], (60,100].
RISK_TIERS = ((0.0, 30.0, "Low"), (30.0, 60.0, "Medium"), (60.0, 100.0, "High"))
# Sentiment bands on the 1-5 score (lower bounds, first match wins).
SENTIMENT_BANDS = ((4.0, "Excellent"), (3.2, "Positive"), (2.8, "Mixed"))
SENTIMENT_BAND_FLOOR = "Negative"
# Account risk thresholds on the unrounded average score and support calls.
ACCOUNT_RISK_HIGH = (2.6, 3)
ACCOUNT_RISK_MEDIUM = (3.4, 1)
RISK_ORDER = ("High", "Medium", "Low")
# Graph display priority by node type; everything else ranks after these.
NODE_TYPE_PRIORITY = ("Product", "Competitor", "Meeting", "Customer")

# Retrieval context layout: headers, one block per meeting, one line per
# quoted sentence, and the message when nothing matched.
CONTEXT_MEETINGS_HEADER = "--- RELEVANT MEETINGS ---"
CONTEXT_QUOTES_HEADER = "--- RELEVANT TRANSCRIPT QUOTES ---"
CONTEXT_MEETING_TEMPLATE = ("Meeting: {title} (ID: {meeting_id})\n"
                            "Type: {call_type}, Sentiment: {overall_sentiment} (Score: {sentiment_score})\n"
                            "Summary: {summary}\n")
CONTEXT_QUOTE_TEMPLATE = '[{title} - {time}s] {speaker}: "{sentence}"'
NO_MATCHING_MEETINGS = "No relevant meetings found"

# Sizes used by the serving queries.
PAGE_SIZE = 12
GRAPH_NODE_LIMIT = 120
SEARCH_MEETINGS = 10
SEARCH_SEGMENTS = 20
CONTEXT_MEETINGS = 5
CONTEXT_QUOTES = 10
CONTEXT_SOURCES = 3
TOP_ACCOUNTS = 12
TOP_TOPICS = 10
TIMELINE_DAYS = 30
TITLE_MATCH_SCORE = 10.0
SENTENCE_MATCH_SCORE = 1.0
ACTION_LABEL_CHARS = 40
HISTOGRAM_BINS = 15

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Dictionaries:
    """All overridable vocabularies in one value object."""

    customers: tuple[str, ...] = KNOWN_CUSTOMERS
    competitors: tuple[str, ...] = COMPETITORS
    products: tuple[str, ...] = PRODUCTS
    product_prefix: str = PRODUCT_PREFIX
    ignored_domains: tuple[str, ...] = IGNORED_DOMAINS
    support_keywords: tuple[str, ...] = SUPPORT_TITLE_KEYWORDS
    internal_keywords: tuple[str, ...] = INTERNAL_TITLE_KEYWORDS
    staff_hints: tuple[str, ...] = STAFF_NAME_HINTS
    deadline_patterns: tuple[tuple[str, str], ...] = DEADLINE_PATTERNS
    risk_keywords: tuple[str, ...] = RISK_KEYWORDS
    issue_patterns: tuple[str, ...] = ISSUE_TOPIC_PATTERNS
    feature_patterns: tuple[str, ...] = FEATURE_TOPIC_PATTERNS
    routes: tuple[tuple[str, tuple[str, ...]], ...] = ROUTES
    extra: dict = field(default_factory=dict)

    def with_(self, **changes) -> "Dictionaries":
        return replace(self, **changes)


DEFAULT = Dictionaries()
