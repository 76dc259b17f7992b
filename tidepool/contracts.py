"""Record shapes and the fixed values results depend on.

Everything under "Fixed values" must equal the behaviour being rebuilt for
results to agree; it is stated plainly and in natural order.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Enrichment record schema (required / optional fields and per-field specs).
ENRICHMENT_SCHEMA = {
    "required_fields": ["enriched", "summary", "topics", "entities"],
    "optional_fields": ["key_takeaways"],
    "field_specs": {
        "enriched": {"type": "bool", "const": True},
        "summary": {"type": "str", "min_len": 200, "max_len": 20000},
        "topics": {"type": "dict", "subkeys": {"primary": "list", "secondary": "list"}},
        "entities": {"type": "dict", "subkeys": {"organizations": "list", "people": "list"}},
        "key_takeaways": {"type": "list", "max_items": 7},
    },
}
# List fields / subkeys whose elements must be strings after sanitising.
STRING_LIST_FIELDS = ("key_takeaways",)
STRING_LIST_SUBKEYS = {"topics": ("primary", "secondary"), "entities": ("organizations", "people")}
# Entity groups that are normalised (alias + case-insensitive dedup).
ENTITY_GROUPS = ("organizations", "people")

# Word-count thresholds.
MIN_BODY_WORDS_FETCH = 100      # fetched body replaces the excerpt / listing page kept
FULL_CONTENT_WORDS = 500        # classify_content: "full"
DEFAULT_MIN_BODY_WORDS = 200    # classify_content: "truncated" lower bound

# File-name stem rules.
TITLE_MAX_LEN = 100
URL_HASH_LEN = 6
UNTITLED_STEM = "untitled"

# Default listing link pattern (article slugs: leading slash, 9+ safe chars).
DEFAULT_LISTING_LINK_PATTERN = r'href="(/[a-z0-9][a-z0-9/_-]{8,})"'

# Default per-source item limit.
DEFAULT_SCRAPE_LIMIT = 10

# Prompt limits and output contract.
PROMPT_MAX_CHARS = 50000
OUTPUT_CONTRACT = "Return only one fenced ```yaml block. No preamble."

# Query defaults.
WINDOW_LIMIT = 50
SNIPPET_CHARS = 120
UNCATEGORIZED = "(uncategorized)"
UNTITLED_ENTRY = "(untitled)"

# Link verification tiers and their labels in the digest.
TIER_LABELS = {
    "live": "✓ live",
    "stale": "⚠ stale",
    "dead": "✗ dead",
    "blocked": "✗ blocked",
}
DEAD_STATUS = (404, 410)

# Response body cap in bytes.
MAX_BODY_BYTES = 10_000_000

# Hosts that are always refused (cloud metadata endpoints).
METADATA_HOSTS = ("metadata.google.internal", "169.254.169.254")

# Hosts a video listing may be read from (https only, exact netloc).
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "youtu.be")

# Third-party tracker hosts (a request whose host contains one is dropped)
# and resource types never needed for text extraction.
TRACKER_HOSTS = (
    "google-analytics.com", "googletagmanager.com", "doubleclick.net",
    "facebook.net", "hotjar.com", "segment.io", "segment.com",
    "amplitude.com", "mixpanel.com", "intercom.io", "branch.io",
    "fullstory.com", "newrelic.com", "cdn.optimizely.com",
)
BLOCKED_RESOURCE_TYPES = ("image", "media", "font")

# IPv4 networks refused by the URL guard: private, loopback, link-local,
# reserved and multicast ranges as the Python 3.13 standard library defines
# them, with its two documented exceptions.
BLOCKED_IPV4_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4", "255.255.255.255/32",
)
ALLOWED_IPV4_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")

# Default per-article cost and the per-tier price table (USD per article).
DEFAULT_ARTICLE_COST = 0.032
TIER_PRICES = {"small": 0.011, "default": 0.032, "large": 0.16}

# Markdown document frontmatter keys written at ingest, in order.
FRONTMATTER_KEYS = ("title", "source", "url", "published", "tags", "perspective")

# Default run date for fixtures and checked queries (never the wall clock).
RUN_DATE = "2024-02-01"

# ---------------------------------------------------------------------------
# Derived (computed from the fixed values above)
# ---------------------------------------------------------------------------


def _ranges(networks):
    out = []
    for cidr in networks:
        net = ipaddress.ip_network(cidr)
        out.append((int(net.network_address), int(net.broadcast_address)))
    return tuple(out)


BLOCKED_IPV4_RANGES = _ranges(BLOCKED_IPV4_NETWORKS)
ALLOWED_IPV4_RANGES = _ranges(ALLOWED_IPV4_EXCEPTIONS)

ALLOWED_KEYS = tuple(ENRICHMENT_SCHEMA["required_fields"] + ENRICHMENT_SCHEMA["optional_fields"])

# ---------------------------------------------------------------------------
# Record shapes
# ---------------------------------------------------------------------------

ITEM_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("perspective", T.StringType()),
    T.StructField("scrape_limit", T.IntegerType()),
    T.StructField("scrape_full_content", T.BooleanType()),
    T.StructField("throttle_group", T.StringType()),
    T.StructField("throttle_seconds", T.DoubleType()),
    T.StructField("kf_mode", T.StringType()),
    T.StructField("kf_include", T.ArrayType(T.StringType())),
    T.StructField("listing_link_pattern", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("enriched", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("topics", T.StructType([
        T.StructField("primary", T.ArrayType(T.StringType())),
        T.StructField("secondary", T.ArrayType(T.StringType())),
    ])),
    T.StructField("entities", T.StructType([
        T.StructField("organizations", T.ArrayType(T.StringType())),
        T.StructField("people", T.ArrayType(T.StringType())),
    ])),
    T.StructField("key_takeaways", T.ArrayType(T.StringType())),
])

INDEX_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("primary_topics", T.ArrayType(T.StringType())),
    T.StructField("secondary_topics", T.ArrayType(T.StringType())),
    T.StructField("entities", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("summary", T.StringType()),
    T.StructField("enriched", T.BooleanType()),
])

# ---------------------------------------------------------------------------
# Validation / writeback messages ({…} are filled per record)
# ---------------------------------------------------------------------------
MSG_NOT_MAPPING = "enrichment output is not a mapping"
MSG_NO_YAML = "could not extract a YAML mapping from model output"
MSG_MISSING = "Missing required field: '{field}'"
MSG_WRONG_TYPE = "Field '{field}' has wrong type: expected {expected}, got {got}"
MSG_CONST = "Field '{field}' must equal {const}, got {value}"
MSG_TOO_SHORT = "Field '{field}' is too short: minimum {min_len} characters, got {n}"
MSG_TOO_LONG = "Field '{field}' is too long: maximum {max_len} characters, got {n}"
MSG_MAX_ITEMS = "Field '{field}' exceeds max_items={max_items}: got {n} items"
MSG_MISSING_SUBKEY = "Field '{field}' is missing required subkey '{subkey}'"
MSG_SUBKEY_TYPE = "Field '{field}.{subkey}' has wrong type: expected {expected}"
MSG_NOT_STRING = "topics.primary item {item} is not a string"
MSG_OFF_VOCAB = "topics.primary item '{item}' not in vocab"
