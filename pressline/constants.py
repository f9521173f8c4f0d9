"""Fixed values and default parameters.

The values under "FIXED VALUES" must equal the ones the original pipeline uses,
or results (marked-up text, token counts, dimension grids) differ. They are
listed as plain text, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Markup words. "PARAGRAH" is spelled this way on purpose: it is data.
PARAGRAPH_WORD = "PARAGRAH"
NEWLINE_WORD = "NEW_LINE"
HEADLINE_WORD = "HEADLINE"
BODY_WORD = "BODY"

# The 24 publishers the listing ingest walks, in the order it walks them.
CORE_SOURCES = [
    "abc-news", "al-jazeera-english", "associated-press", "bbc-news", "bloomberg",
    "breitbart-news", "buzzfeed", "cbc-news", "cbs-news", "cnn", "fox-news",
    "independent", "msnbc", "nbc-news", "politico", "reuters", "the-huffington-post",
    "the-wall-street-journal", "the-washington-post", "the-washington-times", "time",
    "usa-today", "vice-news", "wired",
]

# The four publishers the analytics and training jobs use by default.
CURRENT_SOURCES = ["abc-news", "associated-press", "breitbart-news", "bbc-news"]

# Query dates: every day from the first to the last date, inclusive (41 days).
FIRST_QUERY_DATE = "2020-04-22"
LAST_QUERY_DATE = "2020-06-01"

# Listing page size: the newest 100 articles per (publisher, date).
LISTING_PAGE_SIZE = 100

# Caption sentences ("FILE - ..." photo captions) removed from scraped bodies.
CAPTION_PATTERN = r"([^.]*?FILE - [^.]*\.)"
CAPTION_MARKER = "FILE - "

# Confusion-matrix smoothing in precision / recall denominators.
METRIC_EPSILON = 1e-7

# Run-record timestamp text, as day-month-year (hour:minute:second.micros).
RUN_DATE_FORMAT = "dd-MMM-yyyy (HH:mm:ss.SSSSSS)"

# Training-job defaults.
DEFAULT_MAX_WORDS = 1000
DEFAULT_MIN_WORDS = 500
DEFAULT_MIN_DOCS = 300
DEFAULT_SEQUENCE_LENGTH = 1024
DEFAULT_ENCODE_LENGTH = 100
DEFAULT_TRAIN_SHARE = 0.7
DEFAULT_SPLIT_SHARE = 0.9
DEFAULT_BLOCK_SIZE = 512
LOSS_REPORT_EVERY = 200

# ---------------------------------------------------------------------------
# Engine-side settings (ours, not the original pipeline's)
# ---------------------------------------------------------------------------

# Largest small side (rows) that a join may broadcast after its size was checked.
MAX_BROADCAST_ROWS = 200_000
# ... and its largest size (bytes of its rows as JSON text, an upper estimate).
MAX_BROADCAST_BYTES = 64 << 20
DEFAULT_SEED = "pressline"
