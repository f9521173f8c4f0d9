"""Article extraction from stored HTML pages, as a chain of built-in regex
expressions (RE2-compatible patterns, so DuckDB can check the same rule).

Rule: title = text of ``<title>`` (else of ``<h1>``); body = the ``<article>``
element with scripts, styles, comments and its ``<h1>`` removed, split at
``<p>`` tags; each part loses its tags, has entities decoded and whitespace
collapsed; empty parts are dropped and the rest joined by a blank line. A page
with NULL html, no ``<article>`` or an empty body is an extraction error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.text import ColumnOrName, _col

# FIXED VALUES: HTML entities decoded in extracted text ("&amp;" is decoded last).
ENTITIES = [
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]

DROP_BLOCKS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
H1_RE = r"(?is)<h1[^>]*>(.*?)</h1>"
ARTICLE_RE = r"(?is)<article[^>]*>(.*?)</article>"
PARAGRAPH_SPLIT = r"(?i)<p( [^>]*)?>"
TAG_RE = r"<[^>]*>"
SPACE_RE = r"[ \t\r\n]+"


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def clean_fragment(c: Column) -> Column:
    """Tags out, entities decoded, whitespace runs collapsed, trimmed."""
    no_tags = F.regexp_replace(c, F.lit(TAG_RE), F.lit(""))
    return F.trim(F.regexp_replace(decode_entities(no_tags), F.lit(SPACE_RE), F.lit(" ")))


def extract_title(html: ColumnOrName) -> Column:
    h = _col(html)
    t = clean_fragment(F.regexp_extract(h, TITLE_RE, 1))
    return F.when(t != "", t).otherwise(clean_fragment(F.regexp_extract(h, H1_RE, 1)))


def extract_body(html: ColumnOrName) -> Column:
    h = F.regexp_replace(_col(html), F.lit(DROP_BLOCKS), F.lit(""))
    article = F.regexp_replace(F.regexp_extract(h, ARTICLE_RE, 1), F.lit(H1_RE), F.lit(""))
    parts = F.transform(F.split(article, F.lit(PARAGRAPH_SPLIT), -1), clean_fragment)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def extract_page(html: ColumnOrName) -> Column:
    """``struct(title, content_text, error)``; on error title/content are NULL."""
    h = _col(html)
    body = extract_body(h)
    error = h.isNull() | (F.coalesce(body, F.lit("")) == "")
    return F.struct(F.when(~error, extract_title(h)).alias("title"),
                    F.when(~error, body).alias("content_text"),
                    error.alias("error"))


def extract_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``title``, ``content_text`` and ``error`` (see :func:`extract_page`),
    running the body extraction once per page."""
    from pressline.operators.columns import with_columns_once
    h = F.col(html_col)
    bodied = with_columns_once(df, {"_body": extract_body(h)})
    error = h.isNull() | (F.coalesce(F.col("_body"), F.lit("")) == "")
    return with_columns_once(bodied, {"error": error}).select(
        *[c for c in df.columns], F.when(~F.col("error"), extract_title(h)).alias("title"),
        F.when(~F.col("error"), F.col("_body")).alias("content_text"), "error")
