"""Text markup as native Column expressions (no Python UDFs).

Every function takes and returns ``pyspark.sql.Column`` so it composes into a
single whole-stage-codegen projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline import constants as C

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def open_marker(word: str) -> str:
    """``" <WORD> "`` (spaces are part of the marker)."""
    return f" <{word}> "


def close_marker(word: str) -> str:
    """``" <WORD/> "``."""
    return f" <{word}/> "


PARAGRAPH = open_marker(C.PARAGRAPH_WORD)
NEWLINE = open_marker(C.NEWLINE_WORD)
HEADLINE_OPEN = open_marker(C.HEADLINE_WORD)
HEADLINE_CLOSE = close_marker(C.HEADLINE_WORD)
BODY_OPEN = open_marker(C.BODY_WORD)
BODY_CLOSE = close_marker(C.BODY_WORD)

# Marker vocabulary (stripped), as the headline/body formatter declares it.
HEADLINE_BODY_MARKERS = [m.strip() for m in (PARAGRAPH, NEWLINE, HEADLINE_OPEN, HEADLINE_CLOSE,
                                             BODY_OPEN, BODY_CLOSE)]
# The base formatter keeps its two markers un-stripped.
BODY_ONLY_MARKERS = [PARAGRAPH, NEWLINE]

# Python's str.isspace() set, written as a Java / RE2 character class.
PY_WHITESPACE_CLASS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD_PATTERN = f"[^{PY_WHITESPACE_CLASS}]+"
NON_ASCII_PATTERN = r"[^\x{00}-\x{7F}]"


def clean_ascii(c: ColumnOrName) -> Column:
    """Drop every code point >= 128."""
    return F.regexp_replace(_col(c), F.lit(NON_ASCII_PATTERN), F.lit(""))


# The same set as plain characters, for ``translate``.
PY_WHITESPACE_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                                *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def word_count(c: ColumnOrName) -> Column:
    """Number of maximal runs of non-whitespace (Python ``len(s.split())``).

    Every whitespace code point is first mapped to a plain space (``translate``,
    a per-character table lookup), then the trimmed text is split on space
    runs. This is several times faster than counting matches of the full
    Unicode class, which materialises every match as a string.
    """
    spaced = F.trim(F.translate(_col(c), PY_WHITESPACE_CHARS, " " * len(PY_WHITESPACE_CHARS)))
    # the lambda binds the spaced text once instead of copying it into both branches
    return F.element_at(F.transform(F.array(spaced), lambda s: F.when(s == "", F.lit(0))
                                    .otherwise(F.size(F.split(s, " +")))), 1)


# A leftmost match of the caption pattern always starts at a sentence start (text
# start, or right after a period): a match starting inside a sentence could be
# extended back to the sentence start by the lazy ``[^.]*?``. Anchoring the
# attempts there gives the same matches without retrying at every character.
SENTENCE_START = "(?<![^.])"


def remove_captions(c: ColumnOrName) -> Column:
    """Delete every sentence that holds ``FILE - `` (through its period).

    The regex only runs on rows that contain the marker: on long text without
    periods the lazy prefix backtracks quadratically, so the cheap ``contains``
    guard keeps the common case linear.
    """
    c = _col(c)
    return F.when(c.contains(C.CAPTION_MARKER),
                  F.regexp_replace(c, F.lit(SENTENCE_START + C.CAPTION_PATTERN), F.lit(""))).otherwise(c)


def remove_paragraphs(marked: ColumnOrName, r) -> Column:
    """Keep ``parts[:-r]`` of the text split on the paragraph marker.

    ``r`` NULL keeps everything; ``r >= parts`` and ``r == 0`` give ''; negative
    ``r`` keeps the first ``-r`` parts (Python slice semantics).
    """
    marked = _col(marked)
    r = _lit_or_col(r)
    parts = F.split(marked, F.lit(r"\Q" + PARAGRAPH + r"\E"), -1)
    n = F.size(parts)
    keep = (F.when(r > 0, F.greatest(n - r, F.lit(0)))
             .when(r == 0, F.lit(0))
             .otherwise(F.least(-r, n)))
    sliced = F.array_join(F.slice(parts, F.lit(1), keep), PARAGRAPH)
    return F.when(r.isNull(), marked).otherwise(sliced)


def _mark_body(body: Column, r) -> Column:
    marked = F.replace(body, F.lit("\n\n"), F.lit(PARAGRAPH))
    if r is not None:
        marked = remove_paragraphs(marked, r)
    return F.replace(marked, F.lit("\n"), F.lit(NEWLINE))


def format_headline_body(body: ColumnOrName, headline: ColumnOrName, r=None) -> Column:
    """Headline/body markup used for publisher and topic training text.

    ``\\n\\n`` -> paragraph marker, optional paragraph removal, ``\\n`` -> newline
    marker, non-ASCII removed from the body only, wrapped in headline/body
    markers. A NULL or empty headline contributes ''.
    """
    return F.concat(
        F.lit(HEADLINE_OPEN), F.coalesce(_col(headline), F.lit("")), F.lit(HEADLINE_CLOSE),
        F.lit(NEWLINE), F.lit(BODY_OPEN), clean_ascii(_mark_body(_col(body), r)), F.lit(BODY_CLOSE))


def format_body_only(body: ColumnOrName, r=None) -> Column:
    """Body-only markup (sentiment corpus): the headline/body form without wrappers."""
    return clean_ascii(_mark_body(_col(body), r))


_HEADLINE_RE = "(?d)<" + C.HEADLINE_WORD + ">(.*)<" + C.HEADLINE_WORD + "/>"


def _unmark(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(PARAGRAPH), F.lit("\n\n")), F.lit(NEWLINE), F.lit("\n"))


def decompile_headline_body(formatted: ColumnOrName) -> Column:
    """Inverse of :func:`format_headline_body`: ``struct(headline, body)``.

    The headline is the first greedy ``<HEADLINE>(.*)<HEADLINE/>`` match on one
    line (its padding spaces kept); text without a headline raises.
    """
    text = _unmark(_col(formatted))
    headline = F.when(text.rlike(_HEADLINE_RE), F.regexp_extract(text, _HEADLINE_RE, 1)) \
        .otherwise(F.raise_error(F.lit("formatted text has no headline markers")))
    body = F.replace(F.replace(F.regexp_replace(text, F.lit(_HEADLINE_RE), F.lit("")),
                               F.lit(BODY_OPEN), F.lit("")), F.lit(BODY_CLOSE), F.lit(""))
    return F.struct(headline.alias("headline"), body.alias("body"))


def decompile_body_only(formatted: ColumnOrName) -> Column:
    return _unmark(_col(formatted))


def hour_of(ts: ColumnOrName) -> Column:
    return F.hour(_col(ts))


def day_of(ts: ColumnOrName) -> Column:
    """``YYYY-MM-DD`` text of a timestamp (session time zone UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd")


def title_matches(title: ColumnOrName, pattern: str, case_sensitive: bool = False) -> Column:
    """Regex title search; '' matches everything, a NULL title never matches."""
    if pattern == "":
        return F.lit(True)
    flags = "" if case_sensitive else "(?iu)"
    return F.coalesce(_col(title).rlike(flags + pattern), F.lit(False))
