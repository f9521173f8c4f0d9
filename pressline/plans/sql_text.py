"""DuckDB SQL spellings of the text expressions, used only by the oracle queries.

They mirror :mod:`pressline.functions.text` so that the driver can check the
Spark jobs against an independent engine.
"""

from __future__ import annotations

from pressline import constants as C
from pressline.functions import text as tx

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_ascii(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x{{00}}-\\x{{7F}}]', '', 'g')"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(tx.WORD_PATTERN)})) AS INTEGER)"


def remove_captions(x: str) -> str:
    return (f"CASE WHEN contains({x}, {q(C.CAPTION_MARKER)}) "
            f"THEN regexp_replace({x}, {q(C.CAPTION_PATTERN)}, '', 'g') ELSE {x} END")


def remove_paragraphs(marked: str, r: str) -> str:
    parts = f"string_split({marked}, {q(tx.PARAGRAPH)})"
    n = f"len({parts})"
    keep = (f"(CASE WHEN ({r}) > 0 THEN greatest({n} - ({r}), 0) WHEN ({r}) = 0 THEN 0 "
            f"ELSE least(-({r}), {n}) END)")
    return (f"(CASE WHEN ({r}) IS NULL THEN {marked} "
            f"ELSE array_to_string({parts}[1:{keep}], {q(tx.PARAGRAPH)}) END)")


def mark_body(body: str, r: str | None = None) -> str:
    marked = f"replace({body}, {NL} || {NL}, {q(tx.PARAGRAPH)})"
    if r is not None:
        marked = remove_paragraphs(marked, r)
    return f"replace({marked}, {NL}, {q(tx.NEWLINE)})"


def format_headline_body(body: str, headline: str, r: str | None = None) -> str:
    return (f"({q(tx.HEADLINE_OPEN)} || coalesce({headline}, '') || {q(tx.HEADLINE_CLOSE)} || "
            f"{q(tx.NEWLINE)} || {q(tx.BODY_OPEN)} || {clean_ascii(mark_body(body, r))} || "
            f"{q(tx.BODY_CLOSE)})")


def format_body_only(body: str, r: str | None = None) -> str:
    return clean_ascii(mark_body(body, r))


def sample_key(id_sql: str, seed: str = C.DEFAULT_SEED, *salts: str) -> str:
    parts = [q(seed)] + list(salts) + [f"CAST({id_sql} AS VARCHAR)"]
    return "md5(" + " || ':' || ".join(parts) + ")"
