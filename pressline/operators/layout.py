"""Body text of pages of any layout: blocks scored by text and link density.

A page becomes a table of tags and texts in order. Nesting depth is a prefix sum over opening and
closing container tags; a text's container is the last one opened at its depth, and a container's parent the last one opened a level
above. Paragraphs (texts between paragraph tags and container borders) score by length and commas; a
container has twice its own paragraphs' score plus its children's, less the share of its text that lies in links. The
best container of a page (of equal ones the first) gives the body: its paragraphs, and those of its children that score.

All steps are windows and aggregates within one page, so the tags and texts of the pages that need it are shuffled once, by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.html import DROP_BLOCKS, clean_fragment, extract_body, extract_title
from pressline.operators.columns import with_columns_once
from pressline.plans.stage import stage

# Elements that never hold the body, and the containers that may.
DROP_LAYOUT = (DROP_BLOCKS + "".join(rf"|<{t}( [^>]*)?>.*?</{t}>" for t in ("head", "title", "nav", "header", "footer", "aside", "form", "h1", "button", "select", "figcaption")))
CONTAINERS = "div|section|main|article|td|body|blockquote|center|li"
PIECE_RE = r"<[^>]*>|[^<]+"
OPEN_RE = rf"(?i)^<({CONTAINERS})( [^>]*)?>"
CLOSE_RE = rf"(?i)^</({CONTAINERS}) *>"
BREAK_RE = r"(?i)^</?(p|h[2-6]|ul|ol|table|tr|pre)( [^>]*)?>"
LINK_OPEN_RE = r"(?i)^<a( [^>]*)?>"
LINK_CLOSE_RE = r"(?i)^</a *>"
#: A paragraph scores from so many characters on; each full hundred counts one, at most so many.
LEAST_CHARS, MOST_HUNDREDS = 25, 3


def block_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``at`` (place in the page), ``piece`` and what it is: step (+1/-1 for a container's tags, else 0),
    breaks, link (+1/-1 for a link's tags), text."""
    cleaned = F.regexp_replace(F.col(html), F.lit(f"(?is){DROP_LAYOUT.removeprefix('(?is)')}"), F.lit(""))
    t = pages.select(key, F.posexplode(F.regexp_extract_all(cleaned, F.lit(PIECE_RE), F.lit(0))).alias("at", "piece"))
    p = F.col("piece")
    step = F.when(p.rlike(OPEN_RE), 1).when(p.rlike(CLOSE_RE), -1).otherwise(0)
    link = F.when(p.rlike(LINK_OPEN_RE), 1).when(p.rlike(LINK_CLOSE_RE), -1).otherwise(0)
    out = t.select(key, "at", "piece", step.alias("step"), link.alias("link"), (~F.startswith(p, F.lit("<"))).alias("text"), p.rlike(BREAK_RE).alias("is_break"))
    return out.select(key, "at", "piece", "step", "link", "text", (F.col("is_break") | (F.col("step") != 0)).cast("int").alias("breaks"))


def containers(blocks: DataFrame, key: str) -> DataFrame:
    """Texts and container openings with ``owner``: the place of the container around them (-1: none), ``paragraph`` and whether in a link."""
    order = Window.partitionBy(key).orderBy("at")
    deep = blocks.select("*", F.sum("step").over(order).alias("depth"), F.sum("breaks").over(order).alias("paragraph"),
                         (F.sum("link").over(order) > 0).alias("linked"))
    # an opening stands for itself at its depth, and asks at the depth above
    roles = F.when(F.col("step") == 1, F.array(F.struct(F.col("depth").alias("level"), F.col("at").alias("opened")),
                                               F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast("int").alias("opened")))) \
        .otherwise(F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("int").alias("opened"))))
    asked = deep.where((F.col("step") == 1) | F.col("text")).select(key, "at", "piece", "step", "paragraph", "linked", F.inline(roles))
    same = Window.partitionBy(key, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    owned = asked.withColumn("owner", F.coalesce(F.max("opened").over(same), F.lit(-1)))
    return owned.where(F.col("opened").isNull()).select(key, "at", "piece", "step", "owner", "paragraph", "linked")


def layout_bodies(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``body`` of each page that has one. ``key`` must tell pages apart."""
    parts = containers(block_table(pages, key, html), key)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    paragraphs = (parts.where("step = 0").groupBy(key, "owner", "paragraph")
                  .agg(clean_fragment(text).alias("text"), F.sum(F.when(F.col("linked"), F.length("piece")).otherwise(0)).alias("in_links"),
                       F.sum(F.length("piece")).alias("chars"), F.min("at").alias("at")).where("text <> ''"))
    n = F.length("text")
    commas = F.length("text") - F.length(F.replace(F.col("text"), F.lit(","), F.lit("")))
    score = F.when(n >= LEAST_CHARS, 1 + commas + F.least(F.floor(n / 100), F.lit(MOST_HUNDREDS))).otherwise(0).cast("long")
    paragraphs = paragraphs.withColumn("score", score)
    parents = parts.where("step = 1").select(key, F.col("at").alias("owner"), F.col("owner").alias("parent"))
    own = paragraphs.groupBy(key, "owner").agg(F.sum("score").alias("own"), F.sum("in_links").alias("in_links"), F.sum("chars").alias("chars"))
    own = own.join(parents, [key, "owner"], "left").withColumn("parent", F.coalesce("parent", F.lit(-2)))
    # each container's figures go to itself (twice) and to its parent (once)
    shares = own.select(key, F.inline(F.array(F.struct(F.col("owner").alias("node"), (2 * F.col("own")).alias("s"), "in_links", "chars"),
                                              F.struct(F.col("parent").alias("node"), F.col("own").alias("s"), "in_links", "chars"))))
    nodes = shares.where("node > -2").groupBy(key, "node").agg(F.sum("s").alias("s"), F.sum("in_links").alias("in_links"), F.sum("chars").alias("chars"))
    nodes = nodes.withColumn("value", F.col("s") * (F.col("chars") - F.col("in_links")).cast("double") / F.col("chars")).where("value > 0")
    best = nodes.groupBy(key).agg(F.min(F.struct((-F.col("value")).alias("v"), "node")).getField("node").alias("best"))
    shown = (paragraphs.join(own.select(key, "owner", "parent"), [key, "owner"]).join(best, key)
             .where((F.col("owner") == F.col("best")) | ((F.col("parent") == F.col("best")) & (F.col("score") > 0))))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("body"))


def extract_any_layout(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``title``, ``content_text`` and ``error``: the ``<article>`` element's text where a page has one, else the
    best container's. A page without either (or with NULL html) is an error with NULL title and text."""
    rows = with_columns_once(pages.withColumn("_page", F.monotonically_increasing_id()), {"_body": extract_body(F.col(html_col))})
    rows = stage(rows, "page-bodies")             # the number means the same page in both readings, and the regexes run once
    plain = F.coalesce("_body", F.lit("")) != ""
    found = layout_bodies(rows.where(~plain & F.col(html_col).isNotNull()).select("_page", html_col), "_page", html_col)
    both = rows.where(plain).unionByName(rows.where(~plain).drop("_body").join(found.withColumnRenamed("body", "_body"), "_page", "left").select(*rows.columns))
    error = F.coalesce("_body", F.lit("")) == ""
    return both.select(*pages.columns, F.when(~error, extract_title(F.col(html_col))).alias("title"), F.when(~error, F.col("_body")).alias("content_text"), error.alias("error"))
