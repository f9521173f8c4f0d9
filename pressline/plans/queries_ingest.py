"""Registered queries: listing ingest, stop-at-failure, page extraction and the
incremental scrape pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import html as H
from pressline.operators import ingest as ig
from pressline.operators import layout as L
from pressline.operators import profile as pr
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.plans.queries_profile import GRID_SQL, _cells, _grid
from pressline.plans.stage import scratch_path
from pressline.streaming.release import start_release_stream
from pressline.streaming.scrape import start_scrape_stream
from pressline.sources.articles import (ARTICLES_SQL, URL_PREFIX, load_articles, load_table, read_partitioned,
                                        write_partitioned)

WORK_CAP = 300          # cells of a capped pass (the feature under test)


@register("listing_ingest", f"""
WITH articles AS ({ARTICLES_SQL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, query_date ORDER BY published_at DESC, url) AS rn
           FROM articles)
SELECT doc_id, source_id, query_date, title, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published,
       CAST(rn AS INTEGER) AS listing_rank, false AS scraped, CAST(NULL AS VARCHAR) AS scraped_content,
       CAST(NULL AS BOOLEAN) AS error
FROM ranked WHERE rn <= {C.LISTING_PAGE_SIZE}
""")
def q_listing_ingest(spark, sf_dir):
    """Landed listings -> newest page per (publisher, date) -> fresh status."""
    a = load_articles(spark, sf_dir).select("doc_id", "source_id", "query_date", "title", "url", "published_at")
    top = ig.newest_per_cell(a, C.LISTING_PAGE_SIZE, rank_col="listing_rank")
    out = ig.as_ingested(top)
    return out.select("doc_id", "source_id", "query_date", "title", "url",
                      F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"),
                      "listing_rank", "scraped", "scraped_content", "error")


INGEST_LOG_SQL = f"""
WITH articles AS ({ARTICLES_SQL}),
log AS (SELECT source_id, query_date, bool_or(coalesce(error, false)) AS failed FROM articles
        GROUP BY source_id, query_date)
"""


def _ingest_log(spark, sf_dir):
    """Landing log: one attempt per (publisher, date); it failed when any
    listing of that cell carries an error flag."""
    a = load_articles(spark, sf_dir)
    return a.groupBy("source_id", "query_date").agg(F.bool_or(F.coalesce("error", F.lit(False))).alias("failed"))


@register("ingest_stop_at_failure", INGEST_LOG_SQL + """
, first_fail AS (SELECT source_id, min(CASE WHEN failed THEN query_date END) AS ff FROM log GROUP BY source_id)
SELECT l.source_id, l.query_date FROM log l JOIN first_fail f ON l.source_id = f.source_id
WHERE f.ff IS NULL OR l.query_date < f.ff
""")
def q_ingest_stop_at_failure(spark, sf_dir):
    return ig.stop_at_first_failure(_ingest_log(spark, sf_dir)).select("source_id", "query_date")


def _sql_decode(x: str) -> str:
    for ent, ch in H.ENTITIES:
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


def _sql_clean(x: str) -> str:
    no_tags = f"regexp_replace({x}, {S.q(H.TAG_RE)}, '', 'g')"
    return f"trim(regexp_replace({_sql_decode(no_tags)}, {S.q(H.SPACE_RE)}, ' ', 'g'))"


PAGES_SQL = f"""
WITH p0 AS (SELECT page_id, url, html, regexp_replace(html, {S.q(H.DROP_BLOCKS)}, '', 'g') AS h FROM pages),
p1 AS (SELECT *, regexp_replace(regexp_extract(h, {S.q(H.ARTICLE_RE)}, 1), {S.q(H.H1_RE)}, '', 'g') AS art,
              {_sql_clean(f"regexp_extract(html, {S.q(H.TITLE_RE)}, 1)")} AS t1,
              {_sql_clean(f"regexp_extract(html, {S.q(H.H1_RE)}, 1)")} AS t2
       FROM p0),
p2 AS (SELECT *, array_to_string(list_filter(list_transform(string_split_regex(art, {S.q(H.PARAGRAPH_SPLIT)}),
                                                             lambda x: {_sql_clean('x')}), lambda x: x <> ''),
                                 chr(10) || chr(10)) AS body
       FROM p1),
extracted AS (SELECT page_id, url, html IS NULL OR coalesce(body, '') = '' AS error,
                     CASE WHEN t1 <> '' THEN t1 ELSE t2 END AS title0, body FROM p2)
"""


@register("page_extraction", PAGES_SQL + """
SELECT page_id, url, CASE WHEN error THEN NULL ELSE title0 END AS title,
       CASE WHEN error THEN NULL ELSE body END AS content_text, error
FROM extracted
""")
def q_page_extraction(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return H.extract_pages(p).select("page_id", "url", "title", "content_text", "error")


def _sql_is(pattern: str) -> str:
    return f"regexp_matches(piece, {S.q(pattern)})"


# Pages whose <article> became a plain container, so that only the block scores can find the body.
LAYOUT_SQL = f"""
WITH src AS (SELECT page_id, html AS h0, replace(replace(html, '<article>', '<div class="w"><div class="s">'), '</article>', '</div></div>') AS html FROM pages),
pc AS (SELECT page_id, regexp_extract_all(regexp_replace(html, {S.q("(?is)" + L.DROP_LAYOUT.removeprefix("(?is)"))}, '', 'g'), {S.q(L.PIECE_RE)}) AS ps FROM src),
b0 AS (SELECT page_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM pc),
b AS (SELECT *, CASE WHEN {_sql_is(L.OPEN_RE)} THEN 1 WHEN {_sql_is(L.CLOSE_RE)} THEN -1 ELSE 0 END AS step,
             CASE WHEN {_sql_is(L.LINK_OPEN_RE)} THEN 1 WHEN {_sql_is(L.LINK_CLOSE_RE)} THEN -1 ELSE 0 END AS link,
             piece NOT LIKE '<%' AS is_text, {_sql_is(L.BREAK_RE)} AS is_break FROM b0),
d AS (SELECT *, sum(step) OVER w AS depth, sum(CAST(is_break OR step <> 0 AS INTEGER)) OVER w AS paragraph, sum(link) OVER w > 0 AS linked
      FROM b WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
roles AS (SELECT page_id, pos, piece, step, paragraph, linked, depth AS level, CASE WHEN step = 1 THEN pos END AS opened FROM d WHERE step = 1 OR is_text
          UNION ALL SELECT page_id, pos, piece, step, paragraph, linked, depth - 1, NULL FROM d WHERE step = 1),
owned AS (SELECT *, coalesce(max(opened) OVER (PARTITION BY page_id, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS owner FROM roles),
parts AS (SELECT * FROM owned WHERE opened IS NULL),
p0 AS (SELECT page_id, owner, paragraph, string_agg(piece, '' ORDER BY pos) AS raw, sum(CASE WHEN linked THEN length(piece) ELSE 0 END) AS in_links,
              sum(length(piece)) AS chars, min(pos) AS pos FROM parts WHERE step = 0 GROUP BY ALL),
p1 AS (SELECT *, {_sql_clean('raw')} AS text FROM p0),
p AS (SELECT *, CASE WHEN length(text) >= {L.LEAST_CHARS} THEN 1 + length(text) - length(replace(text, ',', '')) + least(length(text) // 100, {L.MOST_HUNDREDS}) ELSE 0 END AS score
      FROM p1 WHERE text <> ''),
own AS (SELECT page_id, owner, sum(score) AS own, sum(in_links) AS in_links, sum(chars) AS chars FROM p GROUP BY ALL),
par AS (SELECT own.*, coalesce(x.owner, -2) AS parent FROM own LEFT JOIN parts x ON x.step = 1 AND x.page_id = own.page_id AND x.pos = own.owner),
sh AS (SELECT page_id, owner AS node, 2 * own AS s, in_links, chars FROM par UNION ALL SELECT page_id, parent, own, in_links, chars FROM par WHERE parent > -2),
nodes AS (SELECT page_id, node, sum(s)::DOUBLE * (sum(chars) - sum(in_links))::DOUBLE / sum(chars)::DOUBLE AS v FROM sh GROUP BY ALL),
best AS (SELECT page_id, node FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v DESC, node) AS k FROM nodes WHERE v > 0) WHERE k = 1),
body AS (SELECT p.page_id, string_agg(p.text, chr(10) || chr(10) ORDER BY p.pos) AS body
         FROM p JOIN par USING (page_id, owner) JOIN best USING (page_id) WHERE p.owner = best.node OR (par.parent = best.node AND p.score > 0) GROUP BY ALL)
SELECT src.page_id, body AS content_text, body IS NULL AS error FROM src LEFT JOIN body USING (page_id)
"""


@register("page_layout_extraction", LAYOUT_SQL)
def q_page_layout_extraction(spark, sf_dir):
    """Bodies of pages without an <article> element, found by block scores."""
    p = load_table(spark, sf_dir, "pages").select("page_id", "html")
    divs = p.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="w"><div class="s">')), F.lit("</article>"), F.lit("</div></div>")))
    return L.extract_any_layout(divs).select("page_id", "content_text", "error")


def page_store(spark, sf_dir):
    """Stored raw pages keyed by the article url they were fetched for."""
    return load_table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit(URL_PREFIX), F.col("page_id").cast("string")).alias("url"), "html")


def extract_stored(pages):
    return L.extract_any_layout(pages).select("url", "content_text", "error")


SCRAPE_SQL = f"""
WITH articles AS ({ARTICLES_SQL}),
store AS (SELECT '{URL_PREFIX}' || CAST(page_id AS VARCHAR) AS url,
                 CASE WHEN error THEN NULL ELSE body END AS content_text, error
          FROM ({PAGES_SQL} SELECT * FROM extracted) e),
upd AS (
  SELECT a.doc_id, a.source_id, a.query_date,
         CASE WHEN a.scraped THEN true ELSE s.url IS NOT NULL AND NOT coalesce(s.error, true) END AS scraped,
         CASE WHEN a.scraped THEN a.error ELSE NOT (s.url IS NOT NULL AND NOT coalesce(s.error, true)) END AS error,
         NOT a.scraped AND s.url IS NOT NULL AND NOT coalesce(s.error, true) AS newly_scraped,
         CASE WHEN a.scraped THEN a.scraped_content
              WHEN s.url IS NOT NULL AND NOT coalesce(s.error, true) THEN s.content_text
              ELSE a.scraped_content END AS scraped_content
  FROM articles a LEFT JOIN store s ON NOT a.scraped AND a.url = s.url)
"""


def _scrape_pass(spark, sf_dir):
    return ig.apply_scrape(load_articles(spark, sf_dir), page_store(spark, sf_dir), extract=extract_stored,
                           version="page_id")


@register("scrape_status_update", SCRAPE_SQL + """
SELECT doc_id, scraped, error, newly_scraped, sha256(scraped_content) AS body_sha256 FROM upd
""")
def q_scrape_status_update(spark, sf_dir):
    u = _scrape_pass(spark, sf_dir)
    return u.select("doc_id", "scraped", "error", "newly_scraped", F.sha2("scraped_content", 256).alias("body_sha256"))


@register("scrape_counts", SCRAPE_SQL + """
SELECT source_id, query_date, CAST(count(*) FILTER (WHERE newly_scraped) AS BIGINT) AS n_newly_scraped,
       CAST(count(*) FILTER (WHERE NOT scraped AND error) AS BIGINT) AS n_failed
FROM upd GROUP BY source_id, query_date
""")
def q_scrape_counts(spark, sf_dir):
    u = _scrape_pass(spark, sf_dir)
    return u.groupBy("source_id", "query_date").agg(
        F.count_if("newly_scraped").alias("n_newly_scraped"),
        F.count_if(~F.col("scraped") & F.col("error")).alias("n_failed"))


WORK_SQL = GRID_SQL + """
SELECT query_date, source_id FROM grid
WHERE EXISTS (SELECT 1 FROM present p WHERE p.source_id = grid.source_id AND p.query_date = grid.query_date)
"""


def _work(spark, sf_dir, cap):
    cells = _cells(load_articles(spark, sf_dir))
    return ig.capped_work(pr.present_cells(_grid(cells), cells), cap).select("query_date", "source_id")


@register("scrape_work_list", WORK_SQL)
def q_scrape_work_list(spark, sf_dir):
    """Work list: grid cells that hold listings."""
    return _work(spark, sf_dir, None)


@register("scrape_work_list_capped", WORK_SQL + f"ORDER BY query_date, source_id LIMIT {WORK_CAP}")
def q_scrape_work_list_capped(spark, sf_dir):
    """The first cells of the work list, as a capped scrape pass takes them."""
    return _work(spark, sf_dir, WORK_CAP)


@register("scrape_run", SCRAPE_SQL + """
SELECT doc_id, source_id, query_date, scraped, error, sha256(scraped_content) AS body_sha256 FROM upd
""")
def q_scrape_run(spark, sf_dir):
    """The whole scrape job on a table of its own: grid -> work list -> pass -> write back -> table."""
    path = scratch_path(spark, "scrape-table")
    write_partitioned(load_articles(spark, sf_dir), path)
    cells = _cells(read_partitioned(spark, path))
    ig.scrape_run(path, _grid(cells), page_store(spark, sf_dir), extract_stored, version="page_id")
    return read_partitioned(spark, path).select("doc_id", "source_id", "query_date", "scraped", "error",
                                                F.sha2("scraped_content", 256).alias("body_sha256"))


@register("ingest_run", INGEST_LOG_SQL + f"""
, first_fail AS (SELECT source_id, min(CASE WHEN failed THEN query_date END) AS ff FROM log GROUP BY source_id),
ranked AS (SELECT a.*, row_number() OVER (PARTITION BY a.source_id, a.query_date ORDER BY published_at DESC, url) AS rn
           FROM articles a JOIN first_fail f ON a.source_id = f.source_id
           WHERE f.ff IS NULL OR a.query_date < f.ff)
SELECT doc_id, source_id, query_date, title, url, sha256(content) AS content_sha256, false AS scraped
FROM ranked WHERE rn <= {C.LISTING_PAGE_SIZE}
""")
def q_ingest_run(spark, sf_dir):
    """The ingest job: publisher x date run with the stop rule -> newest page -> partitioned table."""
    a = load_articles(spark, sf_dir).select("doc_id", "source_id", "query_date", "title", "url", "published_at", "content")
    path = scratch_path(spark, "ingest-table")
    write_partitioned(ig.ingest_listings(a, _ingest_log(spark, sf_dir)), path)
    return read_partitioned(spark, path).select("doc_id", "source_id", "query_date", "title", "url",
                                                F.sha2("content", 256).alias("content_sha256"), "scraped")


def land(rows, path):
    """Files of a landing folder, as the scan of ``rows`` gives them: none grows with the table."""
    rows.write.parquet(path)


@register("scrape_stream_run", SCRAPE_SQL + """
SELECT doc_id, source_id, query_date, scraped, error, sha256(scraped_content) AS body_sha256 FROM upd
""")
def q_scrape_stream_run(spark, sf_dir):
    """The scrape pass as a stream: listings and pages arrive as files and meet by url in the stream's state."""
    landing, pages, table, progress = (scratch_path(spark, n) for n in ("stream-listings", "stream-pages", "stream-table", "stream-progress"))
    rows = load_articles(spark, sf_dir).select("doc_id", "url", "scraped", "scraped_content", "error", "query_date", "source_id")
    land(rows, landing)
    store = page_store(spark, sf_dir)
    land(store, pages)
    stream = [spark.readStream.schema(f.schema).parquet(p) for f, p in ((rows, landing), (store, pages))]
    start_scrape_stream(*stream, table, progress, extract=lambda p: H.extract_pages(p)).awaitTermination()
    return read_partitioned(spark, table).select("doc_id", "source_id", "query_date", "scraped", "error", F.sha2("scraped_content", 256).alias("body_sha256"))


@register("ingest_stream_run", INGEST_LOG_SQL + f"""
, days AS (SELECT strftime(d, '%Y-%m-%d') AS query_date FROM range(DATE '{C.FIRST_QUERY_DATE}', DATE '{C.LAST_QUERY_DATE}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
grid AS (SELECT source_id, query_date FROM (SELECT DISTINCT source_id FROM articles), days),
free AS (SELECT g.source_id, g.query_date, bool_and(coalesce(NOT l.failed, false)) OVER (PARTITION BY g.source_id ORDER BY g.query_date) AS ok
         FROM grid g LEFT JOIN log l ON l.source_id = g.source_id AND l.query_date = g.query_date),
ranked AS (SELECT a.*, row_number() OVER (PARTITION BY a.source_id, a.query_date ORDER BY published_at DESC, url) AS rn
           FROM articles a JOIN free f ON f.ok AND f.source_id = a.source_id AND f.query_date = a.query_date)
SELECT source_id, query_date, title, url, sha256(content) AS content_sha256, scraped FROM (SELECT * REPLACE (false AS scraped) FROM ranked WHERE rn <= {C.LISTING_PAGE_SIZE})
""")
def q_ingest_stream_run(spark, sf_dir):
    """The ingest as a stream: responses arrive as files, and dates wait until all earlier ones of their publisher succeeded."""
    landing, table, progress = (scratch_path(spark, n) for n in ("stream-landing", "stream-table", "stream-progress"))
    a = load_articles(spark, sf_dir)
    listing = F.struct(F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"), "title", "url",
                       F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), "content")
    top = ig.newest_per_cell(a)                      # a response holds one page of listings
    answers = top.groupBy(*ig.CELL).agg(F.collect_list(listing).alias("articles")).join(_ingest_log(spark, sf_dir), ig.CELL)
    answers.select("query_date", "source_id", F.when(F.col("failed"), "failed").otherwise("ok").alias("status"), "articles").repartition(4).write.json(landing)
    start_release_stream(spark, landing, table, progress, sources=None, files_per_batch=2, multi_line=False).awaitTermination()
    return read_partitioned(spark, table).select("source_id", "query_date", "title", "url", F.sha2("content", 256).alias("content_sha256"), "scraped")
