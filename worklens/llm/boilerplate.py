"""Line dedup by site-relative frequency.

The text lines of a page are what is left of its HTML when scripts, styles and
comments are removed, block tags become line breaks, other tags vanish and the
common entities are decoded. Lines are trimmed; empty ones do not count. Per
host, a line's frequency is the number of pages that contain it divided by the
host's pages; lines on at least ``MIN_PAGES`` pages whose frequency exceeds
``RATIO`` are boilerplate and are dropped from every page of the host.

A host can have at most (lines per page) / ``RATIO`` boilerplate lines, so they
are held as one array per host and the pages keep their lines in place: only
distinct (host, line) counts are shuffled, pre-aggregated where they arise. The
join of the arrays to the pages is salted against hosts with most of the pages.

Pages without a host (NULL or odd URL) share no site and keep all lines; a NULL
html is a page without lines. Repeated pages count as pages. An empty table
gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import stage, table

RATIO = 0.3
MIN_PAGES = 3
SALTS = 32

# Patterns that turn HTML into lines, in the order they apply.
HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?([^/?#:@]+)"
HTML_STEPS = (
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main"
     r"|nav|ol|p|pre|section|table|td|th|title|tr|ul)(\s[^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), HOST, 2)
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, by in HTML_STEPS:
        text = F.regexp_replace(text, pattern, by)
    return text_lines(text)


def text_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, r"[\n\r]+"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f]+", " ")))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines) of pages -> (host, boilerplate): one array per host that has any."""
    sited = pages.select("host", "lines").filter("host is not null")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        sited.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("_on"))
        .filter(F.col("_on") >= min_pages)
    )
    return (
        counts.join(totals, "host").filter(F.col("_on") > F.col("_pages") * ratio)
        .groupBy("host").agg(F.collect_list("line").alias("boilerplate"))
    )


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with host, lines (all) and kept (lines that are not boilerplate)."""
    columns = [F.col(f"`{c}`") for c in pages.columns]
    held = pages.select(F.struct(*columns).alias("_row"), host_of(F.col("url")).alias("host"),
                        html_lines(F.col("html")).alias("lines"))
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    found = stage(boilerplate(held, ratio, min_pages), "boilerplate").withColumn("_salt", F.explode(salts))
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)))
    return (
        held.withColumn("_salt", F.pmod(F.xxhash64("host", "lines"), F.lit(SALTS)).cast("int"))
        .join(found, ["host", "_salt"], "left")
        .withColumn("kept", kept)
        .select("_row.*", F.col("host").alias("_host"), F.col("lines").alias("_lines"), F.col("kept").alias("_kept"))
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "pages"))


def line_report(pages: DataFrame) -> DataFrame:
    return drop_boilerplate(pages.select("page_id", "url", "html")).select(
        "page_id", F.col("_host").alias("host"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.md5(F.array_join("_kept", "\n")).alias("kept_md5"))


def _sql_html(column: str) -> str:
    text = f"coalesce({column}, '')"
    for pattern, by in HTML_STEPS:
        by = "chr(10)" if by == "\n" else "'" + by + "'"
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


ORACLE = f"""
WITH texts AS (
    SELECT page_id, nullif(regexp_extract(lower(url), '{HOST}', 2), '') AS host, {_sql_html('html')} AS t,
           row_number() OVER () AS n
    FROM pages),
lined AS (
    SELECT page_id, host, n, list_filter(list_transform(regexp_split_to_array(t, '[\\n\\r]+'),
           lambda x: trim(regexp_replace(x, '[ \\t\\f]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
    FROM texts),
line AS (SELECT page_id, host, n, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM lined),
rate AS (
    SELECT host, line FROM line WHERE host IS NOT NULL GROUP BY host, line
    HAVING count(DISTINCT n) >= {MIN_PAGES}
       AND count(DISTINCT n) > {RATIO} * (SELECT count(*) FROM lined o WHERE o.host = line.host)),
kept AS (
    SELECT n, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM line WHERE (host, line) NOT IN (SELECT host, line FROM rate) OR host IS NULL GROUP BY n)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - coalesce(n_kept, 0) AS n_dropped,
       md5(coalesce(text, '')) AS kept_md5
FROM lined LEFT JOIN kept USING (n)"""
