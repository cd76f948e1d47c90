"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Pages from which a host is hot and is dealt into parts of so many where its pages meet its list; hot hosts at
#: most: where there would be more, a host is hot from a larger number of pages.
PART_PAGES, MOST_HOT = 256, 100_000
#: Tags that end a line of a page.
BLOCKS = r"(?is)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|table|tr|td|th|h[1-6]|title|body|head|html|blockquote|pre|hr)\b[^>]*>"
#: What a reader of a page does not see.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)\s*>"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def visible_lines(html: Column) -> Column:
    """The lines of a page: markup taken out, blanks squeezed, empty ones left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BLOCKS, "\n"), "<[^>]*>", "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def line_keys(lines: Column) -> Column:
    """128 bits that stand for each line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, least_pages: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """pages (their columns `keep`, else all) with host, n_lines, n_dropped (long) and text: the lines left, joined by newlines.

    A line is boilerplate of its host if more than `ratio` of the host's pages have it,
    and `least_pages` of them at least. A line counts once a page. A page is parsed once, and its lines are kept
    in the shared folder; lines are counted by 128 bits of hash, with partial sums before the shuffle, so that a hot host or line adds a row for each task.
    A host has at most the lines of its average page divided by `ratio` such lines,
    so that its list stays small; pages meet it by their host, a hot host's in parts by its number of pages.

    Pages whose url has no host, or is null, form one site, whose host is null. A null or empty html has no
    lines. Repeated rows are pages of their own, long pages are parsed whole. Columns of pages with the names of the four go.
    Equal counts need no tie-break. An empty table gives no rows.
    """
    added = ("host", "n_lines", "n_dropped", "text")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in added]
    split = checkpointed(
        pages.select(
            *(F.col(f"`{c}`") for c in kept),
            F.coalesce(host_of(F.col("url")), F.lit("")).alias("_tl_host"),
            F.coalesce(visible_lines(F.col("html")), F.array().cast("array<string>")).alias("_tl_lines"),
            F.pmod(F.xxhash64("url", "html"), F.lit(1 << 30)).alias("_tl_draw"),
        )
    )
    totals = checkpointed(split.groupBy("_tl_host").agg(F.count(F.lit(1)).alias("_tl_pages")))
    every = totals.agg(F.sum("_tl_pages")).first()[0] or 0
    most = max(PART_PAGES, -(-every // MOST_HOT))
    # each hot host has more than 1 of MOST_HOT parts of all pages, so that there are fewer than MOST_HOT
    hot = F.broadcast(totals.where(F.col("_tl_pages") > most).select("_tl_host", F.ceil(F.col("_tl_pages") / most).alias("_tl_parts")))
    with_part = lambda df, draw: df.join(hot, "_tl_host", "left").withColumn("_tl_part", F.pmod(draw, F.coalesce("_tl_parts", F.lit(1).cast("long")))).drop("_tl_parts")
    in_parts = lambda df: df.join(hot, "_tl_host", "left").withColumn("_tl_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_tl_parts", F.lit(1).cast("long")) - 1))).drop("_tl_parts")
    site = ["_tl_host", "_tl_part"]
    lines = split.select("_tl_host", F.explode(F.array_distinct(line_keys(F.col("_tl_lines")))).alias("_tl_line")).groupBy("_tl_host", "_tl_line").agg(F.count(F.lit(1)).alias("_tl_n"))
    frequent = with_part(lines.where(F.col("_tl_n") >= least_pages), F.col("_tl_line.a")).join(in_parts(totals), site).where(F.col("_tl_n") > ratio * F.col("_tl_pages"))
    lists = in_parts(frequent.groupBy("_tl_host").agg(F.collect_list("_tl_line").alias("_tl_drop")))
    met = with_part(split, F.col("_tl_draw")).join(lists, site, "left")
    keyed = F.arrays_zip(F.col("_tl_lines").alias("l"), line_keys(F.col("_tl_lines")).alias("k"))
    stays = F.transform(F.filter(keyed, lambda x: ~F.array_contains("_tl_drop", x["k"])), lambda x: x["l"])
    out = met.withColumn("_tl_left", F.when(F.col("_tl_drop").isNull(), F.col("_tl_lines")).otherwise(stays))
    return out.select(
        *(F.col(f"`{c}`") for c in kept),
        F.nullif("_tl_host", F.lit("")).alias("host"),
        F.size("_tl_lines").cast("long").alias("n_lines"),
        (F.size("_tl_lines") - F.size("_tl_left")).cast("long").alias("n_dropped"),
        F.array_join("_tl_left", "\n").alias("text"),
    )


def oracle_sql(ratio: float = 0.3, least_pages: int = 3) -> str:
    """The query's rows in DuckDB's SQL."""
    return rf"""
WITH split AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    coalesce(list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(10), 'g'), '{BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> ''), []) AS lines
  FROM pages
), totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host
), counted AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split) GROUP BY host, line
), lists AS (
  SELECT c.host, list(line) AS gone FROM counted c JOIN totals t ON c.host = t.host
  WHERE n >= {least_pages} AND n > {ratio} * pages GROUP BY c.host
), rest AS (
  SELECT page_id, s.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS l
  FROM split s LEFT JOIN lists ON s.host = lists.host
)
SELECT page_id, nullif(host, '') AS host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(l) AS BIGINT) AS n_dropped,
  array_to_string(l, chr(10)) AS text FROM rest"""
