"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. A line is boilerplate on a host when the share of
the host's pages containing it exceeds ``ratio`` (and at least ``min_pages``
pages contain it, so that a host of one or two pages keeps its text).

Plan: lines are made distinct within their page, counted by (host, line
digest) with map-side partial sums, compared with the host's page total, and
the surviving digests become one array per host. That array is bounded: if a
host's pages have ``d`` distinct lines on average, at most ``d / ratio`` lines
can exceed the ratio. Pages then meet their host's array in one join whose
key carries a salt, so a host with a third of all pages is spread over
``salts`` tasks.

Defined results: a null page text has no lines; a null or unparsable url has
no host, and pages without host are not a site, so nothing is dropped there;
repeated rows are separate pages; a line repeated inside one page counts once
there, and is dropped at every place it occurs; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
BLANKS = r"[\x09\x0B-\x0D\x20]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case authority of an absolute url; null when there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible lines of a page: markup ends a line, blanks collapse, empty lines go."""
    text = F.regexp_replace(F.regexp_replace(html, MARKUP, "\n"), BLANKS, " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def site_line_dedup(pages: DataFrame, key: str, host: Column, lines: Column,
                    ratio: float = 0.5, min_pages: int = 3, salts: int = 32) -> DataFrame:
    """One row per page: key, host, host_pages, n_lines, n_dropped, text.

    ``text`` is the page's remaining lines joined by newlines.
    """
    base = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), lines.alias("lines"))
    sited = base.filter("host is not null")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = (sited.select("host", F.explode(F.array_distinct("lines")).alias("line"))
              .groupBy("host", F.md5("line").alias("line_md5"))
              .agg(F.count(F.lit(1)).alias("line_pages"))
              .filter(F.col("line_pages") >= min_pages)
              .withColumn("salt", F.pmod(F.hash("line_md5"), F.lit(salts))))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    frequent = (counts.join(totals.select("host", "host_pages", every_salt), ["host", "salt"])
                .filter(F.col("line_pages") > F.lit(ratio) * F.col("host_pages"))
                .groupBy("host").agg(F.collect_list("line_md5").alias("frequent")))
    sites = totals.join(frequent, "host", "left").select(
        "host", "host_pages", "frequent", every_salt)
    dealt = base.withColumn("salt", F.pmod(F.xxhash64(key, "lines"), F.lit(salts)).cast("int"))
    met = dealt.join(sites, ["host", "salt"], "left")
    none = F.array().cast("array<string>")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("frequent", none), F.md5(x)))
    return (met.withColumn("kept", kept)
            .select(key, "host", F.coalesce("host_pages", F.lit(0)).alias("host_pages"),
                    F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                    F.array_join("kept", "\n").alias("text")))


ORACLE = r"""
WITH base AS (
  SELECT page_id,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
         coalesce(list_filter(list_transform(string_split(
             regexp_replace(
               regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>',
                              chr(10), 'g'),
               '[\x09\x0B-\x0D\x20]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''),
           []::VARCHAR[]) AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM base WHERE host IS NOT NULL GROUP BY host),
seen AS (SELECT host, unnest(list_distinct(lines)) AS line FROM base WHERE host IS NOT NULL),
frequent AS (
  SELECT host, list(line) AS frequent
  FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) JOIN totals USING (host)
  WHERE n >= 3 AND n > 0.5 * host_pages GROUP BY host),
met AS (
  SELECT page_id, base.host, coalesce(host_pages, 0) AS host_pages, lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(frequent, []::VARCHAR[]), x)) AS kept
  FROM base LEFT JOIN totals ON base.host = totals.host LEFT JOIN frequent ON base.host = frequent.host)
SELECT page_id, host, host_pages, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM met
"""
