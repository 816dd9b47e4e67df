"""Line deduplication by site-relative frequency.

The pages of a host that contain a line, divided by all pages of the host, is the
line's frequency there.  Lines above a ratio are boilerplate of that site and are
dropped; what is common on one site may stay on another.

A page counts once for a line however often it holds it.  A line must be on more than one
page, or the lines of a host with a single page would all go; all else the ratio decides.

Defined cases: NULL and empty texts have no lines; NULL hosts are one site; lines are
compared trimmed, and empty ones are not counted and not kept; repeated pages count as
pages; empty tables give empty results.  Working columns get a prefix that does not occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.2
LEAST_PAGES = 2
#: A line of a host is spread over so many join keys, as a line may be on very many pages.
SPREAD = 16


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def page_text(html: Column) -> Column:
    """Visible text of a page, a line for each block element."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style|title)\b.*?</(?:script|style|title)\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|footer|header|main|h[1-6]|br|tr|td|th|table|body|head|html)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                     spread: int = SPREAD) -> DataFrame:
    """``pages`` with its text less the boilerplate lines, ``n_lines`` and ``n_dropped``.

    The lines travel as digests; a page's own list of dropped digests comes back to it.
    """
    pre = "_b"
    while any(c.startswith(pre) for c in pages.columns):
        pre += "_"
    row, digest, salt, held, own, dropped, where = (f"{pre}{x}" for x in ("row", "digest", "salt", "held", "own", "dropped", "where"))
    # Equal pages share a row key; they have the same lines and the same site.
    keyed = pages.withColumn(where, F.coalesce(F.col(site), F.lit(""))).withColumn(
        row, F.sha2(F.concat_ws("\0", F.col(where), F.coalesce(F.col(text), F.lit(""))), 256)).withColumn(own, lines(F.col(text)))
    sites = keyed.groupBy(where).agg(F.count(F.lit(1)).alias(held))
    seen = keyed.select(row, where, F.explode(F.array_distinct(F.transform(own, lambda x: F.unhex(F.md5(x))))).alias(digest))
    counted = seen.groupBy(where, digest).agg(F.count(F.lit(1)).alias("n"))
    common = counted.filter(F.col("n") >= least_pages).join(sites, where).filter(F.col("n") > F.lit(float(ratio)) * F.col(held))
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    common = common.select(where, digest, salts.alias(salt))
    mine = seen.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(spread)).cast("int")).join(common, [where, digest, salt])
    lists = mine.groupBy(row).agg(F.collect_set(digest).alias(dropped))
    kept = F.filter(own, lambda x: ~F.array_contains(F.col(dropped), F.unhex(F.md5(x))))
    out = keyed.join(lists, row, "left").withColumn(dropped, F.when(F.col(dropped).isNull(), F.col(own)).otherwise(kept))
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (text, "n_lines", "n_dropped")]
    return out.select(*others, F.array_join(dropped, "\n").alias(text), F.size(own).cast("bigint").alias("n_lines"),
                      (F.size(own) - F.size(dropped)).cast("bigint").alias("n_dropped"))
