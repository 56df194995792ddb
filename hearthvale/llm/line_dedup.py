"""Line deduplication by site-relative frequency (DataFrame functions only).

A line (trimmed of spaces) is boilerplate on a host when more than ``ratio``
of the host's pages contain it, and at least ``min_pages`` do. Lines are named
by two independent 64-bit hashes, so text is never shuffled to count; each
page counts a line once, and counts are combined before the shuffle, so one
large host is no large group. A host's boilerplate list is short: at most its
mean number of distinct lines per page divided by ``ratio``.

Edge cases: a null text has no lines and stays null; blank lines are neither
counted nor dropped; a null host is a host of its own; repeated rows are
separate pages; a page may be left with an empty text and stays; an empty
table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import staged

RATIO, MIN_PAGES = 0.2, 5

_BLOCK = r"(?is)<(?:/?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|title|h[1-6]|table|tr|td)\b[^>]*|!--.*?--)>"
_CODE = r"(?is)<script\b.*?</script>|<style\b.*?</style>"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
_TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def html_lines(html: Column) -> Column:
    """Text of a raw page, one line for each block element."""
    shown = F.regexp_replace(html, _CODE, "")
    return F.regexp_replace(F.regexp_replace(shown, _BLOCK, "\n"), _TAG, "")


def _name(line: Column) -> Column:
    text = F.trim(line)
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: the hash pairs of each host's boilerplate lines."""
    rows = pages.select(host.alias("host"), F.split(text, "\n", -1).alias("lines"))
    names = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _name))
    counts = (rows.select("host", F.explode(names).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
              .filter(F.col("n") >= min_pages))
    # Both small results are written: joins with them start from files of known
    # size, so Spark broadcasts them or splits a large host's partition.
    totals = staged(rows.groupBy("host").agg(F.count("*").alias("pages")), "host-totals")
    same = counts["host"].eqNullSafe(totals["host"])
    found = (counts.join(totals, same).filter(F.col("n") > F.col("pages") * F.lit(float(ratio)))
             .groupBy(counts["host"].alias("host")).agg(F.collect_list("line").alias("lines")))
    return staged(found, "boilerplate")


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     out: str = "text", host_out: str | None = None, dropped_out: str | None = None,
                     lines_out: str | None = None) -> DataFrame:
    """``pages`` with column ``out`` holding the text without boilerplate
    lines, and if named, the host and the counts of all and of dropped lines."""
    bad = boilerplate(pages, host, text, ratio, min_pages)
    bad = bad.select(F.col("host").alias("__host_b"), F.col("lines").alias("__bad"))
    rows = pages.withColumns({"__host": host, "__lines": F.split(text, "\n", -1)})
    rows = rows.join(bad, F.col("__host").eqNullSafe(F.col("__host_b")), "left")
    kept = F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", _name(x))))
    rows = rows.withColumn("__kept", kept)
    new = {out: F.array_join("__kept", "\n")}
    if host_out:
        new[host_out] = F.col("__host")
    if lines_out:
        new[lines_out] = F.greatest(F.size("__lines"), F.lit(0))
    if dropped_out:
        new[dropped_out] = F.greatest(F.size("__lines"), F.lit(0)) - F.greatest(F.size("__kept"), F.lit(0))
    return rows.withColumns(new).drop("__host", "__lines", "__host_b", "__bad", "__kept")
