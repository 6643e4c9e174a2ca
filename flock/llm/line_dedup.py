"""Operator 1, line dedup: lines that many pages of one site share go.

Site-relative frequency: for each host, the pages that contain a line are
divided by the host's pages; lines above a boilerplate ratio are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._util import BROADCAST_BYTES, unused

_BLOCK = "(?i)</?(?:p|div|ul|ol|li|h[1-6]|br|hr|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|meta)(?:[\\s/][^<>]*)?>"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
             ("&middot;", "·"), ("&amp;", "&")]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null when there is none."""
    h = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", h)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element, blank lines left out."""
    t = F.regexp_replace(html, "(?is)<(?:script|style)\\b.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, _BLOCK, "\n"), "<[^<>]*>", "")
    for name, char in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\r]+", " "), " ?\\n[ \\n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def line_dedup(docs: DataFrame, host_col: str = "host", text_col: str = "text", max_ratio: float = 0.1,
               min_pages: int = 5, page_col: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` less the boilerplate lines, plus ``n_lines``
    and ``n_dropped`` (replaced if ``docs`` has columns of these names).

    A line is boilerplate on a host when at least ``min_pages`` of its pages
    and more than ``max_ratio`` of them contain it.  Lines are compared without
    outer blanks; a line counts once a page; blank lines are never dropped.
    Repeated rows are pages of their own unless ``page_col`` is given: then rows of
    a host with one value in it are one page, with the lines of them all.  A null host or text leaves the row
    as it is (n_lines 0 for a null text); an empty text has one blank line.

    Scale: lines travel as (host, 128-bit hash) rows, combined per task before
    the shuffle, so a hot host or line is one row per task; with ``page_col``, as
    (host, page, hash) rows, told apart first and counted then.  A host's
    boilerplate has at most (mean lines a page) / ``max_ratio`` lines, so its
    hashes fit in one array; hosts meet pages by broadcast when all arrays
    together measure small, else by a join whose skewed host AQE splits.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    own = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""))
    rows = docs.where(F.col(host_col).isNotNull())
    page = [] if page_col is None else [F.col(page_col).alias("_p")]
    seen = rows.select(F.col(host_col).alias("_h"), *page, F.explode(own).alias("_l")).select("_h", *["_p"] * len(page), F.unhex(F.md5("_l")).alias("_k"))
    pages = rows.select(F.col(host_col).alias("_h"), *page)
    if page:
        seen, pages = seen.distinct(), pages.distinct()
    pages = pages.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    common = seen.groupBy("_h", "_k").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_pages)
    host, gone, left = unused(docs, "_h"), unused(docs, "_gone"), unused(docs, "_left")
    bad = materialize(common.join(pages, "_h").where(F.col("_c") > F.col("_n") * F.lit(float(max_ratio)))
                      .groupBy(F.col("_h").alias(host)).agg(F.collect_list("_k").alias(gone)))
    size = bad.select(F.sum(F.size(gone) * 24 + 64)).first()[0] or 0
    if size == 0:
        joined = docs.withColumn(gone, F.lit(None).cast("array<binary>"))
    else:
        joined = docs.join(F.broadcast(bad) if size <= BROADCAST_BYTES else bad, F.col(host_col).eqNullSafe(F.col(host)), "left").drop(host)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), F.unhex(F.md5(F.trim(x)))))
    out = joined.withColumn(left, F.when(F.col(gone).isNotNull(), kept))  # other hosts' lines are not hashed again
    untouched = F.col(gone).isNull() | F.col(text_col).isNull()
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    out = out.withColumn("n_lines", n.cast("long")).withColumn(
        "n_dropped", F.when(untouched, F.lit(0)).otherwise(n - F.size(left)).cast("long"))
    return out.withColumn(text_col, F.when(untouched, F.col(text_col)).otherwise(F.array_join(left, "\n"))).drop(gone, left)


def page_line_dedup(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """Line dedup of raw web pages: page_id, host, n_lines, n_dropped, text.

    The visible texts are written once: they are read for the counts and again
    for the result, and taking them out of the markup is most of the work."""
    d = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")))
    return line_dedup(d, "host", "text", max_ratio, min_pages).select("page_id", "host", "n_lines", "n_dropped", "text")
