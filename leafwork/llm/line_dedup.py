"""Line dedup: lines that too large a part of a site's pages has are boilerplate. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, join_by_weight, written

#: Elements whose tags end a line.
BLOCKS = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul".split()
#: The entities that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

#: The lists of dropped lines are broadcast up to so many bytes in all, measured before.
MOST_BROADCAST = 8_000_000


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The text lines of a page, trimmed, white space as one space, empty ones left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", "\n"), "<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n[\n ]*", "\n")
    return F.filter(F.split(F.trim(text), "\n"), lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text: each page's lines without those on more than ``ratio`` of its host's pages.

    A line must be on ``min_pages`` pages at least to be dropped, so hosts of one or two pages keep all. A page counts
    once for each line however often it repeats it; every row counts as a page, repeated rows too. A null or empty page has
    no lines and an empty text; pages whose URL is null or has no host form one host, "". Other columns aren't read.
    Hot hosts are counted by partial sums, and a host's list of dropped lines has at most 1 / ratio times as many
    entries as its pages have lines on average; lists are broadcast if all of them have MOST_BROADCAST bytes at most.
    """
    # pages are parsed once: the lines are counted first and filtered afterwards
    p = written(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("_lines")))
    hosts = p.groupBy("host").agg(F.count("*").alias("_pages"))
    found = p.select("host", F.explode(F.array_distinct("_lines")).alias("_line")).groupBy("host", "_line").agg(F.count("*").alias("_found"))
    # the host's total joins its few lines that are on min_pages pages or more
    often = found.filter(F.col("_found") >= min_pages)
    hosts = checkpointed(hosts)
    total = hosts.agg(F.sum("_pages")).first()[0] or 0
    over = join_by_weight(often, hosts, ["host"], "_pages", total, F.xxhash64("_line")).filter(F.col("_found") > F.col("_pages") * ratio)
    lists = checkpointed(over.groupBy("host").agg(F.collect_list("_line").alias("_drop"), F.first("_pages").alias("_pages")))
    # pages need no shuffle where all lists together are small; beyond that hosts of many pages are split
    size = lists.agg(F.sum(F.aggregate("_drop", F.lit(100), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    small = size <= MOST_BROADCAST
    out = p.join(F.broadcast(lists), "host", "left") if small else join_by_weight(p, lists, ["host"], "_pages", total, F.xxhash64("page_id"))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_drop", x)))
    out = out.withColumn("_kept", kept)
    return out.select(
        "page_id", "host", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text")
    )
