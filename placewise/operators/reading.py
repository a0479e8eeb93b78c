"""Which fetched pages a reader of each site opens, and in which order: home page, best links, English version.

The link graph is page to page by equality on addresses: only home pages are searched for links, only addresses are
shuffled, and page texts come in for the pages that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.contact import host_of, url_path, url_query
from ..functions.text import let
from ..session import cut_lineage
from .evidence import english_link, page_links, rank_links, same_site

BLOCKED, UNREAD = "blocked by robots.txt", "not fetched"


def address(url: Column) -> Column:
    """What two addresses of one page have in common: host, path without a last slash, query."""
    query = let(url_query(url), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.concat(host_of(url), F.rtrim(url_path(url), F.lit("/")), query)


def fetched(pages: DataFrame) -> DataFrame:
    """(address, page_id): the newest page of each address."""
    return pages.groupBy(address(F.col("url")).alias("address")).agg(F.max("page_id").alias("page_id"))


# ------------------------------------------------------------------------------- robots
def rule_pattern(rule: Column) -> Column:
    """A robots rule as a regular expression: ``*`` is any run of signs, a last ``$`` the end, all else stands for itself."""
    ends = rule.endswith("$")
    body = F.when(ends, F.regexp_replace(rule, r"\$$", "")).otherwise(rule)
    literal = F.transform(F.split(body, r"\*"), lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?s)^"), F.array_join(literal, ".*"), F.when(ends, "$").otherwise(""))


def allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """URLs their site lets crawlers read: the longest rule that matches decides, of equal ones the one that allows.

    ``robots``: (host, prefix, allow); a prefix may hold ``*`` and end in ``$``. A path is looked up by equality once for
    each length that the literal beginnings of its host's rules have, so rows follow rules, not signs of paths.
    """
    stem = F.regexp_extract("prefix", r"^([^*$]*)", 1)
    rules = robots.filter("host is not null and prefix <> '' and allow is not null").select(
        "host", stem.alias("stem"), "prefix", "allow", F.col("prefix").rlike(r"\*|\$$").alias("wild"), rule_pattern(F.col("prefix")).alias("pattern")
    )
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("stem")).alias("lengths"))  # as many as a robots file has
    path = F.concat(let(url_path(F.col("url")), lambda p: F.when(p == "", "/").otherwise(p)), F.regexp_extract("url", r"^[^?#]*(\?[^#]*)", 1))
    asked = urls.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path}).join(lengths, "host")
    short = F.filter("lengths", lambda n: n <= F.length("path"))
    tried = asked.select("url", "host", "path", F.explode(short).alias("n")).withColumn("stem", F.substring("path", F.lit(1), F.col("n")))
    ruled = tried.join(rules, ["host", "stem"]).filter(~F.col("wild") | F.regexp("path", F.col("pattern")))
    last = ruled.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(last.filter(~F.col("allow")), "url", "left_anti")


# ------------------------------------------------------------------------------- reading order
def reading_order(sites: DataFrame, pages: DataFrame, robots: DataFrame, k: int = 2) -> DataFrame:
    """(site, page_id, page_rank, role): ``home`` has rank 0, the ``k`` best links of it 1 to k, its ``english`` version k + 1.

    ``sites``: (site, url of the home page); ``pages``: (page_id, url, html); ``robots``: (host, prefix, allow). Links that
    robots close, or whose page was not fetched, are passed over; pages that no link leads to are not read.
    """
    known = cut_lineage(fetched(pages))
    rules = cut_lineage(robots)
    homes = cut_lineage(
        allowed(sites.select("site", "url", address(F.col("url")).alias("address")), rules).join(known, "address").select("site", "page_id")
    )
    home_pages = pages.join(homes.select("page_id"), "page_id", "left_semi").select("page_id", "url", "html")
    links = cut_lineage(same_site(page_links(home_pages)))  # addresses are worked out once
    best = rank_links(links, k).select("page_id", "to", F.col("rn").alias("page_rank"), F.lit("link").alias("role"))
    english = english_link(links).select("page_id", "to", F.lit(k + 1).alias("page_rank"), F.lit("english").alias("role"))
    asked = cut_lineage(best.unionByName(english).join(homes, "page_id").select("site", F.col("to").alias("url"), "page_rank", "role"))
    followed = allowed(asked, rules).withColumn("address", address(F.col("url"))).join(known, "address")
    start = homes.select("site", "page_id", F.lit(0).alias("page_rank"), F.lit("home").alias("role"))
    return cut_lineage(start.unionByName(followed.select("site", "page_id", "page_rank", "role")))


def site_errors(sites: DataFrame, order: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, error) of sites whose home page could not be read."""
    unread = sites.join(order.filter("role = 'home'").select("site"), "site", "left_anti").select("site", "url")
    open_ = allowed(unread, robots).select("site", F.lit(UNREAD).alias("error"))
    return unread.join(open_, "site", "left").select("site", F.coalesce("error", F.lit(BLOCKED)).alias("error"))


def in_order(evidence: DataFrame, order: DataFrame) -> DataFrame:
    """What each page says, with its place on the sites that lead to it."""
    return order.join(evidence.drop("site"), "page_id")


def english_version(read: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, flag, snippet) from English pages: English spoken, else only a site in English; nothing where it is known already.

    ``read``: pages in order with ``eng`` (the quote that English is spoken) and ``english_text``; ``facts``: the sites' facts so far.
    """
    known = facts.filter("flag = 'english'").select("site")
    pages = read.filter("role = 'english'").join(known, "site", "left_anti")
    flag = F.when(F.col("eng").isNotNull(), "english").when(F.col("english_text"), "english_site")
    rows = pages.select("site", flag.alias("flag"), F.coalesce("eng", F.lit(V.ENGLISH_SITE_NOTE)).alias("snippet"))
    return rows.filter("flag is not null")
