"""Websites the register does not list: candidates, the match with page text, the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.contact import host_of, normalize_site, own_domain
from ..session import cut_lineage
from .evidence import join_url, page_links, page_text
from .reading import address, allowed, fetched
from .status import at, days

STEM_KEY = 4  # no name stem is shorter


def eligible(providers: DataFrame, as_of) -> DataFrame:
    """Practices without a known site: a visitor suggested one, or the mailbox may tell."""
    due = F.col("web_search_at").isNull() | (F.col("web_search_at") < at(as_of) - days(V.SEARCH_RETRY_DAYS))
    return providers.filter(
        F.col("active") & (F.coalesce("web", F.lit("")) == "") & F.col("web_found").isNull()
        & (F.col("web_suggested").isNotNull() | (F.col("email").contains("@") & due))
    )


def site_candidates(providers: DataFrame, as_of) -> DataFrame:
    """(url, source, provider): one row per practice to try, suggestions before mailboxes.

    Mail domains of many practices belong to a hospital or chain and are left out by a count per
    domain; no group of practices is ever collected.
    """
    rows = eligible(providers, as_of).select(
        "provider_id", "name", "ico", "city", normalize_site(F.col("web_suggested")).alias("suggested"),
        normalize_site(own_domain(F.col("email"))).alias("mailed"),
    )
    source = F.when(F.col("suggested").isNotNull(), "user").when(F.col("mailed").isNotNull(), "email")
    rows = rows.select("provider_id", "name", "ico", "city", F.coalesce("suggested", "mailed").alias("url"), source.alias("source"))
    rows = rows.filter(F.col("url").isNotNull())
    shared = (
        rows.filter(F.col("source") == "email").groupBy("url").agg(F.count("*").alias("n"))
        .filter(F.col("n") > V.MAX_PER_EMAIL_DOMAIN)
    )
    return rows.join(shared.select("url"), "url", "left_anti")


def _long_words(folded: Column, skip: Column, least: int = 5) -> Column:
    return F.filter(T.words(folded), lambda w: (F.length(w) >= least) & ~F.array_contains(skip, w))


def name_tokens(name: Column, city: Column) -> Column:
    """Words that identify a practice. With a doctor's title only the first person's surname does."""
    generic = F.array(*[F.lit(w) for w in dict.fromkeys(V.GENERIC_NAME_WORDS)])
    skip = F.concat(generic, F.split(F.trim(T.normalize_text(F.coalesce(city, F.lit("")))), r"\s+"))

    def chosen(x: Column) -> Column:
        words = F.array_distinct(x["words"])
        surname = F.coalesce(F.element_at(F.nullif(x["own"], F.array().cast("array<string>")), -1), F.element_at(x["words"], -1))
        return F.when(x["n"].rlike(V.TITLES) & (F.size(words) > 0), F.array(surname)).otherwise(words)

    def parts(s: Column) -> Column:
        person = F.get(F.split(s["n"], V.FIRST_PERSON_END), 0)
        return F.struct(
            s["n"].alias("n"), _long_words(s["n"], s["skip"]).alias("words"), _long_words(person, s["skip"]).alias("own")
        )

    start = F.struct(T.normalize_text(name).alias("n"), skip.alias("skip"))
    return T.let(T.let(start, parts), chosen)


def stems(tokens: Column) -> Column:
    """Name words as texts may carry them: the ending of longer ones may change."""
    return F.transform(tokens, lambda t: F.when(F.length(t) >= 6, F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t))


def company_number(ico: Column) -> Column:
    """Digits of a company number without leading zeros, NULL when too short to tell practices apart."""
    number = F.ltrim(F.regexp_replace(F.coalesce(ico, F.lit("")), "[^0-9]", ""), F.lit("0"))
    return F.when(F.length(number) >= 6, number)


def index_key(word: Column) -> Column:
    """Where a word stands in the index: numbers without leading zeros, other words by their first four signs."""
    return F.when(word.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.ltrim(word, F.lit("0")))).otherwise(F.substring(word, 1, STEM_KEY))


def word_index(texts: DataFrame) -> DataFrame:
    """(page_id, key, word): every distinct word of each text once, and a row with a null word where the text speaks of care."""
    folded = texts.select("page_id", T.normalize_text(F.col("text")).alias("folded"))
    care = F.when(F.col("folded").rlike(V.CARE_WORDS), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    words = F.array_distinct(F.regexp_extract_all("folded", F.lit(r"\w+"), 0))
    rows = folded.select("page_id", F.explode(F.concat(words, care)).alias("word"))
    return cut_lineage(rows.select("page_id", index_key(F.col("word")).alias("key"), "word"))


def pages_to_read(candidates: DataFrame, pages: DataFrame, robots: DataFrame) -> DataFrame:
    """(url, page_id, home_url) of candidate addresses: the page there, and the contact page that its first such link leads to."""
    rules, known = cut_lineage(robots), cut_lineage(fetched(pages))
    asked = candidates.select("url").distinct()
    homes = cut_lineage(allowed(asked, rules).withColumn("address", address(F.col("url"))).join(known, "address").select("url", "page_id"))
    home_pages = pages.join(homes.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "url", "html")
    home_urls = home_pages.select("page_id", F.col("url").alias("home_url"))
    links = page_links(home_pages)
    contact = links.filter(T.normalize_text(F.concat_ws(" ", "href", "label")).rlike(V.CONTACT_PAGE))
    first = contact.groupBy("page_id").agg(F.min_by(F.struct("url", "href"), "pos").alias("l"))
    led = cut_lineage(first.select("page_id", host_of(F.col("l.url")).alias("host"), join_url(F.col("l.url"), F.col("l.href")).alias("to")))
    same_host = led.filter(host_of(F.col("to")) == F.col("host")).select("page_id", F.col("to").alias("url"))
    follow = allowed(same_host, rules).withColumn("address", address(F.col("url"))).join(known.withColumnRenamed("page_id", "contact_id"), "address")
    at_home = homes.join(home_urls, "page_id")
    at_contact = at_home.join(follow.select("page_id", "contact_id"), "page_id").select("url", F.col("contact_id").alias("page_id"), "home_url")
    return cut_lineage(at_home.select("url", "page_id", "home_url").unionByName(at_contact).distinct())


def named_on(candidates: DataFrame, reading: DataFrame, index: DataFrame) -> DataFrame:
    """(provider_id, source) of candidates whose company number or name stands on a page of theirs.

    Words meet by equality on (page, key) and the ending is looked at afterwards, so a portal's page spreads over as many
    keys as its practices' names have, and no text is moved.
    """
    number = company_number(F.col("ico"))
    of_name = F.transform(stems(name_tokens(F.col("name"), F.col("city"))), lambda t: F.struct(index_key(t).alias("key"), t.alias("stem")))
    of_number = F.when(number.isNotNull(), F.array(F.struct(F.concat(F.lit("#"), number).alias("key"), F.lit(None).cast("string").alias("stem"))))
    empty = F.array().cast("array<struct<key:string,stem:string>>")
    asked = candidates.select("provider_id", "source", "url", F.explode(F.concat(of_name, F.coalesce(of_number, empty))).alias("n")).select(
        "provider_id", "source", "url", "n.key", "n.stem")
    met = asked.join(reading.select("url", "page_id"), "url").join(index.filter("word is not null"), ["page_id", "key"])
    ending = F.substring("word", F.length("stem") + 1, F.length("word"))
    fits = F.col("stem").isNull() | (F.col("word").startswith(F.col("stem")) & ending.rlike("^[a-z]{0,3}$"))
    return met.filter(fits).select("provider_id", "source").distinct()


def in_domain(host: Column, name: Column) -> Column:
    """Does the domain's own label contain a word of the name?"""
    labels = F.split(host, r"\.")
    label = F.regexp_replace(F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(host), "[^a-z0-9]", "")
    generic = F.array(*[F.lit(w) for w in dict.fromkeys(V.GENERIC_NAME_WORDS)])
    words = _long_words(T.normalize_text(name), generic, 4)
    return T.let(label, lambda x: F.exists(words, lambda w: x.contains(w)))


def match_sites(candidates: DataFrame, pages: DataFrame, robots: DataFrame) -> DataFrame:
    """(candidate_url, source, provider_id, matched, found_url): which candidate sites are really the practice's own.

    ``pages``: (page_id, url, html); ``robots``: (host, prefix, allow). Candidates whose page was not fetched or is closed are
    left out. A site is a practice's own when its page or its contact page speaks of care and one of them, or the domain, names it.
    """
    reading = pages_to_read(candidates, pages, robots)
    opened = pages.join(reading.select("page_id").distinct(), "page_id", "left_semi")
    index = word_index(opened.select("page_id", page_text(F.col("html")).alias("text")))
    named = named_on(candidates, reading, index).withColumn("named", F.lit(True))
    care = reading.join(index.filter("word is null").select("page_id", F.lit(True).alias("care")), "page_id", "left")
    sites = care.groupBy("url").agg(F.coalesce(F.bool_or("care"), F.lit(False)).alias("care"), F.min("home_url").alias("home_url"))
    host = host_of(F.col("home_url"))
    both = candidates.join(sites, "url").join(named, ["provider_id", "source"], "left").withColumn(
        "matched", F.col("care") & (F.coalesce("named", F.lit(False)) | in_domain(host, F.col("name"))))
    root = F.concat(F.regexp_extract("home_url", "^([^:]+://[^/?#]*)", 1), F.lit("/"))
    return both.select(F.col("url").alias("candidate_url"), "source", "provider_id", "matched", F.when(F.col("matched"), root).alias("found_url"))


def record_sites(providers: DataFrame, candidates: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    """Providers after the search: found sites kept, suggestions used up, the search remembered."""
    tried = candidates.select("provider_id", "source").distinct().join(
        matches.filter("matched").select("provider_id", "source", "found_url"), ["provider_id", "source"], "left"
    ).select("provider_id", F.col("source").alias("tried_by"), "found_url")
    was_tried = F.col("tried_by").isNotNull()
    take = F.col("found_url").isNotNull() & (F.coalesce("web", F.lit("")) == "")
    before = F.col("web_found_source") if "web_found_source" in providers.columns else F.lit(None)
    return (
        providers.join(tried, "provider_id", "left")
        .withColumns(
            {
                "web_search_at": F.when(was_tried, at(as_of)).otherwise(F.col("web_search_at")),
                "web_suggested": F.when(F.col("tried_by") == "user", F.lit(None)).otherwise(F.col("web_suggested")),
                "web_found": F.when(take, F.col("found_url")).otherwise(F.col("web_found")),
                "web_found_source": F.when(take, F.col("tried_by")).otherwise(before),
            }
        )
        .drop("tried_by", "found_url")
    )


def suggest_sites(providers: DataFrame, reports: DataFrame) -> DataFrame:
    """A visitor's website becomes a suggestion where none is known. ``reports``: (provider_id, site, ts)."""
    newest = reports.filter(F.col("site").isNotNull()).groupBy("provider_id").agg(F.max_by("site", "ts").alias("new_site"))
    unknown = (F.coalesce("web", F.lit("")) == "") & F.col("web_found").isNull()
    return (
        providers.join(newest, "provider_id", "left")
        .withColumn("web_suggested", F.when(unknown, F.coalesce("new_site", "web_suggested")).otherwise(F.col("web_suggested")))
        .drop("new_site")
    )


def discover_summary(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Outcome by source."""
    seen = candidates.join(matches.select("provider_id", "source", "matched"), ["provider_id", "source"], "left")
    outcome = F.when(F.col("matched"), "found").when(F.col("matched").isNull(), "unread").otherwise("not theirs")
    return seen.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))
