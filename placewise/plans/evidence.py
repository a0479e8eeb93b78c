"""Registered queries: page evidence, reconciliation, website discovery."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import values as V
from ..functions import contact as C
from ..functions import text as T
from ..operators import cards as K
from ..operators import discover as DI
from ..operators import evidence as E
from ..operators import reading as R
from ..operators import reconcile as RC
from ..session import spread
from ..sources import domain as D
from ..sources import pages as P
from .registry import STEPS, query
from .serving import us

YEAR = int(D.AS_OF[:4])
US, DAY = D.AS_OF_US, D.DAY_US
q = lambda s: "'" + s.replace("'", "''") + "'"
any_of = lambda ps: q("|".join(f"(?:{p})" for p in ps))


def replace_all(text, patterns, by):
    for p in patterns:
        text = f"regexp_replace({text}, {q(p)}, {by}, 'g')"
    return text


TEXT_SQL = replace_all("html", [
    "(?s)<!--.*?-->", "(?is)<script\\b[^>]*>.*?</script\\s*>", "(?is)<style\\b[^>]*>.*?</style\\s*>",
], "''")
TEXT_SQL = replace_all(TEXT_SQL, ["(?i)</?(?:p|div|li|br|h[1-6]|tr|section|article|header|footer)\\b[^>]*>"], "chr(10)")
TEXT_SQL = replace_all(TEXT_SQL, ["<[A-Za-z/!?][^>]*>"], "''")
for entity, sign in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    TEXT_SQL = f"replace({TEXT_SQL}, '&{entity};', '{sign}')"
NORM_SQL = "regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[ \\t\\r\\f\\v]+', ' ', 'g')"
QUIET = "|".join(f".{{0,{80 - len(w)}}}{w}.{{0,80}}" for w in V.UI_WORDS)
RECENT = "|".join(str(y) for y in range(YEAR - 1, 2050))
STALE = f"(regexp_matches(s, {q(chr(92) + 'b20[0-4][0-9]' + chr(92) + 'b')}) AND NOT regexp_matches(s, {q(chr(92) + 'b(?:' + RECENT + ')' + chr(92) + 'b')}))"
HOST = "lower(split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1))"


# Facts: quotes of English with what stands before them, self-payment, insurers near words of contracts.
bare = lambda p: p.replace(V.ONE_INSURER, "").replace("(?![^.!?\\n]{0,30}(?:vzp|cpzp|ozp|rbp|vozp|zpmv|\\b2\\d\\d\\b))", "")
SAID_ENGLISH = " OR ".join(
    f"len(list_filter(regexp_extract_all(norm, {q('(?s)(.{0,25})(?:' + p + ')')}, 1), lambda x: NOT regexp_matches(x, {q(V.ENGLISH_NEGATION)}))) > 0" for p in V.ENGLISH)
SAID_ENGLISH = f"({SAID_ENGLISH})"
SAID_PAY = f"len(list_filter(string_split_regex(norm, '[.!?\\n]'), lambda s: regexp_matches(s, {any_of([bare(p) for p in V.SELF_PAY])}) AND NOT regexp_matches(s, {q(V.SELF_PAY_EXTRA)}))) > 0"
WINDOWS = f"regexp_extract_all(norm, {q('(?s).{0,120}(?:' + V.CONTRACT_WORDS + ').{0,160}')})"
NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, {q(p)}) THEN '{c}' END" for c, p in V.INSURER_WORDS.items()) + "], lambda c: c IS NOT NULL)"
NUMBERS = f"list_distinct(regexp_extract_all(x, {q(V.INSURER_CODES)}))"
CODES = f"""list_distinct(flatten(list_transform({WINDOWS}, lambda x: CASE WHEN regexp_matches(x, {q(V.NO_CONTRACT)}) THEN [] WHEN regexp_matches(x, {q(V.ALL_INSURERS)}) THEN [{", ".join(map(q, V.INSURER_WORDS))}]
    WHEN len({NUMBERS}) >= 2 OR (len({NUMBERS}) > 0 AND len({NAMED}) > 0) THEN list_distinct(list_concat({NAMED}, {NUMBERS})) ELSE {NAMED} END)))"""


def path_sql(url):
    return f"regexp_extract({url}, '^[^:]+://[^/?#]*([^?#]*)', 1)"


def address_sql(url):
    return f"lower(regexp_extract({url}, '^[^:]+://([^/?#]*)', 1)) || rtrim({path_sql(url)}, '/') || regexp_extract({url}, '(\\?[^#]+)', 1)"


def open_sql(url, host):
    """Does the longest matching rule of its robots file let this address be read?"""
    return f"""coalesce((SELECT arg_max(allow, length(prefix) * 2 + allow::INT) FROM robots x
        WHERE x.host = {host} AND regexp_matches({path_sql(url)} || regexp_extract({url}, '(\\?[^#]+)', 1), x.pattern)), true)"""


LINK_SQL = """
    SELECT DISTINCT page_id, url, CASE WHEN href LIKE 'http%' THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || href
           ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS dest, href, label, pos FROM (
        SELECT page_id, url, regexp_replace(regexp_extract(part, 'href="([^"]*)"', 1), '#.*$', '') AS href, lower(strip_accents(trim(regexp_replace(part, '(?s)<[^>]*>', ' ', 'g')))) AS label, pos
          FROM (SELECT page_id, url, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM (
                SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS parts FROM crawl_pages)))"""
SCORE_SQL = "CASE " + " ".join(f"WHEN contains(hay, '{h}') THEN {len(V.LINK_HINTS) - i}" for i, h in enumerate(V.LINK_HINTS)) + " ELSE 0 END"
EN_SQL = f"(regexp_matches({path_sql('dest')}, {q(V.EN_PATH)}) OR regexp_matches(label, {q(V.EN_LABEL)}))"


def rank_sql(home):
    """The two best links of every page, seen from the address ``home``."""
    return f"""
    SELECT page_id, dest AS "to", score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, dest) AS INT) AS rn FROM (
        SELECT page_id, dest, max(score) AS score, min(pos) AS pos FROM (
            SELECT *, {SCORE_SQL} AS score FROM (
                SELECT *, lower(strip_accents({path_sql('dest')})) || ' ' || label AS hay, {path_sql('home')} AS path FROM (SELECT *, {home} AS home FROM ({LINK_SQL}))))
         WHERE score > 0 AND rtrim(dest, '/') <> rtrim(home, '/') AND starts_with({path_sql('dest')},
               CASE WHEN path LIKE '%/' THEN path WHEN regexp_matches(path, '\\.[^/]*$') THEN regexp_replace(path, '[^/]*$', '') ELSE path || '/' END)
         GROUP BY 1, 2) QUALIFY rn <= 2"""


STEPS.update({
    "page_texts": f"SELECT page_id, url, {HOST} AS site, html, {TEXT_SQL} AS text FROM crawl_pages",
    "page_norm": f"SELECT *, {NORM_SQL} AS norm FROM page_texts",
    "page_quiet": f"SELECT *, regexp_replace(norm, {q('(?s)' + QUIET)}, '.', 'g') AS quiet FROM page_norm",
    "page_masked": f"SELECT *, {replace_all('quiet', V.NEGATIVE, chr(39) + '.' + chr(39))} AS masked FROM page_quiet",
    "page_said": f"""
        SELECT *, regexp_matches(quiet, {any_of(V.NEGATIVE)}) AS neg,
               len(list_filter(string_split_regex(quiet, '[.!?\\n]'), lambda s: regexp_matches(s, {any_of(V.WAITLIST)}) AND NOT {STALE})) > 0 AS wait,
               len(list_filter(string_split_regex(masked, '[.!?\\n]'), lambda s: regexp_matches(s, {any_of(V.POSITIVE)}) AND NOT regexp_matches(s, {q(V.PAID_EXTRA)}) AND NOT {STALE})) > 0 AS pos
          FROM page_masked""",
    "page_verdict": """
        SELECT page_id, url, site, CASE WHEN neg AND pos THEN NULL WHEN neg THEN 'not_accepting' WHEN wait THEN 'waitlist' WHEN pos THEN 'accepting' END AS status,
               neg AND pos AS conflicting FROM page_said""",
    "page_facts": f"""
        SELECT page_id, site, unnest(list_concat(CASE WHEN pay THEN ['self_pay'] ELSE list_transform(codes, lambda c: 'ins' || c) END, CASE WHEN eng THEN ['english'] ELSE [] END)) AS flag FROM (
            SELECT page_id, site, {SAID_PAY} AS pay, {SAID_ENGLISH} AS eng, {CODES} AS codes FROM page_norm)""",
    "page_english": f"""
        SELECT page_id, len(list_filter(w, lambda x: x IN ({", ".join(map(q, V.EN_WORDS))}))) AS en, len(list_filter(w, lambda x: x IN ({", ".join(map(q, V.CS_WORDS))}))) AS cs
          FROM (SELECT page_id, regexp_extract_all(norm, '[a-z]+') AS w FROM page_norm)""",
    # robots, addresses, links of home pages
    "sites": f"SELECT {HOST} AS site, 'http://' || {HOST} || '/' AS url, min(page_id) AS n FROM crawl_pages GROUP BY 1, 2",
    "robots": " UNION ALL ".join(
        f"SELECT site AS host, {q(p)} AS prefix, {allow} AS allow, {q('^' + re.escape(p).replace(chr(92) + '*', '.*').replace(chr(92) + '$', '$'))} AS pattern FROM sites WHERE {w.replace('host', 'site')}"
        for w, p, allow in D.ROBOTS),
    "fetched": f"SELECT {address_sql('url')} AS address, max(page_id) AS page_id FROM crawl_pages GROUP BY 1",
    "site_homes": f"SELECT s.site, f.page_id FROM sites s JOIN fetched f ON f.address = {address_sql('s.url')} WHERE {open_sql('s.url', 's.site')}",
    "home_links": f"SELECT h.site, l.* FROM ({LINK_SQL}) l JOIN site_homes h ON h.page_id = l.page_id",
    "asked": f"""
        SELECT h.site, r."to" AS url, r.rn AS page_rank, 'link' AS role FROM ({rank_sql('url')}) r JOIN site_homes h ON h.page_id = r.page_id
        UNION ALL SELECT site, min(dest), 3, 'english' FROM home_links WHERE {EN_SQL} GROUP BY 1""",
    "reading": f"""
        SELECT site, page_id, 0 AS page_rank, 'home' AS role FROM site_homes
        UNION ALL SELECT a.site, f.page_id, a.page_rank, a.role FROM asked a JOIN fetched f ON f.address = {address_sql('a.url')} WHERE {open_sql('a.url', 'a.site')}""",
    "site_best": """
        SELECT r.site, min(page_rank) FILTER (WHERE status IS NOT NULL OR conflicting) AS decisive_rank,
               coalesce(min(page_rank) FILTER (WHERE status IS NOT NULL OR conflicting), 0) AS best
          FROM reading r JOIN page_verdict v ON v.page_id = r.page_id WHERE role <> 'english' GROUP BY 1""",
    "site_verdict": """
        SELECT b.site, s.n, b.decisive_rank, v.page_id, v.url AS page_url, v.status, v.conflicting FROM site_best b JOIN sites s ON s.site = b.site
          JOIN reading r ON r.site = b.site AND r.page_rank = b.best AND r.role <> 'english' JOIN page_verdict v ON v.page_id = r.page_id""",
    "own_facts": """
        SELECT r.site, f.flag, arg_min(r.page_id, r.page_rank) AS page FROM reading r JOIN page_facts f ON f.page_id = r.page_id JOIN site_best b ON b.site = r.site
         WHERE r.role <> 'english' AND (b.decisive_rank IS NULL OR r.page_rank <= b.decisive_rank) GROUP BY 1, 2""",
    "site_facts": f"""
        SELECT * FROM own_facts UNION ALL
        SELECT site, flag, page_id FROM (
            SELECT r.site, r.page_id, CASE WHEN EXISTS (SELECT 1 FROM page_facts f WHERE f.page_id = r.page_id AND flag = 'english') THEN 'english' WHEN en >= 15 AND en > 2 * cs THEN 'english_site' END AS flag
              FROM reading r JOIN page_english e ON e.page_id = r.page_id
             WHERE role = 'english' AND NOT EXISTS (SELECT 1 FROM own_facts o WHERE o.site = r.site AND o.flag = 'english')) WHERE flag IS NOT NULL""",
})


def texts_of(pages):
    return P.readable_pages(pages)


def texts(d):
    return texts_of(d.pages)


def verdicts(d):
    return E.page_verdicts(texts(d).drop("html"), YEAR)


@query("A9_pages_source", f"SELECT {HOST} AS site, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM crawl_pages GROUP BY 1")
def pages_source(d):
    return texts(d).groupBy("site").agg(F.count("*").alias("pages"), F.sum(F.length("html").cast("bigint")).alias("chars"))


# Signs that windows-1250 has too; others are written as a question mark before the page is encoded.
EASTERN = "áâäçéëíîóôöúüýßčěřšž"


@query("A10_page_decode", f"""
    SELECT page_id, md5(CASE page_id % 5 WHEN 2 THEN regexp_replace(html, '[^\\x00-\\x7F{EASTERN}]', '?', 'g')
                                         WHEN 3 THEN regexp_replace(html, '[^\\x00-\\x7F{EASTERN}]', '?', 'g') || chr(65533) ELSE html END) AS digest FROM pages""")
def page_decode(d):
    """UTF-8 declared and not, windows-1250 with a byte of no meaning and without, and a wrong declaration."""
    eastern = F.encode(F.regexp_replace("html", f"[^\\x00-\\x7F{EASTERN}]", "?"), "windows-1250")
    kind = F.col("page_id") % 5
    body = F.when(kind == 2, eastern).when(kind == 3, F.concat(eastern, F.unhex(F.lit("81")))).otherwise(F.encode("html", "UTF-8"))
    said = F.when(kind == 0, "utf-8").when(kind.isin(2, 3), "Windows-1250").when(kind == 4, "us-ascii")
    raw = d.given("pages").select("page_id", body.alias("body"), F.concat(F.lit("text/html; charset="), said).alias("content_type"))
    return raw.select("page_id", F.md5(P.decode_body(F.col("body"), F.col("content_type"))).alias("digest"))


@query("I1_page_text", "SELECT page_id, md5(text) AS digest, length(text) AS chars FROM page_texts")
def page_text(d):
    return texts(d).select("page_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query("I2_page_links", """
    SELECT page_id, href, label, count(*) AS n FROM (
        SELECT page_id, regexp_extract(part, 'href="([^"]*)"', 1) AS href, replace(trim(regexp_replace(part, '(?s)<[^>]*>', ' ', 'g')), '&amp;', '&') AS label
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS part FROM crawl_pages)) GROUP BY 1, 2, 3""")
def page_links(d):
    return E.page_links(d.pages).groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))



@query("I3_rank_links", rank_sql("url"))
def rank_links(d):
    """Links of every page, as if each page were a site's homepage."""
    return E.rank_links(E.page_links(d.pages))


def rooted(d):
    """Links of every page, each taken as its site's root."""
    return E.page_links(d.pages.withColumn("url", F.concat(F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1), F.lit("/"))))


ROOTED_SQL = "crawl_roots"
STEPS[ROOTED_SQL] = "SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' AS url, html FROM crawl_pages"


@query("I3_rank_links_home", rank_sql("url").replace("FROM crawl_pages", f"FROM {ROOTED_SQL}"))
def rank_links_home(d):
    """The same with every page taken as its site's root."""
    return E.rank_links(rooted(d))


@query("I4_english_link", f"""
    SELECT page_id, min(dest) AS "to", 1 AS rank FROM ({LINK_SQL.replace('FROM crawl_pages', f'FROM {ROOTED_SQL}')}) WHERE {EN_SQL} GROUP BY 1""")
def english_link(d):
    return E.english_link(rooted(d))


@query("I5_sentences", f"""
    SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM (
        SELECT doc_id, unnest(string_split_regex({NORM_SQL}, '[.!?\\n]')) AS s FROM documents) GROUP BY 1""")
def sentences(d):
    """Sentences of whole documents, one row each, then counted."""
    rows = spread(d.given("documents")).select("doc_id", F.posexplode(E.sentences(T.normalize_text(F.col("text")))).alias("pos", "s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s").cast("bigint")).alias("chars"))


@query("I6_rule_match", f"""
    SELECT page_id, regexp_matches(norm, {any_of(V.NEGATIVE)}) AS negative, regexp_matches(norm, {any_of(V.WAITLIST)}) AS waitlist,
           regexp_matches(norm, {any_of(V.POSITIVE)}) AS positive FROM page_norm""")
def rule_match(d):
    hit = lambda ps, n: F.col("norm").rlike("|".join(f"(?:{p})" for p in ps)).alias(n)
    df = texts(d).withColumn("norm", T.normalize_text(F.col("text")))
    return df.select("page_id", hit(V.NEGATIVE, "negative"), hit(V.WAITLIST, "waitlist"), hit(V.POSITIVE, "positive"))


@query("I7_rule_excludes", f"""
    SELECT page_id, count(*) FILTER (WHERE regexp_matches(s, {any_of(V.POSITIVE)})) AS positive,
           count(*) FILTER (WHERE regexp_matches(s, {any_of(V.POSITIVE)}) AND regexp_matches(s, {q(V.PAID_EXTRA)})) AS extra,
           count(*) FILTER (WHERE regexp_matches(s, {any_of(V.POSITIVE)}) AND {STALE}) AS stale
      FROM (SELECT page_id, unnest(string_split_regex(norm, '[.!?\\n]')) AS s FROM page_norm) GROUP BY 1""")
def rule_excludes(d):
    rows = texts(d).select("page_id", F.explode(E.sentences(T.normalize_text(F.col("text")))).alias("s"))
    pos = F.col("s").rlike("|".join(f"(?:{p})" for p in V.POSITIVE))
    return rows.groupBy("page_id").agg(
        F.count_if(pos).alias("positive"), F.count_if(pos & F.col("s").rlike(V.PAID_EXTRA)).alias("extra"),
        F.count_if(pos & E.stale(F.col("s"), YEAR)).alias("stale"),
    )


@query("I8_page_verdict", "SELECT page_id, status, conflicting FROM page_verdict")
def page_verdict(d):
    return verdicts(d).select("page_id", "status", "conflicting")


@query("I9_scope", f"""
    SELECT v.page_id, CASE WHEN kids AND NOT adults THEN 'children' WHEN adults AND NOT kids THEN 'adults' ELSE 'all' END AS scope FROM page_verdict v
      JOIN (SELECT page_id, regexp_matches(w, {q(V.KIDS)}) AS kids, regexp_matches(w, {q(V.ADULTS)}) AS adults FROM (
            SELECT page_id, regexp_extract(norm, {q('(?s).{0,80}(?:' + '|'.join(V.NEGATIVE + V.WAITLIST + V.POSITIVE) + ').{0,80}')}) AS w FROM page_norm)) s ON s.page_id = v.page_id
     WHERE v.status IS NOT NULL""")
def scope(d):
    return verdicts(d).filter("status IS NOT NULL").select("page_id", "scope")


@query("I10_page_flags", "SELECT page_id, flag FROM page_facts")
def page_flags(d):
    return E.page_flags(texts(d)).select("page_id", "flag")


@query("I11_looks_english", f"""
    SELECT doc_id, lang, en >= 15 AND en > 2 * cs AS looks_english FROM (
        SELECT doc_id, lang, len(list_filter(w, lambda x: x IN ({", ".join(map(q, V.EN_WORDS))}))) AS en, len(list_filter(w, lambda x: x IN ({", ".join(map(q, V.CS_WORDS))}))) AS cs
          FROM (SELECT doc_id, lang, regexp_extract_all({NORM_SQL}, '[a-z]+') AS w FROM documents))""")
def looks_english(d):
    return spread(d.given("documents")).select("doc_id", "lang", E.looks_english(T.normalize_text(F.col("text"))).alias("looks_english"))


FIELD_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(s, {q(p)}) THEN '{f}' END" for f, p in V.FIELD_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query("I12_attribution", f"""
    SELECT page_id, provider_id, CASE WHEN len(own) <= 1 OR len(list_filter(own, lambda x: x NOT IN ('zubar', 'hygienistka'))) = 0 OR len(list_filter(own, lambda x: x NOT IN ('praktik', 'pediatr'))) = 0
           THEN len(list_intersect(named, own)) > 0 OR NOT (len(named) > 0 OR regexp_matches(s, {q(V.OTHER_FIELDS)})) ELSE len(list_filter(own, lambda x: NOT list_contains(named, x))) = 0 END AS mine
      FROM (SELECT *, {FIELD_SQL} AS named FROM (
            SELECT v.page_id, p.provider_id, string_split(p.specialties, ',') AS own, regexp_extract(n.norm, {q('(?s).{0,50}(?:' + '|'.join(V.NEGATIVE + V.WAITLIST + V.POSITIVE) + ').{0,50}')}) AS s
              FROM page_verdict v JOIN page_norm n ON n.page_id = v.page_id JOIN cards p ON p.provider_id = v.page_id WHERE v.status IS NOT NULL OR v.conflicting))""")
def attribution(d):
    """Is what a page says, in its own words, about the practice of the same number?"""
    said = verdicts(d).filter("snippet IS NOT NULL").select("page_id", "snippet")
    both = said.join(d.cards.select("provider_id", "specialties"), F.col("page_id") == F.col("provider_id"))
    return both.select("page_id", "provider_id", E.attributable(F.col("snippet"), F.col("specialties")).alias("mine"))


def first_word_sql(seen, patterns):
    """The first match in the folded text of the first pattern that ``seen`` holds."""
    return "CASE " + " ".join(f"WHEN regexp_matches({seen}, {q(p)}) THEN regexp_extract(norm, {q(p)})" for p in patterns) + " END"


STEPS.update({
    # the page's text with its accents, sign by sign as long as the folded text
    "page_hits": f"""
        SELECT s.page_id, v.status, s.norm, regexp_replace(array_to_string(list_filter(string_split(s.text, ''), lambda c: unicode(strip_accents(c)) < 128), ''), '[ \t\r\f\v]+', ' ', 'g') AS source,
               CASE WHEN s.neg THEN {first_word_sql('quiet', V.NEGATIVE)} WHEN s.wait THEN {first_word_sql('quiet', V.WAITLIST)} ELSE {first_word_sql('masked', V.POSITIVE)} END AS word
          FROM page_said s JOIN page_verdict v ON v.page_id = s.page_id WHERE v.status IS NOT NULL OR v.conflicting""",
    "page_spans": """
        SELECT *, greatest(pos0 - 50, 1) AS a0, least(pos0 + length(word) + 50, length(norm) + 1) AS b0 FROM (SELECT *, strpos(norm, word) AS pos0 FROM page_hits)""",
    # words that a border cuts are left out
    "page_quotes": """
        SELECT *, a0 + CASE WHEN a0 > 1 AND regexp_matches(substr(norm, a0 - 1, 1), '[a-z0-9]') THEN length(regexp_extract(substr(norm, a0, pos0 - a0), '^[a-z0-9]*')) ELSE 0 END AS a,
               b0 - CASE WHEN regexp_matches(substr(norm, b0, 1), '[a-z0-9]') THEN length(regexp_extract(substr(norm, pos0 + length(word), b0 - pos0 - length(word)), '[a-z0-9]*$')) ELSE 0 END AS b FROM page_spans""",
})


@query("I14_snippet", """
    SELECT page_id, status, CASE WHEN a > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(source, CAST(a AS BIGINT), CAST(b - a AS BIGINT)), '\\s+', ' ', 'g')) || CASE WHEN b <= length(norm) THEN '…' ELSE '' END AS snippet
      FROM page_quotes""")
def snippet(d):
    return verdicts(d).filter("snippet IS NOT NULL").select("page_id", "status", "snippet")


@query("I15_robots_filter", f"SELECT page_id FROM crawl_pages p WHERE {open_sql('p.url', HOST.replace('url', 'p.url'))}")
def robots_filter(d):
    """Pages their site lets crawlers read: folders, file endings and parameters are closed on some hosts, with exceptions."""
    return R.allowed(d.pages.select("page_id", "url"), d.robots).select("page_id")


# ------------------------------------------------------------------------------- per site
class Crawl:
    """One reading of all sites: which pages, in which order, what they say; pages are parsed once."""

    def __init__(self, d):
        self.sites, self.robots = d.sites, d.robots
        self.order = R.reading_order(d.sites, d.pages, d.robots)
        opened = d.pages.join(self.order.select("page_id").distinct(), "page_id", "left_semi")
        self.evidence = E.page_evidence(texts_of(opened), YEAR)
        self.read = R.in_order(self.evidence, self.order)
        self.verdicts = E.site_verdicts(self.read.filter("role <> 'english'"))
        own = E.site_flags(E.facts_of(self.read.filter("role <> 'english'"), "site", "page_rank"), self.verdicts)
        self.facts = own.unionByName(R.english_version(self.read, own))

    def results(self):
        """Each site's verdict for its two practices; some sites could not be loaded."""
        n = F.col("n")
        failed = F.when(n % 10 == 7, "HTTP 503").when(n % 10 == 9, "URLError: timed out")
        sites = self.sites.select("site", "n").join(self.verdicts, "site", "left").join(R.site_errors(self.sites, self.order, self.robots), "site", "left")
        sites = sites.withColumn("error", F.coalesce("error", failed))
        return sites.withColumn("provider_id", F.explode(F.array(n * 2, n * 2 + 1)))

    def found(self, d):
        return RC.found_flags(self.facts, self.results(), K.specialty_lists(d.bridge))


@query("E10_site_best_page", "SELECT site, page_url, status, conflicting FROM site_verdict")
def site_best_page(d):
    return Crawl(d).verdicts.select("site", "page_url", "status", "conflicting")


@query("E10_reading_order", "SELECT site, page_id, CAST(page_rank AS INT) AS page_rank, role FROM reading")
def reading_order(d):
    """Pages that are opened on each site: home, best links, English version."""
    return R.reading_order(d.sites, d.pages, d.robots)


@query("E11_site_flags", "SELECT site, flag FROM site_facts")
def site_flags(d):
    return Crawl(d).facts.select("site", "flag")


STEPS["crawl_results"] = f"""
    SELECT s.site, s.n, v.decisive_rank, v.page_id, v.page_url, v.status, v.conflicting, unnest([2 * s.n, 2 * s.n + 1]) AS provider_id,
           CASE WHEN h.site IS NULL AND NOT {open_sql('s.url', 's.site')} THEN 'blocked by robots.txt' WHEN h.site IS NULL THEN 'not fetched'
                WHEN s.n % 10 = 7 THEN 'HTTP 503' WHEN s.n % 10 = 9 THEN 'URLError: timed out' END AS error
      FROM sites s LEFT JOIN site_homes h ON h.site = s.site LEFT JOIN site_verdict v ON v.site = s.site"""


def results(d):
    return Crawl(d).results()


@query("D17_crawl_summary", """
    SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN conflicting THEN 'conflicting' ELSE coalesce(status, 'nothing') END AS outcome, count(*) AS n
      FROM crawl_results GROUP BY 1""")
def crawl_summary(d):
    return E.crawl_summary(results(d))


@query("L4_check_marks", f"""
    SELECT p.provider_id, CASE WHEN r.provider_id IS NOT NULL THEN {US} END AS web_checked_us, r.error AS web_check_error
      FROM providers p LEFT JOIN crawl_results r ON r.provider_id = p.provider_id""")
def check_marks(d):
    marked = RC.mark_checked(d.providers, results(d), d.as_of)
    return marked.select("provider_id", us("web_checked_at"), "web_check_error")


@query("H26_error_kind", """
    SELECT CASE error WHEN 'HTTP 503' THEN 'HTTP 5xx' WHEN 'URLError: timed out' THEN 'timeout' ELSE error END AS kind, count(*) AS n FROM crawl_results WHERE error IS NOT NULL GROUP BY 1""")
def error_kinds(d):
    failed = results(d).filter("error IS NOT NULL")
    return failed.groupBy(C.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


STEPS["results_own"] = f"""
    SELECT r.*, CASE WHEN len(own) <= 1 OR len(list_filter(own, lambda x: x NOT IN ('zubar', 'hygienistka'))) = 0 OR len(list_filter(own, lambda x: x NOT IN ('praktik', 'pediatr'))) = 0
           THEN len(list_intersect(named, own)) > 0 OR NOT (len(named) > 0 OR regexp_matches(s, {q(V.OTHER_FIELDS)})) ELSE len(list_filter(own, lambda x: NOT list_contains(named, x))) = 0 END AS mine
      FROM (SELECT *, {FIELD_SQL} AS named FROM (
        SELECT r.*, coalesce(string_split(b.specialties, ','), []) AS own, regexp_extract(n.norm, {q('(?s).{0,50}(?:' + '|'.join(V.NEGATIVE + V.WAITLIST + V.POSITIVE) + ').{0,50}')}) AS s
          FROM crawl_results r LEFT JOIN (SELECT provider_id, string_agg(specialty_slug, ',') AS specialties FROM bridge GROUP BY 1) b ON b.provider_id = r.provider_id
          LEFT JOIN page_norm n ON n.page_id = r.page_id)) r"""
STEPS["recent_crawl"] = f"SELECT DISTINCT provider_id, status FROM signals WHERE source = 'web_crawl' AND observed_us > {US} - 6 * {DAY}"
STEPS["decisions"] = """
    SELECT r.provider_id, r.status, CASE WHEN r.error IS NOT NULL THEN 'keep' WHEN r.status IS NULL THEN 'delete' WHEN NOT r.mine THEN 'delete'
           WHEN c.provider_id IS NOT NULL THEN 'refresh' ELSE 'insert' END AS action
      FROM results_own r LEFT JOIN recent_crawl c ON c.provider_id = r.provider_id AND c.status = r.status"""


def decisions(d):
    return RC.decide(results(d), d.signals, K.specialty_lists(d.bridge), d.as_of)


@query("L4_reconcile_crawl", "SELECT provider_id, status, action FROM decisions")
def reconcile_crawl(d):
    return decisions(d).select("provider_id", "status", "action")


@query("M10_crawl_evidence", f"""
    SELECT s.provider_id, s.source, s.status, s.observed_us FROM signals s LEFT JOIN decisions a ON a.provider_id = s.provider_id
     WHERE NOT (s.source = 'web_crawl' AND coalesce(a.action = 'delete', false))
    UNION ALL SELECT provider_id, 'web_crawl', status, {US} FROM decisions WHERE action = 'insert'""")
def crawl_evidence(d):
    """Pages to the next signal log, in one plan."""
    log = RC.apply_decisions(d.signals, decisions(d), d.as_of)
    return log.select("provider_id", "source", "status", us("observed_at"))


@query("J3_crawl_dedup", """
    SELECT r.provider_id, r.status FROM crawl_results r WHERE error IS NULL AND status IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM recent_crawl c WHERE c.provider_id = r.provider_id AND c.status = r.status)""")
def crawl_dedup(d):
    return RC.new_verdicts(results(d), d.signals, d.as_of).select("provider_id", "status")


# The words around a fact may name fields of care.
STEPS["found_facts"] = f"""
    SELECT provider_id, flag FROM (SELECT *, {FIELD_SQL} AS named FROM (
        SELECT r.provider_id, f.flag, coalesce(b.own, []) AS own, CASE f.flag WHEN 'english_site' THEN '' WHEN 'english' THEN regexp_extract(norm, {q('(?s).{0,50}(?:' + '|'.join(V.ENGLISH) + ').{0,50}')})
               WHEN 'self_pay' THEN regexp_extract(norm, {q('(?s).{0,50}(?:' + '|'.join(map(bare, V.SELF_PAY)) + ').{0,50}')}) ELSE regexp_extract(norm, {q('(?s).{0,90}(?:' + V.CONTRACT_WORDS + ').{0,90}')}) END AS s
          FROM crawl_results r JOIN site_facts f ON f.site = r.site JOIN page_norm n ON n.page_id = f.page
          LEFT JOIN (SELECT provider_id, list(specialty_slug) AS own FROM bridge GROUP BY 1) b ON b.provider_id = r.provider_id
         WHERE r.error IS NULL)) WHERE len(list_intersect(named, own)) > 0 OR NOT (len(named) > 0 OR regexp_matches(s, {q(V.OTHER_FIELDS)}))"""


@query("D17_run_summary", """
    SELECT 'outcome' AS part, CASE WHEN error IS NOT NULL THEN 'error' WHEN conflicting THEN 'conflicting' ELSE coalesce(status, 'nothing') END AS name, count(*) AS n
      FROM crawl_results GROUP BY 1, 2
    UNION ALL SELECT 'fact', flag, count(*) FROM found_facts GROUP BY 1, 2
    UNION ALL SELECT 'error', CASE error WHEN 'HTTP 503' THEN 'HTTP 5xx' WHEN 'URLError: timed out' THEN 'timeout' ELSE error END, count(*)
      FROM crawl_results WHERE error IS NOT NULL GROUP BY 1, 2""")
def run_summary(d):
    crawl = Crawl(d)
    return RC.run_summary(crawl.results(), crawl.found(d))


@query("L5_reconcile_flags", f"""
    SELECT provider_id, flag, source, observed_us FROM flags
     WHERE NOT (source = 'web_crawl' AND provider_id IN (SELECT provider_id FROM crawl_results WHERE error IS NULL))
    UNION ALL SELECT provider_id, flag, 'web_crawl', {US} FROM found_facts""")
def reconcile_flags(d):
    crawl = Crawl(d)
    out = RC.reconcile_flags(d.flags, crawl.found(d), crawl.results(), d.as_of)
    return out.select("provider_id", "flag", "source", us("observed_at"))


@query("G4_flag_keep", """
    SELECT provider_id, flag FROM flags
     WHERE source = 'web_crawl' AND provider_id IN (SELECT provider_id FROM crawl_results WHERE error IS NULL)
    EXCEPT SELECT provider_id, flag FROM found_facts""")
def flag_keep(d):
    crawl = Crawl(d)
    return RC.stale_flags(d.flags, crawl.found(d), crawl.results())


# ------------------------------------------------------------------------------- targets
def site_sql(c):
    first = f"list_filter(string_split_regex(coalesce({c}, ''), '[\\s,;]+'), lambda x: x <> '')[1]"
    full = f"CASE WHEN regexp_matches({first}, '^https?://', 'i') THEN {first} ELSE 'http://' || {first} END"
    return full


STEPS.update({
    "listed": f"""
        SELECT p.provider_id, coalesce(nullif(web, ''), web_found) AS web, name, facility_type, (SELECT count(*) FROM bridge x WHERE x.provider_id = p.provider_id) AS n_spec
          FROM providers p WHERE active AND coalesce(nullif(web, ''), web_found) IS NOT NULL AND regexp_matches(city_slug, '^(praha|mesto)')""",
    "listed_sites": f"""
        SELECT provider_id, lower(regexp_extract(u, '^([^/]*//[^/?]*)', 1)) || CASE WHEN regexp_extract(u, '^[^/]*//[^/?]*(.*)$', 1) = '' THEN '/' ELSE regexp_extract(u, '^[^/]*//[^/?]*(.*)$', 1) END AS site
          FROM (SELECT *, {site_sql('web')} AS u FROM listed
                 WHERE n_spec < 3 AND NOT regexp_matches(lower(coalesce(facility_type, '') || ' ' || coalesce(name, '')), 'nemocnic|nad 5 obor|poliklinik|centrum duševního zdraví|zařízení lps'))
         WHERE NOT regexp_matches(lower(regexp_extract(u, '//([^/?]*)', 1)), {q(V.NOT_OWN_SITE)})""",
    "site_groups": "SELECT site, string_agg(CAST(provider_id AS STRING), ',' ORDER BY provider_id) AS ids FROM listed_sites GROUP BY 1 HAVING count(*) <= 5",
})


def listed(d):
    return RC.sites_listed(d.providers, d.bridge, "^(praha|mesto)")


def targets(d):
    return RC.crawl_targets(d.providers, d.bridge, "^(praha|mesto)")


def ids():
    return F.array_join(F.transform("provider_ids", lambda i: i.cast("string")), ",").alias("ids")


@query("M9_crawl_targets", "SELECT site, ids FROM site_groups")
def crawl_targets(d):
    return targets(d).select("site", ids())


@query("D19_site_groups", "SELECT site, count(*) AS practices FROM listed_sites GROUP BY 1 HAVING count(*) <= 5")
def site_groups(d):
    return targets(d).select("site", F.size("provider_ids").cast("bigint").alias("practices"))


@query("B20_big_facility", """
    SELECT provider_id, n_spec >= 3 OR regexp_matches(lower(coalesce(facility_type, '') || ' ' || coalesce(name, '')), 'nemocnic|nad 5 obor|poliklinik|centrum duševního zdraví|zařízení lps') AS big FROM listed""")
def big_facility(d):
    return listed(d).select("provider_id", RC.big_facility(F.col("n_spec"), F.col("facility_type"), F.col("name")).alias("big"))


@query("G5_distinct_providers", "SELECT DISTINCT p.provider_id FROM providers p JOIN bridge b ON b.provider_id = p.provider_id AND b.specialty_slug IN ('zubar', 'hygienistka') WHERE active")
def distinct_providers(d):
    wanted = d.bridge.filter(F.col("specialty_slug").isin("zubar", "hygienistka")).select("provider_id")
    return d.providers.filter("active").join(wanted, "provider_id", "left_semi").select("provider_id")


DROPPED_SQL = "SELECT provider_id FROM listed WHERE provider_id NOT IN (SELECT CAST(unnest(string_split(ids, ',')) AS BIGINT) FROM site_groups)"
STEPS["dropped"] = DROPPED_SQL


@query("G2_dropped_sites", "SELECT provider_id FROM dropped")
def dropped_sites(d):
    return RC.dropped_providers(listed(d), targets(d))


@query("L6_forget_dropped", "SELECT signal_id, provider_id FROM signals WHERE NOT (source = 'web_crawl' AND provider_id IN (SELECT provider_id FROM dropped))")
def forget_dropped(d):
    return RC.forget_dropped(d.signals, RC.dropped_providers(listed(d), targets(d))).select("signal_id", "provider_id")


@query("H15_normalize_site", f"""
    SELECT provider_id, CASE WHEN u IS NOT NULL AND contains(h, '.') AND NOT regexp_matches(h, {q(V.NOT_OWN_SITE)}) THEN
           lower(regexp_extract(u, '^([^/]*//[^/?]*)', 1)) || CASE WHEN t = '' THEN '/' ELSE t END END AS site
      FROM (SELECT *, lower(regexp_extract(u, '//([^/?]*)', 1)) AS h, regexp_extract(u, '^[^/]*//[^/?]*(.*)$', 1) AS t FROM (SELECT provider_id, {site_sql('web')} AS u FROM providers))""")
def normalize_site(d):
    return d.providers.select("provider_id", C.normalize_site(F.col("web")).alias("site"))


@query("B21_not_own_site", f"SELECT page_id, regexp_matches({HOST}, {q(V.NOT_OWN_SITE)}) AS directory FROM pages")
def not_own_site(d):
    return d.given("pages").select("page_id", C.not_own_site(C.host_of(F.col("url"))).alias("directory"))


@query("B22_freemail", f"SELECT provider_id, regexp_matches(regexp_extract(lower(email), '@([a-z0-9.-]+)', 1), {q(V.FREEMAIL)}) AS mailbox FROM providers")
def freemail(d):
    return d.providers.select("provider_id", C.freemail(F.regexp_extract(F.lower("email"), "@([a-z0-9.-]+)", 1)).alias("mailbox"))


@query("B23_public_url", f"""
    SELECT signal_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '//(10|127)\\.') AS public FROM (
        SELECT signal_id, CASE signal_id % 4 WHEN 0 THEN 'http://10.0.' || CAST(signal_id % 200 AS STRING) || '.5/' WHEN 1 THEN 'https://a' || CAST(signal_id AS STRING) || '.cz/x'
               WHEN 2 THEN 'ftp://a.cz/' ELSE 'http://127.0.0.1:80/' END AS url FROM signals)""")
def public_url(d):
    n = F.col("signal_id")
    url = (
        F.when(n % 4 == 0, F.concat(F.lit("http://10.0."), (n % 200).cast("string"), F.lit(".5/")))
        .when(n % 4 == 1, F.concat(F.lit("https://a"), n.cast("string"), F.lit(".cz/x")))
        .when(n % 4 == 2, F.lit("ftp://a.cz/")).otherwise(F.lit("http://127.0.0.1:80/"))
    )
    return d.signals.select("signal_id", C.public_url(url).alias("public"))


# ------------------------------------------------------------------------------- discovery
OWN_SQL = f"""CASE WHEN dom <> '' AND NOT regexp_matches(dom, {q(V.FREEMAIL)}) THEN dom END"""
STEPS.update({
    "own_domains": f"SELECT provider_id, {OWN_SQL} AS domain FROM (SELECT *, regexp_replace(regexp_extract(lower(coalesce(email, '')), '@([a-z0-9.-]+\\.[a-z]{{2,}})', 1), '^www\\.', '') AS dom FROM providers)",
    "eligible": f"""
        SELECT p.*, o.domain FROM providers p JOIN own_domains o ON o.provider_id = p.provider_id
         WHERE active AND coalesce(web, '') = '' AND web_found IS NULL
           AND (web_suggested IS NOT NULL OR (email LIKE '%@%' AND (web_search_us IS NULL OR web_search_us < {US} - 90 * {DAY})))""",
    "candidate_rows": """
        SELECT provider_id, name, ico, city, 'http://' || coalesce(lower(web_suggested), domain) || '/' AS url, CASE WHEN web_suggested IS NOT NULL THEN 'user' ELSE 'email' END AS source
          FROM eligible WHERE web_suggested IS NOT NULL OR domain IS NOT NULL""",
    "candidates": "SELECT * FROM candidate_rows WHERE url NOT IN (SELECT url FROM candidate_rows WHERE source = 'email' GROUP BY 1 HAVING count(*) > 3)",
})


@query("H16_own_domain", "SELECT provider_id, domain FROM own_domains")
def own_domain(d):
    return d.providers.select("provider_id", C.own_domain(F.col("email")).alias("domain"))


@query("B24_discover_eligible", "SELECT provider_id FROM eligible")
def discover_eligible(d):
    return DI.eligible(d.providers, d.as_of).select("provider_id")


@query("D20_candidate_groups", "SELECT url, source, count(*) AS practices FROM candidates GROUP BY 1, 2")
def candidate_groups(d):
    return DI.site_candidates(d.providers, d.as_of).groupBy("url", "source").agg(F.count("*").alias("practices"))


@query("H30_name_tokens", f"""
    SELECT provider_id, CASE WHEN starts_with(n, 'mudr') THEN w[len(w)] ELSE array_to_string(list_sort(list_distinct(w)), ',') END AS tokens FROM (
        SELECT provider_id, n, list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda x: length(x) >= 5 AND NOT list_contains([{", ".join(map(q, dict.fromkeys(V.GENERIC_NAME_WORDS)))}], x)) AS w
          FROM (SELECT provider_id, lower(strip_accents(name)) AS n FROM providers))""")
def name_tokens(d):
    tokens = DI.name_tokens(F.col("name"), F.col("city"))
    return d.providers.select("provider_id", F.array_join(F.array_sort(tokens), ",").alias("tokens"))


def seekers(d):
    """Practices for which a visitor suggested the host of the page of their number; all else as in the domain."""
    site = d.pages.select(F.col("page_id").alias("provider_id"), C.host_of(F.col("url")).alias("site"))
    return d.providers.join(site, "provider_id", "left").withColumn("web_suggested", F.coalesce("site", "web_suggested")).drop("site")


def sought(d):
    providers = seekers(d)
    return providers, DI.site_candidates(providers, d.as_of)


def stem_sql(t):
    return f"CASE WHEN length({t}) >= 6 THEN left({t}, length({t}) - 2) ELSE {t} END"


STEPS.update({
    "seekers": f"SELECT p.* REPLACE (coalesce(s.site, p.web_suggested) AS web_suggested) FROM providers p LEFT JOIN (SELECT page_id, {HOST} AS site FROM crawl_pages) s ON s.page_id = p.provider_id",
    "seeker_eligible": re.sub(r"\bproviders\b", "seekers", STEPS["eligible"]),
    "seeker_rows": re.sub(r"\beligible\b", "seeker_eligible", STEPS["candidate_rows"]),
    "seeker_candidates": STEPS["candidates"].replace("candidate_rows", "seeker_rows"),
    "contact_links": f"""
        SELECT site, page_id, arg_min(dest, pos) AS dest FROM home_links WHERE regexp_matches(lower(strip_accents(href)) || ' ' || label, {q(V.CONTACT_PAGE)}) GROUP BY 1, 2""",
    "site_texts": f"""
        SELECT h.site, n.norm FROM site_homes h JOIN page_norm n ON n.page_id = h.page_id
        UNION ALL SELECT c.site, n.norm FROM contact_links c JOIN fetched f ON f.address = {address_sql('c.dest')} JOIN page_norm n ON n.page_id = f.page_id
         WHERE {open_sql('c.dest', 'c.site')} AND split_part(split_part(c.dest, '/', 3), '?', 1) = c.site""",
    "name_words": f"""
        SELECT provider_id, CASE WHEN starts_with(n, 'mudr') THEN [w[len(w)]] ELSE list_distinct(w) END AS tokens, ltrim(ico, '0') AS number FROM (
            SELECT provider_id, n, ico, list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda x: length(x) >= 5 AND NOT list_contains([{", ".join(map(q, dict.fromkeys(V.GENERIC_NAME_WORDS)))}], x)) AS w
              FROM (SELECT provider_id, ico, lower(strip_accents(name)) AS n FROM providers))""",
    "matches": f"""
        SELECT c.provider_id, c.source, c.url, p.url AS home_url, bool_or(regexp_matches(t.norm, {q(V.CARE_WORDS)})) AND bool_or(named) AS matched, bool_or(named) AS named FROM (
            SELECT c.provider_id, t.site, t.norm, regexp_matches(t.norm, '\\b0*' || w.number || '\\b') OR
                   len(list_filter(w.tokens, lambda x: regexp_matches(t.norm, '\\b' || {stem_sql('x')} || '[a-z]{{0,3}}\\b'))) > 0 AS named
              FROM seeker_candidates c JOIN site_texts t ON t.site = {HOST.replace('url', 'c.url')} JOIN name_words w ON w.provider_id = c.provider_id) t
          JOIN seeker_candidates c ON c.provider_id = t.provider_id JOIN site_homes h ON h.site = t.site JOIN crawl_pages p ON p.page_id = h.page_id GROUP BY 1, 2, 3, 4""",
})
ROOT_SQL = "regexp_extract(home_url, '^([^:]+://[^/?#]*)', 1) || '/'"


@query("I13_site_match", f"SELECT provider_id, source, matched, CASE WHEN matched THEN {ROOT_SQL} END AS found_url FROM matches")
def site_match(d):
    return DI.match_sites(sought(d)[1], d.pages, d.robots).select("provider_id", "source", "matched", "found_url")


@query("C18_name_in_text", f"SELECT provider_id, {HOST} AS host FROM matches WHERE named")
def name_in_text(d):
    """Candidates whose name or number stands on the home or contact page of their host."""
    _, cands = sought(d)
    reading = DI.pages_to_read(cands, d.pages, d.robots)
    opened = d.pages.join(reading.select("page_id").distinct(), "page_id", "left_semi")
    index = DI.word_index(opened.select("page_id", E.page_text(F.col("html")).alias("text")))
    named = DI.named_on(cands, reading, index)
    return cands.join(named, ["provider_id", "source"], "left_semi").select("provider_id", C.host_of(F.col("url")).alias("host"))


@query("L7_record_found", f"""
    SELECT p.provider_id, CASE WHEN m.matched THEN {ROOT_SQL} ELSE p.web_found END AS web_found, CASE WHEN m.matched THEN c.source END AS web_found_source,
           CASE WHEN c.source = 'user' THEN NULL ELSE p.web_suggested END AS web_suggested, CASE WHEN c.provider_id IS NOT NULL THEN {US} ELSE p.web_search_us END AS web_search_us
      FROM seekers p LEFT JOIN seeker_candidates c ON c.provider_id = p.provider_id LEFT JOIN matches m ON m.provider_id = p.provider_id""")
def record_found(d):
    providers, cands = sought(d)
    out = DI.record_sites(providers, cands, DI.match_sites(cands, d.pages, d.robots), d.as_of)
    return out.select("provider_id", "web_found", "web_found_source", "web_suggested", us("web_search_at"))


@query("M11_discover", f"SELECT provider_id, source, {ROOT_SQL} AS found_url FROM matches WHERE matched")
def discover(d):
    return DI.match_sites(sought(d)[1], d.pages, d.robots).filter("matched").select("provider_id", "source", "found_url")


@query("D18_discover_summary", """
    SELECT c.source, CASE WHEN m.matched THEN 'found' WHEN m.matched IS NULL THEN 'unread' ELSE 'not theirs' END AS outcome, count(*) AS n
      FROM seeker_candidates c LEFT JOIN matches m ON m.provider_id = c.provider_id GROUP BY 1, 2""")
def discover_summary(d):
    _, cands = sought(d)
    return DI.discover_summary(cands, DI.match_sites(cands, d.pages, d.robots))
