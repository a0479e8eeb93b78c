"""What practices' web pages say: pages -> text and links -> verdict and facts per page and site.

Everything up to the per-page result is a narrow computation on each page: no page is shuffled and
no Python runs. Costly steps hide behind one cheap test per rule family, so a page without any of
the words a family needs costs a single scan.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.contact import host_of, url_path, url_query
from ..session import cut_lineage

STOPS = r"[.!?\n]"
SPAN = "array<struct<start:int,word:string>>"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "bdquo": "„", "ldquo": "“", "rdquo": "”", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó",
    "uacute": "ú", "yacute": "ý", "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Uacute": "Ú", "scaron": "š", "Scaron": "Š",
    "zcaron": "ž", "Zcaron": "Ž", "ccaron": "č", "Ccaron": "Č", "rcaron": "ř", "Rcaron": "Ř", "ecaron": "ě", "uring": "ů",
}


@dataclass(frozen=True)
class Rules:
    """Phrase rules as data, tried in order. ``hint`` holds a stem every rule needs one of."""

    negative: list[str] = field(default_factory=lambda: V.NEGATIVE)
    waitlist: list[str] = field(default_factory=lambda: V.WAITLIST)
    positive: list[str] = field(default_factory=lambda: V.POSITIVE)
    extra: str = V.PAID_EXTRA
    ui_words: list[str] = field(default_factory=lambda: V.UI_WORDS)
    ui_reach: int = V.UI_REACH
    kids: str = V.KIDS
    adults: str = V.ADULTS
    hint: str = "nov|dalsi|zadn|kapacit|stop|poradnik|cekaci"


# ------------------------------------------------------------------------------- html
@functools.cache
def _all_entities() -> str:
    """Every named character reference of HTML."""
    return "\x01".join(f"{name[:-1]}\x02{value}" for name, value in sorted(html5.items()) if name.endswith(";"))


def decode_entities(text: Column) -> Column:
    """Named and numbered character references; anything unknown stays as written."""
    usual = F.str_to_map(F.lit("|".join(f"{k}~{v}" for k, v in ENTITIES.items())), F.lit("\\|"), F.lit("~"))
    table = F.str_to_map(F.lit(_all_entities()), F.lit("\x01"), F.lit("\x02"))
    western = F.array(*[F.lit(bytes([b]).decode("windows-1252", "ignore") or chr(b)) for b in range(128, 160)])

    def letter(n: Column) -> Column:
        """A numbered character; numbers from 128 to 159 mean windows-1252, numbers of no character a replacement sign."""
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        odd = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(odd, "\ufffd").when(n.between(128, 159), F.element_at(western, n - 127)).otherwise(plain)

    def sign(name: Column) -> Column:
        decimal = F.regexp_extract(name, r"^#(\d{1,9})$", 1).try_cast("int")
        hexadecimal = F.conv(F.nullif(F.regexp_extract(name, "^#[xX]([0-9A-Fa-f]{1,7})$", 1), F.lit("")), 16, 10).try_cast("int")
        named = F.coalesce(F.try_element_at(usual, name), F.try_element_at(table, name))
        return F.when(name.startswith("#"), T.let(F.coalesce(decimal, hexadecimal), letter)).otherwise(named)

    def one(piece: Column, i: Column) -> Column:
        named = lambda n: F.coalesce(
            F.concat(sign(n), F.substring(piece, F.length(n) + 2, F.length(piece))), F.concat(F.lit("&"), piece)
        )
        return F.when(i == 0, piece).otherwise(T.let(F.regexp_extract(piece, "^(#?[A-Za-z0-9]+);", 1), named))

    decoded = lambda t: F.array_join(F.transform(F.split(t, "&"), one), "")
    return T.let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, NULL when it is not there."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return T.let(tag, lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, g), F.lit("")) for g in (1, 2, 3)]))


def _logo_labels(html: Column) -> Column:
    """Pictures vanish, but one whose label names an insurer leaves the label."""
    keep = lambda label: F.when(
        T.normalize_text(label).rlike(V.LOGO_WORDS), F.concat(F.lit(" "), label, F.lit(" "))
    ).otherwise(F.lit(""))

    def one(piece: Column, i: Column) -> Column:
        tag = F.regexp_extract(piece, "(?s)^([^>]*)", 1)
        label = decode_entities(F.concat_ws(" ", attribute(tag, "alt"), attribute(tag, "title")))
        rest = F.regexp_replace(piece, "(?s)^[^>]*>?", "")
        return F.when(i == 0, piece).otherwise(F.concat(T.let(label, keep), rest))

    pattern = r"(?i)<img\b"
    labelled = lambda h: F.array_join(F.transform(F.split(h, pattern), one), "")
    return T.let(html, lambda h: F.when(h.rlike(pattern), labelled(h)).otherwise(h))


def page_text(html: Column) -> Column:
    """Readable text: no scripts or styles, blocks on their own lines, the page description kept."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>", "")
    out = _logo_labels(out)
    described = r"""(?is)<meta\b(?=[^>]*\sname\s*=\s*["']?description["'\s>])[^>]*\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>"""
    out = F.regexp_replace(out, described, "\n$1$2\n")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|li|br|h[1-6]|tr|section|article|header|footer)\b[^>]*>", "\n")
    return decode_entities(F.regexp_replace(out, r"<[A-Za-z/!?][^>]*>", ""))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label) in document order; language links as ``hreflang:xx``."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>|<link\b[^>]*>"), 0)
    rows = pages.select("page_id", "url", F.posexplode(parts).alias("pos", "part"))
    tag = F.regexp_extract("part", "(?s)^(<[^>]*>)", 1)
    is_anchor = F.col("part").rlike("(?i)^<a")
    rows = rows.select(
        "page_id", "url", "pos", is_anchor.alias("anchor"), decode_entities(attribute(tag, "href")).alias("href"),
        F.lower(attribute(tag, "hreflang")).alias("lang"), F.lower(attribute(tag, "rel")).alias("rel"),
        T.strip(decode_entities(F.regexp_replace("part", "(?s)<[^>]*>", " "))).alias("text"),
    ).filter(F.col("href").isNotNull())
    lang = F.when(
        F.col("lang").isNotNull() & (F.col("anchor") | F.col("rel").contains("alternate")), F.concat(F.lit("hreflang:"), "lang")
    )
    labels = F.array_compact(F.array(lang, F.when(F.col("anchor"), F.col("text"))))
    return rows.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "href", F.explode(labels).alias("label"))


def join_url(base: Column, href: Column) -> Column:
    """Absolute address of a link without its fragment."""
    scheme, origin = F.regexp_extract(base, "^([^:]+):", 1), F.regexp_extract(base, "^([^:]+://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = T.let(folder, lambda f: F.when(f == "", F.lit("/")).otherwise(f))
    full = lambda h: (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("?"), F.concat(origin, url_path(base), h))
        .otherwise(F.concat(origin, folder, h))
    )
    return T.let(T.let(F.regexp_replace(T.strip(href), "#.*$", ""), full), without_dots)


def without_dots(url: Column) -> Column:
    """An address whose path has no ``.`` and ``..`` steps, however many there were."""
    pattern = r"^([^:/?]+://[^/?]*)(/[^?]*)(.*)$"
    steps = F.slice(F.split(F.regexp_extract(url, pattern, 2), "/"), F.lit(2), F.lit(1 << 20))
    none = F.array().cast("array<string>")

    def walk(done: Column, step: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    folder = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)  # a last step of dots is a folder
    path = F.array_join(F.concat(F.aggregate(steps, none, walk), folder), "/")
    joined = F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), path, F.regexp_extract(url, pattern, 3))
    return F.when(url.rlike(r"^[^:/?]+://[^/?]*/(?:[^?]*/)?\.\.?(?:[/?]|$)"), joined).otherwise(url)


def same_site(links: DataFrame) -> DataFrame:
    """Links that lead to another page of the same host, with that page's address ``to``; done once where it is there already."""
    if "to" in links.columns:
        return links
    skip = F.col("href").rlike("^(?:#|mailto:|tel:|javascript:)")
    bare = lambda c: F.rtrim(c, F.lit("/"))
    return (
        links.filter(~skip)
        .withColumn("to", join_url(F.col("url"), F.col("href")))
        .filter(F.col("to").rlike("^https?://") & (host_of(F.col("to")) == host_of(F.col("url"))))
        .filter(bare(F.col("to")) != bare(F.col("url")))
    )


def rank_links(links: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` links of a page most likely to speak about new patients."""
    path = url_path(F.col("url"))
    last = F.regexp_extract(path, "([^/]*)$", 1)
    scope = F.when(path.endswith("/"), path).when(last.contains("."), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))
    to_path = url_path(F.col("to"))
    inside = same_site(links).filter(((scope == "/") | to_path.startswith(scope)) & ~to_path.rlike(V.FILE_LINK))
    hay = T.normalize_text(F.concat_ws(" ", to_path, "label"))
    score = F.lit(0)
    for i, hint in reversed(list(enumerate(V.LINK_HINTS))):
        score = F.when(hay.contains(hint), F.lit(len(V.LINK_HINTS) - i)).otherwise(score)
    best = inside.withColumn("score", score).filter(F.col("score") > 0).groupBy("page_id", "to").agg(
        F.max("score").alias("score"), F.min("pos").alias("pos")
    )
    order = W.partitionBy("page_id").orderBy(F.col("score").desc(), "pos", "to")
    return best.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select("page_id", "to", "score", "rn")


def english_link(links: DataFrame) -> DataFrame:
    """Where a page's English version seems to be, one row per page that has one."""
    path = url_path(F.col("url"))
    rooted = (F.regexp_replace(path, "^/+|/+$", "") == "") | path.rlike(V.ROOT_PATH)
    label = F.trim(T.normalize_text(F.col("label")))
    declared = label.startswith("hreflang:")
    guess = label.rlike(V.EN_LABEL) | url_path(F.col("to")).rlike(V.EN_PATH) | url_query(F.col("to")).rlike(V.EN_QUERY)
    rank = F.when(declared, F.when(label.startswith("hreflang:en"), 0)).when(guess, 1)
    rows = same_site(links.filter(rooted)).withColumn("rank", rank).filter(F.col("rank").isNotNull())
    return rows.groupBy("page_id").agg(F.min(F.struct("rank", "to")).alias("best")).select("page_id", "best.to", "best.rank")


# ------------------------------------------------------------------------------- verdict
def sentences(norm: Column) -> Column:
    return F.split(norm, STOPS)


def stale(sentence: Column, as_of_year: int) -> Column:
    """Dated, and only with years before last year."""
    recent = "|".join(str(y) for y in range(max(as_of_year - 1, 2000), 2050))
    return T.let(sentence, lambda s: s.rlike(r"\b20[0-4]\d\b") & ~s.rlike(rf"\b(?:{recent})\b"))


def _ui(text: Column, hit: Column, rules: Rules) -> Column:
    """A search filter's label rather than a statement."""
    near = T.around(text, hit["start"], F.length(hit["word"]), rules.ui_reach, rules.ui_reach)
    return near.rlike("|".join(rules.ui_words))


def _first_hit(text: Column, focus: Column, patterns: list[str], bad) -> Column:
    """First match of the first pattern that has one which is not ``bad``.

    ``focus`` is the part of the text worth trying; the whole text is searched only for patterns
    that match there.
    """
    out = []
    for p in patterns:
        hits = F.filter(T.spans(text, p), lambda h: ~bad(h))
        out.append(F.when(focus.rlike(p), F.get(hits, 0)))
    return F.coalesce(*out)


def _focus(norm: Column, stems: str) -> Column:
    """The sentences that hold one of the stems, NULL when there are none."""
    kept = F.filter(F.split(norm, "[.!?]"), lambda s: s.rlike(stems))
    return F.when(norm.rlike(stems), F.array_join(kept, "."))


def _scope(window: Column, rules: Rules) -> Column:
    only = lambda x: F.when(x["kids"] & ~x["adults"], "children").when(x["adults"] & ~x["kids"], "adults").otherwise("all")
    return T.let(window, lambda w: T.let(F.struct(w.rlike(rules.kids).alias("kids"), w.rlike(rules.adults).alias("adults")), only))


def _judged(pages: DataFrame, as_of_year: int, rules: Rules) -> DataFrame:
    """Adds ``status``, ``scope``, ``snippet`` and ``conflicting`` to pages with ``text`` and ``norm``."""
    norm = F.col("norm")
    sentence = lambda t, h: T.sentence_at(t, h["start"], F.length(h["word"]))
    focus = F.col("focus")
    neg = _first_hit(norm, focus, rules.negative, lambda h: _ui(norm, h, rules))
    wait = _first_hit(norm, focus, rules.waitlist, lambda h: stale(sentence(norm, h), as_of_year) | _ui(norm, h, rules))
    masked = norm
    for p in rules.negative:
        masked = T.blank_out(masked, p, focus)
    m = F.col("masked")
    pos = _first_hit(
        m, focus, rules.positive,
        lambda h: T.let(sentence(m, h), lambda s: s.rlike(rules.extra) | stale(s, as_of_year)) | _ui(m, h, rules),
    )
    hinted = focus.isNotNull()
    df = (
        pages.withColumn("focus", _focus(norm, rules.hint))
        .withColumns({"neg": F.when(hinted, neg), "wait": F.when(hinted, wait), "masked": F.when(hinted, masked)})
        .withColumn("pos", F.when(hinted, pos))
    )
    has = lambda c: F.col(c).isNotNull()
    conflict = has("neg") & has("pos")
    status = F.when(conflict, F.lit(None)).when(has("neg"), "not_accepting").when(has("wait"), "waitlist").when(has("pos"), "accepting")
    df = df.withColumns({"conflicting": conflict, "status": status, "hit": F.coalesce("neg", "wait", "pos")})
    at_, length = F.col("hit.start"), F.length("hit.word")
    said = has("hit")
    return df.withColumns(
        {
            "scope": F.when(F.col("status").isNotNull(), _scope(T.quote(norm, norm, at_, length, 80), rules)),
            "snippet": F.when(said, T.quote(norm, T.quotable(F.col("text")), at_, length, 50)),
        }
    ).drop("focus", "neg", "wait", "pos", "masked", "hit")


def page_verdicts(pages: DataFrame, as_of_year: int, rules: Rules = Rules()) -> DataFrame:
    """Adds ``status``, ``scope``, ``snippet`` and ``conflicting`` to pages with a ``text``.

    ``status`` is NULL when the page says nothing, or both things at once. The short results are
    kept in the shared folder: sites, facts and signals all build on them, and whatever they
    filter by must not make Spark scan the page texts again.
    """
    norm = pages.withColumn("norm", T.normalize_text(F.col("text")))
    return cut_lineage(_judged(norm, as_of_year, rules).drop("norm", "text", "html"))


# ------------------------------------------------------------------------------- facts
def self_pay_hit(norm: Column) -> Column:
    """Care not covered by any insurer, unless the sentence is about one paid extra."""
    about_extra = lambda h: T.sentence_at(norm, h["start"], F.length(h["word"])).rlike(V.SELF_PAY_EXTRA)
    focus = _focus(norm, "nemame|bez smlouv|nesmluvn|samoplatc")
    return T.let(focus, lambda f: F.when(f.isNotNull(), _first_hit(norm, f, V.SELF_PAY, about_extra)))


def english_hit(norm: Column) -> Column:
    """Someone speaks English, unless the words just before deny it."""
    denied = lambda h: F.substring(
        norm, F.greatest(h["start"] - 25, F.lit(1)), h["start"] - F.greatest(h["start"] - 25, F.lit(1))
    ).rlike(V.ENGLISH_NEGATION)
    return F.when(norm.rlike("anglick|english"), _first_hit(norm, norm, V.ENGLISH, denied))


def _window_codes(window: Column) -> Column:
    """Insurers one window names. A lone number is more likely a price or a house number."""
    none, every = F.array().cast("array<string>"), F.array(*[F.lit(c) for c in V.INSURER_WORDS])

    def read(w: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(w.rlike(p), F.lit(c)) for c, p in V.INSURER_WORDS.items()]))
        numbers = F.array_distinct(F.regexp_extract_all(w, F.lit(V.INSURER_CODES), 1))
        both = F.struct(named.alias("named"), numbers.alias("numbers"))
        counts = lambda x: (F.size(x["numbers"]) >= 2) | ((F.size(x["numbers"]) > 0) & (F.size(x["named"]) > 0))
        found = T.let(both, lambda x: F.when(counts(x), F.array_union(x["named"], x["numbers"])).otherwise(x["named"]))
        return F.when(w.rlike(V.NO_CONTRACT), none).when(w.rlike(V.ALL_INSURERS), every).otherwise(found)

    return T.let(window, read)


def insurer_windows(norm: Column) -> Column:
    """array<struct<start, word, codes>>: every mention of contracts with the insurers around it."""
    hits = T.spans(norm, V.CONTRACT_WORDS)
    near = lambda h: T.around(norm, h["start"], F.length(h["word"]), V.CONTRACT_BEFORE, V.CONTRACT_AFTER)
    read = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["word"].alias("word"), _window_codes(near(h)).alias("codes")))
    return F.when(norm.rlike(V.CONTRACT_WORDS), F.filter(read, lambda w: F.size(w["codes"]) > 0))


def looks_english(norm: Column) -> Column:
    """Written in English: many English stop words, more than twice the Czech ones."""
    among = lambda words, known: F.size(F.filter(words, lambda w: w.isin(known)))
    clear = lambda n: (n["en"] >= V.EN_MIN_WORDS) & (n["en"] > 2 * n["cs"])
    count = lambda w: F.struct(among(w, V.EN_WORDS).alias("en"), among(w, V.CS_WORDS).alias("cs"))
    return T.let(T.let(F.regexp_extract_all(norm, F.lit("[a-z]+"), 0), count), clear)


def _stated(pages: DataFrame) -> DataFrame:
    """Adds the quotes ``pay``, ``eng`` and ``ins`` and the insurers' ``codes`` to pages with ``text`` and ``norm``."""
    norm = F.col("norm")
    df = pages.withColumns({"pay_hit": self_pay_hit(norm), "eng_hit": english_hit(norm)})
    df = df.withColumn("ins_hits", F.when(F.col("pay_hit").isNull(), insurer_windows(norm)))
    source = T.quotable(F.col("text"))
    said = lambda h, pad: F.when(h.isNotNull(), T.quote(norm, source, h["start"], F.length(h["word"]), pad))
    return df.withColumns(
        {
            "pay": said(F.col("pay_hit"), 50), "eng": said(F.col("eng_hit"), 50), "ins": said(F.get("ins_hits", F.lit(0)), 90),
            "codes": F.array_distinct(F.flatten(F.transform("ins_hits", lambda w: w["codes"]))),
        }
    ).drop("pay_hit", "eng_hit", "ins_hits")


def facts_of(stated: DataFrame, *keys: str) -> DataFrame:
    """(keys, flag, snippet): one row per fact of pages read by ``page_flags`` or ``page_evidence``."""
    fact = lambda flag, snippet: F.struct(flag.alias("flag"), snippet.alias("snippet"))
    facts = F.concat(
        F.array_compact(F.array(
            F.when(F.col("pay").isNotNull(), fact(F.lit("self_pay"), F.col("pay"))),
            F.when(F.col("eng").isNotNull(), fact(F.lit("english"), F.col("eng"))),
        )),
        F.coalesce(F.transform("codes", lambda c: fact(F.concat(F.lit("ins"), c), F.col("ins"))), F.array().cast("array<struct<flag:string,snippet:string>>")),
    )
    return stated.select(*keys, F.explode(facts).alias("f")).select(*keys, "f.flag", "f.snippet")


def page_flags(pages: DataFrame) -> DataFrame:
    """(page_id, flag, snippet): the facts a page states beyond "accepting?"."""
    keys = [c for c in pages.columns if c not in ("text", "html")]
    # Short results first, kept; only then rows without any fact are dropped.
    short = cut_lineage(_stated(pages.withColumn("norm", T.normalize_text(F.col("text")))).select(*keys, "pay", "eng", "ins", "codes"))
    return facts_of(short, *keys)


def page_evidence(pages: DataFrame, as_of_year: int, rules: Rules = Rules()) -> DataFrame:
    """Verdict, facts and language of pages with a ``text``, in one pass: each text is folded once and only short results are kept."""
    norm = pages.withColumn("norm", T.normalize_text(F.col("text")))
    read = _stated(_judged(norm, as_of_year, rules)).withColumn("english_text", looks_english(F.col("norm")))
    return cut_lineage(read.drop("norm", "text", "html"))


# ------------------------------------------------------------------------------- per site
def site_verdicts(page_results: DataFrame) -> DataFrame:
    """One row per site: the first page in reading order that says something, else the first page.

    ``page_results``: (site, page_rank, url, status, scope, snippet, conflicting).
    """
    cols = F.struct("url", "status", "scope", "snippet", "conflicting")
    decisive = F.col("status").isNotNull() | F.col("conflicting")
    best = page_results.groupBy("site").agg(
        F.min(F.when(decisive, F.col("page_rank"))).alias("decisive_rank"),
        F.coalesce(F.min_by(cols, F.when(decisive, F.col("page_rank"))), F.min_by(cols, "page_rank")).alias("b"),
    )
    return best.select("site", "decisive_rank", F.col("b.url").alias("page_url"), "b.status", "b.scope", "b.snippet", "b.conflicting")


def site_flags(flag_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Facts of a site: the earliest page wins; pages after the decisive one were never read."""
    read = flag_rows.join(sites.select("site", "decisive_rank"), "site").filter(
        F.col("decisive_rank").isNull() | (F.col("page_rank") <= F.col("decisive_rank"))
    )
    return read.groupBy("site", "flag").agg(F.min_by("snippet", "page_rank").alias("snippet"))


# ------------------------------------------------------------------------------- whose news is it
def named_fields(snippet_norm: Column) -> Column:
    return F.array_compact(F.array(*[F.when(snippet_norm.rlike(p), F.lit(s)) for s, p in V.FIELD_WORDS.items()]))


def fits_specialty(snippet: Column, specialties: Column) -> Column:
    """False when a sentence names fields of care, none of them this practice's."""
    def judge(s: Column) -> Column:
        return T.let(
            named_fields(s),
            lambda n: F.arrays_overlap(n, specialties) | ~((F.size(n) > 0) | s.rlike(V.OTHER_FIELDS)),
        )

    return T.let(T.normalize_text(snippet), judge)


def attributable(snippet: Column, specialties: Column) -> Column:
    """Can a sentence be pinned on a practice? With several fields it must name them all."""
    one = F.size(specialties) <= 1
    for group in V.ONE_PRACTICE:
        one = one | (F.size(F.array_except(specialties, F.array(*[F.lit(x) for x in group]))) == 0)
    every = T.let(T.normalize_text(snippet), lambda s: F.size(F.array_except(specialties, named_fields(s))) == 0)
    return F.when(one, fits_specialty(snippet, specialties)).otherwise(every)


def crawl_summary(results: DataFrame) -> DataFrame:
    """Counts by outcome of a run."""
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("conflicting"), "conflicting")
        .otherwise(F.coalesce("status", F.lit("nothing")))
    )
    return results.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def as_of_year(as_of: str) -> int:
    return int(str(as_of)[:4])

