"""Main text of HTML pages by equivalence-class template deduction.

*Tokens.* Every block element that a page opens is a token: the path of block elements above and with it, with their class
words, so the same tag at two places of a layout gives two tokens.

*Equivalence classes.* A token's occurrence vector holds how often it stands on each page of its host. Tokens of a host with
equal vectors form a class: they were made by the same part of the host's template. Vectors are never gathered: each is
known by a fingerprint, the exclusive-or of a hash of every (page, count) pair, which Spark adds up part by part, so a host
with a third of all pages is no heavier than others. A class is valid if it is frequent (on half of the host's pages, and five at least).
A page whose tokens of a class do not come in the order they have on the host does not fit the template and loses no slot to it.
All pages are counted; hosts of fewer than five pages borrow the classes of all hosts together.

*Slots.* Classes are nested by their paths: what a token of a valid class opens, up to the tokens of valid classes inside, is its slot.
A path that is on few pages is data of the slot it stands in. A slot is template when most of its text is link text, or when it holds the same text on all
pages though the pages differ (of borrowed classes only the latter counts). What stands inside elements that are made
for something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments: by element, class, id or role) is
no slot. A class or id counts only when all of it names such a part ('sidebar', 'cookie-notice', not 'with-sidebar'), and never on html,
body, main or article. The remaining slots are the text.

*Check.* If the page names its article, or else its main element, the slots are compared with it, and where they differ the element decides.

Each page keeps all blocks of its slots, whole, in page order. Defined cases: a null or empty html has an empty text; a null url has
the empty host; broken nesting is closed at the next matching end; a head that is not closed ends at the first block or text, a button
or other element without text of the page with its parent, a script or title with the page; repeated rows are extracted each; empty tables give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, setup, sliced

# Element names and class words of HTML pages.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template svg math object canvas textarea title head select button audio video".split())
LITERAL = {name: re.compile(f"</{name}\\b[^>]*>", re.I) for name in "script style textarea title".split()}  # hold no elements
SINGLE = frozenset("head button select noscript iframe".split())  # do not stand in their own kind
WHOLE = frozenset("html body main article".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead cookie cookies consent gdpr notice notices alert comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay widget widgets login signup search pagination pager toolbar".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
# closed by a block that begins, and by no other element between
CLOSES = {"p": frozenset("p"), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}

FREQUENT, LEAST_PAGES, LINKED = 0.5, 5, 0.5
SENT = 16 << 20  # bytes of paths


def attributes(name: str, text: str) -> tuple[list[str], bool]:
    """(class and id words, whether the element is made for something else)."""
    words, aside = [], bool(HIDDEN.search(text))
    for m in NAMED.finditer(text):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            aside |= value.strip() in ASIDE_ROLES
        else:
            for token in value.split():
                found = WORDS.findall(token)
                words += found
                aside |= bool(found) and name not in WHOLE and ASIDE_WORDS.issuperset(found)
    return words, aside


def named(m: re.Match) -> tuple[str, str, str]:
    """("/" at an end, name, attributes) of a mark; comments and the like have no name."""
    end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
    return end, (name or "").lower(), rest


def literal_end(page: str, at: int, name: str) -> int:
    """Where an element that holds no elements ends."""
    stop = LITERAL[name].search(page, at)
    return stop.end() if stop else len(page)


def raw_ends(page: str) -> dict[int, int]:
    """Where the page's text goes on after each element of ``RAW``, by its place."""
    ends: dict[int, int] = {}
    stack: list[list] = []  # name, place; in elements of RAW: where the parent ends without an end of its own, first block inside
    standing: Counter[str] = Counter()

    def drop(end: int) -> None:
        name, place, parent, _ = stack.pop()
        standing[name] -= 1
        if name in RAW:
            ends[place] = end if parent is None else parent

    at, n = 0, len(page)
    while at < n:
        m = MARK.search(page, at)
        start = m.start() if m else n
        if stack and stack[-1][0] == "head" and page[at:start].strip():
            drop(at)
        if m is None:
            break
        at = m.end()
        end, name, rest = named(m)
        if name in LITERAL:
            if not end and not rest.endswith("/"):
                at = ends[start] = literal_end(page, at, name)
        elif name not in RAW and name not in BLOCK:
            continue
        elif end:
            if standing[name]:
                while stack[-1][0] != name:
                    drop(start)
                stack[-1][2] = None
                drop(at)
        elif name in RAW:
            if not rest.endswith("/"):
                while name in SINGLE and standing[name]:
                    drop(start)
                stack.append([name, start, None, None])
                standing[name] += 1
        else:
            while standing["head"] and (name == "body" or name != "html" and stack[-1][0] == "head"):
                drop(start)
            shut = CLOSES.get(name, frozenset(["p"]))
            if stack and stack[-1][0] in RAW:
                stack[-1][3] = start if stack[-1][3] is None else stack[-1][3]
                if stack[-1][2] is None and len(stack) > 1 and stack[-2][0] in shut:
                    stack[-1][2] = start
            while stack and stack[-1][0] in shut:
                drop(start)
            if name not in VOID:
                stack.append([name, start, None, None])
                standing[name] += 1
    while stack:
        drop(n if stack[-1][3] is None else stack[-1][3])
    return ends


class Block:
    """A block of text: its path, whether it is aside, in an article, in a main element, and its link characters."""

    __slots__ = ("path", "aside", "article", "main", "text", "linked")

    def __init__(self, path, aside, article, main, text, linked):
        self.path, self.aside, self.article, self.main, self.text, self.linked = path, aside, article, main, text, linked


def blocks(page: str, opened: list[str] | None = None) -> Iterator[Block]:
    """The blocks of a page, in order; text is decoded and its white space is single spaces. Paths of elements go to ``opened``."""
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, path, aside, article, main
    runs: list[str] = []
    links = linked = 0

    def close() -> Iterator[Block]:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                _, path, aside, article, main = stack[-1] if stack else ("", "", False, False, False)
                yield Block(path, aside, article, main, text, min(linked, len(text)))
            runs.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            runs.append(text)
            if links:
                linked += len(text)

    ends = raw_ends(page)
    at, n = 0, len(page)
    while at < n:
        m = MARK.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        end, name, rest = named(m)
        if not name:
            continue
        if name == "br":
            runs.append(" ")
        elif name == "a":
            links = 0 if end else 1
        elif name in RAW:
            at = ends.get(m.start(), at)
        elif name in BLOCK:
            yield from close()
            links = 0
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID:
                shut = CLOSES.get(name, frozenset(["p"]))
                while stack and stack[-1][0] in shut:
                    stack.pop()
                words, aside = attributes(name, rest) if rest and not rest.isspace() else ([], False)
                _, path, was_aside, article, main = stack[-1] if stack else ("", "", False, False, False)
                stack.append((
                    name, f"{path}/{'.'.join([name, *words])}", was_aside or aside or name in ASIDE, article or name == "article",
                    main or name == "main" or "main" in rest and 'role' in rest.lower(),
                ))
                if opened is not None:
                    opened.append(stack[-1][1])
    yield from close()


ALL = "\0"  # stands for all hosts together


def counted(pages: DataFrame) -> DataFrame:
    """(host, path, vector, pages, first, chars, linked, low, high): what each token of each host adds up to, part by part.

    ``first`` is the sum of the places where the token comes first on its pages.
    """

    def run(batches):
        for batch in sliced(batches):
            sums: dict[tuple[str, str], list[int]] = {}
            for key, host, page in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own: dict[str, list[int]] = {"": [1, 0, 0, 0, 0]}  # times, first place, characters, link characters, checksum of the texts; of the page under ""
                opened: list[str] = []
                for b in blocks(page or "", opened):
                    if b.aside:
                        continue
                    text = b"\0" + b.text.encode("utf-8", "replace")
                    own[""][4] = crc32(text, own[""][4])
                    if b.path:
                        mine = own.setdefault(b.path, [0, 0, 0, 0, 0])
                        mine[2] += len(b.text)
                        mine[3] += b.linked
                        mine[4] = crc32(text, mine[4])
                for place, path in enumerate(opened):
                    mine = own.setdefault(path, [0, 0, 0, 0, 0])
                    mine[0] += 1
                    mine[1] = mine[1] if mine[0] > 1 else place
                vectors = mix64(np.array([(key ^ (v[0] * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF for v in own.values()], np.uint64)).view(np.int64).tolist()
                for of in (host, ALL):
                    for vector, (path, (_, first, chars, linked, text)) in zip(vectors, own.items(), strict=True):
                        s = sums.setdefault((of, path), [0, 0, 0, 0, 0, text, text])
                        s[0] ^= vector
                        s[1] += 1
                        s[2] += first
                        s[3] += chars
                        s[4] += linked
                        s[5], s[6] = min(s[5], text), max(s[6], text)
            columns = list(zip(*[(*k, *v) for k, v in sums.items()], strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                ["host", "path", "vector", "pages", "first", "chars", "linked", "low", "high"],
            )

    schema = "host string, path string, vector long, pages long, first long, chars long, linked long, low long, high long"
    return pages.mapInArrow(run, schema).groupBy("host", "path").agg(
        F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "first", "chars", "linked")], F.min("low").alias("low"), F.max("high").alias("high")
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, few, slots): each host's tokens of valid classes with class, place and whether their slot is template; ``few``: too few pages for any."""
    tokens = cut_lineage(counted(pages))
    hosts = tokens.filter("path = ''").select("host", F.col("pages").alias("of"), (F.col("low") != F.col("high")).alias("differ"))
    judged = tokens.filter("path <> ''").join(hosts, "host")
    # paths of a class are on equally many pages, so a class is valid when any of its paths is frequent
    frequent = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= FREQUENT * F.col("of"))
    valid = judged.filter(frequent)
    # the text of paths on few pages is data of the slot they stand in: the longest valid path above
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rare = judged.filter(~frequent & (F.col("chars") > 0) & (F.size(parts) > 2)).select("host", "path", "chars", "linked", F.explode(above).alias("slot"))
    inside = rare.join(valid.select("host", F.col("path").alias("slot")), ["host", "slot"]).groupBy("host", "path").agg(
        F.max_by("slot", F.length("slot")).alias("slot"), F.first("chars").alias("chars"), F.first("linked").alias("linked"))
    inside = inside.groupBy("host", F.col("slot").alias("path")).agg(F.sum("chars").alias("more"), F.sum("linked").alias("more_linked"))
    slots = valid.join(inside, ["host", "path"], "left").fillna(0, ["more", "more_linked"])
    links = (F.col("linked") + F.col("more_linked") > LINKED * (F.col("chars") + F.col("more"))) & (F.col("host") != ALL)
    same = F.col("differ") & (F.col("low") == F.col("high")) & (F.col("chars") > 0) & (F.col("more") == 0)
    slot = F.struct("path", F.col("vector").alias("class"), (F.col("first") / F.col("pages")).alias("place"), (links | same).alias("template"))
    found = slots.groupBy("host").agg(F.collect_list(slot).alias("slots"))
    return hosts.select("host", (F.col("of") < LEAST_PAGES).alias("few")).join(found, "host", "left")


class Template:
    """A host's slots by path, and the order of the tokens of its classes."""

    def __init__(self, slots: list[dict] = ()):
        self.slots = {s["path"]: s["template"] for s in slots}
        self.order: dict[str, tuple[int, float]] = {s["path"]: (s["class"], s["place"]) for s in slots}
        self.any = any(self.slots.values())

    def fits(self, opened: list[str]) -> bool:
        """Whether the tokens of each class first come in the host's order."""
        last: dict[int, float] = {}
        for path in dict.fromkeys(opened):
            if path in self.order:
                of, place = self.order[path]
                if place < last.get(of, place):
                    return False
                last[of] = place
        return True

    def is_template(self, path: str) -> bool:
        """The verdict on the slot that a path stands in."""
        while path and path not in self.slots:
            path = path[: path.rfind("/")]
        return self.slots.get(path, False)


def deduced(page: str, template: Template) -> tuple[list[Block], list[Block]]:
    """(blocks of the page's data slots, all blocks that are not aside)."""
    opened: list[str] = []
    own = [b for b in blocks(page, opened) if not b.aside]
    if not template.any or not template.fits(opened):
        return own, own
    return [b for b in own if not template.is_template(b.path)], own


def main_text(page: str, template: Template = Template()) -> str:  # noqa: B008
    """The blocks of the page's data slots, checked against its article or main element, joined by empty lines."""
    slots, own = deduced(page, template)
    for inside in ("article", "main"):
        if named := [b for b in own if getattr(b, inside)]:
            slots = named
            break
    return "\n\n".join(b.text for b in slots)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    setup(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    found = cut_lineage(templates(rows.select(F.xxhash64("page_id", "url").alias("key"), "host", "html")))
    pool = found.filter(F.col("host") == ALL).select("slots").first()  # as long as a page or two: of paths on half of all pages
    borrowed = Template(pool["slots"] or () if pool else ())
    found = found.filter(F.col("host") != ALL)
    # what hosts have is short: it is sent to all tasks if its measured size allows, so no page is shuffled; else joined by host
    size = found.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length(F.to_json("slots")), F.lit(0)))).first()[0] or 0
    if size <= SENT:
        found = F.broadcast(found)

    def run(batches):
        for batch in sliced(batches):
            hosts = batch.column("host").to_pylist()
            of: dict[str, Template] = {}
            for k, host in enumerate(hosts):
                if host not in of:
                    of[host] = borrowed if batch.column("few")[k].as_py() else Template(batch.column("slots")[k].as_py() or ())
            texts = [main_text(h or "", of[host]) for h, host in zip(batch.column("html").to_pylist(), hosts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "few", "slots")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
