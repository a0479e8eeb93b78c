"""E-mail, web, phone and reporter fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from .text import let, strip, tokens


def emails_of(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: t.rlike(V.EMAIL_TOKEN))


def first_email(c: Column) -> Column:
    return F.get(emails_of(c), 0)


def first_web(c: Column) -> Column:
    """First word that could be an address, with a scheme."""
    w = F.get(F.filter(tokens(c), lambda t: t.contains(".") & ~t.contains("@")), 0)
    return F.when(w.rlike("(?i)^https?://"), w).otherwise(F.concat(F.lit("https://"), w))


def _groups_of_three(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{3})$", "$1 $2 $3")


def phone_mail(c: Column) -> Column:
    """Phone in an e-mail: first of several, national number without its prefix."""
    digits = F.regexp_replace(F.split_part(c, F.lit(","), F.lit(1)), r"\D", "")
    national = F.when(digits.rlike(r"^420\d{9}$"), F.substring(digits, 4, 9)).otherwise(digits)
    return F.when(F.length(national) == 9, _groups_of_three(national)).otherwise(F.nullif(strip(c), F.lit("")))


def phone_web(c: Column) -> Column:
    """Phone on a page: +420 and 00420 are both cut; anything unusual stays as given."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[^\d+]", ""), r"^(\+|00)420", "")
    return F.when(digits.rlike(r"^\d{9}$"), _groups_of_three(digits)).otherwise(strip(c))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def not_own_site(host: Column) -> Column:
    return host.rlike(V.NOT_OWN_SITE)


def freemail(domain: Column) -> Column:
    return domain.rlike(V.FREEMAIL)


def effective_web(web: Column, web_found: Column) -> Column:
    return F.coalesce(F.nullif(web, F.lit("")), web_found)


def normalize_site(web: Column) -> Column:
    """Comparable form of the first address in a field, NULL when it is nobody's own site."""
    with_scheme = lambda w: F.when(w.rlike("(?i)^https?://"), w).otherwise(F.concat(F.lit("http://"), w))

    def compared(u: Column) -> Column:
        origin = F.lower(F.regexp_extract(u, r"^([^/?#]*://[^/?#]*)", 1))
        rest = F.regexp_replace(F.regexp_replace(u, r"^[^/?#]*://[^/?#]*", ""), r"#.*$|\?(?:#.*)?$", "")
        rest = F.regexp_replace(rest, r"^(?!/)", "/")
        ok = let(host_of(u), lambda h: h.contains(".") & ~not_own_site(h)) & ~F.split_part(u, F.lit("/"), F.lit(3)).contains("@")
        return F.when(ok, F.concat(origin, rest))

    first = F.get(F.filter(tokens(web), lambda t: t != ""), 0)
    return let(let(first, with_scheme), compared)


def own_domain(email: Column) -> Column:
    """Domain of a practice's own mailbox, NULL for mailbox providers."""
    found = F.btrim(F.regexp_extract(F.lower(F.coalesce(email, F.lit(""))), r"@([a-z0-9.-]+\.[a-z]{2,})\b", 1), F.lit("."))
    own = lambda h: F.when((h != "") & ~freemail(h) & normalize_site(h).isNotNull(), h)
    return let(F.regexp_replace(found, r"^www\.", ""), own)


def site_address(raw: Column) -> Column:
    """A typed website: scheme, host and path, NULL when empty or not an address."""
    v = strip(raw)
    full = F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("http://"), v))
    authority = F.regexp_extract(full, r"^[^/?#]*://([^/?#]*)", 1)
    path = url_path(full)
    ok = (
        (v != "")
        & (F.length(v) <= 200)
        & ~v.rlike(r"\s|@")
        & authority.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$")
    )
    scheme = F.lower(F.regexp_extract(full, r"^([^:]*):", 1))
    return F.when(
        ok, F.concat(scheme, F.lit("://"), F.lower(authority), F.when(path == "", F.lit("/")).otherwise(path))
    )


def public_url(url: Column) -> Column:
    """http(s) with a host that is not a literal local, private or reserved IP address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    quad = F.split(host, r"\.")
    n = lambda i: F.get(quad, i).try_cast("int")
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    local4 = (
        n(0).isin(0, 10, 127)
        | (n(0) >= 224)
        | ((n(0) == 100) & n(1).between(64, 127))
        | ((n(0) == 169) & (n(1) == 254))
        | ((n(0) == 172) & n(1).between(16, 31))
        | ((n(0) == 192) & (n(1) == 168))
        | ((n(0) == 192) & (n(1) == 0) & n(2).isin(0, 2))
        | ((n(0) == 198) & n(1).isin(18, 19))
        | ((n(0) == 198) & (n(1) == 51) & (n(2) == 100))
        | ((n(0) == 203) & (n(1) == 0) & (n(2) == 113))
    )
    local6 = host.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*|ff.*|2001:db8.*)\]$")
    return (
        url.rlike("(?i)^https?://")
        & (host != "")
        & (host != "localhost")
        & ~F.when(v4, local4).otherwise(local6)
    )


def pseudonym(salt: str, value: Column) -> Column:
    """Salted hash; the raw value is never kept."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), value), 256), 1, 32)


def error_kind(error: Column) -> Column:
    """Group read errors for a run summary."""
    e, head = F.lower(error), F.split_part(error, F.lit(":"), F.lit(1))
    out = F.when(e.contains("http 4"), head)
    for needle, kind in V.ERROR_KINDS:
        out = out.when(e.contains(needle), F.lit(kind))
    return out.otherwise(F.substring(head, 1, 40))
