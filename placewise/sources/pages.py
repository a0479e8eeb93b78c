"""Tables of fetched pages: raw bodies to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import host_of, public_url
from ..functions.text import let
from ..operators.evidence import page_text

# Charset labels that pages use, by the name Java knows. UTF-8 and US-ASCII are settled by the bytes themselves.
CHARSETS = {
    "windows-1250": "windows-1250", "cp1250": "windows-1250", "windows-1251": "windows-1251", "windows-1252": "windows-1252", "cp1252": "windows-1252",
    "windows-1253": "windows-1253", "windows-1254": "windows-1254", "windows-1257": "windows-1257", "iso-8859-1": "windows-1252", "latin1": "windows-1252",
    "iso-8859-2": "ISO-8859-2", "latin2": "ISO-8859-2", "iso-8859-5": "ISO-8859-5", "iso-8859-7": "ISO-8859-7", "iso-8859-9": "ISO-8859-9",
    "iso-8859-15": "ISO-8859-15", "ibm852": "IBM852", "cp852": "IBM852", "koi8-r": "KOI8-R", "koi8-u": "KOI8-U", "utf-16": "UTF-16", "utf-16le": "UTF-16LE",
    "utf-16be": "UTF-16BE", "gb2312": "GBK", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5", "shift_jis": "Shift_JIS", "euc-jp": "EUC-JP", "euc-kr": "EUC-KR",
}


def declared_charset(body: Column, content_type: Column) -> Column:
    """The charset a page declares, in its header or anywhere in itself; NULL when it does not."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(content_type, r"""(?i)charset=["']?([\w-]+)""", 1), F.lit("")),
        F.nullif(F.regexp_extract(F.decode(body, "ISO-8859-1"), r"""(?i)<meta[^>]+charset=["']?([\w-]+)""", 1), F.lit("")),
    )
    return F.lower(found)


def decode_body(body: Column, content_type: Column) -> Column:
    """Text of a page: the declared charset if it is a known one, else UTF-8 if the bytes allow it, else windows-1250.

    Bytes without a meaning in the charset become replacement signs; no page ends the job.
    """
    readable = F.is_valid_utf8(body.cast("string"))
    guess = F.when(readable, F.decode(body, "UTF-8")).otherwise(F.decode(body, "windows-1250"))

    def by_name(name: Column) -> Column:
        out = F.when(name.isNull(), guess)
        for charset in dict.fromkeys(CHARSETS.values()):
            out = out.when(name.isin([alias for alias, c in CHARSETS.items() if c == charset]), F.decode(body, charset))
        return out.otherwise(guess)

    return let(declared_charset(body, content_type), by_name)


def readable_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, site, html, text) of pages with a public address."""
    return pages.filter(public_url(F.col("url"))).select(
        "page_id", "url", host_of(F.col("url")).alias("site"), "html", page_text(F.col("html")).alias("text")
    )
