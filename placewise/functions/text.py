"""Text as Column expressions: folding, slugs, cleaning. No Python runs per row."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """Name a value for use inside ``body``: it is written and computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


@functools.cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding of all characters, derived from the Unicode database.

    Returns the characters that fold to one ASCII character, what they fold to, and those (dots,
    fractions, ligatures, letter and unit signs) that fold to several.
    """
    src, dst, longer = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue  # halves of UTF-16 pairs are no characters
        ch = chr(code)
        ascii_form = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(ascii_form) == 1:
            src.append(ch)
            dst.append(ascii_form)
        elif ascii_form:
            longer[ch] = ascii_form
    return "".join(src), "".join(dst), longer


def _ranges(chars) -> str:
    """Characters as the inside of a regex class; consecutive ones as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


@functools.cache
def _sign_list() -> str:
    return "\n".join(f"{sign}\t{plain}" for sign, plain in _fold_table()[2].items())


def expand_signs(c: Column) -> Column:
    """Spell out signs that fold to several letters; text without any costs one regex test."""
    table = F.str_to_map(F.lit(_sign_list()), F.lit("\n"), F.lit("\t"))
    signs = "[\\x{80}-\\x{10FFFF}&&[" + _ranges(_fold_table()[2]) + "]]"  # plain letters fail at the first half
    spell = lambda t: F.array_join(
        F.transform(F.split(t, ""), lambda ch: F.when(ch.rlike(signs), F.coalesce(F.try_element_at(table, ch), ch)).otherwise(ch)), ""
    )
    return let(c, lambda t: F.when(t.rlike(signs), spell(t)).otherwise(t))


def unaccent(c: Column) -> Column:
    """Compatibility decomposition, then everything outside ASCII is dropped."""
    src, dst, _ = _fold_table()
    fold = lambda t: F.regexp_replace(F.translate(expand_signs(t), src, dst), r"[^\x00-\x7F]", "")
    return let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), fold(t)).otherwise(t))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def slugify_web(c: Column) -> Column:
    """Only accents are removed; other foreign letters become a dash instead of vanishing."""
    src, dst, _ = _fold_table()
    plain = F.regexp_replace(F.translate(expand_signs(c), src, dst), r"[\x{0300}-\x{036F}]", "")
    return F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def flat(c: Column) -> Column:
    """A slug without its dashes, for comparing what people type."""
    return F.replace(slugify_web(c), F.lit("-"))


def normalize_text(c: Column) -> Column:
    """Folded lower-case text; runs of blanks become one space, newlines stay."""
    return F.regexp_replace(F.lower(unaccent(c)), r"[ \t\r\f\x0B]+", " ")


def quotable(c: Column) -> Column:
    """Text with its diacritics whose characters line up one-to-one with ``normalize_text``.

    Signs without any ASCII form are left out, so positions found in the folded text can be used
    to quote from this one.
    """
    src, _, _ = _fold_table()
    blanks = "".join(ch for ch in src if unicodedata.normalize("NFKD", ch) == " ")
    text = F.translate(expand_signs(c), blanks, " " * len(blanks))
    safe = _ranges(ch for ch in src if ch not in blanks)
    return F.regexp_replace(F.regexp_replace(text, f"[^\\x00-\\x7F{safe}]", ""), r"[ \t\r\f\x0B]+", " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Trimmed value, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def norm_header(name: str) -> str:
    """Header names are few and live on the driver."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return "".join(ch for ch in plain if ch.isascii() and ch.isalnum())


def norm_name(c: Column) -> Column:
    """``norm_header`` for names in a column."""
    return F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]", "")


def parse_number(c: Column) -> Column:
    """Decimal comma or point; NULL for anything that is not a plain number."""
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return let(
        F.replace(strip(c), F.lit(","), F.lit(".")), lambda t: F.when(t.rlike(plain), t.try_cast("double"))
    )


def postcode(c: Column) -> Column:
    return F.nullif(F.replace(F.coalesce(c, F.lit("")), F.lit(" ")), F.lit(""))


def tokens(c: Column) -> Column:
    """Words of a field that lists several values."""
    return F.split(F.coalesce(c, F.lit("")), r"[\s,;]+")


def spans(text: Column, pattern: str) -> Column:
    """Where a pattern matches: array of (start from 1, word). Meant for text known to match."""
    words = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(words)).alias("gap"), words.alias("word"))
    empty = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<start:int,word:string>>").alias("out"))
    return F.aggregate(
        pairs,
        empty,
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["gap"]) + F.length(x["word"])).alias("pos"),
            F.concat(acc["out"], F.array(F.struct((acc["pos"] + F.length(x["gap"])).alias("start"), x["word"].alias("word")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def blank_out(text: Column, pattern: str, focus: Column | None = None) -> Column:
    """Matches become blanks of the same length, so nothing moves.

    ``focus``, when given, is the only part of the text that can match.
    """

    def masked(t: Column) -> Column:
        words = F.concat(F.regexp_extract_all(t, F.lit(pattern), 0), F.array(F.lit("")))
        kept = F.zip_with(F.split(t, pattern), words, lambda g, w: F.concat(g, F.repeat(F.lit(" "), F.length(w))))
        there = (t if focus is None else focus).rlike(pattern)
        return F.when(there, F.array_join(kept, "")).otherwise(t)

    return let(text, masked)


def around(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The match with so many characters on either side."""
    first = F.greatest(start - F.lit(before), F.lit(1))
    return F.substring(text, first, start + length + F.lit(after) - first)


def sentence_at(text: Column, start: Column, length: Column, stops: str = r"[.!?\n]") -> Column:
    """The sentence a match lies in."""
    head = F.element_at(F.split(F.substring(text, F.lit(1), start - 1), stops), -1)
    tail = F.get(F.split(F.substring(text, start + length, F.length(text)), stops, 2), 0)
    return F.concat(head, F.substring(text, start, length), tail)


def quote(folded: Column, source: Column, start: Column, length: Column, pad: int) -> Column:
    """Text around a match, whole words only, with dots where it was cut.

    Positions refer to ``folded``; the characters come from ``source``, which lines up with it.
    """
    dots = lambda cond: F.when(cond, F.lit("…")).otherwise(F.lit(""))
    alnum = lambda at: F.substring(folded, at, F.lit(1)).rlike("^[a-z0-9]$")
    edges = F.struct(
        start.alias("s"), (start + length).alias("e"), F.greatest(start - F.lit(pad), F.lit(1)).alias("a"),
        F.least(start + length + F.lit(pad), F.length(folded) + 1).alias("b"),
    )

    def trimmed(x: Column) -> Column:
        left, right = F.substring(folded, x["a"], x["s"] - x["a"]), F.substring(folded, x["e"], x["b"] - x["e"])
        head, tail = F.length(F.regexp_extract(left, "^[a-z0-9]*", 0)), F.length(F.regexp_extract(right, r"[a-z0-9]*\z", 0))
        return F.struct(
            (x["a"] + F.when((x["a"] > 1) & alnum(x["a"] - 1), head).otherwise(F.lit(0))).alias("a"),
            (x["b"] - F.when(alnum(x["b"]), tail).otherwise(F.lit(0))).alias("b"),
        )

    def shown(x: Column) -> Column:
        piece = F.trim(F.regexp_replace(F.substring(source, x["a"], x["b"] - x["a"]), r"\s+", " "))
        return F.concat(dots(x["a"] > 1), piece, dots(x["b"] <= F.length(folded)))

    return let(let(edges, trimmed), shown)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[a-z0-9]+"), 0)
