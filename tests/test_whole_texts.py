"""Folding, references, addresses and bytes over their whole range."""

from html.entities import html5

from pyspark.sql import functions as F

from placewise.functions import text as T
from placewise.operators import evidence as E
from placewise.sources.pages import decode_body


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_signs_of_several_letters(spark):
    assert one(spark, T.unaccent, "㎡ ⑩ 𝐀 ㎏", "ﬁn ½", "Žluťoučký 😀") == ["m2 10 A kg", "fin 12", "Zlutoucky "]
    assert one(spark, T.slugify, "Dr. Ⅷ / №5 𝒳") == ["dr-viii-no5-x"]


def test_every_named_reference(spark):
    names = sorted(n for n in html5 if n.endswith(";"))
    assert one(spark, E.decode_entities, *[f"a&{n}b" for n in names]) == [f"a{html5[n]}b" for n in names]


def test_numbered_references(spark):
    got = one(spark, E.decode_entities, "&#128512;", "&#x1F600;", "&#150;", "&#0;", "&#xD800;", "&#233;", "&nothing; & &#;", "&#1114112;")
    assert got == ["😀", "😀", "–", "�", "�", "é", "&nothing; & &#;", "�"]


def test_dots_in_addresses(spark):
    base = "http://h.cz/1/2/3/4/5/6/7/8/9/10/11/p.html"
    links = ["../../../../../../p", "../" * 10 + "x", "../" * 30 + "y?a=../b", "./q", ".", "..", "a/./b/../c", "/z/../w/", "http://o.cz/a/..", "?k=/../v"]
    df = spark.createDataFrame([(base, x) for x in links], "b string, h string")
    assert [r[0] for r in df.select(E.join_url(F.col("b"), F.col("h"))).collect()] == [
        "http://h.cz/1/2/3/4/5/p", "http://h.cz/1/x", "http://h.cz/y?a=../b", "http://h.cz/1/2/3/4/5/6/7/8/9/10/11/q", "http://h.cz/1/2/3/4/5/6/7/8/9/10/11/",
        "http://h.cz/1/2/3/4/5/6/7/8/9/10/", "http://h.cz/1/2/3/4/5/6/7/8/9/10/11/a/c", "http://h.cz/w/", "http://o.cz/", "http://h.cz/1/2/3/4/5/6/7/8/9/10/11/p.html?k=/../v",
    ]


def test_bytes_without_a_meaning(spark):
    far = b"<html>" + b" " * 9000 + b'<meta charset="iso-8859-2">'
    rows = [
        (b"a\x81b", "text/html; charset=windows-1250", "a�b"), ("café".encode(), "text/html; charset=us-ascii", "café"), (b"\x8ai\xff\x81", None, "Ši˙�"),
        (far + b"\xb9", "text/html", (far + b"\xb9").decode("iso-8859-2")), ("д".encode("koi8-r"), 'text/html; charset="KOI8-R"', "д"),
        ("é".encode("windows-1250"), "text/html; charset=utf-8", "é"), ("é".encode(), "text/html; charset=never-heard-of", "é"),
    ]
    df = spark.createDataFrame([(bytearray(b), t) for b, t, _ in rows], "b binary, t string")
    assert [r[0] for r in df.select(decode_body(F.col("b"), F.col("t"))).collect()] == [want for *_, want in rows]


def test_register_folder_of_two_kinds(spark, tmp_path):
    """Each file has its own encoding, also where the first accent comes late, and its own separator and headers."""
    from placewise.sources.register import read_register

    plain = "".join(f"P{k};Ordinace {k};Plzen;zubni lekarstvi\n" for k in range(3000))
    late = "ZZ_ID;ZZ_nazev;ZZ_obec;ZZ_obor_pece\n" + plain + "P9999;Šťastná;Žďár;zubní lékařství\n"
    (tmp_path / "a.csv").write_bytes(late.encode("windows-1250"))
    (tmp_path / "b.csv").write_text("MistoPoskytovaniId,NazevCely,Obec,OborPece\n1,Čilá,Kadaň,zubní lékařství\n", encoding="utf-8")
    got = {r.name: r.city for r in read_register(spark, str(tmp_path)).collect()}
    assert got == {"Šťastná": "Žďár", "Čilá": "Kadaň"}


def test_register_files_of_other_headers(spark, tmp_path):
    """Files of one encoding and separator are bound by their own headers: swapped, old and new names, one quoted, one with a name twice."""
    from placewise.sources.register import read_register

    texts = [
        "NazevCely,Obec,OborPece\nPrvní,Kadaň,zubní lékařství\n", "OborPece,NazevCely,Obec\nneurologie,Druhá,Louny\n",
        'ZZ_nazev,"ZZ_obec",ZZ_obor_pece,X\n"Třetí, s čárkou",Most,urologie,1\n', "\ufeffObec,Obec,NazevCely,OborPece\nTábor,Písek,Čtvrtá,psychiatrie\n",
        "OborPece,NazevCely,Obec\nchirurgie,Pátá,Zlín\n",
    ]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
    got = {r.name: (r.city, r.specialties) for r in read_register(spark, str(tmp_path)).collect()}
    assert got == {
        "První": ("Kadaň", ["zubar"]), "Druhá": ("Louny", ["neurolog"]), "Třetí, s čárkou": ("Most", ["urolog"]), "Čtvrtá": ("Tábor", ["psychiatr"]),
        "Pátá": ("Zlín", ["chirurg"]),
    }


def test_quote_keeps_the_line_before_a_cut_word(spark):
    """The border cuts the word after a line feed; the line before it stays."""
    df = spark.createDataFrame([("xx yy abc\ndef ghi",)], "t string")
    got = df.select(T.quote(F.col("t"), F.col("t"), F.lit(1), F.lit(2), 8)).first()[0]
    assert got == "xx yy abc…"
