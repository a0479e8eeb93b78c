"""Sentences and pages with known answers."""

import pytest
from pyspark.sql import functions as F

from placewise.operators import evidence as E
from placewise.functions import text as T

YEAR = 2024
VERDICTS = [
    # each positive rule
    ("Paní doktorka od února bere další nové klienty.", "accepting", "all"),
    ("Naše středisko nabírá nové pacientky z celého okresu.", "accepting", "all"),
    ("V ambulanci je volná kapacita i pro klienty odjinud.", "accepting", "all"),
    ("Noví klienti vítáni", "accepting", "all"),
    ("Do péče bereme nové pacienty, jen dorost a děti.", "accepting", "children"),
    # each negative rule, also in capitals, and with a scope
    ("Od pondělí nebereme nikoho jiného ani další klienty.", "not_accepting", "all"),
    ("KAPACITA NAŠÍ AMBULANCE JE UŽ ZCELA VYČERPANÁ", "not_accepting", "all"),
    ("Pro letošek nemáme ani jednu kapacitu.", "not_accepting", "all"),
    ("Do konce roku platí stopstav.", "not_accepting", "all"),
    ("Ke konci června uzavíráme nábor nových klientů.", "not_accepting", "all"),
    ("Registrace nových klientek je do odvolání přerušena.", "not_accepting", "all"),
    ("Kapacita obvodu nestačí.", "not_accepting", "all"),
    ("Nenabíráme žádné dospělé klienty.", "not_accepting", "adults"),
    # a negative sentence is not a positive one as well; what follows about old patients does not matter
    ("Neregistrujeme nové klienty. O dosavadní klienty se postaráme.", "not_accepting", "all"),
    # waiting lists
    ("Zájemce zapíšeme na čekací listinu.", "waitlist", "all"),
    ("Nové klientky vedeme na čekacím seznamu? Ne: nové klientky patří do pořadníku.", "waitlist", "all"),
    # years: this year's and last year's news count, older positive news does not, older refusals do
    ("Od května 2023 bere lékař nové klienty.", "accepting", "all"),
    ("Zpráva z roku 2017: nabíráme nové klienty.", None, None),
    ("Od roku 2018 nebereme nové klienty.", "not_accepting", "all"),
    # nothing said: two sentences, no newcomers, paid extras, labels of a search form
    ("Bereme hotovost. Nové klienty zveme na prohlídku.", None, None),
    ("Registrujeme klienty každé pondělí.", None, None),
    ("Na kosmetické zákroky bereme nové klienty.", None, None),
    ("Nové klienty registrujeme výhradně jako samoplátkyně.", None, None),
    ("Hledat lékaře podle okresu: bere nové klienty", None, None),
    ("Otevírací doba ve čtvrtek do šesti.", None, None),
    # both at once
    ("Neregistrujeme další klienty. V březnu registrujeme nové klienty.", None, None),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, text string")


def test_verdicts(spark):
    plain = [v[0] for v in VERDICTS]
    wrapped = [f"Dobrý den na stránkách střediska.\n{t}\nTelefon jen dopoledne." for t in plain]
    for texts in (plain, wrapped):
        got = {r.page_id: r for r in E.page_verdicts(frame(spark, texts), YEAR).collect()}
        for i, (text, status, scope) in enumerate(VERDICTS):
            assert (got[i].status, got[i].scope) == (status, scope), text
            assert bool(got[i].snippet) == (status is not None or got[i].conflicting)
        assert [VERDICTS[i][0] for i in got if got[i].conflicting] == [VERDICTS[-1][0]]


def test_snippet_keeps_diacritics(spark):
    text = "Vítejte.\nOd září opět PŘIJÍMÁME   nové pacienty, prosíme volejte.\nTel. 123"
    row = E.page_verdicts(frame(spark, [text]), YEAR).first()
    assert "Od září opět PŘIJÍMÁME nové pacienty" in row.snippet
    long = "slovo " * 30 + "přijímáme nové pacienty" + " konec" * 30
    row = E.page_verdicts(frame(spark, [long]), YEAR).first()
    assert row.snippet.startswith("…slovo ") and row.snippet.endswith("konec…") and "přijímáme nové pacienty" in row.snippet


def test_quotable_lines_up(spark):
    text = "Žluťoučký „kůň“ … ½ ﬁn – ß  \t x y ÀÉ Ω№ ™ ł"
    df = frame(spark, [text]).select(
        F.length(T.normalize_text(F.col("text"))).alias("a"), F.length(T.quotable(F.col("text"))).alias("b"),
        T.normalize_text(F.col("text")).alias("n"),
    )
    row = df.first()
    assert row.a == row.b
    import unicodedata, re

    want = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    assert row.n == re.sub(r"[ \t\r\f\v]+", " ", want)


SELF_PAY = [
    ("Nemáme žádné smlouvy se zdravotními pojišťovnami, platí se na místě.", True),
    ("Pracujeme bez smlouvy se žádnou pojišťovnou, bez smluv s pojišťovnami.", True),
    ("Vedeme nesmluvní pracoviště.", True),
    ("Péče je vyhrazena, a to výhradně pro samoplátce.", True),
    ("Vítáme i samoplátkyně.", False),
    ("Nemáme zatím smlouvu s pojišťovnou 205.", False),
    ("Nemáme smlouvy s pojišťovnami mimo VZP.", False),
    ("Nemáme smlouvy se všemi, jen s některými pojišťovnami.", False),
    ("Laserové ošetření je jen pro samoplátce.", False),
    ("Nesmluvní zařízení pro ČPZP.", False),
]
ENGLISH = [
    ("Na recepci domluvíme se i anglicky.", True),
    ("Sestra i lékařka hovoří plynně anglicky.", True),
    ("Hledáte anglicky hovořící pediatričku?", True),
    ("We also speak German, French and English.", True),
    ("An English-speaking paediatrician.", True),
    ("Appointments in English on Tuesdays.", True),
    ("The doctor speaks English.", True),
    ("Bohužel nikdo nemluví anglicky.", False),
    ("Unfortunately no treatment in English.", False),
    ("Sorry, we do not speak English.", False),
    ("We speak with your insurer.", False),
    ("Anglická literatura v čekárně.", False),
]
ALL = {"111", "201", "205", "207", "209", "211", "213"}
INSURERS = [
    ("Naše smluvní partnery najdete pod čísly 205, 213 a 111.", {"205", "213", "111"}),
    ("Smlouvu máme s RBP, ČPZP i VoZP.", {"213", "205", "201"}),
    ("Ošetříme klienty se všemi zdravotními pojišťovnami.", ALL),
    ("Pojišťovny: 209 (ZPŠ) a Oborová zdravotní pojišťovna.", {"209", "207"}),
    ("Bez smlouvy jsme jen s RBP, jinak pojišťovny ano.", set()),
    ("Pojišťovna platí 205 Kč.", set()),
    ("Vstup z ulice číslo 111, dům 213.", set()),
    ("Smlouvy máme se všemi pojišťovnami. Mimo pracovní dny zavřeno.", ALL),
    ("Smlouvy máme se všemi pojišťovnami mimo OZP.", set()),
]


def flags_of(spark, texts):
    out = {i: {} for i in range(len(texts))}
    for r in E.page_flags(frame(spark, texts)).collect():
        out[r.page_id][r.flag] = r.snippet
    return out


def test_self_pay(spark):
    got = flags_of(spark, [t for t, _ in SELF_PAY])
    for i, (text, yes) in enumerate(SELF_PAY):
        assert ("self_pay" in got[i]) is yes, text


def test_english(spark):
    got = flags_of(spark, [t for t, _ in ENGLISH])
    for i, (text, yes) in enumerate(ENGLISH):
        assert ("english" in got[i]) is yes, text


def test_insurers(spark):
    got = flags_of(spark, [t for t, _ in INSURERS])
    for i, (text, codes) in enumerate(INSURERS):
        assert {f[3:] for f in got[i] if f.startswith("ins")} == codes, text


def test_self_pay_hides_insurers(spark):
    got = flags_of(spark, [
        "Jsme nesmluvní ambulance. Loni ještě smlouvy s OZP 207 a RBP 213.",
        "Jsme nesmluvní ambulance. English spoken.",
    ])
    assert set(got[0]) == {"self_pay"} and set(got[1]) == {"self_pay", "english"}


FITS = [
    ("Kardiologie bere nové klienty.", ["urolog"], False),
    ("Kožní středisko bere nové klienty.", ["urolog"], False),
    ("Kožní středisko bere nové klienty.", ["kozni"], True),
    ("Dorostové středisko bere nové klienty.", ["pediatr"], True),
    ("Kožní a kardiologické středisko bere nové klienty.", ["kozni"], True),
    ("Středisko bere nové klienty.", ["chirurg"], True),
    ("Logopedie bere nové klienty.", ["chirurg"], False),
]
PINNED = [
    ("Bereme nové klienty.", ["urolog"], True),
    ("Bereme nové klienty.", ["hygienistka", "zubar"], True),
    ("Bereme nové klienty.", ["pediatr", "praktik"], True),
    ("Bereme nové klienty.", ["kozni", "urolog"], False),
    ("Urologie bere nové klienty.", ["kozni", "urolog"], False),
    ("Kožní i urologie berou nové klienty.", ["kozni", "urolog"], True),
]


@pytest.mark.parametrize("rows,fn", [(FITS, E.fits_specialty), (PINNED, E.attributable)])
def test_whose_news(spark, rows, fn):
    df = spark.createDataFrame([(s, sp, ok) for s, sp, ok in rows], "snippet string, specs array<string>, ok boolean")
    wrong = df.filter(fn(F.col("snippet"), F.col("specs")) != F.col("ok")).collect()
    assert wrong == []


def links(spark, base, rows):
    return spark.createDataFrame([(1, base, i, h, l) for i, (h, l) in enumerate(rows)], "page_id long, url string, pos long, href string, label string")


def test_rank_links(spark):
    """Best hints first; other hosts, files, anchors and addresses of people are no pages; a doctor's folder on a portal is not left."""
    rows = [("o-nas.html", "Kdo jsme"), ("//stredisko.cz/registrace/?krok=1#form", "Přihláška"), ("https://mesto.cz/registrace", "Registrace"), ("/registrace.docx", "Registrace"),
            ("#registrace", "Registrace"), ("tel:+420123", "Objednat"), ("/fotky", "Fotky"), ("/objednavky", "Objednání"), ("/objednavky", "Termíny")]
    got = E.rank_links(links(spark, "https://stredisko.cz/", rows)).orderBy("rn").collect()
    assert [(r.to, r.score) for r in got] == [("https://stredisko.cz/registrace/?krok=1", 9), ("https://stredisko.cz/objednavky", 8)]
    rows = [("/kos/novinky", "Novinky"), ("/vrana/pacienti", "Pacienti"), ("/pacienti", "Pacienti")]
    for base in ("http://portal.cz/kos/", "http://portal.cz/kos", "http://portal.cz/kos/uvod.php"):
        assert [r.to for r in E.rank_links(links(spark, base, rows)).collect()] == ["http://portal.cz/kos/novinky"]


EN_LINKS = [
    ("https://stredisko.cz/", [("/preklad", "hreflang:en-us"), ("/english/", "English")], "https://stredisko.cz/preklad"),
    ("https://stredisko.cz/", [("/web_en.php", "Vlajka"), ("/eng-GB", "")], "https://stredisko.cz/eng-GB"),
    ("https://stredisko.cz/", [("/p2", "In English")], "https://stredisko.cz/p2"),
    ("https://stredisko.cz/", [("/?a=1&lng=en", "")], "https://stredisko.cz/?a=1&lng=en"),
    ("https://stredisko.cz/index.php", [("anglicky.html", "")], "https://stredisko.cz/anglicky.html"),
    ("https://stredisko.cz/cz/", [("/en", "hreflang:en")], "https://stredisko.cz/en"),
    ("https://stredisko.cz/", [("https://preklady.cz/en/", "EN")], None),
    ("https://stredisko.cz/", [("/enter", "Vstup"), ("/fr/", "hreflang:fr")], None),
    ("http://portal.cz/kos/", [("/en/", "hreflang:en")], None),
]


def test_english_link(spark):
    rows = [(i, base, p, h, l) for i, (base, ls, _) in enumerate(EN_LINKS) for p, (h, l) in enumerate(ls)]
    df = spark.createDataFrame(rows, "page_id long, url string, pos long, href string, label string")
    got = {r.page_id: r.to for r in E.english_link(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(EN_LINKS) if want}


def test_page_text_and_links(spark):
    html = ('<html><head><title>Zubní ordinace</title><style>.x{}</style><meta name="description" content="Popis &amp; více">'
            '<link rel="alternate" hreflang="en-GB" href="/en/"></head><body><script>var t="Přijímáme nové pacienty"</script>'
            '<!-- skryté --><h1>V&iacute;tejte</h1><p>Po&#345;adn&#xED;k</p><h3>Smluvní pojišťovny</h3><img src="a.png" alt="VZP">'
            '<img src="b.png" alt="OZP logo"><img src="c.png" alt="Fotka čekárny"><a href="/x">X <b>y</b></a></body></html>')
    df = spark.createDataFrame([(1, "http://a.cz/", html)], "page_id long, url string, html string")
    text = df.select(E.page_text(F.col("html"))).first()[0]
    assert "Přijímáme" not in text and "skryté" not in text and "čekárny" not in text and ".x{}" not in text
    for part in ("Zubní ordinace", "Popis & více", "Vítejte", "Pořadník", "VZP", "OZP logo"):
        assert part in text
    got = {(r.href, " ".join(r.label.split())) for r in E.page_links(df).collect()}
    assert got == {("/en/", "hreflang:en-gb"), ("/x", "X y")}
    flags = E.page_flags(df.withColumn("text", E.page_text(F.col("html")))).collect()
    assert {f.flag for f in flags} == {"ins111", "ins207"}


def test_looks_english(spark):
    texts = [
        "Welcome to our dental practice in the centre of the town. We are open on Monday to Friday and you can book an appointment "
        "with the dentist of your choice by phone or e-mail. Our team takes care of the whole family and we look forward to your visit at the practice.",
        "Vítejte v naší ordinaci. Jsme tu pro vás a pro vaše děti, ordinace je otevřena " * 3, "Opening hours",
    ]
    rows = frame(spark, texts).select("page_id", E.looks_english(T.normalize_text(F.col("text"))).alias("en")).orderBy("page_id").collect()
    assert [r.en for r in rows] == [True, False, False]


def test_best_page_and_flags(spark):
    pages = spark.createDataFrame(
        [("a", 0, "a/0", None, False), ("a", 1, "a/1", "accepting", False), ("a", 2, "a/2", "not_accepting", False),
         ("b", 0, "b/0", None, False), ("b", 1, "b/1", None, False), ("c", 0, "c/0", None, True), ("c", 1, "c/1", "accepting", False)],
        "site string, page_rank long, url string, status string, conflicting boolean",
    ).withColumns({"scope": F.lit("all"), "snippet": F.col("url")})
    sites = E.site_verdicts(pages)
    assert {(r.site, r.page_url, r.status) for r in sites.collect()} == {("a", "a/1", "accepting"), ("b", "b/0", None), ("c", "c/0", None)}
    flags = spark.createDataFrame(
        [("a", 2, "english", "late"), ("a", 1, "self_pay", "p1"), ("a", 0, "self_pay", "p0"), ("b", 1, "ins111", "x")],
        "site string, page_rank long, flag string, snippet string",
    )
    assert {tuple(r) for r in E.site_flags(flags, sites).collect()} == {("a", "self_pay", "p0"), ("b", "ins111", "x")}
