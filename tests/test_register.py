"""Register files, parsing rules, merging, snapshots."""

import pytest
from pyspark.sql import functions as F

from placewise.functions import contact as C
from placewise.functions import text as T
from placewise.functions.geo import parse_coords
from placewise.operators import register as R
from placewise.sources import sinks
from placewise.sources.register import read_register, resolve_columns

# Own rows: a place in two rows, a swapped pair of coordinates, no coordinates, an inpatient department, numbers by pattern.
OLD = """MistoPoskytovaniId,ZdravotnickeZarizeniId,NazevCely,DruhZarizeni,Obec,Psc,Ulice,CisloDomovniOrientacni,Okres,Kraj,Ico,OborPece,FormaPece,Lat,Lng
71,F1,Zuby Kadaň a.s.,Samostatná ordinace,Kadaň,432 01,Mírové náměstí,8,Chomutov,Ústecký kraj,70000001,"zubní lékařství, ortodoncie",ambulantní péče,50.376,13.2713
72,F2,Ordinace U Mostu,Samostatná ordinace,Louny,44001,Žatecká,2,Louny,Ústecký kraj,70000002,všeobecné praktické lékařství,ambulantní péče,50.357,13.7967
73,F3,Lůžkové oddělení Jih,Nemocnice,Tábor,390 03,Kpt. Jaroše,99,Tábor,Jihočeský kraj,70000003,"urologie, chirurgie",lůžková péče,49.41,14.67
74,F4,Děti Říčany,Samostatná ordinace,Říčany,251 01,Lipová,4,Praha-východ,Středočeský kraj,70000004,praktické lékařství pro děti a dorost,ambulantní péče,14.6543,49.9917
75,F5,Chrup na Letné,Samostatná ordinace,Praha 7,170 00,Letenská,6,Hlavní město Praha,Hlavní město Praha,70000005,Zubní lékařství,ambulantní péče,,
71,F1,Zuby Kadaň a.s.,Samostatná ordinace,Kadaň,432 01,Mírové náměstí,8,Chomutov,Ústecký kraj,70000001,dentální hygiena,ambulantní péče,50.376,13.2713
"""
NEW = """ZZ_ID;ZZ_nazev;ZZ_obec;ZZ_ulice;ZZ_obor_pece;ZZ_GPS
B7;Zubní péče Šíp;Žatec;Dvořákova;zubní lékařství;50.3272 13.5458
B8;Lékárna Na Rohu;Žatec;Tržní;lékárenství;50.3 13.5
B9;Ordinace Svěží;Český Krumlov;Horní;všeobecné praktické lékařství;48,81 14,31
"""


@pytest.fixture(scope="module")
def old_places(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("reg") / "old.csv"
    path.write_text(OLD, encoding="utf-8-sig")
    return read_register(spark, str(path))


def test_old_headers(old_places):
    rows = {r.place_id: r for r in old_places.collect()}
    assert set(rows) == {"71", "72", "74", "75"}
    assert rows["71"].specialties == ["hygienistka", "zubar"]
    assert rows["71"].raw_specialties == "zubní lékařství, ortodoncie, dentální hygiena"
    assert (rows["74"].lat, rows["74"].lng) == (49.9917, 14.6543)
    assert rows["74"].city_slug == "ricany" and rows["71"].postcode == "43201"
    assert rows["75"].lat is None and rows["75"].city_slug == "praha-7"


def test_new_headers_cp1250(spark, tmp_path):
    path = tmp_path / "new.csv"
    path.write_bytes(NEW.encode("cp1250"))
    rows = {r.name: r for r in read_register(spark, str(path)).collect()}
    assert set(rows) == {"Zubní péče Šíp", "Ordinace Svěží"}
    one = rows["Zubní péče Šíp"]
    assert (one.lat, one.lng, one.facility_id) == (50.3272, 13.5458, "B7") and one.place_id.startswith("B7|Žatec")


def test_resolve_columns():
    assert resolve_columns(["zz_NÁZEV", "ZZ obor péče"]) == {"name": "zz_NÁZEV", "specialties": "ZZ obor péče"}
    assert resolve_columns(["X", "OborPece"], {"name": "X"})["name"] == "X"
    for headers, over in ((["OborPece"], {}), (["Nazev", "OborPece"], {"name": "Y"}), (["Nazev", "OborPece"], {"bogus": "Nazev"})):
        with pytest.raises(ValueError):
            resolve_columns(headers, over)


def test_specialties(spark):
    cases = [
        ("Zubní lékařství, ortodoncie", None, None, ["zubar"]),
        ("neurologie", "lůžková péče", None, []),
        ("neurologie", "ambulantní péče", None, ["neurolog"]),
        ("zubní lékařství", None, "Lékárna", []),
        ("chirurgie;gynekologie a porodnictví", None, "Samost. ordinace PL - gynekologa", ["gynekolog"]),
        ("psychiatrie|dermatovenerologie", None, "Psychiatrická nemocnice", ["psychiatr"]),
        ("všeobecné praktické lékařství, praktické lékařství pro děti a dorost, chirurgie", None, "Ordinace všeob. prakt. lékaře", ["pediatr", "praktik"]),
        (None, None, None, []),
    ]
    df = spark.createDataFrame([c for c in cases], "raw string, form string, kind string, want array<string>")
    bad = df.filter(R.specialties_col(F.col("raw"), F.col("form"), F.col("kind")) != F.col("want")).collect()
    assert bad == []


def test_coords(spark):
    cases = [("50.08 14.42", 50.08, 14.42), ("50.08, 14.42", 50.08, 14.42), ("50,08 14,42", 50.08, 14.42), ("0 0", None, None), ("garbage", None, None)]
    df = spark.createDataFrame(cases, "gps string, lat double, lng double")
    none = F.lit(None).cast("string")
    got = df.select(parse_coords(none, none, F.col("gps")).alias("p"), "lat", "lng").collect()
    assert [(r.p.lat, r.p.lng) for r in got] == [(r.lat, r.lng) for r in got]
    odd = spark.createDataFrame([("50.08d",), ("1_000",), ("NaN",), (" 5,5 ",)], "s string").select(T.parse_number(F.col("s")).alias("n"))
    assert [r.n for r in odd.collect()] == [None, None, None, 5.5]


def test_slug_clash(spark):
    rows = [("1", "benesov", "Benešov"), ("2", "benesov", "Benešov"), ("3", "benesov", "Blansko"), ("4", "benesov", None), ("5", None, "Blansko")]
    df = spark.createDataFrame(rows, "place_id string, city_slug string, district string")
    got = {r.place_id: r.city_slug for r in R.disambiguate_slugs(df).collect()}
    assert got == {"1": "benesov", "2": "benesov", "3": "benesov-blansko", "4": "benesov", "5": None}


def test_closed_names(spark):
    rows = [(i, n, "zubní lékařství") for i, n in enumerate(["Domov pro seniory X", "Závodní lékař", "MUDr. Závodní", "ARMÁDA SPÁSY"])]
    parsed = R.parse_rows(spark.createDataFrame(rows, "row_no long, name string, specialties string"), F.col("row_no"))
    assert {r.name for r in parsed.filter(F.size("specialties") > 0).collect()} == {"MUDr. Závodní"}


def test_import_twice_then_truncated(spark, old_places, tmp_path):
    from placewise.model import PROVIDER_SCHEMA

    empty = spark.createDataFrame([], PROVIDER_SCHEMA)
    stats = lambda prev, new, ratio=0.8: tuple(R.import_stats(prev, new, ratio).first())
    assert stats(empty, old_places) == (4, 4, 0, False)
    sinks.write_snapshot(R.upsert(empty, old_places, "2024-01-01"), str(tmp_path / "p"), "1")
    first = sinks.read_snapshot(spark, str(tmp_path / "p"))
    assert stats(first, old_places) == (4, 0, 0, False)
    again = R.upsert(first, old_places, "2024-02-01")
    assert {(r.provider_id, r.place_id) for r in again.collect()} == {(r.provider_id, r.place_id) for r in first.collect()}
    one = old_places.filter("place_id = '71'")
    assert stats(first, one) == (1, 0, 0, True)
    assert R.upsert(first, one, "2024-03-01").filter("active").count() == 4
    three = old_places.filter("place_id <> '71'")
    assert stats(first, three, 0.5) == (3, 0, 1, False)
    kept = {r.place_id for r in R.upsert(first, three, "2024-03-01", 0.5).filter("active").collect()}
    assert kept == {"72", "74", "75"}


def test_hot_place_merges(spark):
    """One place with most of the rows: first row's values, each label once, in order."""
    df = spark.range(20_000).select(
        F.col("id").alias("row_no"), F.lit("P").alias("place_id"), F.concat(F.lit("N"), "id").alias("name"),
        F.concat(F.lit("label "), (F.col("id") % 3).cast("string"), F.lit(", psychiatrie")).alias("specialties"),
    ).orderBy(F.rand(1))
    row = R.merge_places(R.parse_rows(df, F.col("row_no"))).first()
    assert row.name == "N0" and row.specialties == ["psychiatr"]
    assert row.raw_specialties == "label 0, psychiatrie, label 1, psychiatrie, label 2, psychiatrie"


SITES = [
    ("www.zubar.cz", "http://www.zubar.cz/"), ("https://Zubar.CZ/praha", "https://zubar.cz/praha"), ("http://www.a.cz/ http://www.b.cz", "http://www.a.cz/"),
    ("", None), ("není", None), ("ondrej.vacha@seznam.cz", None), ("http://facebook.com/ordinace", None), ("https://www.firmy.cz/detail/1.html", None),
    ("www.google.com/maps/place/x", None), ("mailto:x@y.cz", None), ("https://www.zdravotniregistr.cz/lekar/123", None), ("a.cz?x=1", "http://a.cz/?x=1"),
]


def test_sites_and_domains(spark):
    got = spark.createDataFrame(SITES, "web string, want string").select("web", "want", C.normalize_site(F.col("web")).alias("got")).collect()
    assert [(r.web, r.got) for r in got] == [(w, x) for w, x in SITES]
    mails = [("ordinace@zubarnovak.cz", "zubarnovak.cz"), ("MUDr.Novak@Seznam.cz", None), ("x@gmail.com", None), ("x@o2active.cz", None), ("", None)]
    got = spark.createDataFrame(mails, "m string, want string").select(C.own_domain(F.col("m")).alias("got")).collect()
    assert [r.got for r in got] == [w for _, w in mails]
    urls = ["http://127.0.0.1/", "http://10.0.0.5/", "http://localhost:8080/", "file:///etc/passwd", "http://[::1]/", "http://169.254.169.254/latest", "https://a.cz/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(C.public_url(F.col("u")).alias("ok")).collect()
    assert [r.ok for r in got] == [False] * 6 + [True]
