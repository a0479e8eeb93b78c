"""The given tables read as domain tables.

Every column is a plain SQL expression over the given tables, kept here as text. The Spark side
uses it through ``selectExpr``; the SQL twins of the registered queries use the same text, so both
sides start from the same rows and what is compared is the work done on them.
Times are whole microseconds (``*_us``) in the text and timestamps in the DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contact import host_of
from ..operators.cards import by_specialty, listing, newest_flags, provider_cards
from ..operators.status import at, provider_status
from ..session import spread

AS_OF = "2024-01-31 00:00:00"
AS_OF_US = 1_706_659_200_000_000
AS_OF_DATE = "2024-01-31"
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# A third of all practices crowd into one city, the others spread over the country.
LAT = "CASE WHEN {k} % 3 = 0 THEN 50.0e0 + (({k} * 7919) % 1501) / 10000.0e0 ELSE 48.6e0 + (({k} * 7919) % 2400) / 1000.0e0 END"
LNG = "CASE WHEN {k} % 3 = 0 THEN 14.3e0 + (({k} * 104729) % 2503) / 10000.0e0 ELSE 12.2e0 + (({k} * 104729) % 6500) / 1000.0e0 END"
SLUG_OF = {
    "AUTOMOBILE": "zubar", "BUILDING": "praktik", "FURNITURE": "pediatr", "HOUSEHOLD": "gynekolog", "MACHINERY": "ocni",
}
SEGMENT_SLUG = "CASE c_mktsegment " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SLUG_OF.items()) + " END"

# from customer x nation x region
PROVIDERS = {
    "provider_id": "c_custkey",
    "place_id": "'P' || CAST(c_custkey AS STRING)",
    "facility_id": "'ZZ' || CAST(c_custkey % 900 AS STRING)",
    "ico": "CAST(10000000 + c_custkey * 37 AS STRING)",
    "name": "CASE c_custkey % 5 WHEN 0 THEN 'MUDr. Jana ' WHEN 1 THEN 'Zubní ordinace ' WHEN 2 THEN 'Poliklinika ' ELSE 'Ordinace ' END || c_name",
    "facility_type": "CASE c_custkey % 7 WHEN 0 THEN 'Nemocnice' WHEN 1 THEN 'Ordinace všeob. prakt. lékaře' ELSE 'Samostatná ordinace' END",
    "street": "CASE WHEN c_custkey % 9 <> 4 THEN 'Ulice ' || CAST(c_nationkey AS STRING) END",
    "house_no": "CAST(c_custkey % 100 AS STRING)",
    "city": "CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Praha ' || CAST(CAST((c_custkey % 66) / 3 + 1 AS INT) AS STRING) WHEN c_custkey % 60 = 59 THEN 'Praha' ELSE 'Město ' || CAST(c_custkey % 60 AS STRING) END",
    "city_slug": "CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN 'praha-' || CAST(CAST((c_custkey % 66) / 3 + 1 AS INT) AS STRING) WHEN c_custkey % 60 = 59 THEN 'praha' WHEN c_custkey % 60 = 22 AND c_nationkey % 2 = 1 THEN 'mesto-22-nation' ELSE 'mesto-' || CAST(c_custkey % 60 AS STRING) END",
    "postcode": "CAST(10000 + (c_custkey % 300) * 7 AS STRING)",
    "district": "CASE WHEN c_custkey % 53 <> 5 THEN n_name END",
    "region": "CASE WHEN c_custkey % 97 <> 6 THEN r_name END",
    "lat": "CASE WHEN c_custkey % 41 <> 3 THEN " + LAT.format(k="c_custkey") + " END",
    "lng": "CASE WHEN c_custkey % 41 <> 3 THEN " + LNG.format(k="c_custkey") + " END",
    "phone": "CASE c_custkey % 4 WHEN 0 THEN '+420' || CAST(600000000 + (c_custkey * 7919) % 399999999 AS STRING) WHEN 1 THEN '00420 ' || CAST(600000000 + (c_custkey * 7919) % 399999999 AS STRING) WHEN 2 THEN CAST(600000000 + (c_custkey * 7919) % 399999999 AS STRING) || ', 123' END",
    "email": "CASE c_custkey % 5 WHEN 0 THEN 'Lekar' || CAST(c_custkey AS STRING) || '@Seznam.cz' WHEN 1 THEN 'ordinace@clinic' || CAST(c_custkey % 200 AS STRING) || '.cz' WHEN 2 THEN 'bad; info@www.praxe' || CAST(c_custkey AS STRING) || '.cz, x@y.cz' WHEN 3 THEN NULL ELSE '' END",
    "web": "CASE c_custkey % 6 WHEN 0 THEN 'www.Site' || CAST(c_custkey % 400 AS STRING) || '.cz/Page?a=B' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'https://www.facebook.com/x' WHEN 4 THEN 'HTTP://Portal.cz/dr' || CAST(c_custkey % 400 AS STRING) || ' http://b.cz' END",
    "web_found": "CASE WHEN c_custkey % 12 = 2 THEN 'http://found' || CAST(c_custkey % 300 AS STRING) || '.cz/' END",
    "web_suggested": "CASE WHEN c_custkey % 12 = 5 THEN 'www.navrh' || CAST(c_custkey % 250 AS STRING) || '.cz' END",
    "web_search_us": f"CASE WHEN c_custkey % 8 = 1 THEN {AS_OF_US} - (c_custkey % 200) * {DAY_US} END",
    "active": "c_acctbal > -500",
}
PROVIDERS_FROM = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

# from events, after k and the two times are taken out (EVENT_BASE)
EVENT_K = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)"
SIGNALS = {
    "signal_id": "event_id",
    "provider_id": "(event_id * 7919) % n_providers",
    "source": "CASE event_type WHEN 'signup' THEN 'clinic' WHEN 'purchase' THEN 'region' WHEN 'error' THEN 'web_crawl' ELSE 'user' END",
    "status": "CASE k % 3 WHEN 0 THEN 'accepting' WHEN 1 THEN 'not_accepting' ELSE 'waitlist' END",
    "scope": "CASE k % 5 WHEN 0 THEN 'adults' WHEN 1 THEN 'children' ELSE 'all' END",
    "observed_us": f"{AS_OF_US} - 10 * ({AS_OF_US} - ts_us)",
    "created_us": f"{AS_OF_US} - 10 * ({AS_OF_US} - ts_us) + {6 * HOUR_US}",
    "note": "CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN '„zpráva ' || CAST(event_id AS STRING) || '“' END",
    "reporter_hash": "CASE WHEN event_type IN ('view', 'click') THEN 'r' || CAST(user_id AS STRING) END",
}
FLAG_EVENTS = {
    "provider_id": "(event_id * 104729) % n_providers",
    "flag": "CASE k % 10 WHEN 0 THEN 'self_pay' WHEN 1 THEN 'english' WHEN 2 THEN 'english_site' WHEN 3 THEN 'ins111' WHEN 4 THEN 'ins201' WHEN 5 THEN 'ins205' WHEN 6 THEN 'ins207' WHEN 7 THEN 'ins209' WHEN 8 THEN 'ins211' ELSE 'ins213' END",
    "source": SIGNALS["source"],
    # stretched further than the signals, so that the one-year rule bites
    "observed_us": f"{AS_OF_US} - 20 * ({AS_OF_US} - ts_us)",
}
REPORTS = {
    "report_id": "event_id",
    # one reporter sends a third of everything
    "reporter": "CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'r' || CAST(user_id % 30 AS STRING) END",
    "provider_id": "event_id % 40",
    "created_us": "ts_us",
}

# Report and sign-up forms as sent; one of each per event.
EVENT_DATE = "CAST(DATE '1970-01-01' + CAST((ts_us - ts_us % 86400000000) / 86400000000 AS INT) AS STRING)"
REPORT_FORMS = {
    "form_id": "event_id",
    "provider": "CASE k % 10 WHEN 3 THEN '' WHEN 4 THEN '12a' WHEN 5 THEN '-4' ELSE ' ' || CAST(event_id % 2000 + 1 AS STRING) END",
    "status": "CASE k % 7 WHEN 0 THEN 'accepting' WHEN 1 THEN 'waitlist' WHEN 2 THEN 'maybe' ELSE 'not_accepting' END",
    "scope": "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'adults' WHEN 2 THEN 'pets' ELSE 'children' END",
    "visit_date": "CASE k % 11 WHEN 0 THEN '2024-13-45' WHEN 1 THEN '1. 1. 2024' ELSE " + EVENT_DATE + " END",
    "note": "CASE k % 5 WHEN 0 THEN '   ' ELSE ' Zpráva   číslo ' || CAST(event_id AS STRING) || ' ' || repeat('abc ', CAST(k AS INT) * 2) END",
    "insurers": "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '111,999,111' ELSE '213,201' END",
    "site": "CASE k % 8 WHEN 0 THEN 'www.Zubar-Novak.cz' WHEN 1 THEN 'https://A.cz/x?y=1' WHEN 2 THEN 'info@a.cz' WHEN 3 THEN 'a b.cz' WHEN 4 THEN 'http://a.cz:8080/' WHEN 5 THEN 'nonsense' ELSE '' END",
    "trap": "CASE WHEN user_id % 13 = 0 THEN 'x' ELSE '' END",
    "rendered_us": "ts_us - k * k * 4000000",
    "sent_us": "ts_us",
}
SIGNUP_FORMS = {
    "form_id": "event_id",
    "email": "CASE k % 9 WHEN 0 THEN 'neplatný' WHEN 1 THEN 'a@b' ELSE ' Osoba' || CAST(user_id AS STRING) || '@Example.cz ' END",
    "specialty": "CASE k % 5 WHEN 0 THEN 'zubar' WHEN 1 THEN 'praktik' WHEN 2 THEN 'kominik' ELSE 'ocni' END",
    "lat": "CASE k % 6 WHEN 0 THEN '48.3' WHEN 1 THEN 'x' ELSE '50.' || CAST(k AS STRING) END",
    "lng": "'14.' || CAST(k AS STRING)",
    "radius_km": "CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN '7' ELSE '20' END",
    "place": "CASE k % 10 WHEN 9 THEN '  ' ELSE 'Praha   ' || CAST(k AS STRING) END",
    "lang": "CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END",
}
SIGNUP_REQUESTS = {
    "request_id": "event_id",
    "email": "CASE WHEN user_id % 3 = 0 THEN 'osoba' ELSE 'nova' END || CAST(user_id AS STRING) || '@example.cz'",
    "requester": "'h' || CAST(user_id % 50 AS STRING)",
    "specialty": "CASE k % 3 WHEN 0 THEN 'zubar' WHEN 1 THEN 'praktik' ELSE 'ocni' END",
    "radius_km": "CASE k % 2 WHEN 0 THEN 5 ELSE 20 END",
    "lat": "49.0e0 + (k % 4) / 10.0e0",
    "lng": "15.0e0",
    "created_us": "ts_us",
}

# What people type into the search box; one search per event.
TYPED = [
    "praha", "Praha 6", "pra", "mes", "Město 3", "mesto-22", "město 40", "Dejvice", "Praha-Žižkov", "Brno-sever",
    "Město 31-sever", "100 07", "10014", "99999", "22", "o", "", "Prague 4", "město", "Praha 30 Karlín",
]
SEARCHES = {
    "search_id": "event_id",
    "specialty": "CASE user_id % 6 WHEN 0 THEN 'zubar' WHEN 1 THEN 'praktik' WHEN 2 THEN 'pediatr' WHEN 3 THEN 'gynekolog' WHEN 4 THEN 'ocni' ELSE 'chirurg' END",
    "q": "CASE k % 20 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(TYPED)) + " END",
}

# from orders
SUB_PLACE = "CAST(o_custkey AS BIGINT)"
SUBSCRIPTIONS = {
    "subscription_id": "o_orderkey",
    "email": "'Osoba' || CAST(o_custkey % 700 AS STRING) || '@example.cz'",
    "specialty_slug": "CASE o_orderkey % 6 WHEN 0 THEN 'zubar' WHEN 1 THEN 'praktik' WHEN 2 THEN 'pediatr' WHEN 3 THEN 'gynekolog' WHEN 4 THEN 'ocni' ELSE 'hygienistka' END",
    "lat": LAT.format(k=SUB_PLACE),
    "lng": LNG.format(k=SUB_PLACE),
    "radius_km": "CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 50 ELSE 100 END",
    "place_label": "CASE WHEN o_orderkey % 13 <> 0 THEN 'Místo ' || CAST(o_custkey % 60 AS STRING) END",
    "lang": "CASE WHEN o_orderkey % 5 = 0 THEN 'en' ELSE 'cs' END",
    "token": "'tok_' || CAST(o_orderkey AS STRING)",
    "requester_hash": "'h' || CAST(o_custkey % 900 AS STRING)",
    "created_us": f"{AS_OF_US} - ((o_orderkey * 7919) % 10368000) * 1000000",
    "verified_us": f"CASE WHEN o_orderkey % 7 <> 0 THEN {AS_OF_US} - ((o_orderkey * 7919) % 10368000) * 1000000 + {HOUR_US} END",
    "unsubscribed_us": f"CASE WHEN o_orderkey % 11 = 0 THEN {AS_OF_US} - {HOUR_US} END",
    "confirm_sends": "CAST(1 + o_orderkey % 3 AS INT)",
}
LEDGER = {
    "subscription_id": "o_orderkey",
    "provider_id": "o_custkey",
    "sent_us": f"{AS_OF_US} - (o_orderkey % 120) * {DAY_US}",
}
MAIL_LOG = {
    "mail_id": "o_orderkey",
    "kind": "CASE WHEN o_orderkey % 3 = 0 THEN 'alert' ELSE 'confirm' END",
    "sent_us": f"{AS_OF_US} - ((o_orderkey * 104729) % 5184000) * 1000000",
}
SPONSORED = {
    "listing_id": "o_orderkey",
    "provider_id": "o_custkey",
    "tagline": "'Volné termíny ' || o_orderpriority",
    "starts_on": f"CAST('{AS_OF_DATE}' AS DATE) + (CAST(o_orderkey % 90 AS INT) - 60)",
    "ends_on": f"CAST('{AS_OF_DATE}' AS DATE) + (CAST(o_orderkey % 90 AS INT) - 30)",
}

# from orders x customer x nation x region: the register as a dirty file, one row per line
REGISTER_ROWS = {
    "row_no": "o_orderkey",
    "place_id": "CASE WHEN c_custkey % 10 = 9 THEN ' ' ELSE ' R' || CAST(c_custkey AS STRING) || ' ' END",
    "facility_id": "CASE WHEN c_custkey % 20 = 19 THEN NULL ELSE 'ZZ' || CAST(c_custkey AS STRING) END",
    "name": "CASE WHEN o_orderkey % 101 = 100 THEN '  ' WHEN c_custkey % 31 = 30 THEN 'Domov pro seniory ' || c_name ELSE 'Ordinace ' || c_name END",
    "facility_type": "CASE c_custkey % 9 WHEN 0 THEN 'Lékárna' WHEN 1 THEN 'Ordinace všeob. prakt. lékaře' WHEN 2 THEN 'Psychiatrická nemocnice' WHEN 3 THEN 'Ordinace PL - gynekologa' ELSE 'Samostatná ordinace' END",
    "city": "CASE c_custkey % 6 WHEN 0 THEN 'Ústí nad Labem' WHEN 1 THEN ' Benešov' WHEN 2 THEN 'Český Krumlov' WHEN 3 THEN 'Praha ' || CAST(c_custkey % 22 + 1 AS STRING) WHEN 4 THEN 'Žďár' ELSE NULL END",
    "postcode": "CAST(100 + c_custkey % 700 AS STRING) || ' ' || CAST(10 + c_custkey % 90 AS STRING)",
    "street": "CASE WHEN c_custkey % 3 = 0 THEN 'Ulice ' || CAST(c_nationkey AS STRING) END",
    "house_no": "CAST(c_custkey % 100 AS STRING)",
    "district": "CASE WHEN c_custkey % 17 <> 5 THEN n_name END",
    "region": "r_name",
    "phone": "'+420 ' || CAST(600000000 + c_custkey AS STRING)",
    "email": "CASE WHEN c_custkey % 2 = 0 THEN 'o' || CAST(o_orderkey AS STRING) || '@x.cz' ELSE ' ' END",
    "web": "CASE WHEN c_custkey % 3 = 1 THEN 'www.p' || CAST(o_orderkey AS STRING) || '.cz' END",
    "ico": "CAST(10000000 + c_custkey AS STRING)",
    "specialties": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Zubní lékařství, ortodoncie' WHEN '2-HIGH' THEN 'všeobecné praktické lékařství;psychiatrie' WHEN '3-MEDIUM' THEN 'gynekologie a porodnictví|chirurgie' WHEN '4-NOT SPECIFIED' THEN 'kardiologie' ELSE 'dentální hygiena, Neurologie' END",
    "care_form": "CASE o_orderstatus WHEN 'F' THEN 'ambulantní péče' WHEN 'O' THEN 'lůžková péče' END",
    "lat": "CASE c_custkey % 5 WHEN 0 THEN '49,' || CAST(100 + c_custkey % 900 AS STRING) WHEN 1 THEN '14.' || CAST(100 + c_custkey % 900 AS STRING) WHEN 2 THEN 'x' WHEN 3 THEN '0' END",
    "lng": "CASE c_custkey % 5 WHEN 0 THEN ' 15.' || CAST(100 + c_custkey % 900 AS STRING) WHEN 1 THEN '50.' || CAST(100 + c_custkey % 900 AS STRING) WHEN 2 THEN '14.5' WHEN 3 THEN '0' END",
    "gps": "CASE c_custkey % 5 WHEN 2 THEN '50.08, 14.' || CAST(100 + c_custkey % 900 AS STRING) WHEN 4 THEN '49,5 15,' || CAST(100 + c_custkey % 900 AS STRING) END",
}
REGISTER_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

# What practices put on their pages: one notice per page, added to the given page.
NOTICES = [
    "Přijímáme nové pacienty!",
    "Momentálně NEPŘIJÍMÁME nové pacienty.",
    "Nové pacienty zapisujeme do pořadníku.",
    "Ordinační hodiny Po - Pá 8 - 16.",
    "Kapacita ordinace je naplněna. Od ledna opět přijímáme nové pacienty.",
    "Přijímáme nové pacienty, pouze děti do 18 let.",
    "Přijímáme nové klienty na bělení zubů.",
    "Od září 2019 přijímáme nové pacienty.",
    "Hledat lékaře: přijímá nové pacienty, zrušit filtry.",
    "Nepřijímáme nové dospělé pacienty.",
    "Oční ambulance přijímá nové pacienty. V ordinaci mluvíme anglicky.",
    "Ošetřujeme pouze samoplátce. We don't speak English.",
    "Smluvní pojišťovny: 111, 201, 205. We speak Czech, English and German.",
]
NOTICE = "CASE page_id % 13 " + " ".join(
    f"WHEN {i} THEN '" + n.replace("'", "''") + "'" for i, n in enumerate(NOTICES)
) + " END"
# Pages of each given host become the addresses of one site; an address fetched more than once keeps its newest page.
ORIGIN = "regexp_extract(url, '^[^:]+://[^/?#]*', 0)"
PAGE_LINKS = [
    ("page_id % 5 <> 4", "'<a href=\"/kontakt\">Kontakt</a>'"),
    ("page_id % 3 = 0", "'<a href=\"objednani/#top\">Objednání</a>'"),
    ("page_id % 4 = 1", f"'<a href=\"' || {ORIGIN} || '/pro-pacienty.html\">Informace</a>'"),
    ("page_id % 5 = 2", "'<a href=\"/aktuality?strana=1\">Novinky</a>'"),
    ("page_id % 7 <> 6", "'<a href=\"/en/\">English</a>'"),
]
# Some pages name practices, by a word in another case or by the number of the practice with the page's number.
PAGE_NAMES = "CASE page_id % 4 WHEN 1 THEN 'Praxe Customeru' WHEN 2 THEN 'IČO 00' || CAST(10000000 + page_id * 37 AS STRING) ELSE 'Praxe' END"
PAGES = {
    "page_id": "page_id",
    "url": f"{ORIGIN} || CASE page_id % 10 WHEN 4 THEN '/kontakt' WHEN 5 THEN '/objednani/' WHEN 6 THEN '/en/' WHEN 7 THEN '/pro-pacienty.html'"
           " WHEN 8 THEN '/aktuality?strana=1#top' WHEN 9 THEN '/lekar/' || CAST(page_id AS STRING) || '/' ELSE '/' END",
    "html": f"html || '<footer><p>' || {NOTICE} || '</p>' || " + " || ".join(f"CASE WHEN {when} THEN {link} ELSE '' END" for when, link in PAGE_LINKS) + f" || '<p>' || {PAGE_NAMES} || '</p></footer>'",
}
# Rules of robots files, by the length of a host's name.
ROBOTS = [
    ("length(host) % 4 = 0", "/objednani", False), ("length(host) % 4 = 1", "/*.html$", False), ("length(host) % 5 = 2", "/en", False),
    ("length(host) % 5 = 2", "/en/$", True), ("length(host) % 9 = 5", "/", False), ("length(host) % 6 = 0", "/*?strana=", False),
]


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def stamp(df: DataFrame) -> DataFrame:
    """Microsecond columns become timestamps: ``observed_us`` -> ``observed_at``."""
    return df.select(
        *[
            F.timestamp_micros(c).alias(c[:-3] + "_at") if c.endswith("_us") else F.col(c)
            for c in df.columns
        ]
    )


class Domain:
    """Lazy domain tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str, as_of: str = AS_OF):
        self.spark, self.folder, self.as_of = spark, folder, as_of

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _pick(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return stamp(df.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()]))

    @cached_property
    def _customer(self) -> DataFrame:
        nation, region = self.given("nation"), self.given("region")
        return (
            self.given("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        )

    @cached_property
    def _event(self) -> DataFrame:
        """Events with their number, their time in microseconds and the provider count."""
        n = self.given("customer").agg(F.count("*")).scalar()
        return self.given("events").select(
            "event_id", "user_id", "event_type", "value",
            F.expr(EVENT_K).alias("k"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            n.alias("n_providers"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        return self._pick(self._customer, PROVIDERS)

    @cached_property
    def bridge(self) -> DataFrame:
        c = self.given("customer")
        one = lambda df, slug: df.select(F.col("c_custkey").alias("provider_id"), slug.alias("specialty_slug"))
        also = F.explode(F.array_compact(F.array(
            F.expr(SEGMENT_SLUG),
            F.when(F.col("c_custkey") % 4 == 0, "hygienistka"),
            F.when(F.col("c_custkey") % 8 == 0, "chirurg"),
        )))
        return one(c, also)

    @cached_property
    def signals(self) -> DataFrame:
        return self._pick(self._event, SIGNALS)

    @cached_property
    def flag_events(self) -> DataFrame:
        return self._pick(self._event, FLAG_EVENTS)

    @cached_property
    def flags(self) -> DataFrame:
        return newest_flags(self.flag_events)

    @cached_property
    def reports(self) -> DataFrame:
        return self._pick(self._event, REPORTS)

    @cached_property
    def report_forms(self) -> DataFrame:
        df = self._pick(self._event, REPORT_FORMS)
        return df.withColumn("insurers", F.filter(F.split("insurers", ","), lambda c: c != ""))

    @cached_property
    def signup_forms(self) -> DataFrame:
        return self._pick(self._event, SIGNUP_FORMS)

    @cached_property
    def signup_requests(self) -> DataFrame:
        return self._pick(self._event, SIGNUP_REQUESTS)

    @cached_property
    def searches(self) -> DataFrame:
        return self._pick(self._event, SEARCHES)

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self._pick(self.given("orders"), SUBSCRIPTIONS)

    @cached_property
    def ledger(self) -> DataFrame:
        return self._pick(self.given("orders"), LEDGER)

    @cached_property
    def mail_log(self) -> DataFrame:
        return self._pick(self.given("orders"), MAIL_LOG)

    @cached_property
    def sponsored(self) -> DataFrame:
        return self._pick(self.given("orders"), SPONSORED)

    @cached_property
    def register_rows(self) -> DataFrame:
        df = spread(self.given("orders")).join(self._customer, F.col("o_custkey") == F.col("c_custkey"))
        return self._pick(df, REGISTER_ROWS)

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.given("pages")).selectExpr(*[f"{text} AS {name}" for name, text in PAGES.items()])

    @cached_property
    def sites(self) -> DataFrame:
        """(site, url, n): hosts of the pages, their home address and number (their least page)."""
        hosts = self.pages.select("page_id", host_of(F.col("url")).alias("site")).groupBy("site").agg(F.min("page_id").alias("n"))
        return hosts.select("site", F.concat(F.lit("http://"), "site", F.lit("/")).alias("url"), "n")

    @cached_property
    def robots(self) -> DataFrame:
        """(host, prefix, allow) of the pages' hosts."""
        rules = F.array_compact(F.array(*[
            F.when(F.expr(when), F.struct(F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))) for when, prefix, allow in ROBOTS
        ]))
        return self.sites.select(F.col("site").alias("host")).select("host", F.explode(rules).alias("r")).select("host", "r.*")

    @cached_property
    def status(self) -> DataFrame:
        return provider_status(self.signals, self.as_of)

    @cached_property
    def cards(self) -> DataFrame:
        return provider_cards(self.providers, self.bridge, self.status, self.flags, self.as_of)

    @cached_property
    def spec_cards(self) -> DataFrame:
        return by_specialty(self.cards)

    @cached_property
    def listing(self) -> DataFrame:
        return listing(self.providers, self.bridge, self.status)

    @property
    def now(self):
        return at(self.as_of)
