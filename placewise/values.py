"""Aliases, word lists, patterns, limits.

Everything in this file is data that results depend on, so it is stated plainly and in one place.
The code that uses it lives in the other modules.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Register columns. Canonical field -> accepted headers, first alias wins.
# ---------------------------------------------------------------------------------------------
FIELD_ALIASES = {
    "place_id": ["MistoPoskytovaniId", "MP_ID", "MistoPoskytovani_ID"],
    "facility_id": ["ZdravotnickeZarizeniId", "ZZ_ID"],
    "name": ["NazevCely", "NazevZarizeni", "ZZ_nazev", "ZZ_nazev_cely", "Nazev"],
    "facility_type": ["DruhZarizeni", "ZZ_druh", "ZZ_druh_zarizeni"],
    "city": ["Obec", "ZZ_obec", "MP_obec"],
    "postcode": ["Psc", "ZZ_psc", "MP_psc"],
    "street": ["Ulice", "ZZ_ulice", "MP_ulice"],
    "house_no": ["CisloDomovniOrientacni", "ZZ_cislo_domovni_orientacni", "MP_cislo"],
    "district": ["Okres", "ZZ_okres", "MP_okres"],
    "region": ["Kraj", "ZZ_kraj", "MP_kraj"],
    "phone": ["PoskytovatelTelefon", "ZZ_telefon", "Telefon"],
    "email": ["PoskytovatelEmail", "ZZ_email", "Email"],
    "web": ["PoskytovatelWeb", "ZZ_web", "Web"],
    "ico": ["Ico", "ICO", "Poskytovatel_ICO", "P_ico"],
    "specialties": ["OborPece", "ZZ_obor_pece"],
    "care_form": ["FormaPece", "ZZ_forma_pece"],
    "lat": ["Lat", "GPS_lat", "ZZ_lat", "Latitude"],
    "lng": ["Lng", "Lon", "GPS_lng", "ZZ_lng", "Longitude"],
    "gps": ["GPS", "ZZ_GPS"],
}
REQUIRED_FIELDS = ["name", "specialties"]

# Tracked specialties (slug, display name, lower-case register labels).
SPECIALTIES = [
    ("zubar", "Zubař", ["zubní lékařství"]),
    ("praktik", "Praktický lékař", ["všeobecné praktické lékařství"]),
    ("pediatr", "Praktický lékař pro děti", ["praktické lékařství pro děti a dorost"]),
    ("gynekolog", "Gynekolog", ["gynekologie a porodnictví"]),
    ("hygienistka", "Dentální hygiena", ["dentální hygiena", "dentální hygienistka"]),
    ("ocni", "Oční lékař", ["oftalmologie"]),
    ("orl", "ORL lékař", ["otorinolaryngologie a chirurgie hlavy a krku", "otorinolaryngologie", "dětská otorinolaryngologie"]),
    ("kozni", "Kožní lékař", ["dermatovenerologie", "dětská dermatovenerologie"]),
    ("psychiatr", "Psychiatr", ["psychiatrie"]),
    ("neurolog", "Neurolog", ["neurologie"]),
    ("urolog", "Urolog", ["urologie", "dětská urologie"]),
    ("chirurg", "Chirurg", ["chirurgie", "dětská chirurgie"]),
    ("ortoped", "Ortoped", ["ortopedie a traumatologie pohybového ústrojí"]),
]
SPECIALISTS = ["ocni", "orl", "kozni", "psychiatr", "neurolog", "urolog", "chirurg", "ortoped"]
OUTPATIENT_WORD = "ambulant"

# Facility types nobody can sign up at (substrings of the lower-cased type).
CLOSED_FACILITIES = [
    "zdravotnická zachranná služba", "zdravotnická záchranná služba", "přeprava pacientů", "zdravotnická dopravní služba",
    "koroner", "záchytná stanice", "státní zdravotní ústav", "hospic", "zařízení lps",
    "zařízení závodní preventivní péče", "lékárna", "oční optika",
    "samostatná odborná laboratoř", "samostatná stomatologická laboratoř",
    "samostatné zařízení fyzioterapeuta", "samostatné zařízení psychologa", "domácí zdravotní péče",
    "lázeňská léčebna", "léčebna pro dlouhodobě nemocné", "nemocnice následné péče", "rehabilitační ústav",
    "další lůžkové zařízení", "léčebné ústavy", "léčebna tuberkul", "ústavech sociální p",
    "hemodialyzační středisko", "centrum asistované reprodukce", "stacionář", "krizové centrum",
    "centrum komplexní péče o děti", "ostatní zvláštní zdravotnická zařízení",
]
CLOSED_NAMES = "domov pro seniory|domov důchodců|domov se zvláštním režimem|armáda spásy|závodní ordinace|^závodní lékař"
SINGLE_KIND = [
    ("ordinace všeob. prakt. lékaře", ["praktik", "pediatr"]),
    ("ord.prakt.lékaře pro děti", ["pediatr", "praktik"]),
    ("ordinace pl - gynekologa", ["gynekolog"]),
    ("ordinace pl - stomatologa", ["zubar", "hygienistka"]),
]
PSYCHIATRY_ONLY = ["psychiatrická nemocnice", "psychiatrická léčebna", "zařízení pro léčbu závislostí"]

# ---------------------------------------------------------------------------------------------
# Boxes (lat low, lat high, lng low, lng high, ends included).
# ---------------------------------------------------------------------------------------------
BOX_REGISTER = (48.5, 51.1, 12.0, 18.9, True)
BOX_SIGNUP = (48.4, 51.2, 12.0, 19.0, False)
BOX_NEAR_PAGE = (48.0, 51.5, 12.0, 19.5, False)
BOX_GEOCODE = (48.5, 51.1, 12.0, 18.9, False)
EARTH_KM = 6378.168
PRAGUE_POINT = (50.0755, 14.4378)
PRAGUE_SLUG = "^praha(-[0-9]+)?$"

# Status scoring.
STATUSES = ["accepting", "not_accepting", "waitlist"]
SCOPES = ["adults", "children", "all"]
SOURCE_WEIGHTS = {"clinic": 1.0, "region": 0.8, "user": 0.6, "web_crawl": 0.4}
STATUS_VALUES = {"accepting": 1.0, "waitlist": 0.3, "not_accepting": -1.0}
HALF_LIFE_DAYS, HORIZON_DAYS, CLINIC_DAYS, FUTURE_HOURS = 30, 90, 30, 1
MIN_CONFIDENCE, CLEAR_SCORE = 0.3, 0.5
RANK_CLI = {"accepting": 0, "mixed": 1, "unknown": 2}
RANK_WEB = {"accepting": 0, "waitlist": 1, "mixed": 2, "unknown": 3}

# Flags and insurers (code -> short name).
INSURER_NAMES = {"111": "VZP", "201": "VoZP", "205": "ČPZP", "207": "OZP", "209": "ZPŠ", "211": "ZP MV", "213": "RBP"}
FLAGS = ["self_pay", "english", "english_site", "ins111", "ins201", "ins205", "ins207", "ins209", "ins211", "ins213"]
FLAG_YEARS = 1

# Limits of the jobs.
MIN_IMPORT_RATIO = 0.8
RECHECK_DAYS, MAX_PRACTICES_PER_SITE, MAX_SPECIALTIES_PER_PLACE = 6, 5, 3
MAX_PER_EMAIL_DOMAIN, SEARCH_RETRY_DAYS = 3, 90
DAILY_MAILS, RENOTIFY_DAYS, PENDING_DAYS, MAX_PER_ALERT = 450, 60, 7, 10
MAIL_LOG_DAYS, HASH_DAYS = 30, 90
REPORTS_PER_DAY, REPORT_MAX_AGE_DAYS, NOTE_CHARS = 10, 60, 300
FORM_MIN_SECONDS, FORM_MAX_SECONDS = 3, 6 * 3600
SIGNUP_RADII, SIGNUPS_PER_REQUESTER, SIGNUPS_PER_EMAIL, MAX_ACTIVE_PER_EMAIL = [2, 5, 10, 20], 5, 3, 10
SIGNUP_RECENT_MINUTES, MAX_RESENDS, SEND_FAILED_MINUTES = 10, 3, 11
SITEMAP_MAX = 50000

# ---------------------------------------------------------------------------------------------
# Contacts and sites.
# ---------------------------------------------------------------------------------------------
EMAIL_TOKEN = r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"
SIGNUP_EMAIL = r"(?i)^[^\s@<>()\",;:]+@[^\s@<>()\",;:]+\.[a-z]{2,}$"
NOT_OWN_SITE = (
    r"(^|\.)(facebook\.com|fb\.com|instagram\.com|linkedin\.com|twitter\.com|x\.com|youtube\.com|"
    r"firmy\.cz|seznam\.cz|google\.[a-z.]+|goo\.gl|mapy\.cz|mapy\.com|zlatestranky\.cz|najisto\.centrum\.cz|"
    r"zdravotniregistr\.cz)$"
)
FREEMAIL = (
    r"^(?:seznam|email|post|centrum|volny|atlas|tiscali|quick|iol|gmail|googlemail|outlook|hotmail|live|msn|"
    r"yahoo|ymail|icloud|me|mac|mybox|razdva|raz-dva|cbox|c-box|o2active|chello|upcmail|tlapnet|cmail|unet|iex|"
    r"hbnet|worldonline|gmx|proton|protonmail|pm|azet|zoznam|mujmail|inmail|bluetone|t-email|vodafonemail|"
    r"wo|ktknet|kabel1|lpnet|netbox|onet|seznam-mail|telecom|o2|vodafone|tmobile|t-mobile)\.[a-z.]+$"
)
BIG_FACILITY = "nemocnic|nad 5 obor|poliklinik|centrum duševního zdraví|zařízení lps"
ERROR_KINDS = [
    ("http 5", "HTTP 5xx"), ("timed out", "timeout"), ("timeout", "timeout"), ("certificate", "TLS/certificate"),
    ("ssl", "TLS/certificate"), ("dns failed", "DNS: domain not found"), ("name or service", "DNS: domain not found"),
    ("nodename", "DNS: domain not found"), ("getaddrinfo", "DNS: domain not found"), ("no address", "DNS: domain not found"),
    ("refused", "connection refused"), ("reset", "connection reset"), ("not html", "not HTML"),
    ("robots", "blocked by robots.txt"), ("non-public", "non-public address"),
]

# Words in a practice name that identify nobody.
GENERIC_NAME_WORDS = """
mudr mddr mvdr phdr rndr ing mgr bc doc prof csc phd dr med dent sro spol as os ops zs vos
ordinace ordinaci ordinacni zubni zubar zubari stomatologie stomatologicka stomatologicke stomatologicky
stomatolog lekar lekarka lekari lekarska lekarske praktick prakticka prakticky prakticke detsk detska
detsky detske dorost dorostu pro deti dospele ambulance ambulantni centrum center klinika kliniky
poliklinika zdravotni zdravotnicke zdravotnicka zdravi sluzby sluzba pece medical medicine medic
dental dentist clinic health care family studio praxe privatni soukroma soukrome nemocnice
gynekologie gynekologicka gynekologicke porodnictvi pediatrie pediatricka ocni ocniho kozni neurologie
neurologicka psychiatrie psychiatricka urologie urologicka chirurgie chirurgicka ortopedie ortopedicka
orl ambulantni hygiena dentalni hygienistka the and und von van
""".split()
TITLES = r"\b(?:mudr|mddr|mvdr|phdr|mgr|bc|doc|prof|ing)\b"
FIRST_PERSON_END = r"[,;]|\ba\b|\bmudr\b(?=.*\bmudr\b)"
CARE_WORDS = (
    "ordinac|lekar|mudr|mddr|pacient|zubn|ambulanc|klinik|stomatolog|ordinacni hodiny|"
    "zdravotn|pojistovn|ockovan|prohlidk|vysetren"
)
CONTACT_PAGE = "kontakt|o-nas|onas|o nas|about"

# Links worth reading (best first) and signs of an English version.
LINK_HINTS = ["pacient", "registrac", "objedn", "kontakt", "ordinac", "o-nas", "onas", "aktual", "novinky", "pojistov"]
FILE_LINK = r"(?i)\.(?:pdf|jpe?g|png|gif|webp|docx?|xlsx?|zip)$"
EN_PATH = r"(?i)(?:^|/)(?:en|eng|english|en-gb|en-us)(?:/|$|[._-])|english|anglick"
EN_LABEL = r"^(?:en|eng|english|in english|english version|anglicky|anglictina|v anglictine)$"
EN_QUERY = r"(?i)(?:^|&)(?:lang|language|lng)=en\b"
ROOT_PATH = r"(?i)^/?(?:index\.\w+|cs|cz)?/?$"
LOGO_WORDS = r"\b(?:vzp|vozp|cpzp|ozp|zps|zp ?mv|zpmv|rbp)\b|pojistovn|revirni bratrsk|ministerstva vnitra|ceska prumyslova"

# ---------------------------------------------------------------------------------------------
# Phrase rules over folded (lower-case ASCII) text. GAP never leaves a sentence.
# ---------------------------------------------------------------------------------------------
GAP = r"[^.!?\n]{0,40}?"
VERB = r"(?:prijimame|prijima|bereme|bere|registrujeme|registruje|nabirame|nabira)"
WHO = r"(?:pacient\w*|klient\w*)"
NEGATIVE = [
    rf"\bne{VERB}\b{GAP}\b(?:nov\w*|dalsi\w*|zadn\w*)\b{GAP}\b{WHO}",
    rf"\bkapacit\w*\b{GAP}\b(?:naplnen\w*|plna|vycerpan\w*|zaplnen\w*)",
    rf"\bnemame\b{GAP}\bkapacit\w*",
    r"\bstop\s?stav\w*",
    rf"\b(?:pozastav\w*|zastav\w*|ukoncil\w*|ukoncujeme|uzavrel\w*|uzavirame|preruseni|prerusujeme|pozastaveni|zastaveni|ukonceni)\b{GAP}\b(?:prijem\w*|prijimani|registrac\w*|nabor\w*)\b{GAP}\bnov\w*\b{GAP}\b{WHO}",
    rf"\b(?:prijem|prijimani|registrac\w*)\b{GAP}\bnov\w*\b{GAP}\b{WHO}\b{GAP}\b(?:pozastav\w*|zastav\w*|ukoncen\w*|uzavren\w*|preruse\w*)",
    rf"\bkapacit\w*\b{GAP}\b(?:nedostacuj\w*|nestaci|nepostacuj\w*)",
]
WAITLIST = [
    rf"\b(?:zapisujeme|zapiseme|zapis)\b{GAP}\b(?:poradnik\w*|cekaci\w*)",
    rf"\bnov\w* {WHO}{GAP}\b(?:poradnik\w*|cekaci (?:listin|seznam)\w*)",
]
POSITIVE = [
    rf"\b{VERB}\b{GAP}\bnov\w*\b{GAP}\b{WHO}",
    rf"\bvoln\w*\b{GAP}\bkapacit\w*{GAP}\b(?:nov\w*|{WHO})",
    rf"\bnovi {WHO} (?:jsou )?vitani\b",
]
PAID_EXTRA = r"\b(?:belen\w*|beleni|estetick\w*|kosmetick\w*|samoplat\w*)"
UI_WORDS = ["filtr", "vyhledat lekar", "hledat lekar"]
UI_REACH = 80
KIDS, ADULTS = r"\b(?:det\w*|dorost\w*|pediatr\w*)", r"\bdospel\w*"

# Care not covered by insurance.
ONE_INSURER = r"(?!\s*(?:\d|vzp|cpzp|ozp|rbp|vozp|zpmv|zps|ministerstva|skoda|vojensk|oborov|ceska|ceske|vseobecn|krome|mimo|s vyjimkou))"
INSURERS_AT_ALL = rf"(?:zadnou\b{GAP}pojistovn\w*|(?:zdravotnimi )?pojistovnami|(?:zdravotni )?pojistovnou){ONE_INSURER}"
SELF_PAY = [
    rf"\bnemame\b{GAP}\bsmlouv\w*\b{GAP}{INSURERS_AT_ALL}",
    rf"\bbez smlouv\w* (?:se?|s) {INSURERS_AT_ALL}",
    r"\bnesmluvn\w* (?:ordinac\w*|lekar\w*|zarizen\w*|pracovist\w*|poskytovatel\w*|ambulanc\w*)\b(?![^.!?\n]{0,30}(?:vzp|cpzp|ozp|rbp|vozp|zpmv|\b2\d\d\b))",
    r"\b(?:pouze|jen|vyhradne|vylucne) (?:pro |pro nase )?samoplatc\w*",
]
SELF_PAY_EXTRA = r"\b(?:vsemi|vsech|nekter\w*|hygien\w*|belen\w*|estetick\w*|kosmetick\w*|implant\w*|botox\w*|laser\w*|nadstandard\w*|ortodont\w*|rovnatk\w*)"

# Someone speaks English.
ENGLISH = [
    rf"\b(?:mluvime|hovorime|domluvite se|domluvime se|komunikujeme|dorozumite se|mluvi|hovori|ovladame|ovlada)\b{GAP}\banglick\w*",
    r"\banglick\w* (?:mluvic\w*|hovoric\w*)",
    r"\bwe (?:also )?speak\b(?:\W+\w+){0,4}?\W+english\b|\b(?:english[- ]speaking|speaks? english|english (?:is )?spoken)\b",
    r"\b(?:we (?:also )?communicate|consultations?|treatment|care|appointments?) in english\b",
]
ENGLISH_NEGATION = r"\b(?:don'?t|do not|doesn'?t|does not|cannot|can'?t|no|not|unfortunately|bohuzel|nikdo)\s+(?:\w+\s+)?$"
EN_WORDS = ["the", "and", "of", "to", "for", "our", "we", "you", "your", "with", "is", "are", "in", "on", "at"]
CS_WORDS = ["je", "se", "na", "pro", "jsme", "ve", "nebo", "jako", "ktere", "ktery", "ordinace", "pacienty", "nas", "vas"]
EN_MIN_WORDS = 15
ENGLISH_SITE_NOTE = "Web má i anglickou verzi."

# Health insurers as pages write them.
INSURER_WORDS = {
    "111": r"\bvzp\b|vseobecn\w* zdravotni\w* pojistovn\w*",
    "201": r"\bvozp\b|vojensk\w* zdravotni\w* pojistovn\w*",
    "205": r"\bcpzp\b|ceska prumyslova",
    "207": r"\bozp\b|oborov\w* zdravotni\w* pojistovn\w*",
    "209": r"\bzps\b|zamestnaneck\w* pojistovn\w* skoda|pojistovn\w* skoda",
    "211": r"\bzp ?mv\b|\bzpmv\b|ministerstva vnitra",
    "213": r"\brbp\b|revirni bratrsk\w*",
}
CONTRACT_WORDS = r"pojistov\w*|smluvn\w*|smlouv\w*"
CONTRACT_BEFORE, CONTRACT_AFTER = 120, 160
INSURER_CODES = r"\b(111|201|205|207|209|211|213)\b"
ALL_INSURERS = r"\b(?:vsemi|vsech(?:ny)?) (?:zdravotnimi |zdravotnich |zdravotni )?(?:pojistovn\w*|zp\b)"
NO_CONTRACT = (
    r"\b(?:nemame|nema|bez) smlouv\w*|\bnesmluvn\w*"
    r"|\b(?:krome|mimo|s vyjimkou)\W+(?:\w+\W+){0,2}?(?:vzp|cpzp|ozp|rbp|vozp|zp ?mv|zps|111|2\d\d|pojistovn)"
)

# Words that name a field of care.
FIELD_WORDS = {
    "zubar": r"zub|stomato|dent", "hygienistka": r"hygien",
    "praktik": r"praktick|vseobecn", "pediatr": r"detsk|pediatr|dorost|praktick",
    "gynekolog": r"gynekolog|porodn", "ocni": r"\bocni|\bocn|oftalmolog",
    "orl": r"\borl\b|\busni|\bkrcni|otorinolaryng", "kozni": r"\bkozni|dermatolog",
    "psychiatr": r"psychiatr", "neurolog": r"neurolog",
    "urolog": r"urolog", "chirurg": r"chirurg", "ortoped": r"ortoped|traumatolog",
}
OTHER_FIELDS = (
    r"diabetolog|kardiolog|\binterni|internist|endokrinolog|gastroenterolog|"
    r"revmatolog|alergolog|\bplicni|pneumolog|onkolog|nefrolog|rehabilita|psycholog|logoped|"
    r"fyzioterap|mamolog|\bcevni|hematolog|angiolog|geriatr|sexuolog|algeziolog"
)
ONE_PRACTICE = [["zubar", "hygienistka"], ["praktik", "pediatr"]]

# Prague neighbourhoods by district number.
PRAGUE_PARTS = {
    1: ["Staré Město", "Josefov", "Malá Strana", "Hradčany"],
    2: ["Nové Město", "Vinohrady", "Vyšehrad", "Nusle"],
    3: ["Žižkov"],
    4: ["Michle", "Podolí", "Braník", "Krč", "Hodkovičky", "Lhotka", "Kunratice", "Pankrác"],
    5: ["Smíchov", "Košíře", "Motol", "Hlubočepy", "Barrandov", "Radlice", "Jinonice", "Slivenec", "Malvazinky"],
    6: ["Dejvice", "Bubeneč", "Břevnov", "Střešovice", "Veleslavín", "Vokovice", "Ruzyně", "Liboc", "Suchdol", "Sedlec", "Lysolaje", "Nebušice", "Přední Kopanina", "Petřiny"],
    7: ["Holešovice", "Letná", "Troja"],
    8: ["Karlín", "Libeň", "Kobylisy", "Bohnice", "Čimice", "Ďáblice", "Dolní Chabry", "Březiněves", "Palmovka"],
    9: ["Vysočany", "Prosek", "Střížkov", "Hrdlořezy"],
    10: ["Vršovice", "Strašnice", "Malešice", "Záběhlice"],
    11: ["Chodov", "Háje", "Jižní Město"],
    12: ["Modřany", "Komořany", "Kamýk", "Cholupice", "Točná"],
    13: ["Stodůlky", "Třebonice", "Lužiny", "Nové Butovice", "Butovice"],
    14: ["Černý Most", "Kyje", "Hostavice", "Hloubětín"],
    15: ["Hostivař", "Horní Měcholupy", "Dolní Měcholupy", "Štěrboholy", "Petrovice"],
    16: ["Radotín", "Zbraslav", "Lipence", "Velká Chuchle", "Lochkov"],
    17: ["Řepy", "Zličín"],
    18: ["Letňany", "Čakovice"],
    19: ["Kbely", "Vinoř", "Satalice"],
    20: ["Horní Počernice"],
    21: ["Újezd nad Lesy", "Běchovice", "Klánovice", "Koloděje"],
    22: ["Uhříněves", "Pitkovice", "Kolovraty", "Benice", "Královice", "Nedvězí"],
}
