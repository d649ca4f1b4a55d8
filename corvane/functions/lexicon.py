"""Word lists and patterns that results depend on.

The tables below are fixed values: they must be as they are for the same results.
"""

from __future__ import annotations

STOPWORDS = [
    "a", "about", "and", "are", "bu", "co", "czy", "dla", "do", "gibi", "ile", "is", "jak", "jaki", "na", "nedir", "of", "olan", "the",
    "to", "ve", "what", "where", "w", "z", "де", "до", "і", "та", "які", "як", "в", "для", "и", "какие", "как", "что",
]

SYNONYM_GROUPS = [
    ["admission", "admissions", "apply", "application", "başvuru", "kabul", "rekrutacja", "rekrutacji", "вступ", "вступу", "прийом", "поступление", "поступления", "приём"],
    ["cost", "czesne", "fee", "fees", "harç", "tuition", "ücret", "ücreti", "вартість", "навчання", "оплата", "обучение", "стоимость"],
    ["address", "adres", "contact", "iletişim", "kontakt", "контакт", "контакти"],
    ["dean", "dekan", "dziekanat", "декан", "деканат"],
    ["burs", "scholarship", "stypendium"],
    ["belgeler", "documents", "dokumenty", "документи", "документы"],
    ["calendar", "dönem", "kalendarz", "semester", "semestr", "takvim", "календар", "семестр"],
    ["bilgisayar", "computer", "informatyka", "informatyce", "informatyki", "informatics", "компютер", "информатика"],
]

LANGUAGE_ALIASES = {
    "english": "en", "en": "en",
    "polski": "pl", "polish": "pl", "pl": "pl",
    "türkçe": "tr", "turkish": "tr", "tr": "tr",
    "українська": "uk", "ukrainian": "uk", "uk": "uk",
    "русский": "ru", "russian": "ru", "ru": "ru",
}

#: Hints in URL paths and the categories they stand for; the first that fits counts.
CATEGORY_HINTS = {
    "architektura": "Architektura",
    "informatyka": "Informatyka",
    "cyberbezpieczenstwo": "Informatyka",
    "sztuczna-inteligencja": "Informatyka",
    "programowanie": "Informatyka",
    "zarzadzanie": "Zarządzanie",
    "budownictwo": "Budownictwo",
    "logistyka": "Logistyka",
    "ochrona-srodowiska": "Ochrona środowiska",
    "wzornictwo": "Wzornictwo",
    "kandydat": "Rekrutacja",
    "zasady-rekrutacji": "Rekrutacja",
    "kalkulator-czesnego": "Czesne / opłaty",
    "kontakt": "Kontakt",
    "erasmus": "Erasmus",
    "dziekanat": "Dziekanat",
    "wazne-dokumenty": "Dokumenty / Regulaminy",
    "aktualnosci": "Aktualności",
}
CATEGORY_DEFAULT = "Ogólne"

SKIPPED_PATHS = ["/wp-admin", "/wp-login", "/feed", "/search", "/tag/", "/category/", "/aktualnosci/"]

DYNAMIC_PATHS = [
    r"^/oferta/studia-1-stopnia/[^/]+/$",
    r"^/oferta/studia-2-stopnia/[^/]+/$",
    r"^/studia-podyplomowe/[^/]+/$",
    r"^/studia-mba/[^/]+/$",
    r"^/kalkulator-czesnego/$",
    r"^/en/offer/bachelor/[^/]+/$",
    r"^/en/offer/master/[^/]+/$",
    r"^/en/tuition-calculator/$",
    r"^/uk/propozyciya/bakalavrat/[^/]+/$",
    r"^/uk/propozyciya/mahistratura/[^/]+/$",
    r"^/uk/kalkulator-czesnego/$",
    r"^/ru/predlozhenie/bakalavriat/[^/]+/$",
    r"^/ru/predlozhenie/magistratura/[^/]+/$",
    r"^/ru/kalkulator-czesnego/$",
]

URL_LANGUAGES = ["en", "uk", "ru"]
URL_LANGUAGE_DEFAULT = "pl"

# The patterns below hold whatever the case of letters; in the first a dot may stand for a line end.
COUNTDOWN_MARKERS = ["pierwszego", "zarezerwuj", "liczba miejsc"]
COOKIE_MARKERS = ["cookie", "cookies", "plików cookie", "plików cookies"]
CONSENT_MARKERS = ["akceptuj", "zaakceptuj", "odrzuć", "ustawienia", "zgadzam", "accept", "reject", "settings", "consent"]
COUNTDOWN_WIDGET = r"\bstart\s*pierwszego\s*zarezerwuj\s*liczba\s+miejsc\s*start\s*\d+\s*:\s*\d+\s*:\s*\d+\s*:\s*\d+\s*studiów\s*października\s*swoje\s+miejsce\s*ograniczona\s*studiów"

RESPONSE_KEYWORDS = ["price", "pricing", "tuition", "fee", "fees", "czes", "opl", "calculator", "kalkulator", "ajax", "api"]
PRICE_PATTERN = r"zł/m-c|[0-9]{3,5}\s*(zł|PLN)"
PRICE_PENDING, PRICE_RAW = "Cennik w przygotowaniu", '"ctaMore"'

#: Answers where nothing was found, by the language's name or code; English otherwise.
NOT_FOUND = {
    "en": "I could not find this information in the indexed sources.",
    "pl": "Nie udało mi się znaleźć tej informacji w zindeksowanych źródłach.",
    "tr": "Bu bilgiyi indekslenen kaynaklarda bulamadım.",
    "uk": "Не вдалося знайти цю інформацію в проіндексованих джерелах.",
    "ru": "Не удалось найти эту информацию в проиндексированных источниках.",
}

# Constants of ranking and answering.
BM25_K1, BM25_B, META_BOOST = 1.5, 0.75, 1.25
RRF_K, RRF_VECTOR, RRF_LEXICAL = 60, 1.0, 0.7
TOP_K, DEPTH, CONFIDENCE, SIMILARITY = 5, 10, 0.15, 0.55
CHUNK_MOST, CHUNK_LEAST = 1800, 15
EXCERPT_MOST, EXCERPT_CUT = 1200, 1197
