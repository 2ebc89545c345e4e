"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour being reproduced
(word lists, lookup tables, limits, messages, prompt texts). Values are kept as plain text,
in their natural order, so they can be read and checked directly.
"""

# --- FIXED VALUES: limits ------------------------------------------------------------------
MIN_TEXT_LENGTH = 3
MAX_TEXT_LENGTH = 10000
DEFAULT_HISTORY_LIMIT = 20
TRANSLATIONS_PAGE = 50
CORRECTIONS_PAGE = 50
CHAT_PAGE = 20
TIPS_PAGE = 20
MAX_FILE_SIZE_MB = 10
MAX_FILE_SIZE_BYTES = MAX_FILE_SIZE_MB * 1024 * 1024
SUPPORTED_FILE_TYPES = ["txt", "docx", "pdf"]
MIN_AUDIO_SIZE_BYTES = 1000
TTS_MAX_CHARS = 4000
PREVIEW_CHARS = 200
ERROR_SNIPPET_CHARS = 100
SUMMARY_VOCABULARY_ITEMS = 20
SUMMARY_ERRORS = 5
REFRESH_INTERVAL_SECONDS = 30

# --- FIXED VALUES: record kinds ------------------------------------------------------------
MODES = ["translation", "correction", "analysis", "exercise", "chat_session", "learning_tips"]
CORRECTION_LIST_MODES = ["correction", "analysis", "exercise"]

# --- FIXED VALUES: cache time-to-live in seconds by kind (default 300) ---------------------
DEFAULT_TTL_SECONDS = 300
TTL_BY_KIND = {
    "translations": 600,
    "corrections": 600,
    "chat_sessions": 300,
    "tips_history": 300,
}

# --- FIXED VALUES: languages ---------------------------------------------------------------
SUPPORTED_LANGUAGES = [
    "angielski", "niemiecki", "francuski", "hiszpański",
    "włoski", "rosyjski", "japoński", "koreański", "chiński",
]

LANGUAGE_VOICE_MAPPING = {
    "angielski": "alloy",
    "niemiecki": "onyx",
    "francuski": "nova",
    "hiszpański": "echo",
    "włoski": "fable",
    "polski": "shimmer",
    "rosyjski": "onyx",
    "japoński": "nova",
    "koreański": "shimmer",
    "chiński": "alloy",
}
DEFAULT_VOICE = "alloy"

AVAILABLE_VOICES = [
    ("alloy", "Alloy - neutralny"),
    ("echo", "Echo - męski"),
    ("fable", "Fable - młody"),
    ("onyx", "Onyx - poważny"),
    ("nova", "Nova - kobiecy"),
    ("shimmer", "Shimmer - przyjazny"),
]

FLAGGED_LANGUAGE_NAMES = {
    "🇺🇸 angielski": "angielski",
    "🇩🇪 niemiecki": "niemiecki",
    "🇫🇷 francuski": "francuski",
    "🇪🇸 hiszpański": "hiszpański",
    "🇮🇹 włoski": "włoski",
    "🇷🇺 rosyjski": "rosyjski",
    "🇯🇵 japoński": "japoński",
    "🇰🇷 koreański": "koreański",
    "🇨🇳 chiński": "chiński",
}

# --- FIXED VALUES: exercises ---------------------------------------------------------------
EXERCISE_TYPES = ["vocabulary", "grammar", "translation"]
EXERCISE_TYPE_LABELS = {
    "vocabulary": "📚 Słownictwo",
    "grammar": "📖 Gramatyka",
    "translation": "🔄 Tłumaczenie",
}
DEFAULT_EXERCISE_TITLE = "Ćwiczenie"

# --- FIXED VALUES: validation messages -----------------------------------------------------
MSG_EMPTY_TEXT = "Wprowadź tekst do przetworzenia."
MSG_TEXT_TOO_SHORT = "Tekst jest za krótki. Wprowadź co najmniej 3 znaki."
MSG_TEXT_TOO_LONG = "Tekst jest za długi. Maksymalna długość to 10000 znaków."
MSG_PICK_LANGUAGE = "Wybierz język"
MSG_UNSUPPORTED_LANGUAGE = "Nieobsługiwany język: "
MSG_UNKNOWN_EXERCISE = "Nieznany typ ćwiczenia: "
MSG_FILE_TOO_LARGE = "Plik jest za duży. Maksymalny rozmiar: 10MB"
MSG_UNSUPPORTED_FORMAT = "Nieobsługiwany format pliku"
MSG_TXT_DECODE_FAILED = "Nie udało się odczytać pliku TXT - problem z kodowaniem"
MSG_AI_NOT_JSON = "Odpowiedź AI nie jest w formacie JSON"
MSG_AI_PARSE_ERROR = "Błąd parsowania odpowiedzi AI"
MSG_UNKNOWN_EXERCISE_TYPE = "Nieznany typ ćwiczenia"
MSG_WORD_PARSE_ERROR = "Błąd parsowania"
MSG_NO_TIPS = "Brak danych do wygenerowania wskazówek"

# --- FIXED VALUES: text decoding order for .txt files --------------------------------------
TXT_ENCODINGS = ["utf-8", "cp1250", "iso-8859-2", "latin-1"]

# --- FIXED VALUES: answer prefixes stripped before analysis (order matters) ----------------
TRANSLATION_PREFIXES = [
    "Tłumaczenie:", "Translation:", "Przetłumaczony tekst:",
    "Translated text:", "Oto tłumaczenie:", "Here's the translation:",
]
CORRECTION_PREFIXES = [
    "Poprawiona wersja:", "Corrected version:", "Poprawiony tekst:",
    "Corrected text:", "Oto poprawiona wersja:", "Here's the corrected version:",
]

# --- FIXED VALUES: tips bullet -------------------------------------------------------------
TIP_BULLET = "• "

# --- FIXED VALUES: speech API error classes (first match wins) -----------------------------
ERROR_CLASSES = [
    ("quota_or_billing", ["quota", "billing"]),
    ("invalid_format", ["invalid", "format"]),
    ("rate_limit", ["rate"]),
]

# --- FIXED VALUES: language-learning question keywords (substring match, lower-cased) ------
LANGUAGE_KEYWORDS = [
    # grammar
    "grammar", "gramatyka", "tense", "czas", "verb", "czasownik", "noun", "rzeczownik",
    "adjective", "przymiotnik", "adverb", "przysłówek", "preposition", "przyimek",
    "conjunction", "spójnik", "pronoun", "zaimek", "article", "artykuł",
    "past tense", "present tense", "future tense", "perfect", "continuous",
    "conditional", "subjunctive", "passive", "active", "infinitive", "gerund",
    # vocabulary
    "vocabulary", "słownictwo", "word", "słowo", "meaning", "znaczenie",
    "translation", "tłumaczenie", "synonym", "antonim", "definition", "definicja",
    "phrase", "fraza", "expression", "wyrażenie", "idiom", "idiom",
    # pronunciation
    "pronunciation", "wymowa", "accent", "akcent", "stress", "akcent",
    "phonetics", "fonetyka", "sound", "dźwięk", "speak", "mówić",
    # skills
    "speaking", "mówienie", "listening", "słuchanie", "reading", "czytanie",
    "writing", "pisanie", "conversation", "rozmowa", "dialogue", "dialog",
    "practice", "ćwiczenie", "exercise", "zadanie", "test", "test",
    # languages
    "english", "angielski", "german", "niemiecki", "french", "francuski",
    "spanish", "hiszpański", "italian", "włoski", "russian", "rosyjski",
    "japanese", "japoński", "korean", "koreański", "chinese", "chiński",
    # questions about language
    "how to say", "jak powiedzieć", "what does", "co oznacza", "how do you",
    "jak się", "can you help", "czy możesz pomóc", "explain", "wyjaśnij",
    "difference", "różnica", "correct", "poprawny", "wrong", "błędny",
    "mistake", "błąd", "error", "błąd", "improve", "poprawić",
    # levels
    "beginner", "początkujący", "intermediate", "średniozaawansowany",
    "advanced", "zaawansowany", "level", "poziom", "difficulty", "trudność",
]

# --- FIXED VALUES: conversation-request keywords (substring match, lower-cased) ------------
CONVERSATION_KEYWORDS = [
    "rozmawiajmy", "rozmowa", "conversation", "pogadajmy", "pogadaj",
    "ćwiczmy", "ćwiczenie", "practice", "przećwiczmy", "przećwicz",
    "porozmawiajmy", "porozmawiaj", "let's talk", "let's practice",
    "let's speak", "mówmy", "speak", "mów", "talk", "pogadajmy",
    "przećwiczmy rozmowę", "practice conversation", "ćwiczenie rozmowy",
    "rozmowa w", "conversation in", "mówmy po", "speak in",
    "przećwiczmy po", "practice in", "ćwiczenie po", "exercise in",
    "od teraz mów", "from now speak", "od teraz rozmawiaj", "from now talk",
    "przełącz się na", "switch to", "przełącz na", "switch on",
    "mów do mnie po", "speak to me in", "rozmawiaj ze mną po", "talk to me in",
]

# --- FIXED VALUES: texts shown to the learner ----------------------------------------------
REFUSAL_TEMPLATE = (
    "Przepraszam, ale mogę pomóc Ci tylko z pytaniami związanymi z nauką języka %s. "
    "Zadaj mi pytanie o gramatykę, słownictwo, wymowę lub inne tematy językowe. "
    "Jestem tutaj, żeby być Twoim korepetytorem %s!"
)
EXERCISE_CONTEXT_PREFIX_LATEST = "Ostatnie ćwiczenie: "
EXERCISE_CONTEXT_PREFIX_ARCHIVE = "Ćwiczenie: "
TIPS_CONTEXT_PREFIX = "Wskazówki do nauki: "
CHAT_CONTEXT_PREFIX = "KONTEKST: "

# --- FIXED VALUES: history summary labels --------------------------------------------------
SUMMARY_HEADER = "HISTORIA NAUKI - JĘZYK "
SUMMARY_TRANSLATIONS = "Liczba tłumaczeń: "
SUMMARY_CORRECTIONS = "Liczba poprawek: "
SUMMARY_ANALYSES = "Liczba analiz: "
SUMMARY_WORDS = "POZNAWE SŁOWA "
SUMMARY_ERRORS_HEADER = "OSTATNIE BŁĘDY:"
SUMMARY_LEVEL = " - poziom: "
