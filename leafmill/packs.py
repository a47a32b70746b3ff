"""Language packs and thresholds: everything that a corpus may want to change.

Operators take a pack or a settings object; the defaults below hold the fixed
values of the medical guideline corpus in Serbian (both scripts). The intents'
keyword lists are read from ``data/guideline_intents.json``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

# Cyrillic letters that look like Latin ones, pair by pair.
HOMOGLYPHS = ("аеојсркмтнивхАЕОЈСРКМТНИВХ", "aeojcpkmtnubxAEOJCPKMTNUBX")

# Transliteration of single letters, then of letters that become two.
LETTERS = (
    "абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ",
    "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ",
)
DIGRAPHS = {"љ": "lj", "њ": "nj", "џ": "dž", "Љ": "Lj", "Њ": "Nj", "Џ": "Dž"}

# Headings of a table of contents and of a bibliography, matched without case.
CONTENTS_TITLES = [
    "садржај", "садржaj", "садржаj", "садржај књиге", "садржај документа",
    "sadržaj", "sadrzaj", "sadržaj knjige", "sadrzaj knjige",
    "contents", "table of contents", "table of content", "toc",
    "inhalt", "inhaltsverzeichnis",
    "table des matières", "table des matieres", "sommaire",
    "indice", "sommario", "índice", "tabla de contenidos",
]
BIBLIOGRAPHY_TITLES = [
    "литература", "референце", "референца", "извори",
    "literatura", "reference", "referenca", "izvori",
    "references", "bibliography", "literature", "sources", "works cited", "further reading",
    "literatur", "literaturverzeichnis", "quellen",
    "bibliographie", "références", "bibliografia", "riferimenti",
]

# Words of an imprint page; phrases of a summary section.
IMPRINT_MARKS = ["ISBN", "CIP -", "COBISS", "ТИРАЖ", "ШТАМПА", "ИЗДАВАЧ", "ЛЕКТОР"]
SUMMARY_PHRASES = ["збирни преглед", "zbirni pregled"]

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["dr", "mr", "str", "sl", "npr", "itd", "tj", "v", "g", "god", "sv", "nr", "br", "op", "cit", "upor", "vid", "vidi"]

# Line patterns (Java regex, with Unicode classes).
ROMAN = "I{1,3}|IV|V|VI{0,3}|IX|X{1,3}"
CYRILLIC_UPPER = "А-ШЂЈЉЊЋЏ"
CYRILLIC_LOWER = "а-шђјљњћџ"
RECOMMENDATION = r"^Препорука\s+(\d+\.\d+)\.?\s*$"
TABLE = r"^Табела\s+(\d+)\.\s*(.+)$"
BIBLIOGRAPHY_LINE = r"^\s*Литература\s*[:.]?\s*$"
BULLET = r"^\s*[–—•\-▪]\s+(.+)$"
NUMBERED = r"^\s*(\d+)[.)]\s+(.+)$"
# Marker families in order of precedence: name, pattern, group of the id, group of the title.
MARKERS = [
    ("arapski-3", r"^(\d{1,2}\.\d{1,2}\.\d{1,2})\.?\s{1,4}(.+)$", 1, 2),
    ("arapski-2", r"^(\d{1,2}\.\d{1,2})\.?\s{1,4}(.+)$", 1, 2),
    ("rimski", rf"^({ROMAN})\.?\s{{1,6}}(.+)$", 1, 2),
    ("arapski-1", r"^(\d{1,2})\.\s{1,4}(.+)$", 1, 2),
    ("veliko", rf"^([A-Z{CYRILLIC_UPPER}])\.\s{{1,3}}(.+)$", 1, 2),
    ("malo", rf"^([a-z{CYRILLIC_LOWER}])\.\s{{1,3}}(.+)$", 1, 2),
    ("poglavlje", r"(?iu)^(ПОГЛАВЉЕ|POGLAVLJE)\s+(\d+)\.\s*(.+)$", 2, 3),
]
MARKER_BULLET = r"^([^\w\s]+)\s+(.+)$"
MARKER_PREFIX = rf"(?iu)^\s*(\d{{1,2}}\.\d{{1,2}}\.\d{{1,2}}\.?|\d{{1,2}}\.\d{{1,2}}\.?|[IVX]{{1,4}}\.?|\d{{1,2}}\.|[a-z{CYRILLIC_LOWER}]\.|(ПОГЛАВЉЕ|POGLAVLJE)\s+\d+\.)\s*"
# What a heading loses before it is compared, in order, and the markers that it may lose.
HEADING_CLEAN = [
    (r"\A#+\s*", ""),
    (r"\.{2,}.*$", ""),
    (r"\s+", " "),
    (r"\A([IVXivx]+|\d+|[a-zA-Z])\.\s+", "$1 "),
    (r"[.,;:!?]+\z", ""),
]
HEADING_MARK = r"\A(i{1,3}|iv|v|vi{0,3}|ix|x|\d{1,3}|[a-z])\s+"
#: The word for chapter, its Cyrillic letters that look like Latin ones folded.
CHAPTER = "пoглabљe"
# Marks at a line's start that begin no sentence; a contents line's dot leader or gap before its page.
LINE_MARK = r"^\s*(\d+\.|[IVX]+\.|ПОГЛАВЉЕ\s+\d+\.)\s*"
ENTRY_DOTS = r"\.{2,}\s*(\d{1,4})?\s*$"
ENTRY_GAP = r"\s{2,}(\d{1,4})\s*$"
# What a bibliography entry holds.
REFERENCE_WORDS = ["et al", "doi:", "http://", "https://"]
# a word of its own, letters around it make another one
REFERENCE_ID = r"(?<!\p{L})pmids?(?!\p{L})"
REFERENCE_YEAR = r"\b(19|20)\d{2}\b"
REFERENCE_ISSUE = r"\b(19|20)\d{2}[;.]"
REFERENCE_NAME = rf"[A-Z{CYRILLIC_UPPER}][a-z{CYRILLIC_LOWER}]+\s+[A-Z{CYRILLIC_UPPER}]\."
HEADING_LEVELS = [
    (1, rf"^({ROMAN})\.\s{{1,6}}([{CYRILLIC_UPPER}A-Z][^\n]+)$"),
    (2, rf"^(\d{{1,2}})\.\s{{1,4}}([{CYRILLIC_UPPER}A-Z][^\n]+)$"),
    (3, rf"^([{CYRILLIC_LOWER}a-z])\.\s{{1,3}}([{CYRILLIC_UPPER}A-Z][^\n]+)$"),
]
SEGMENT_END = [rf"^({ROMAN})\.?\s+\S", rf"^\d{{1,2}}\.\s+[{CYRILLIC_UPPER}]"]

# Entity types that the extractor may return.
ENTITY_TYPES = [
    "disease", "drug", "dose", "procedure", "symptom", "measure", "complication", "criterion", "test", "stage", "age_group", "comorbidity",
    "mechanism", "effect", "cause", "risk_factor", "vaccine", "lifestyle", "frequency", "route", "duration", "classification", "differential",
    "prognosis", "mortality", "prevalence", "incidence", "population", "genetic", "progression", "term", "referral", "followup", "monitoring",
]

# Intents in order of precedence; the last is the default.
INTENTS = [
    "curability", "dosage", "symptoms", "prevention", "risk_factors", "comprehensive", "reference",
    "procedural", "comparison", "causal", "therapeutic", "diagnostic", "definitional", "precise",
]
#: The intent of questions for a whole list.
COMPREHENSIVE = "comprehensive"
# Words of section titles that suit an intent; an intent without words suits any section.
INTENT_SECTIONS = {
    "curability": ["lečenje", "terapija", "izlečiv", "prognoza", "uvod"],
    "dosage": ["doza", "doziranje", "primena", "terapija"],
    "symptoms": ["simptom", "klinička slika", "manifestacij", "dijagnoza"],
    "prevention": ["prevencija", "sprečavanje", "vakcinacija", "imunizacija"],
    "risk_factors": ["faktor rizika", "rizik", "uzrok", "etiology"],
    "therapeutic": ["lečenje", "terapija", "lek", "farmakološk"],
    "diagnostic": ["dijagnoza", "dijagnostik", "ispitivanje", "test"],
    "definitional": ["definicij", "uvod", "pojam"],
    "causal": ["uzrok", "patogenez", "mehanizam", "nastanak"],
    "complications": ["komplikacij", "posledic"],
    "contraindication": ["kontraindikacij", "oprez", "mere opreza"],
    "prognosis": ["prognoza", "preživljavanje"],
    "monitoring": ["praćenje", "monitoring", "kontrola"],
    "lifestyle": ["životni stil", "ishrana", "vežbanje", "pušenje"],
    "epidemiology": ["epidemiolog", "prevalencij", "incidenc", "mortalitet"],
    "differential_diagnosis": ["diferencijalna", "diferencijaln"],
}


@dataclass(frozen=True)
class Settings:
    """Thresholds; the defaults are the fixed values of the guideline corpus."""

    min_page_chars: int = 100
    lookahead_pages: int = 50
    skip_end_pages: int = 5
    min_toc_lines: int = 5
    toc_ratio_titled: float = 0.70
    toc_ratio_untitled: float = 0.95
    toc_ratio_continued: float = 0.50
    toc_line_chars: int = 150
    fallback_lines: int = 3
    fallback_dot_lines: int = 2
    fallback_ratio: float = 0.70
    fallback_sentences: int = 1
    fallback_lines_weak: int = 40
    fuzzy_short: float = 0.90
    fuzzy_long: float = 0.85
    short_title: int = 20
    overlap: float = 0.70
    overlap_line: int = 100
    one_word_line: int = 40
    pages_per_target: int = 10
    pack_target: int = 700
    pack_min: int = 200
    recommendation_max: int = 700
    list_max: int = 500
    list_split_items: int = 5
    lookahead_lines: int = 8
    term_fuzzy: float = 0.82
    term_fuzzy_min: int = 5
    term_gap: int = 3
    term_max: int = 100
    term_min: int = 2
    values_per_placeholder: int = 3
    combinations: int = 5
    questions_per_chunk: int = 10
    min_entity_types: int = 2
    min_question_chars: int = 10
    extractor_chars: int = 3000
    question_top: int = 25
    question_score: float = 0.90
    passage_top: int = 15
    passage_score: float = 0.70
    results: int = 5


@dataclass(frozen=True)
class LanguagePack:
    """Word lists of a language; see the fixed values above for the defaults."""

    contents_titles: list[str] = field(default_factory=lambda: list(CONTENTS_TITLES))
    bibliography_titles: list[str] = field(default_factory=lambda: list(BIBLIOGRAPHY_TITLES))
    imprint_marks: list[str] = field(default_factory=lambda: list(IMPRINT_MARKS))
    summary_phrases: list[str] = field(default_factory=lambda: list(SUMMARY_PHRASES))
    recommendation: str = RECOMMENDATION
    table: str = TABLE
    bibliography_line: str = BIBLIOGRAPHY_LINE
    bullet: str = BULLET
    numbered: str = NUMBERED
    entity_types: list[str] = field(default_factory=lambda: list(ENTITY_TYPES))
    intents: list[str] = field(default_factory=lambda: list(INTENTS))
    intent_keywords: dict[str, list[str]] = field(default_factory=dict)
    intent_sections: dict[str, list[str]] = field(default_factory=lambda: dict(INTENT_SECTIONS))
    translations: dict[str, str] = field(default_factory=dict)
    known_terms: list[str] = field(default_factory=list)
    primary_categories: dict[str, str] = field(default_factory=dict)
    toc_locations: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, *paths: str) -> LanguagePack:
        """The defaults, with whatever lists the files name in their place."""
        given: dict = {}
        for path in paths:
            given |= json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**given)


GUIDELINE_INTENTS = Path(__file__).resolve().parent / "data" / "guideline_intents.json"


def guideline_pack(**more) -> LanguagePack:
    """The pack of the guideline corpus, with its term dictionaries and its intents' words."""
    from . import terms

    words = json.loads(GUIDELINE_INTENTS.read_text(encoding="utf-8"))["intent_keywords"]
    given = {"translations": terms.TRANSLATIONS, "known_terms": terms.KNOWN, "primary_categories": terms.CATEGORIES, "intent_keywords": words}
    return LanguagePack(**(given | more))
