"""Spellings of languages: codes of two and three letters, English names, any
letter case, with or without a region."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The languages told apart, with the spellings they go by.
SPELLINGS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castilian"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
    "uk": ["uk", "ukr", "ukrainian", "українська"],
    "th": ["th", "tha", "thai", "ไทย"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語"],
    "zh": ["zh", "zho", "chi", "chinese", "cmn", "mandarin", "中文"],
    "ko": ["ko", "kor", "korean", "한국어"],
    "ar": ["ar", "ara", "arabic", "العربية"],
    "hi": ["hi", "hin", "hindi", "हिन्दी"],
}
LANGUAGES = list(SPELLINGS)


def language_of(label: Column) -> Column:
    """The language a label names, or null (null, blank, unknown words)."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)(?:[-_ (].*)?$", 1)
    codes = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)])
    return F.try_element_at(codes, F.when(first != "", first))
