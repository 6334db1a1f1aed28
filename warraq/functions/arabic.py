"""Normalisation of Arabic text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warraq.bindings import MARKS, UNIFIED

# Vowel marks, and the letter folds of classifiers and of headings.
VOWELS = "\u064b-\u065f\u0670"
CLASSIFIER_MARKS = "\u064b-\u0652\u0670\u0640"
CLASSIFIER_FOLD = ("أإآٱىئؤة", "ااااييوه")
HEADING_FOLD = ("أإآٱىة", "اااايه")
DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_arabic(text: Column) -> Column:
    """Without marks, with unified letters and single spaces; null as ''."""
    bare = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARKS}]", ""), *UNIFIED)
    return collapse(bare)


def fold_letters(text: Column) -> Column:
    """The classifiers' fold, which also reads seated hamzas as their seats; spaces stay."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{CLASSIFIER_MARKS}]", ""), *CLASSIFIER_FOLD)


def fold_heading(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, f"[{CLASSIFIER_MARKS}]", ""), *HEADING_FOLD)


def has_tashkeel(text: Column) -> Column:
    return text.rlike(f"[{VOWELS}]")


def strip_tashkeel(text: Column) -> Column:
    return F.regexp_replace(text, f"[{VOWELS}]", "")


def vocal_density(text: Column) -> Column:
    """Vowel marks for each letter; null without letters."""
    letters = F.regexp_count(text, F.lit("[ء-غف-ي]"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(f"[{VOWELS}]")) / letters)


def vocalised_window(text: Column, letters: int = 60, density: float = 0.6) -> Column:
    return (F.regexp_count(text, F.lit("[ء-غف-ي]")) >= letters) & (vocal_density(text) >= density)


def digits_to_latin(text: Column) -> Column:
    """Latin digits without leading zeros; nothing left is '0'."""
    bare = F.regexp_replace(F.translate(text, *DIGITS), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)
