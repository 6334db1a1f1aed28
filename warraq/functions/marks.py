"""Helpers that scan one row's letters: offset maps, vowel marks, and their transfer."""

from __future__ import annotations

import re

import pandas as pd

from warraq.bindings import MARKS, UNIFIED
from warraq.functions.vectorized import vectorized

_MARK = re.compile(f"[{MARKS}]")
_LETTER = str.maketrans(*UNIFIED)
_VOWEL = re.compile("[ً-ْٰ]")
#: An Arabic letter and the marks after it, letters that count as one, and marks that are not shown.
_MARKED_LETTER = re.compile("([\u0621-\u064a])([\u064b-\u0652\u0670]*)")
_FOLDED = str.maketrans("أإآٱىئؤة", "ااااييوه")
_DISPLAY_MARK = re.compile("[ً-ٰٟۖ-ۭـ]")
#: The classes of a letter's marks; shadda may stand with a vowel.
CLASSES = ("", "َ", "ً", "ُ", "ٌ", "ِ", "ٍ", "ْ", "ّ", "َّ", "ًّ", "ُّ", "ٌّ", "ِّ", "ٍّ", "ٰ")


def with_map(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its letters, its place in the raw one."""
    kept = []
    for at, letter in enumerate(text):
        if _MARK.match(letter):
            continue
        if letter.isspace():
            if kept and kept[-1][0] != " ":
                kept.append((" ", at))
        else:
            kept.append((letter.translate(_LETTER), at))
    if kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [at for _, at in kept]


@vectorized("struct<norm:string,at:array<int>>")
def norm_with_map(texts: pd.Series) -> pd.DataFrame:
    found = [with_map(x or "") for x in texts]
    return pd.DataFrame({"norm": [n for n, _ in found], "at": [a for _, a in found]})


def split(text: str) -> tuple[str, list[int]]:
    """The bare text and the class of the marks after each of its letters."""
    bare, marks = [], []
    for letter in text:
        if _VOWEL.match(letter) and bare:
            marks[-1] += letter
        elif not _VOWEL.match(letter):
            bare.append(letter)
            marks.append("")
    number = {m: i for i, m in enumerate(CLASSES)} | {m[::-1]: i for i, m in enumerate(CLASSES) if len(m) == 2}
    return "".join(bare), [number.get(m, 0) for m in marks]


def apply(bare: str, classes: list[int]) -> str:
    return "".join(c + CLASSES[k] for c, k in zip(bare, classes))


@vectorized("struct<bare:string,classes:array<int>>")
def split_marks(texts: pd.Series) -> pd.DataFrame:
    found = [split(x or "") for x in texts]
    return pd.DataFrame({"bare": [b for b, _ in found], "classes": [c for _, c in found]})


@vectorized("string")
def apply_marks(bare: pd.Series, classes: pd.Series) -> pd.Series:
    return pd.Series([apply(b, c) for b, c in zip(bare, classes)])


def letter_stream(text: str) -> list[tuple[int, str, str]]:
    """Place, folded letter and marks after it, of each Arabic letter; all else is passed over."""
    return [(m.start(), m[1].translate(_FOLDED), m[2]) for m in _MARKED_LETTER.finditer(text)]


def transplanted(bare: str, marked: str, skip: int = 8) -> str | None:
    """``bare`` with the marks of the same letters of ``marked``, which may have up to ``skip`` letters
    between them; a letter after a gap counts only if the one that follows it agrees too, as far as
    there is one.  None where a letter isn't found or ``marked`` has none."""
    wanted, source = letter_stream(bare), letter_stream(marked)
    letters = "".join(c for _, c, _ in source)
    if not letters:
        return None
    out, done, at = [], 0, 0
    for i, (place, c, _) in enumerate(wanted):
        following = wanted[i + 1][1] if i + 1 < len(wanted) else ""
        found = letters.find(c, at, at + 1)
        if found < 0:
            gap = range(at + 1, min(at + skip + 1, len(letters)))
            found = next((j for j in gap if letters[j] == c and letters.startswith(following[: len(letters) - j - 1], j + 1)), -1)
        if found < 0:
            return None
        out += [bare[done : place + 1], source[found][2]]
        done, at = place + 1, found + 1
    return "".join([*out, bare[done:]])


@vectorized("string")
def transplant_marks(bare: pd.Series, marked: pd.Series) -> pd.Series:
    return pd.Series([transplanted(b, m) if b and m else None for b, m in zip(bare, marked)])


@vectorized("array<int>")
def places_of_letters(texts: pd.Series, places: pd.Series) -> pd.Series:
    """Places in a text without its marks, as places in the text itself; -1 for those outside."""

    def one(text, wanted):
        if wanted is None or not len(wanted):
            return []
        kept = [i for i, c in enumerate(text or "") if not _DISPLAY_MARK.match(c)]
        return [kept[k] if 0 <= k < len(kept) else -1 for k in map(int, wanted)]

    return pd.Series([one(t, w) for t, w in zip(texts, places)])


@vectorized("int")
def place_in_raw(texts: pd.Series, places: pd.Series) -> pd.Series:
    """A place in the normalised text, as a place in the raw one; -1 where there is none."""

    def one(text, k):
        if pd.isna(k):
            return -1
        at = with_map(text or "")[1]
        return at[int(k)] if 0 <= k < len(at) else -1

    return pd.Series([one(t, k) for t, k in zip(texts, places)])


_QUOTED = re.compile("﴿[^﴾]*﴾|\\{[^}]*\\}")


def merged(text: str, vocalised: dict[str, str]) -> str:
    """Words without any mark, outside scripture, in their vocalised form where one is supplied."""
    out, at = [], 0
    spell = lambda part: re.sub(r"\S+", lambda m: vocalised.get(m[0], m[0]) if not _VOWEL.search(m[0]) else m[0], part)
    for m in _QUOTED.finditer(text):
        out += [spell(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, spell(text[at:])])


@vectorized("string")
def merge_bare_words(texts: pd.Series, forms: pd.Series) -> pd.Series:
    """``forms``: map of bare words to vocalised ones."""
    return pd.Series([merged(t or "", dict(f) if f is not None else {}) for t, f in zip(texts, forms)])


@vectorized("int")
def map_offset(raw: pd.Series, marked: pd.Series, offset: pd.Series) -> pd.Series:
    """The place in ``marked`` of the letter at ``offset`` of ``raw``, which differs in marks only."""

    def one(a, b, k):
        letters = len([c for c in a[:k] if not _VOWEL.match(c)])
        seen = 0
        for i, c in enumerate(b):
            if not _VOWEL.match(c):
                if seen == letters:
                    return i
                seen += 1
        return len(b)

    return pd.Series([one(a, b, k) for a, b, k in zip(raw, marked, offset)])
