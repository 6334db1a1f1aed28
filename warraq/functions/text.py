"""Functions over plain text columns; helpers in Arrow batches where a row needs a scan of its own."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from warraq.functions.vectorized import vectorized

# Crawler remains in page texts, and named entities.
JUNK_CALL = r"AddHistory\([^)]*\)[^;]*;?"
PAGE_REFERENCE = r"\[\d+/\d+\]"


def strip_junk(text: Column, references: bool = False) -> Column:
    return F.trim(F.regexp_replace(text, f"{JUNK_CALL}|{PAGE_REFERENCE}" if references else JUNK_CALL, " " if references else ""))


def has_junk(text: Column) -> Column:
    return text.contains("AddHistory(")


def clean_display(text: Column) -> Column:
    """Without crawler remains, a leading letter marker of the page, and section signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_junk(text, True), r"^\s*[ء-ي]{1,2}\s*[-–]\s+", ""), "§", ""))


def fix_newlines(text: Column) -> Column:
    """Same length, so that offsets stay."""
    return F.translate(text, "\r", "\n")


@vectorized("string")
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def strip_html(text: Column, scripts: bool = False) -> Column:
    """Tags as spaces, entities as characters, single spaces; with ``scripts`` their bodies go too."""
    if scripts:
        text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, r"(?s)<[^>]+>", " ")), r"(?U)\s+", " "))


def part_and_page(text: Column) -> tuple[Column, Column]:
    """'part/page' split at the first slash; without one it is the page."""
    slash = text.contains("/")
    return F.when(slash, F.substring_index(text, "/", 1)), F.when(slash, F.regexp_replace(text, r"^[^/]*/", "")).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def hash_split(key: Column) -> Column:
    """'train', 'dev' or 'test' by md5 modulo 100 (the modulus of 128 bits, from its two halves)."""
    digest = F.md5(key)
    half = lambda start: F.pmod(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)"), F.lit(100))
    place = F.pmod(half(1) * 16 + half(17), F.lit(100))  # 2**64 mod 100 = 16
    return F.when(place < 90, "train").when(place < 95, "dev").otherwise("test")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an array of one, whose element the body gets."""
    return F.get(F.transform(F.array(value), body), 0)


def chunk_text(text: Column, size: int = 1500, overlap: int = 200, slack: int = 300) -> Column:
    """Stripped chunks of at most ``size`` characters for embedding, none of them empty.

    A chunk ends at the last space of its final ``slack`` characters if there is one, and the next begins
    ``overlap`` characters before that end.  A fold over as many steps as a text can have chunks."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def chunks(x):
        whole, n = x["whole"], x["n"]
        many = F.ceil(n / max(1, size - slack - overlap)).cast("int")

        def step(state, _):
            start = state["next"]
            full = F.least(start + size, n)

            def cut(back):
                """The chunk that ends ``back`` characters before the end of a full one, and where the next begins."""
                end = F.when((full < n) & (back > 0) & (full - back > start), full - back).otherwise(full)
                piece = F.struct(start.alias("at"), (end - start).alias("n"))
                following = F.when(end >= n, n).otherwise(F.greatest(end - overlap, start + 1))
                return F.struct(following.alias("next"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))

            last_space = F.instr(F.reverse(F.substring(whole, full - slack + 1, F.lit(slack))), " ")
            return F.when(start >= n, state).otherwise(bound(last_space, cut))

        none = F.array().cast("array<struct<at: int, n: int>>")
        pieces = F.aggregate(F.sequence(F.lit(1), many), F.struct(F.lit(0).alias("next"), none.alias("pieces")), step, lambda s: s["pieces"])
        cuts = F.filter(F.transform(pieces, lambda p: strip(F.substring(whole, p["at"] + 1, p["n"]))), lambda c: c != "")
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(whole)).otherwise(cuts)

    measured = lambda w: F.struct(w.alias("whole"), F.length(w).alias("n"))
    return F.when(text.isNotNull(), bound(bound(strip(text), measured), chunks))


def word_windows(text: Column, size: int = 380) -> Column:
    """Words packed greedily into windows of at most ``size`` characters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def put(state, word):
        longer = F.concat_ws(" ", state["open"], word)
        fits = (state["open"] == "") | (F.length(longer) <= size)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            F.when(fits & (state["open"] == ""), word).when(fits, longer).otherwise(word).alias("open"),
        )

    return F.aggregate(words, start, put, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


@vectorized("array<struct<idx:int,start:int,end:int,token:string>>")
def ws_tokenize(texts: pd.Series) -> pd.Series:
    """White-space tokens with offsets."""
    return texts.map(lambda x: [{"idx": i, "start": m.start(), "end": m.end(), "token": m[0]} for i, m in enumerate(re.finditer(r"\S+", x))] if isinstance(x, str) else [])


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def canonical_tokens(name: Column) -> Column:
    """Tokens with the cases of 'father of' and the forms of 'son' made one."""
    tokens = F.transform(words(name), lambda w: F.when(w == "ابن", "بن").otherwise(w))
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.when(F.get(tokens, F.lit(0)).isin("ابا", "ابي"), F.concat(F.array(F.lit("ابو")), rest)).otherwise(tokens)


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens by the smaller of two token sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def ordered_token_hit(a: Column, b: Column, n: int = 25, least: int = 3) -> Column:
    """Share of the first n tokens of ``a`` (those of ``least`` letters or more) that are in ``b``; repeats count."""
    first = F.slice(F.filter(a, lambda w: F.length(w) >= least), 1, n)
    return F.when(F.size(first) > 0, F.size(F.filter(first, lambda w: F.array_contains(b, w))) / F.size(first)).otherwise(F.lit(0.0))


def preview(text: Column, n: int = 220) -> Column:
    return F.left(text, F.lit(n))


def snippet_highlight(tokens: Column, terms: list[str], most: int = 40, fragments: int = 2) -> Column:
    """Up to ``fragments`` parts of at most ``most`` words, with hits marked, joined by " … ".

    The text is cut into windows of ``most`` words; those with the most hits are shown, the earlier
    ones on ties, in the order of the text."""
    count = F.greatest(F.ceil(F.size(tokens) / most), F.lit(1)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * most + 1, F.lit(most)))
    ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct((-F.size(F.filter(w, lambda x: x.isin(terms)))).alias("hits"), i.alias("place"), w.alias("w"))))
    best = F.slice(F.filter(ranked, lambda r: r["hits"] < 0), 1, fragments)
    shown = F.array_sort(F.transform(best, lambda r: F.struct(r["place"].alias("place"), r["w"].alias("w"))))
    mark = lambda w: F.when(w.isin(terms), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)
    return F.array_join(F.transform(shown, lambda r: F.array_join(F.transform(r["w"], mark), " ")), " … ")


def embedding_cost(chars: Column, usd_per_million: float = 0.15) -> Column:
    return F.round(chars / 2.5 / 1_000_000 * usd_per_million, 6)
