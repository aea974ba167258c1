"""Text to terms: accent folding and word / character n-grams, row-local and JVM side."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions.cells import let


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose compatibility form is one base character, and marks to drop.

    Made from the Unicode database by rule.  Characters that decompose into several
    base characters (ligatures, Hangul syllables) stay as they are.
    """
    changed, targets, dropped = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch:
            continue
        if not base:
            dropped.append(ch)
        elif len(base) == 1:
            changed.append(ch)
            targets.append(base)
    return "".join(changed + dropped), "".join(targets)


def fold(text: Column, strip_accents: bool = True) -> Column:
    """Lower-case, then drop accents; pure ASCII text skips the second step."""
    lowered = F.lower(text)
    if not strip_accents:
        return lowered
    source, target = _accent_table()
    return F.when(lowered.rlike(r"[^\x00-\x7F]"), F.translate(lowered, source, target)).otherwise(lowered)


def words(folded: Column) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_ngrams(folded: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` consecutive words.

    The words are bound once; an n-gram joins n shifted views of them.
    """
    def grams(bound: Column) -> Column:
        tokens = bound["tokens"]
        size = F.size(tokens)
        parts = []
        for n in range(low, high + 1):
            width = F.greatest(size - F.lit(n - 1), F.lit(0))
            run = F.slice(tokens, F.lit(1), width)
            for shift in range(1, n):
                following = F.slice(tokens, F.lit(shift + 1), width)
                run = F.zip_with(run, following, lambda a, b: F.concat(a, F.lit(" "), b))
            parts.append(run)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(F.struct(words(folded).alias("tokens")), grams)


# A zero-width match at every code point whose look-ahead captures the n-gram there.
_AT_CODE_POINT = r"(?![\uDC00-\uDFFF])"


def squeezed(folded: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(folded, r"(?U)\s\s+", " ")


def char_ngrams(folded: Column, low: int, high: int) -> Column:
    """Overlapping character n-grams; runs of white space count as one space."""
    text = squeezed(folded)
    grams = [
        F.regexp_extract_all(text, F.lit(rf"(?s){_AT_CODE_POINT}(?=(.{{{n}}}))"), F.lit(1))
        for n in range(low, high + 1)
    ]
    return F.concat(*grams)


def padded(folded: Column) -> Column:
    """Words laid out as ``" a  b "``, so that a gram lies in one word exactly when it has no two blanks in a row."""
    trimmed = F.regexp_replace(folded, r"(?U)^\s+|\s+$", "")
    return F.when(
        F.length(trimmed) > 0,
        F.concat(F.lit(" "), F.regexp_replace(trimmed, r"(?U)\s+", "  "), F.lit(" ")),
    ).otherwise(F.lit(""))


def char_wb_ngrams(folded: Column, low: int, high: int) -> Column:
    """Character n-grams that stay inside one blank-padded word."""
    text = padded(folded)
    grams = [
        F.regexp_extract_all(text, F.lit(rf"(?s){_AT_CODE_POINT}(?=((?:(?!  ).){{{n - 1}}}.))"), F.lit(1))
        for n in range(low, high + 1)
    ]
    return F.concat(*grams)


ANALYZERS = {"word": word_ngrams, "char": char_ngrams, "char_wb": char_wb_ngrams}


def terms(text: Column, analyzer: str, low: int, high: int, strip_accents: bool) -> Column:
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {analyzer}")
    return ANALYZERS[analyzer](fold(text, strip_accents), low, high)


# What the n-grams of an analyzer are consecutive parts of: an array of words, or the characters of a string.
UNITS = {"word": words, "char": squeezed, "char_wb": padded}


def units(text: Column, analyzer: str, strip_accents: bool) -> Column:
    """The text's words or characters in order, of which ``terms`` makes n-grams."""
    if analyzer not in UNITS:
        raise ValueError(f"unknown analyzer: {analyzer}")
    return UNITS[analyzer](fold(text, strip_accents))
