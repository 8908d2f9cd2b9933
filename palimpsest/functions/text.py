"""Tokens, stems, anchors and token estimates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dropped from every tokenised text (English, Russian, Kazakh).
STOPWORDS = ("a", "an", "and", "the", "or", "of", "to", "in", "и", "в", "на", "для", "мен", "және", "с", "со", "за", "от", "до", "по", "о", "об", "у", "да", "де", "та", "те", "үшін")
SPLIT = r"[^\p{L}\p{N}]+"
_STOPPED, _RUN = frozenset(STOPWORDS), re.compile(r"[^\W_]+")

#: Characters to a token: ASCII letters and digits, other letters, punctuation, line breaks.
TOKEN_PROFILES = {"default": (4, 2, 4, 2), "gpt-4o": (4, 2, 4, 2), "deepseek": (4, 2, 3, 2), "gemma": (4, 2, 3, 2), "bge-m3": (3, 1, 3, 2)}


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs without stopwords, in order, repeats kept."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def python_tokens(text: str | None) -> list[str]:
    """The same for driver-side query analysis."""
    return [t for t in map(str.lower, _RUN.findall(text or "")) if t not in _STOPPED]


def stem(term: Column, language: str = "english") -> Column:
    """Light suffix stripping: the first suffix that leaves at least four characters."""
    suffixes = {
        "english": ["ing", "ed", "es", "s"],
        "russian": "ами ями ого ему ому ам ям ах ях ом ем ов ев ый ая ое ые а ы и у е".split(),
        "kazakh": "лары лері дың дің тың тің лар лер дар дер тар тер".split(),
    }.get(language, [])
    size = F.octet_length(term) if language == "english" else F.length(term)
    out = F.when(F.lit(False), term)
    for s in suffixes:
        out = out.when((size > len(s) + 3) & F.endswith(term, F.lit(s)), F.left(term, F.length(term) - len(s)))
    return out.otherwise(term)


def estimate_tokens(text: Column, profile: str = "default") -> Column:
    """Runs of one character class, each rounded up to whole tokens; 0 for nothing, else at least 1.

    Line breaks count as one run until the next other character.
    """
    ascii_, other, punctuation, newline = TOKEN_PROFILES[profile]
    text = F.coalesce(text, F.lit(""))

    def cost(pattern: str, per: int) -> Column:
        return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), 0), F.lit(0).cast("long"), lambda a, r: a + F.ceil(F.length(r) / per))

    total = cost("[A-Za-z0-9]+", ascii_) + cost(r"[!-/:-@\[-`{-~]+", punctuation) + cost(r"[^\x00-\x20!-~\x7f\s\p{Z}]+", other) + cost(r"[\r\n]+", newline)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(total, F.lit(1))).cast("long")


def enrichment(text: Column, key: str) -> Column:
    """Value of the first ``key: value`` or ``key=value`` line among the first 80 lines."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 80)
    pattern = rf"(?i)^\s*{key}\s*[:=]\s*(.+?)\s*$"
    hits = F.filter(head, lambda x: F.rlike(x, F.lit(pattern)))
    return F.regexp_extract(F.try_element_at(hits, F.lit(1)), pattern, 1)


def fnv1a64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in data:
        value = ((value ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


def scope_id(name: str) -> int:
    """60-bit id of a scope name."""
    return fnv1a64(name.encode()) & ((1 << 60) - 1)
