"""What a text says about a fact: numbers with units, dates, negations. Plain Python over one text, called batch-wise."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, lru_cache

from palimpsest.functions.text import python_tokens

# Magnitudes, currencies, units with their class and size in the smallest unit of it, negations, antonyms.
MAGNITUDES = {"b": 10**9, "bn": 10**9, "billion": 10**9, "млрд": 10**9, "m": 10**6, "mn": 10**6, "million": 10**6, "млн": 10**6, "k": 1000, "thousand": 1000, "тыс": 1000, "%": 1, "percent": 1, "percentage": 1, "процент": 1}
CURRENCIES = ("KZT", "USD", "EUR", "RUB", "GBP", "JPY", "CNY", "KGS", "UZS", "TJS", "TMT", "BYN", "AMD", "GEL", "AZN", "TRY")
UNITS = {
    "m": "m", "meter": "m", "meters": "m", "km": "km", "kilometer": "km", "kilometers": "km", "cm": "cm", "centimeter": "cm", "centimeters": "cm", "mm": "mm", "millimeter": "mm", "millimeters": "mm",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg", "g": "g", "gram": "g", "grams": "g", "t": "t", "ton": "t", "tons": "t", "tonne": "t", "tonnes": "t",
    "l": "l", "liter": "l", "liters": "l", "litre": "l", "litres": "l", "ml": "ml", "milliliter": "ml", "milliliters": "ml", "millilitre": "ml", "millilitres": "ml",
    "h": "h", "hour": "h", "hours": "h", "hr": "h", "hrs": "h", "min": "min", "minute": "min", "minutes": "min", "s": "s", "second": "s", "seconds": "s", "sec": "s", "ms": "ms", "millisecond": "ms", "milliseconds": "ms",
    "day": "day", "days": "days", "week": "week", "weeks": "weeks", "month": "month", "months": "months", "year": "year", "years": "years", "%": "%", "percent": "%", "percentage": "%",
}
SIZES = {
    "mm": ("length", 1), "cm": ("length", 10), "m": ("length", 1000), "km": ("length", 1_000_000), "g": ("mass", 1), "kg": ("mass", 1000), "t": ("mass", 1_000_000), "ml": ("volume", 1), "l": ("volume", 1000),
    "ms": ("time", 1), "s": ("time", 1000), "min": ("time", 60_000), "h": ("time", 3_600_000), "day": ("time", 86_400_000), "days": ("time", 86_400_000), "week": ("time", 604_800_000), "weeks": ("time", 604_800_000),
    "month": ("time", 2_592_000_000), "months": ("time", 2_592_000_000), "year": ("time", 31_536_000_000), "years": ("time", 31_536_000_000), "%": ("ratio", 1),
}
NEGATIONS_BEFORE = ("not", "no", "never", "without", "denies", "denied", "не", "нет", "жоқ", "емес")
NEGATIONS_AFTER = ("false", "incorrect", "wrong", "ложно", "неверно", "неправда")
_REFUSED = ("rejected", "rejects", "denied", "declined", "refused", "cancelled", "canceled", "revoked", "отклонено", "отклонен", "отклонена")
ANTONYMS = {
    "approved": _REFUSED, "approve": _REFUSED, "accepted": _REFUSED, "ready": ("blocked", "failed", "unready", "notready"), "valid": ("invalid", "false", "incorrect"), "true": ("invalid", "false", "incorrect"),
    "increased": ("decreased", "reduced", "lowered"), "increase": ("decreased", "reduced", "lowered"), "decreased": ("increased", "raised", "grew"), "reduced": ("increased", "raised", "grew"),
    "open": ("closed", "shut"), "active": ("inactive", "disabled"),
}
EXACT, NUMERIC, ALL_TERMS, CONTRADICTED = 65535, 62000, 60000, 65535

_DIGIT, _EDGES, _BARE = re.compile(r"\d"), re.compile(r"^[^\w.$%]+|[^\w.,$%]+$"), re.compile(r"^[^\w%]+|[^\w%]+$|\d")
_NUMBER = re.compile(r"^(\$?)(\d+)(?:\.(\d+))?([A-Za-zА-Яа-я%]*)[.,]*$")


@dataclass(frozen=True)
class Value:
    """A number as it counts: whole after its magnitude, fractions of a plain number dropped."""

    scaled: int
    currency: str | None = None
    unit: str | None = None


def numeric_values(text: str | None) -> list[Value]:
    """The numbers of a text, in order."""
    return [value for _, value in placed_values(text)]


def placed_values(text: str | None) -> list[tuple[int, Value]]:
    """The numbers of a text with the place of their word. The word before may name a currency or unit; the two words behind, and letters that are
    stuck on, a unit, a magnitude and a currency, each taken once, in this order of preference."""
    if not text or not _DIGIT.search(text):
        return []
    words = text.split()
    out = []
    for i, raw in enumerate(words):
        hit = None if raw.isalpha() else _NUMBER.match(raw if raw.isalnum() else _EDGES.sub("", raw).replace(",", ""))
        if not hit:
            continue
        dollar, whole, fraction, stuck = hit.groups()
        slots: dict[str, object] = {"currency": "USD"} if dollar else {}
        bare = [w if w.isalpha() else "" if w.isdecimal() else _BARE.sub("", w) for w in words[max(i - 1, 0) : i + 3]]
        if i:
            _offer(slots, bare[0], ("currency", "unit"), every=True)
        for word in bare[1 if i else 0 :][1:]:
            _offer(slots, word, ("unit", "magnitude", "currency"))
        _offer(slots, stuck, ("magnitude", "unit", "currency"), every=True)
        factor = slots.get("magnitude")
        number = Fraction(f"{whole}.{fraction or 0}") * factor if factor else int(whole)
        out.append((i, Value(int(number), slots.get("currency"), slots.get("unit"))))
    return out


_KINDS = {"unit": lambda w: UNITS.get(w.lower()), "magnitude": lambda w: MAGNITUDES.get(w.lower()), "currency": lambda w: w.upper() if w.upper() in CURRENCIES else None}


@lru_cache(maxsize=4096)
def _meanings(word: str) -> dict:
    return {kind: found for kind, of in _KINDS.items() if word and (found := of(word)) is not None}


def _offer(slots: dict, word: str, kinds: tuple[str, ...], *, every: bool = False) -> None:
    """Puts a word in the first free slot it fits in, or in every one."""
    meanings = _meanings(word)
    if not meanings:
        return
    for kind in kinds:
        if kind in meanings and kind not in slots:
            slots[kind] = meanings[kind]
            if not every:
                return


def compare(a: Value, b: Value) -> str:
    """``equal``, ``value_conflict``, ``currency_mismatch`` (a conflict too) or ``incomparable``."""
    if a.currency or b.currency:
        if not (a.currency and b.currency):
            return "incomparable"
        if a.currency != b.currency:
            return "currency_mismatch"
        x, y = a.scaled, b.scaled
    elif a.unit or b.unit:
        if not (a.unit and b.unit) or SIZES[a.unit][0] != SIZES[b.unit][0]:
            return "incomparable"
        x, y = a.scaled * SIZES[a.unit][1], b.scaled * SIZES[b.unit][1]
    else:
        x, y = a.scaled, b.scaled
    return "equal" if x == y else "value_conflict"


def display(value: Value) -> str:
    """1.2B, 3M, 5K with the currency or unit, if nothing gets lost; else the plain number."""
    n, tail = value.scaled, value.currency or value.unit or ""
    for size, letter, step in ((10**9, "B", 10**8), (10**6, "M", 10**5), (1000, "K", 1000)):
        if n >= size and n % step == 0:
            shown = f"{n / size:.1f}".removesuffix(".0") + letter
            break
    else:
        shown = str(n)
    return f"{shown} {tail}".strip()


@lru_cache(maxsize=4096)
def date_bounds(text: str) -> tuple[str, str] | None:
    """First and last day of ``2021``, ``2021-03`` or ``2021/03/05``, from 1900 to 2199."""
    hit = re.fullmatch(r"(\d{4})(?:([-/])(\d{2})(?:\2(\d{2}))?)?", text.strip(".,;:()[]\"'?!"))
    if not hit or not 1900 <= int(hit[1]) <= 2199:
        return None
    year, month, day = int(hit[1]), hit[3] and int(hit[3]), hit[4] and int(hit[4])
    if month is None:
        return f"{year}-01-01", f"{year}-12-31"
    if not 1 <= month <= 12 or day is not None and not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    return f"{year}-{month:02}-{day or 1:02}", f"{year}-{month:02}-{day or calendar.monthrange(year, month)[1]:02}"


@lru_cache(maxsize=64)
def query_range(text: str | None) -> tuple[str, str] | None:
    """The time a text speaks of: its first full date, else its first year."""
    if not text or not _DIGIT.search(text):
        return None
    found = [b for b in (date_bounds(w) for w in text.split() if _DIGIT.search(w)) if b]
    exact = [b for b in found if b[0] == b[1]]
    years = [b for b in found if b[0].endswith("-01-01") and b[1].endswith("-12-31")]
    return next(iter(exact or years), None)


def stale_reason(asked: tuple[str, str], valid_from: str | None, valid_to: str | None) -> str | None:
    first, last = (date_bounds(x) if x else None for x in (valid_from, valid_to))
    if last and asked[0] > last[1]:
        return "expired"
    return "not_yet_valid" if first and asked[1] < first[0] else None


def _words_only(terms: list[str]) -> set[str]:
    # units and currencies speak through the numbers
    return {t for t in terms if not any(c.isdigit() for c in t) and t not in UNITS and t not in MAGNITUDES and t.upper() not in CURRENCIES}


def _body(text: str) -> tuple[str, list[str]]:
    """The text without its marker lines, and the facts that these contradict."""
    if "contradicts=" not in text:
        return text, []
    lines = text.split("\n")
    marked = [x.strip()[len("contradicts=") :].strip() for x in lines if x.strip().startswith("contradicts=")]
    return "\n".join(x for x in lines if not x.strip().startswith("contradicts=")), [x for x in marked if x]


class _Read:
    """What all comparisons look at, read from a text once."""

    def __init__(self, text: str, marked: list[str] = ()):
        self.text, self.marked, self.terms = text, marked, python_tokens(text)
        self.own = frozenset(self.terms)

    @cached_property
    def plain(self) -> str:
        return " ".join(self.text.lower().split())

    @cached_property
    def values(self) -> list[Value]:
        return numeric_values(self.text)

    @cached_property
    def words(self) -> set[str]:
        return _words_only(self.terms)

    @cached_property
    def opposites(self) -> set[str]:
        return {x for t in self.own for x in ANTONYMS.get(t, ())}


# the same few facts and texts come one after another
@lru_cache(maxsize=64)
def _fact(fact: str) -> _Read:
    return _Read(fact)


@lru_cache(maxsize=4)
def _evidence(text: str) -> _Read:
    return _Read(*_body(text))


def support(fact: str, text: str | None) -> tuple[str, int] | None:
    """(kind, score): the fact word for word, its numbers and other words, or all of its words."""
    asked, told = _fact(fact), _evidence(text or "")
    if not asked.terms:
        return None
    if asked.plain in told.plain:
        return "exact_text", EXACT
    if asked.values and asked.words and asked.words <= told.own and all(any(compare(x, y) == "equal" for y in told.values) for x in asked.values):
        return "numeric_entailment", NUMERIC
    return ("all_terms", ALL_TERMS) if asked.own <= told.own else None


def numeric_mismatch(fact: str, text: str | None) -> tuple[Value, Value] | None:
    """The fact's first value that the text, which speaks of the same things, states otherwise, and what it states."""
    asked, told = _fact(fact), _evidence(text or "")
    if not asked.words or not asked.words <= told.own:
        return None
    for x in asked.values:
        verdicts = [compare(x, y) for y in told.values]
        if "equal" not in verdicts:
            for y, verdict in zip(told.values, verdicts, strict=True):
                if verdict in ("value_conflict", "currency_mismatch"):
                    return x, y
    return None


_NEGATIONS = frozenset(NEGATIONS_BEFORE + NEGATIONS_AFTER)


def contradicts(fact: str, text: str | None) -> bool:
    """Whether the text denies the fact: by a marker line, or within one clause by a negation near one of the fact's
    words (up to three before, or four behind; "not only" denies nothing) or by an antonym of one of them."""
    asked, told = _fact(fact), _evidence(text or "")
    terms = asked.own
    if not terms:
        return False
    if any(terms <= set(python_tokens(m)) for m in told.marked):
        return True
    # a clause has no words that the text has not
    if (told.own.isdisjoint(_NEGATIONS) or not terms <= told.own) and told.own.isdisjoint(asked.opposites):
        return False
    return any(_denied(python_tokens(clause), terms) for clause in re.split(r"[.!?;\n]", told.text))


def _denied(words: list[str], terms: frozenset[str]) -> bool:
    have = set(words)
    if terms <= have:
        places = [i for i, w in enumerate(words) if w in terms]
        for i, w in enumerate(words):
            if w in NEGATIONS_BEFORE and words[i : i + 2] != ["not", "only"] and any(0 < p - i <= 3 for p in places):
                return True
            if w in NEGATIONS_AFTER and any(0 < i - p <= 4 for p in places):
                return True
    return any(not have.isdisjoint(ANTONYMS.get(t, ())) and terms - {t} <= have for t in terms)
