"""What a question requires of a text: requirements to cover, conditions on numbers and times, sources, expansions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import evidence
from palimpsest.functions.evidence import Value
from palimpsest.functions.questions import anchors, weights
from palimpsest.functions.text import python_tokens, tokens

#: Source system by term.
SOURCES = {
    "slack": ("slack", "channel", "thread"), "gmail": ("gmail", "email", "mail", "inbox"), "jira": ("jira", "ticket", "issue"), "github": ("github", "repo", "repository", "pull", "pr"),
    "confluence": ("confluence", "wiki", "page"), "drive": ("drive", "file", "spreadsheet", "sheet"), "hubspot": ("hubspot", "crm"), "fireflies": ("fireflies", "meeting", "transcript"), "linear": ("linear",),
}
#: Terms and what each of them adds to a search.
EXPANSIONS = (
    ("blocked blocker blockers stuck slipped slipping", "blocked blocker risk dependency delayed waiting issue"), ("delay delays delayed late", "blocked blocker risk dependency waiting"), ("dependency dependencies waiting", "blocked blocker risk"),
    ("owner owns owned", "assignee assigned responsible dri lead"), ("assignee assigned responsible dri lead", "owner owns"), ("deadline due", "eta date timeline target"), ("eta timeline target", "deadline due date"),
    ("policy", "guideline rule requirement procedure standard"), ("guideline rule requirement procedure standard", "policy"), ("revenue", "income sales arr mrr billing"), ("income sales billing", "revenue"),
    ("customer", "client account tenant"), ("client account tenant", "customer"), ("incident", "outage postmortem root cause sev"), ("outage postmortem sev", "incident"), ("migration", "upgrade rollout transition"), ("upgrade transition", "migration"),
    ("security", "auth permission rbac risk access"), ("auth permission permissions rbac access", "security"), ("launch", "release rollout ga"), ("release ga", "launch rollout"),
    ("overview summary", "mission charter about strategy"), ("mission charter strategy vision", "overview summary about"),
)
#: Phrases and what one of them adds.
PHRASE_EXPANSIONS = (
    (("high level", "big picture", "company overview", "what does"), "overview summary mission charter about"), (("single sign", "sign on"), "sso auth authentication security"),
    (("role based", "access control"), "rbac permission permissions security"), (("go live", "general availability"), "launch release rollout ga"),
)
EXPANSION_WEIGHT, PHRASE_WEIGHT = 1, 2

#: What a question may ask for, by words or phrases in it.
SLOTS = (
    ("date time schedule window timezone", ("when", "scheduled", "schedule", "time window", "timezone")),
    ("threshold limit default pass rate gate size budget", ("threshold", "limit", "pass rate", "gate", "cutoff", "size", "budget")),
    ("latency p95 p99 ms rtt sla slo target", ("latency", "p95", "p99", "ms", "rtt", "sla", "slo")),
    ("cost price credits billing invoice", ("cost", "price", "credits", "billing", "invoice", "cheapest")),
    ("root cause trigger reason", ("cause", "root cause", "caused", "trigger")),
    ("location region edge cluster route environment", ("location", "region", "edge", "cluster", "route", "environment")),
    ("role owner reviewer approver dri", ("role", "owner", "owns", "dri", "review", "approver", "approval")),
    ("status blocker mitigation rollback risk", ("status", "state", "blocker", "blocked", "mitigation", "rollback", "risk")),
    ("complete checklist of requested subparts", ("all", "every", "list", "complete", "procedure")),
)
#: Words that part a question, words that require nothing, words that ask.
PARTS = (" and what ", " and when ", " and where ", " and which ", " and how ", " and why ", " including ", " along with ", " plus ")
IDLE = frozenset("who what which where when why how give tell show find include including does did was were are for with from into about is be can on by if has have i s t e g any each those up so get this that their our".split())
ASKING = frozenset("who what which where when why how does did is are was were in for the and or".split())
NO_EVIDENCE = frozenset("who what which where when why how give tell show find list all any does did was were are for with from into about this that".split())
MOST_ANCHORS, MOST_PARTS, RUN = 12, 8, 5


def source_hints(question: str) -> list[str]:
    """Source systems that a question names, in alphabetical order."""
    terms = set(python_tokens(question))
    return sorted(s for s, words in SOURCES.items() if terms & set(words))


def search_weights(question: str) -> dict[str, int]:
    """Weights of a question's terms with what its words and phrases add."""
    out = weights(question)
    added = [(t, EXPANSION_WEIGHT) for term in python_tokens(question) for words, more in EXPANSIONS if term in words.split() for t in more.split()]
    low = question.lower()
    added += [(t, PHRASE_WEIGHT) for t in {t for phrases, more in PHRASE_EXPANSIONS if any(p in low for p in phrases) for t in more.split()}]
    for term, weight in added:
        out[term] = out.get(term, 0) + weight
    return out


@dataclass(frozen=True)
class Requirement:
    kind: str
    text: str
    tokens: tuple[str, ...]


def _needed(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(python_tokens(text)) - IDLE))


def _tidy(text: str) -> str:
    return " ".join(text.strip(",;:.?! ").split())


def _shouts(word: str) -> bool:
    letters = re.findall("[A-Za-z]", word)
    return len(letters) >= 2 and all(c.isupper() for c in letters)


def _capital(word: str) -> bool:
    return bool(re.match("[A-Z]", word)) or _shouts(word)


def _precise(word: str) -> bool:
    numeric = re.fullmatch(r"(?=.*[0-9])[A-Za-z0-9.%:_-]+", word)
    path = "/" in word or "." in word and len(word.rsplit(".", 1)[1].encode()) <= 8
    return bool(_capital(word) or numeric or path)


def _named(question: str) -> list[str]:
    """What a question names: anchors, runs of capitalised words, precise words; longest first."""
    words = [w.strip(",;:()[]{}\"'?!") for w in question.split()]
    found = {text for _, text in anchors(question)} | {w for w in words if _precise(w)}
    run: list[str] = []
    for word in [*words, ""]:
        fits = bool(word) and _capital(word) and word.lower() not in ASKING
        if fits:
            run.append(word)
        if (not fits or len(run) == RUN) and run:
            if len(run) > 1:
                found.add(" ".join(run))
            run = []
    kept = {_tidy(x) for x in found}
    kept = {x for x in kept if len(x.encode()) >= 2 and x.lower() not in ASKING and _needed(x)}
    return sorted(kept, key=lambda x: (-len(x.encode()), x))


def _distinct(texts: list[str], most: int) -> list[str]:
    first: dict[str, str] = {}
    for text in texts:
        first.setdefault(" ".join(python_tokens(text)), text)
    return [t for k, t in first.items() if k][:most]


def subquestions(question: str) -> list[str]:
    """Parts of a question between joining phrases, and between commas."""
    whole = " ".join(question.split())
    parts = reduce(lambda ps, sep: [q for p in ps for q in re.split(re.escape(sep), p, flags=re.I | re.A)], PARTS, [whole])
    return _distinct([t for t in map(_tidy, parts + re.split("[,;]", whole)) if len(_needed(t)) >= 2], MOST_PARTS)


def requirements(question: str) -> list[Requirement]:
    """What an answer must hold: names, kinds of values asked for, parts; the whole question if there is none of these."""
    question = " ".join(question.split())
    low, terms = question.lower(), set(python_tokens(question.lower()))
    slots = [slot for slot, signs in SLOTS if any(s in low if " " in s else s in terms for s in signs)]
    wanted = [("anchor", x) for x in _named(question)[:MOST_ANCHORS]] + [("slot", x) for x in slots] + [("subquestion", x) for x in subquestions(question)]
    out: dict[tuple, Requirement] = {}
    for kind, text in wanted:
        if _needed(_tidy(text)):
            out.setdefault((kind, tuple(python_tokens(text))), Requirement(kind, _tidy(text), _needed(_tidy(text))))
    return list(out.values()) or [Requirement("question", _tidy(question), _needed(_tidy(question)))]


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() or c in "_./:%-" else " " for c in text.lower()).split())


def covered(text: Column, required: list[Requirement]) -> Column:
    """Array of the numbers (from 1) of the requirements that a text covers: a name as it stands, or enough of the terms
    (one of up to two, else 45%, at least two)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_./:%\-]", " "), r"\s+", " "))
    own = tokens(text)

    def holds(r: Requirement) -> Column:
        least = 1 if len(r.tokens) <= 2 else max(-(-len(r.tokens) * 45 // 100), 2)
        enough = F.size(F.array_intersect(own, F.array(*map(F.lit, r.tokens)))) >= least
        return F.contains(plain, F.lit(_plain(r.text))) | enough if r.kind == "anchor" and _plain(r.text) else enough

    each = [F.when(holds(r), i) for i, r in enumerate(required, 1) if r.tokens]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<int>")


# conditions

#: Comparisons by phrases near a number, the first that fits counts; words that ask for a bound.
COMPARISONS = (
    ("at_least", ("at least", "no less than", "minimum", "min", "gte", "above")), ("greater_than", ("over", "greater", "exceeds", "exceeding", "more")),
    ("at_most", ("at most", "no more than", "maximum", "max", "lte", "below", "under", "cap")), ("less_than", ("less", "fewer")),
)
BOUNDS = (("at_least", ("minimum", "min", "required")), ("at_most", ("maximum", "max", "cap", "limit")), ("equal", ("threshold", "retained", "how long")))
UNMEASURED = frozenset("and are between did does for from give how into less list more must need over than the under was what when where which with".split())
NEAR, AROUND = 4, 5
MET, ON_METRIC, ON_SLOT, ON_DATE = 18_000, 4_000, 6_000, 8_000


@dataclass(frozen=True)
class Condition:
    operator: str
    values: tuple[Value, ...]
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Conditions:
    numbers: list[Condition] = field(default_factory=list)
    slots: list[Condition] = field(default_factory=list)
    dates: tuple[str, str] | None = None

    def __bool__(self) -> bool:
        return bool(self.numbers or self.slots or self.dates)


def _bare(word: str) -> str:
    return re.sub(r"^[^A-Za-z0-9.,%$€₸_-]+|[^A-Za-z0-9.,%$€₸_-]+$", "", word)


def _says(words: list[str], phrases: tuple[str, ...]) -> bool:
    line = f" {' '.join(words)} "
    return any(f" {p} " in line for p in phrases)


def _metric(words: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for w in words for t in python_tokens(_bare(w)) if t not in UNMEASURED))


def conditions(question: str) -> Conditions:
    """Numbers with the comparison and the words around them, bounds without a number, and the time a question names."""
    words = question.split()
    bare = [_bare(w).lower() for w in words]
    found = evidence.placed_values(question)
    span = len(found) > 1 and bool({"between", "from"} & set(bare))
    numbers: list[Condition] = []
    for n, (i, value) in enumerate(found):
        if any(value in c.values for c in numbers):
            continue
        window = bare[max(i - NEAR, 0) : i + NEAR + 1]
        operator = "between" if span else next((op for op, phrases in COMPARISONS if _says(window, phrases)), "equal")
        values = (value, *(v for _, v in found[n + 1 : n + 2])) if span else (value,)
        own = set(python_tokens(re.sub(r"[^\d.]", "", words[i])))
        numbers.append(Condition(operator, values, tuple(t for t in _metric(words[max(i - AROUND, 0) : i + AROUND + 1]) if t not in own)))
    measured = {t for c in numbers for t in c.terms}
    slots: dict[tuple, Condition] = {}
    for i, word in enumerate(bare):
        said = [word] if word != "long" else bare[max(i - 1, 0) : i + 1]
        operator = next((op for op, signs in BOUNDS if " ".join(said) in signs), None)
        terms = _metric(words[max(i - AROUND, 0) : i + AROUND + 1]) if operator else ()
        if terms and not measured & set(terms):
            slots.setdefault(terms, Condition(operator, (), terms))
    return Conditions(numbers, list(slots.values()), evidence.query_range(question))


def _meets(condition: Condition, stated: Value) -> bool:
    first, x = condition.values[0], stated.scaled
    if first.currency and first.currency != stated.currency or first.unit and first.unit != stated.unit:
        return False
    low, high = min(v.scaled for v in condition.values), max(v.scaled for v in condition.values)
    return {"equal": x == first.scaled, "at_least": x >= low, "greater_than": x > low, "at_most": x <= high, "less_than": x < high, "between": low <= x <= high}[condition.operator]


def condition_bonus(asked: Conditions, text: str | None) -> int:
    """What a text is worth for conditions: met ones, ones it only speaks of, bounds and dates it names."""
    if not asked:
        return 0
    text = text or ""
    terms, stated = set(python_tokens(text)), evidence.numeric_values(text)
    speaks = lambda c: any(t in terms for t in c.terms if len(t.encode()) >= 3)
    bonus = 0
    for c in asked.numbers:
        met = (not c.terms or speaks(c)) and any(_meets(c, v) for v in stated)
        bonus += MET if met else ON_METRIC if speaks(c) else 0
    bonus += ON_SLOT * sum(map(speaks, asked.slots))
    return bonus + (ON_DATE if asked.dates and any(d in text for d in asked.dates) else 0)
