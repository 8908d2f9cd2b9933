"""Which part of a corpus a question is about: directives on fields of cells, and what a cell that fits them is worth."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.questions import anchors
from palimpsest.functions.requirements import source_hints
from palimpsest.functions.text import python_tokens, tokens

#: Fields in their order, with the columns in which a directive on them is looked for.
FIELDS = {
    "source": ("source", "path", "title", "body_text"), "scope": ("scope", "topic", "path", "title", "body_text"), "project": ("project", "document_id", "title", "path", "body_text"),
    "team": ("entity", "owner", "project", "path", "title", "body_text"), "topic": ("topic", "section", "title", "path", "body_text"),
}
#: What departments and topics are called, where not by their own name.
DEPARTMENTS = {
    "engineering": "engineering", "platform": "platform", "infrastructure": "infrastructure", "infra": "infrastructure", "security": "security", "sales": "sales", "revenue": "revenue", "revops": "revops",
    "customer success": "customer_success", "support": "support", "finance": "finance", "billing": "billing", "legal": "legal", "marketing": "marketing", "go-to-market": "gtm", "gtm": "gtm", "product": "product",
    "design": "design", "operations": "operations", "ops": "operations", "data": "data", "analytics": "analytics",
}
TOPICS = {
    "onboarding": "onboarding", "launch": "launch", "rollout": "rollout", "migration": "migration", "incident": "incident", "postmortem": "postmortem", "pricing": "pricing", "sso": "sso", "single sign": "sso", "auth": "auth",
    "authentication": "auth", "rbac": "rbac", "permissions": "permissions", "retention": "retention", "renewal": "renewal", "roadmap": "roadmap", "policy": "policy",
}
IDLE = frozenset("a an and are can did do does for from give how is list me of on or show tell the this to was what when where which who why".split())
PROJECT_WORDS, TEAM_WORDS = frozenset("project initiative program rollout launch migration".split()), frozenset("team squad group department".split())
SURE = {"named_source": 61_000, "anchor_source": 58_000, "project": 50_000, "team": 48_000, "scope": 44_000, "topic": 42_000}
MOST_PROJECTS, MOST_TEAMS, SHARE = 8, 6, 6


@dataclass(frozen=True)
class Directive:
    field: str
    value: str
    confidence_q16: int
    hard: bool
    terms: tuple[str, ...]


def _name(word: str) -> bool:
    return bool(re.fullmatch(r"[A-Z](?=.*[a-z0-9]).*", word, re.S)) and len(word.encode()) >= 3


def _said(question: str, names: dict[str, str]) -> list[str]:
    low = question.lower()
    words = set(re.split("[^a-z0-9_]+", low))
    return [value for name, value in names.items() if (name in low if " " in name or "-" in name else name in words)]


def directives(question: str) -> list[Directive]:
    """The directives of a question, by field and value; only a source that it names is a hard one."""
    words = [w.strip(",;:()[]{}\"'?!") for w in question.split()]
    beside = lambda signs, steps: {words[i + d] for i, w in enumerate(words) if w.lower() in signs for d in steps if 0 <= i + d < len(words) and _name(words[i + d])}
    runs = re.findall(r"(?:\S+\n)+", "".join(w + "\n" if w and _name(w) else "\n" for w in words))
    phrases = {p for p in (" ".join(r.split()) for r in runs) if not set(p.lower().split()) <= IDLE}
    teams = beside(TEAM_WORDS, (-1, 1)) | {words[i - 1] for i, w in enumerate(words) if i and w.lower() in TEAM_WORDS and re.fullmatch("[A-Z]+", words[i - 1])}
    kinds = [kind for kind, _ in anchors(question)]
    found = [("source", s, SURE["named_source"], True) for s in source_hints(question)]
    found += [("source", "jira" if k == "ticket_id" else "github", SURE["anchor_source"], False) for k in kinds if k in ("ticket_id", "pull_request", "file_path")]
    found += [("scope", v, SURE["scope"], False) for v in _said(question, DEPARTMENTS)] + [("topic", v, SURE["topic"], False) for v in _said(question, TOPICS)]
    found += [("project", v, SURE["project"], False) for v in sorted(beside(PROJECT_WORDS, (-1, 1)) | phrases)[:MOST_PROJECTS]]
    found += [("team", v, SURE["team"], False) for v in sorted(teams)[:MOST_TEAMS]]
    out: dict[tuple, Directive] = {}
    for field, value, sure, hard in found:
        terms = tuple(sorted(set(python_tokens(value)) - IDLE))
        if terms:
            out.setdefault((field, " ".join(python_tokens(value))), Directive(field, value, sure, hard, terms))
    return sorted(out.values(), key=lambda d: (list(FIELDS).index(d.field), d.value))


def bonus(wanted: list[Directive], columns: list[str]) -> Column:
    """What a cell is worth by the directives that it fits: a sixth of the confidence of each."""

    def fits(d: Directive, own: Column) -> Column:
        needle, long = " ".join(python_tokens(d.value)), [t for t in d.terms if len(t.encode()) >= 3]
        hit = F.size(F.array_intersect(own, F.array(*map(F.lit, d.terms)))) >= min(len(d.terms), 2)
        if len(needle.encode()) >= 3:
            hit |= F.contains(F.array_join(own, " "), F.lit(needle))
        return hit | F.arrays_overlap(own, F.array(*map(F.lit, long))) if long else hit

    def worth(d: Directive) -> Column:
        # each column is cut into words once, inside a lambda
        held = [F.exists(F.array(tokens(F.col(c))), lambda own: fits(d, own)) for c in FIELDS[d.field] if c in columns]
        return F.when(reduce(lambda a, b: a | b, held), d.confidence_q16 // SHARE).otherwise(0) if held else F.lit(0)

    return reduce(lambda a, b: a + b, map(worth, wanted), F.lit(0)).cast("long")


def hard_filter(wanted: list[Directive]) -> Column:
    """Whether a cell is of a source that the question names; true where it names none."""
    named = [d.value for d in wanted if d.hard]
    return F.coalesce(F.lower("source").isin(named), F.lit(False)) if named else F.lit(True)

