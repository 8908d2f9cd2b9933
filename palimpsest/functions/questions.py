"""What a question asks for: anchors, term weights, quoted terms, expansion by the corpus's synonyms. One text, on the driver."""

from __future__ import annotations

import re

from palimpsest.functions.text import python_tokens

#: Kinds of anchors that a word may be, the first that fits counts.
ANCHORS = (
    ("ticket_id", re.compile(r"[A-Z0-9]{2,16}-[0-9]*")),
    ("pull_request", re.compile(r"#[0-9]+")),
    ("date", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    ("version", re.compile(r"[vV](?=[0-9._-]*\.)(?=[0-9._-]*[0-9])[0-9._-]+")),
    ("file_path", re.compile(r"(?=.*[^\W\d_])(?:.*[/\\].*|.*\.[^\W_]{1,8})")),
    ("number", re.compile(r"(?=.*[0-9])[0-9.,%$€₸]+")),
)
#: Weight of a plain term, and what an anchor adds to its terms.
BASE = 4
ANCHOR_WEIGHTS = {"ticket_id": 12, "pull_request": 12, "file_path": 12, "quoted_phrase": 8, "version": 6, "date": 6, "number": 6}
MOST_SYNONYMS, MOST_PER_TERM = 12, 2


def anchors(question: str) -> list[tuple[str, str]]:
    """(kind, text) of quoted phrases and of words that name something, each once."""
    found = [("quoted_phrase", m[2].strip()) for m in re.finditer(r"([\"`])(.*?)\1", question, re.S)]
    for raw in question.split():
        word = raw.strip(",;:()[]{}\"'?!")
        kind = next((k for k, pattern in ANCHORS if pattern.fullmatch(word)), None) if word else None
        if kind:
            found.append((kind, word))
    return [a for a in dict.fromkeys(found) if python_tokens(a[1])]


def weights(question: str) -> dict[str, int]:
    """Weight of each term of a question: its plain weight for each time it stands there, and that of its anchors."""
    out: dict[str, int] = {}
    for term in python_tokens(question):
        out[term] = out.get(term, 0) + BASE
    for kind, text in anchors(question):
        for term in python_tokens(text):
            out[term] = out.get(term, 0) + ANCHOR_WEIGHTS[kind]
    return out


def quoted_terms(statement: str) -> list[str]:
    """The terms inside double quotes; a task without quotes has none."""
    return [t for part in statement.split('"')[1::2][: statement.count('"') // 2] for t in python_tokens(part)]


def expanded(question: str, synonyms: dict[str, list[str]], *, most: int = MOST_SYNONYMS, per_term: int = MOST_PER_TERM) -> list[str]:
    """Synonyms to add to a question, term by term in alphabetical order, ``per_term`` looked at for each, none twice."""
    own = sorted(set(python_tokens(question)))
    added: list[str] = []
    for term in own:
        added += [s for s in synonyms.get(term, [])[:per_term] if s not in own and s not in added]
    return added[:most]
