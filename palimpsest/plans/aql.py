"""The query language: lexer, parser, statements, permission views and their checks."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal

MODES = ("fast", "balanced", "hybrid", "semantic", "audit")
MEMORY_TYPES = ("decision", "preference", "workflow_result", "error_log", "observation")
FIELDS = {"space": "scope", "scope": "scope", "status": "status", "type": "cell_type", "cell_type": "cell_type", "memory_type": "memory_type"}
MAX_DEPTH = 32
U32 = (1 << 32) - 1


class AqlError(ValueError):
    def __init__(self, code: str, message: str, at: int | None = None) -> None:
        super().__init__(f"{code}: {message}" + (f" at {at}" if at is not None else ""))
        self.code, self.at = code, at


@dataclass(frozen=True)
class Literal:
    kind: str  # string, identifier, integer, decimal, boolean, list
    value: object


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    literal: Literal


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    left: object
    right: object


@dataclass(frozen=True)
class Retrieve:
    task: str
    brain: str
    mode: str | None = None
    diversity: int | None = None
    rerank: int | None = None
    budget: int | None = None
    limit: int | None = None
    where: object | None = None
    citations: bool = False
    confidence: Decimal | None = None
    source_trust: Decimal | None = None
    freshness: int | None = None
    valid_at: str | None = None
    suppress_superseded: bool = False
    recency_window: int | None = None


@dataclass(frozen=True)
class VerifyFact:
    fact: str
    brain: str


@dataclass(frozen=True)
class Remember:
    text: str
    scope: str
    memory_type: str
    ttl: int | None = None


@dataclass(frozen=True)
class Explain:
    analyze: bool
    statement: object


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_:-]*")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")
_INTEGER = re.compile(r"[0-9]+")
_OPS = ("!=", ">=", "<=", "=", ">", "<")


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def fail(self, message: str):
        raise AqlError("parse_error", message, self.at)

    def keyword(self, *words: str) -> bool:
        """Consumes the words if they come next; case doesn't matter and no word boundary is asked for."""
        start = self.at
        for w in words:
            self.skip()
            if self.text[self.at : self.at + len(w)].upper() != w:
                self.at = start
                return False
            self.at += len(w)
        return True

    def expect(self, *words: str) -> None:
        if not self.keyword(*words):
            self.fail(f"expected {' '.join(words)}")

    def take(self, pattern: re.Pattern, what: str) -> str:
        self.skip()
        m = pattern.match(self.text, self.at)
        if not m:
            self.fail(f"expected {what}")
        self.at = m.end()
        return m[0]

    def string(self) -> str:
        raw = self.take(_STRING, "a string")[1:-1]
        out, i = [], 0
        while i < len(raw):
            if raw[i] == "\\":
                c = raw[i + 1]
                if c not in 'ntr"\\':
                    self.fail("unknown escape")
                out.append({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))
                i += 2
            else:
                out.append(raw[i])
                i += 1
        return "".join(out)

    def ident(self) -> str:
        return self.take(_IDENT, "a name")

    def integer(self, most: int = (1 << 64) - 1) -> int:
        value = int(self.take(_INTEGER, "an integer"))
        if value > most:
            self.fail("integer is too large")
        return value

    def decimal(self) -> Decimal:
        return Decimal(self.take(_DECIMAL, "a decimal"))

    def literal(self) -> Literal:
        self.skip()
        if self.text[self.at : self.at + 1] == "[":
            self.at += 1
            items = [self.scalar()]
            while self.symbol(","):
                items.append(self.scalar())
            if not self.symbol("]"):
                self.fail("expected ]")
            return Literal("list", tuple(items))
        return self.scalar()

    def scalar(self) -> Literal:
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c == '"':
            return Literal("string", self.string())
        if c.isdigit():
            if _DECIMAL.match(self.text, self.at):
                return Literal("decimal", self.decimal())
            return Literal("integer", self.integer())
        name = self.ident()
        if name.lower() in ("true", "false"):
            return Literal("boolean", name.lower() == "true")
        return Literal("identifier", name)

    def symbol(self, s: str) -> bool:
        self.skip()
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def condition(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise AqlError("too_deep", f"conditions nest more than {MAX_DEPTH} deep", self.at)
        left = self.conjunction(depth)
        while self.keyword("OR"):
            left = Both("or", left, self.conjunction(depth))
        return left

    def conjunction(self, depth: int):
        left = self.negation(depth)
        while self.keyword("AND"):
            left = Both("and", left, self.negation(depth))
        return left

    def negation(self, depth: int):
        if depth > MAX_DEPTH:
            raise AqlError("too_deep", f"conditions nest more than {MAX_DEPTH} deep", self.at)
        if self.keyword("NOT"):
            return Not(self.negation(depth + 1))
        if self.symbol("("):
            inner = self.condition(depth + 1)
            if not self.symbol(")"):
                self.fail("expected )")
            return inner
        name = self.ident()
        if self.keyword("IN"):
            return Comparison(name, "IN", self.literal())
        for op in _OPS:
            if self.symbol(op):
                return Comparison(name, op, self.literal())
        self.fail("expected a comparison")

    def requirement(self, found: dict) -> None:
        def once(key: str, value) -> None:
            if key in found:
                raise AqlError("duplicate_requirement", key, self.at)
            found[key] = value

        if self.keyword("CITATIONS"):
            if self.symbol("="):
                self.expect("TRUE")
            once("citations", True)
        elif self.keyword("CONFIDENCE"):
            self.symbol(">=") or self.fail("expected >=")
            once("confidence", self.decimal())
        elif self.keyword("SOURCE_TRUST"):
            self.symbol(">=") or self.fail("expected >=")
            once("source_trust", self.decimal())
        elif self.keyword("FRESHNESS"):
            self.symbol("<=") or self.fail("expected <=")
            once("freshness", self.integer())
            self.expect("SECONDS")
        elif self.keyword("VALID", "AT"):
            once("valid_at", self.string())
        else:
            self.fail("expected a requirement")

    def retrieve(self) -> Retrieve:
        self.expect("CONTEXT", "FOR", "TASK")
        task = self.string()
        self.expect("IN", "BRAIN")
        brain, found = self.ident(), {}

        def once(key: str, value) -> None:
            if key in found:
                raise AqlError("duplicate_clause", key, self.at)
            found[key] = value

        while not self.symbol(";"):
            if self.keyword("USING", "MODE"):
                once("mode", self.ident().lower())
            elif self.keyword("USING", "DIVERSITY"):
                once("diversity", self.integer())
            elif self.keyword("USING", "RERANK"):
                once("rerank", self.integer())
            elif self.keyword("BUDGET"):
                once("budget", self.integer())
                self.expect("TOKENS")
            elif self.keyword("LIMIT"):
                once("limit", self.integer(U32))
                self.expect("CANDIDATES")
            elif self.keyword("WHERE"):
                once("where", self.condition())
            elif self.keyword("REQUIRE"):
                self.requirement(found)
                while self.symbol(","):
                    self.requirement(found)
            elif self.keyword("SUPPRESS", "SUPERSEDED"):
                once("suppress_superseded", True)
            elif self.keyword("RECENCY", "WINDOW"):
                once("recency_window", self.integer())
            else:
                self.fail("expected a clause or ;")
        return Retrieve(task, brain, **found)

    def statement(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise AqlError("too_deep", "EXPLAIN nests too deep", self.at)
        if self.keyword("EXPLAIN"):
            return Explain(self.keyword("ANALYZE"), self.statement(depth + 1))
        if self.keyword("RETRIEVE"):
            return self.retrieve()
        if self.keyword("VERIFY", "FACT"):
            fact = self.string()
            self.expect("IN", "BRAIN")
            out = VerifyFact(fact, self.ident())
        elif self.keyword("REMEMBER"):
            text = self.string()
            self.expect("IN", "SCOPE")
            scope = self.ident()
            self.expect("AS", "TYPE")
            kind = self.ident()
            ttl = None
            if self.keyword("TTL"):
                ttl = self.integer()
                self.expect("SECONDS")
            out = Remember(text, scope, kind, ttl)
        else:
            self.fail("expected a statement")
        if not self.symbol(";"):
            self.fail("expected ;")
        return out


def parse(text: str):
    parser = _Parser(text)
    out = parser.statement()
    parser.skip()
    if parser.at != len(text):
        parser.fail("text after the statement")
    return out


@dataclass(frozen=True)
class AgentView:
    """What a principal may see and do."""

    readable_scopes: frozenset[str]
    writable_scopes: frozenset[str] = frozenset()
    brains: frozenset[str] = frozenset({"default"})
    modes: frozenset[str] = frozenset(MODES)
    memory_types: frozenset[str] = frozenset(MEMORY_TYPES)
    max_budget: int = 8000
    default_budget: int = 4000
    max_limit: int = 200
    default_limit: int = 50
    min_confidence_q16: int = 0
    max_ttl: int | None = None
    allow_verify: bool = True
    allow_remember: bool = True
    max_evidence: int = 8


@dataclass(frozen=True)
class Bound:
    """A retrieval whose names, limits and thresholds are settled."""

    task: str
    mode: str
    budget: int
    limit: int
    where: object | None
    confidence_q16: int
    trust_q16: int
    freshness: int | None
    valid_at: str | None
    citations: bool
    diversity_q16: int
    rerank_q16: int
    suppress_superseded: bool
    recency_window: int | None
    view: AgentView = field(repr=False)


def to_q16(value: Decimal | None) -> int:
    """A share as 0..65535, rounded half up."""
    if value is None:
        return 0
    if value > 1:
        raise AqlError("threshold_out_of_range", str(value))
    return int(value * 65535 + Decimal("0.5"))


def iso_date(value: str) -> str:
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", value)
    if m:
        y, mo, d = map(int, m.groups())
        if 1900 <= y <= 2199 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]:
            return value
    raise AqlError("invalid_date", value)


def _check_where(node, view: AgentView) -> None:
    if isinstance(node, Not):
        _check_where(node.child, view)
    elif isinstance(node, Both):
        _check_where(node.left, view)
        _check_where(node.right, view)
    elif isinstance(node, Comparison):
        column = FIELDS.get(node.field.lower())
        if column is None:
            raise AqlError("field_not_filterable", node.field)
        if node.op not in ("=", "IN"):
            raise AqlError("unsupported_comparator", node.op)
        items = node.literal.value if node.op == "IN" else (node.literal,)
        if node.op == "IN" and node.literal.kind != "list":
            raise AqlError("unsupported_literal", "IN needs a list")
        for item in items:
            if item.kind not in ("string", "identifier"):
                raise AqlError("unsupported_literal", item.kind)
            if column == "scope" and item.value not in view.readable_scopes:
                raise AqlError("policy_denied", f"scope {item.value}")
            if column == "memory_type" and item.value not in MEMORY_TYPES:
                raise AqlError("unsupported_literal", f"memory type {item.value}")


def bind(statement: Retrieve, view: AgentView) -> Bound:
    if statement.brain not in view.brains:
        raise AqlError("policy_denied", f"brain {statement.brain}")
    mode = statement.mode or "balanced"
    if mode not in MODES:
        raise AqlError("unknown_mode", mode)
    if mode not in view.modes:
        raise AqlError("policy_denied", f"mode {mode}")
    for name in ("diversity", "rerank"):
        if (getattr(statement, name) or 0) > 65535:
            raise AqlError("threshold_out_of_range", name)
    _check_where(statement.where, view)
    budget = min(statement.budget or view.default_budget, view.max_budget)
    limit = min(statement.limit if statement.limit is not None else view.default_limit, view.max_limit, max(1, budget // 160))
    return Bound(
        statement.task, mode, budget, limit, statement.where, max(to_q16(statement.confidence), view.min_confidence_q16), to_q16(statement.source_trust),
        statement.freshness, iso_date(statement.valid_at) if statement.valid_at else None, statement.citations, statement.diversity or 0, statement.rerank or 0,
        statement.suppress_superseded, statement.recency_window, view,
    )


def bind_verify(statement: VerifyFact, view: AgentView) -> tuple[str, int]:
    if not view.allow_verify:
        raise AqlError("policy_denied", "VERIFY FACT")
    if statement.brain not in view.brains:
        raise AqlError("policy_denied", f"brain {statement.brain}")
    return statement.fact, min(view.max_evidence, 8)


def bind_remember(statement: Remember, view: AgentView) -> Remember:
    if not view.allow_remember or statement.scope not in view.writable_scopes:
        raise AqlError("policy_denied", f"writing to {statement.scope}")
    if statement.memory_type not in MEMORY_TYPES or statement.memory_type not in view.memory_types:
        raise AqlError("policy_denied", f"memory type {statement.memory_type}")
    if view.max_ttl is not None and (statement.ttl is None or statement.ttl > view.max_ttl):
        return replace(statement, ttl=view.max_ttl) if statement.ttl is None else _deny_ttl()
    return statement


def _deny_ttl():
    raise AqlError("policy_denied", "TTL is too long")
