"""What kind of question a text asks and how a search for it runs: phrase rules as column expressions, plain dicts beside."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed

#: Kinds of questions, of equal scores the first counts.
TYPES = ("info_not_found", "miscellaneous", "high_level", "completeness", "conflicting_info", "constrained", "project_related", "intra_document_reasoning", "semantic", "basic")

#: Fixed values: (type, score, phrases of which one must occur, and one of these too, where given); ``^`` is the start. The
#: phrases of general use; those that only the questions of one corpus have are for the caller's own rules.
RULES = (
    ("high_level", 8, ("mission statement", "competitive advantage", "business model", "revenue streams", "major departments", "policy dimensions"), ()),
    ("high_level", 5, ("high level", "big picture", "company overview"), ()),
    ("miscellaneous", 8, ("jokes", "memes", "refrigerator", "fridge", "office kitchen", "softball", "fantasy football", "sneakers", "cleats", "planter", "placeholder image", "deep cleaning", "interview"), ()),
    ("info_not_found", 8, ("complete mapping", "public blockchain", "smart contract address", "bios settings", "safe mode boot", "cab approval", "quorum", "tie-break", "microsoft teams", "adaptive cards", "cryptographic signing algorithm", "key rotation cadence", "exact canonicalization rules", "full json schema", "checkpoint mismatch", "firmware rollout"), ()),
    ("info_not_found", 3, ("what exact", "required payload schema", "currently configured in production"), ()),
    ("completeness", 7, ("procedure", "end-to-end process", "across all", "list all", "list each", "comprehensive"), ()),
    ("completeness", 4, ("list all", "list each", "complete", "comprehensive"), ()),
    ("completeness", 3, ("required validations", "required approvals", "required customer communications", "including emergency"), ()),
    ("conflicting_info", 7, ("latest baseline", "previous thresholds", "compared to", "was the degraded", "default ttl"), ()),
    ("conflicting_info", 3, ("conflict", "conflicting", "contradict", "discrepancy", "changed from", "changed between", "previous", "earlier", "latest"), ()),
    ("constrained", 6, ("incident where", "incident that", "root cause and what mitigation", "what caused the production", "server-side mitigation", "immediate mitigation", "target ship date", "follow-up ticket"), ()),
    ("project_related", 7, ("support explain", "support handle", "sales share", "approved stance", "evidence pack", "deal", "credit requests", "policy we should follow", "how do we verify", "how should support", "how should sales", "explain and remediate", "enterprise ticket", "support bridge", "customer update cadence", "approvals are required", "issuing a credit", "standardizing on", "when a tenant has"), ()),
    ("project_related", 6, ("launch", "rollout", "release"), ("owner", "owns", "dri", "blocker", "blocked", "deadline", "slipped", "status", "risk")),
    ("project_related", 2, ("customer-facing",), ()),
    ("intra_document_reasoning", 7, ("what two thresholds", "which meeting time", "what two follow-up", "final tracked wording", "what alert triggered", "what artifacts", "hybrid approach", "what support ticket number", "what request id", "what date should", " and where is the referenced "), ()),
    ("intra_document_reasoning", 2, ("^during ", "^when using "), ()),
    ("semantic", 6, ("what caused an enterprise tenant", "specific gate thresholds", "how should i structure", "staged rollout schedule", "temporary kill switch", "why would", "why does", "what happens when", "mandatory items"), ()),
    ("semantic", 2, ("recommended", "recommend", "recommendation", "requirements for", "what caused", "how should i", "tracking things like", "which approach"), ()),
    ("basic", 4, ("what are the default", "what is the name", "acceptance criteria", "in the meeting", "draft spec", "what support response time", "where was"), ()),
)
#: A date or a version as a word, or a month: a constraint of 3.
MONTHS = ("jan ", "january", "feb ", "february", "march", "april", "may 20", "june", "july", "august", "september", "october", "november", "december")
DATED = r"(^|[\s,;()])(\d{4}-\d{2}-\d{2}|v?[0-9._-]*(\d[0-9._-]*\.|\.[0-9._-]*\d)[0-9._-]*)($|[\s,;()])"

#: Fixed values, by intent: candidates per row asked for, most rows (0: no cap), share of the token budget, lambda of
#: diversity, diversified or not, may abstain, lexical and semantic weight.
ROUTES = {
    "lookup": (2, 5, 32768, 65535, False, False, 42000, 18000),
    "semantic": (5, 0, 65535, 49152, True, False, 18000, 42000),
    "project_related": (6, 0, 65535, 52428, True, False, 28000, 34000),
    "high_level": (8, 0, 65535, 45875, True, False, 24000, 36000),
    "conflicting_info": (6, 0, 65535, 32768, True, False, 34000, 26000),
    "completeness": (8, 0, 65535, 36864, True, False, 30000, 30000),
    "info_not_found": (3, 3, 24576, 65535, False, True, 36000, 20000),
    "constrained": (4, 6, 49152, 65535, False, False, 38000, 22000),
}
INTENTS = {t: t for t in ROUTES if t != "lookup"} | {"basic": "lookup", "miscellaneous": "lookup", "intra_document_reasoning": "semantic"}

#: Fixed values, by type: weights of lexical and vector score, what an anchor term, a source, the scope and a condition in
#: a text add, what is left without evidence, the lexical share of a fusion.
PROFILES = {
    "basic": (3, 2, 25000, 10000, 1, 1, 12000, 45000),
    "semantic": (1, 4, 18000, 10000, 1, 1, 20000, 20000),
    "project_related": (1, 4, 30000, 10000, 2, 1, 16384, 24000),
    "constrained": (4, 1, 28000, 10000, 1, 3, 10000, 45000),
    "conflicting_info": (3, 2, 25000, 14000, 1, 1, 16384, 38000),
    "completeness": (1, 4, 22000, 10000, 1, 1, 22000, 28000),
    "high_level": (1, 4, 25000, 18000, 1, 1, 24000, 20000),
    "info_not_found": (2, 2, 25000, 10000, 1, 1, 8000, 32768),
}
PROFILES |= {"intra_document_reasoning": PROFILES["semantic"], "miscellaneous": PROFILES["info_not_found"]}

#: A plain question of so many words is a semantic one if it begins or speaks so.
LONG, LONG_BEGINS = 16, ("why ", "how should ", "when a ", "when someone ", "after ")
LONG_SAYS = ("how do we", "how should we", "in our ", "for the ", "what change", "what configuration change", "what mechanism", "what fields", "where can i find")

#: Words that ask for the newest, and weights of trust and freshness by what is asked.
CURRENT = ("latest", "current", "newest", "recent", "updated", "as of", "previously", "before", "after", "changed", "change")
METADATA = {"conflicting_info": (18000, 24000), "constrained_dated": (12000, 22000), "dated": (8000, 18000), "info_not_found": (4000, 2000), "": (3000, 3000)}

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any(phrases: Iterable[str]) -> str:
    return "|".join("^" + re.escape(p[1:]) if p[0] == "^" else re.escape(p) for p in phrases)


def _scores(rules: tuple) -> dict[str, list[tuple[int, tuple[str, ...]]]]:
    """By type: what is added where all of the patterns are found."""
    out: dict[str, list] = {t: [] for t in TYPES}
    for kind, score, phrases, also in rules:
        out[kind].append((score, tuple(_any(p) for p in (phrases, also) if p)))
    out["constrained"].append((3, (f"{DATED}|{_any(MONTHS)}",)))
    return out


def question_types(text: Column, rules: tuple = RULES) -> Column:
    """Struct of (type, confidence_q16): the type whose rules add up to most, ``basic`` with half the confidence for none."""
    low = F.translate(F.coalesce(text, F.lit("")), *_LETTERS)

    def total(parts: list) -> Column:
        return reduce(lambda a, b: a + b, (F.when(reduce(lambda a, b: a & b, (F.rlike(low, F.lit(p)) for p in patterns)), score).otherwise(0) for score, patterns in parts), F.lit(0))

    by_type = _scores(rules)
    ranked = F.sort_array(F.array(*(F.struct(total(by_type[t]).alias("score"), F.lit(-i).alias("first"), F.lit(t).alias("type")) for i, t in enumerate(TYPES))), asc=False)
    # one pass over the array by a lambda, so that the rules are written once in the plan
    judged = F.transform(F.array(ranked), lambda r: F.struct(
        F.when(r[0]["score"] == 0, "basic").otherwise(r[0]["type"]).alias("type"),
        F.when(r[0]["score"] == 0, 32768).otherwise(fixed.div(r[0]["score"] * fixed.ONE, r[0]["score"] + r[1]["score"])).cast("long").alias("confidence_q16"),
    ))
    return judged[0]


def question_type(question: str, rules: tuple = RULES) -> str:
    """The same for one question on the driver."""
    low = (question or "").translate(str.maketrans(*_LETTERS))
    sums = {t: sum(score for score, patterns in parts if all(re.search(p, low, re.A) for p in patterns)) for t, parts in _scores(rules).items()}
    best = max(TYPES, key=lambda t: sums[t])
    return best if sums[best] else "basic"


def profile_type(question: str, rules: tuple = RULES) -> str:
    """The type whose profile a rerank takes: long plain questions count as semantic ones."""
    kind, low = question_type(question, rules), question.lower()
    long = len(low.split()) >= LONG and (low.startswith(LONG_BEGINS) or any(p in low for p in LONG_SAYS))
    return "semantic" if kind == "basic" and long else kind


def routes(kind: Column, rows: Column, budget: Column) -> Column:
    """Struct of (intent, candidate_limit, result_limit, token_budget, diversity_lambda_q16, diversity, may_abstain,
    lexical_q16, semantic_q16) for a type of question and the rows and tokens asked for."""
    known = F.create_map(*(x for t, intent in INTENTS.items() for x in (F.lit(t), F.struct(F.lit(intent).alias("intent"), *(F.lit(v).alias(f"v{i}") for i, v in enumerate(ROUTES[intent]))))))
    made = F.transform(F.array(F.element_at(known, kind)), lambda r: F.struct(
        r["intent"].alias("intent"), (rows * r["v0"]).cast("long").alias("candidate_limit"), F.when(r["v1"] > 0, F.least(rows, r["v1"])).otherwise(rows).cast("long").alias("result_limit"),
        F.when(budget == 0, 0).otherwise(F.greatest(fixed.div(budget.cast("long") * r["v2"], F.lit(fixed.ONE)), F.lit(1))).cast("long").alias("token_budget"),
        r["v3"].alias("diversity_lambda_q16"), r["v4"].alias("diversity"), r["v5"].alias("may_abstain"), r["v6"].alias("lexical_q16"), r["v7"].alias("semantic_q16"),
    ))
    return made[0]


def metadata_weights(question: str, dated: bool, rules: tuple = RULES) -> tuple[int, int]:
    """Weights of trust and freshness for a question, ``dated`` if it names a time."""
    kind = question_type(question, rules)
    dated = dated or any(p in question.lower() for p in CURRENT)
    if kind == "conflicting_info":
        return METADATA[kind]
    if dated:
        return METADATA["constrained_dated" if kind == "constrained" else "dated"]
    return METADATA.get(kind if kind == "info_not_found" else "", METADATA[""])
