"""The query language: grammar, binding and policy."""

from decimal import Decimal

import pytest

from palimpsest.plans.aql import AgentView, AqlError, Explain, Remember, VerifyFact, bind, bind_remember, parse, to_q16

VIEW = AgentView(frozenset({"default", "lang:en"}), frozenset({"default"}))


def test_clauses_in_any_order():
    s = parse('retrieve context for task "a \\"b\\"" in brain x limit 5 candidates require citations, confidence >= 0.40 budget 900 tokens;')
    assert (s.task, s.brain, s.limit, s.budget, s.citations, s.confidence) == ('a "b"', "x", 5, 900, True, Decimal("0.40"))


def test_other_statements():
    assert parse('VERIFY FACT "f" IN BRAIN b;') == VerifyFact("f", "b")
    assert parse('REMEMBER "m" IN SCOPE default AS TYPE decision TTL 60 SECONDS;') == Remember("m", "default", "decision", 60)
    assert isinstance(parse('EXPLAIN ANALYZE VERIFY FACT "f" IN BRAIN b;'), Explain)


@pytest.mark.parametrize("text", ['RETRIEVE CONTEXT FOR TASK "x" IN BRAIN b', 'RETRIEVE CONTEXT FOR TASK "x" IN BRAIN b REQUIRE confidence >= 1;', 'RETRIEVE CONTEXT FOR TASK "x" IN BRAIN b LIMIT 1 CANDIDATES LIMIT 2 CANDIDATES;', 'VERIFY FACT "f" IN BRAIN b; x'])
def test_rejected(text):
    with pytest.raises(AqlError):
        parse(text)


@pytest.mark.parametrize(("where", "code"), [("status != \"x\"", "unsupported_comparator"), ("title = \"x\"", "field_not_filterable"), ("scope = \"secret\"", "policy_denied"), ("memory_type = \"y\"", "unsupported_literal")])
def test_binding_errors(where, code):
    with pytest.raises(AqlError) as e:
        bind(parse(f'RETRIEVE CONTEXT FOR TASK "x" IN BRAIN default WHERE {where};'), VIEW)
    assert e.value.code == code


def test_limits_are_clamped():
    b = bind(parse('RETRIEVE CONTEXT FOR TASK "x" IN BRAIN default BUDGET 320 TOKENS LIMIT 100 CANDIDATES;'), VIEW)
    assert (b.budget, b.limit, b.mode) == (320, 2, "balanced")
    assert to_q16(Decimal("0.5")) == 32768
    with pytest.raises(AqlError):
        bind_remember(parse('REMEMBER "m" IN SCOPE other AS TYPE decision;'), VIEW)
