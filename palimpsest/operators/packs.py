"""Greedy selections, which depend on what was taken before: over bounded pools, one group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import estimate_tokens, python_tokens, tokens

ONE = 65535
#: No pool may hold more rows; a larger one is an error, never a silent cut.
MOST = 1024


def pack_budget(pool: DataFrame, budget: int, *, keep_first: bool = True, text: str = "body_text") -> DataFrame:
    """(pack, cell_id, pos, n_tokens, taken, used) of ranked rows (pack, pos): a row too large is passed over and a later,
    smaller one may still fit; the first is always taken with ``keep_first``."""
    sized = pool.select("pack", "cell_id", "pos", estimate_tokens(F.col(text)).alias("n_tokens"))

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > MOST:
            raise ValueError(f"a pack's pool has more than {MOST} rows")
        df = df.sort_values("pos")
        used, taken, sums = 0, [], []
        for i, n in enumerate(df["n_tokens"]):
            fits = used + n <= budget or (keep_first and i == 0)
            used += int(n) if fits else 0
            taken.append(fits)
            sums.append(used)
        return df.assign(taken=taken, used=sums)

    return sized.groupBy("pack").applyInPandas(fill, "pack string, cell_id long, pos long, n_tokens long, taken boolean, used long")


def diversify(pool: DataFrame, weight: int, k: int, *, text: str = "body_text") -> DataFrame:
    """(pack, cell_id, rank): greedy marginal relevance; relevance falls with the position, redundancy is the largest
    term Jaccard with what was taken, ties go to the earlier row. ``weight``: of redundancy, 0..65535."""
    split = pool.select("pack", "cell_id", "pos", F.array_distinct(tokens(F.col(text))).alias("terms"))

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > MOST:
            raise ValueError(f"a pack's pool has more than {MOST} rows")
        df = df.sort_values("pos").reset_index(drop=True)
        sets, n = [set(t) for t in df["terms"]], len(df)
        worst, left, out = [0] * n, list(range(n)), []
        while left and len(out) < k:
            best = max(left, key=lambda i: ((n - i) * ONE // n * (ONE - weight) // ONE - worst[i] * weight // ONE, -i))
            left.remove(best)
            out.append(best)
            for i in left:
                union = len(sets[i] | sets[best])
                worst[i] = max(worst[i], len(sets[i] & sets[best]) * ONE // union if union else 0)
        return pd.DataFrame({"pack": df["pack"].iloc[out], "cell_id": df["cell_id"].iloc[out], "rank": range(len(out))})

    return split.groupBy("pack").applyInPandas(pick, "pack string, cell_id long, rank long")


def mmr_by_vectors(pool: DataFrame, relevance: int) -> DataFrame:
    """(pack, cell_id, rank) of ranked rows (pack, pos, vector) by marginal relevance: ``relevance`` of 65535 goes to the
    position, the rest to the distance from what was taken, by pairwise products scaled to 0..65535. All rows stay;
    at 65535 their order does."""

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = _bounded(df)
        n = len(df)
        like = np.zeros((n, n), dtype=object)
        pairs = {(i, j): sum(int(x) * int(y) for x, y in zip(df["vector"][i], df["vector"][j], strict=True)) for i in range(n) for j in range(i) if df["vector"][i] is not None and df["vector"][j] is not None and len(df["vector"][i]) == len(df["vector"][j])}
        low, high = min(pairs.values(), default=0), max(pairs.values(), default=0)
        for (i, j), dot in pairs.items():
            like[i, j] = like[j, i] = (dot - low) * ONE // (high - low) if high > low else ONE
        near, left, order = [0] * n, list(range(n)), []
        while left:
            gain = (lambda i: (n - i) * ONE // n) if not order else (lambda i: (relevance * ((n - i) * ONE // n) + (ONE - relevance) * (ONE - near[i])) // ONE)
            best = max(left, key=lambda i: (gain(i), -i))
            left.remove(best)
            order.append(best)
            near = [max(a, int(b)) for a, b in zip(near, like[best], strict=True)]
        if relevance >= ONE:
            order = list(range(n))
        return pd.DataFrame({"pack": df["pack"].iloc[:1].repeat(n).to_numpy(), "cell_id": df["cell_id"].to_numpy()[order], "rank": range(n)})

    return pool.select("pack", "cell_id", "pos", "vector").groupBy("pack").applyInPandas(pick, "pack string, cell_id long, rank long")


def _bounded(df: pd.DataFrame) -> pd.DataFrame:
    if len(df) > MOST:
        raise ValueError(f"a pack's pool has more than {MOST} rows")
    return df.sort_values("pos", ignore_index=True)


def _alike(a: set, b: set) -> int:
    both, union = len(a & b), len(a | b)
    return (both * ONE + union // 2) // union if a and b else 0


# What a new term, a matched term, a citation and full redundancy are worth.
NEW_TERM, MATCHED_TERM, CITED, REDUNDANT = 100_000, 10_000, 5_000, 20_000


def pack_order(pool: DataFrame, terms: list[str], *, by: str, text: str = "body_text") -> DataFrame:
    """(pack, cell_id, rank) of ranked rows (pack, pos, lexical, trust_q16, freshness_q16, cited, feedback, n_tokens).

    ``coverage``: three times the share of the query's terms less the largest likeness with what was taken.
    ``value``: value by token, terms that nothing taken covers counting most. Without terms the order stays."""
    wanted = set(terms)
    split = pool.withColumn("terms", F.array_distinct(tokens(F.col(text)))).drop(text)

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = _bounded(df)
        own = [set(x) for x in df["terms"]]
        alike, covered, left, order = [0] * len(df), set(), list(range(len(df))), []

        def coverage(i: int) -> int:
            return 3 * (len(own[i] & wanted) * ONE // len(wanted)) - alike[i]

        def value(i: int) -> int:
            r, hit = df.iloc[i], own[i] & wanted
            total = NEW_TERM * len(hit - covered) + MATCHED_TERM * len(hit) + int(r["lexical"]) + int(r["trust_q16"]) // 2 + int(r["freshness_q16"]) // 2 + (CITED if r["cited"] else 0)
            total = max(total + int(r["feedback"]), 0) - alike[i] * REDUNDANT // ONE
            return max(total, 0) * ONE // max(int(r["n_tokens"]), 1)

        rate = coverage if by == "coverage" else value
        while left:
            best = max(left, key=lambda i: (rate(i), -i)) if wanted else left[0]
            left.remove(best)
            order.append(best)
            covered |= own[best] & wanted
            alike = [max(a, _alike(x, own[best])) for a, x in zip(alike, own, strict=True)]
        return pd.DataFrame({"pack": df["pack"], "cell_id": df["cell_id"].to_numpy()[order], "rank": range(len(df))})

    columns = ["pack", "cell_id", "pos", "terms", *([] if by == "coverage" else ["lexical", "trust_q16", "freshness_q16", "cited", "feedback", "n_tokens"])]
    return split.select(*columns).groupBy("pack").applyInPandas(pick, "pack string, cell_id long, rank long")


def cut_at_sentence(text: str, most: int) -> str:
    """At most so many characters, ended at a sentence's end if there is one in the second half."""
    part = text[:most]
    end = max(part.rfind(c) for c in ".!?\n") + 1
    return part[:end] if end and end >= len(part) / 2 else part


POLICIES = ("preserve_first", "truncate", "exclude", "summary_placeholder", "source_only_reference")


def pack_cells(pool: DataFrame, budget: int, *, policy: str = "preserve_first", redundant: int | None = None, text: str = "body_text") -> DataFrame:
    """(pack, cell_id, pos, n_tokens, outcome, used) of ranked rows (pack, pos, citation, text) in a budget of tokens.

    A row whose terms are as like as ``redundant`` (of 65535) to one that was taken is left out. One that doesn't fit
    is treated by ``policy``: left out (the first is kept whole under ``preserve_first``), cut at a sentence's end, or
    replaced by a reference of its citation; smaller rows behind it may still fit. Tokens are four characters here."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    cost = lambda t: -(-len(t) // 4)
    split = pool.select("pack", "cell_id", "pos", F.coalesce("citation", F.lit("")).alias("citation"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.array_distinct(tokens(F.col(text))).alias("terms"))

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        df = _bounded(df)
        used, taken, out = 0, [], []
        for i, r in df.iterrows():
            own, n, outcome = set(r["terms"]), cost(r["text"]), "included"
            if redundant is not None and any(_alike(own, t) >= redundant for t in taken):
                n, outcome = 0, "redundant"
            elif used + n > budget and not (policy == "preserve_first" and i == 0):
                if policy == "truncate":
                    part = cut_at_sentence(r["text"], max(budget - used, 0) * 4)
                    n, outcome = cost(part), "truncated" if part else "excluded"
                elif policy in ("summary_placeholder", "source_only_reference"):
                    n = cost(f"[{policy}] {r['citation']}")
                    n, outcome = (n, policy) if used + n <= budget else (0, "excluded")
                else:
                    n, outcome = 0, "excluded"
            used += n
            if outcome in ("included", "truncated"):
                taken.append(own)
            out.append((r["pack"], r["cell_id"], r["pos"], n, outcome, used))
        return pd.DataFrame(out, columns=["pack", "cell_id", "pos", "n_tokens", "outcome", "used"])

    return split.groupBy("pack").applyInPandas(fill, "pack string, cell_id long, pos long, n_tokens long, outcome string, used long")


def best_lines(text: str | None, terms: list[str], budget: int) -> str:
    """The line with the most of the terms and as many lines around it, before and behind in turn, as a budget of tokens holds."""
    lines = (text or "").split("\n")
    score = [len({*python_tokens(x)} & {*terms}) for x in lines]
    first = last = max(range(len(lines)), key=lambda i: (score[i], -i))
    while True:
        grown = [(a, b) for a, b in ((first - 1, last), (first, last + 1)) if a >= 0 and b < len(lines) and len("\n".join(lines[a : b + 1])) <= budget * 4]
        if not grown:
            return "\n".join(lines[first : last + 1])
        first, last = grown[0] if (last - first) % 2 == 0 else grown[-1]
