"""Vectors that depend on a text alone (for tests of pipelines without a model) and the hash that says which text a vector is of."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import fnv1a64

#: The steps of the mixing generator.
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Payload lines that carry a vector or speak of one.
VECTOR_LINE = r"^(vector|embedding_model|embedding_text_hash|embedding_ref)=|_vector="


def lanes(seeds: np.ndarray, dimension: int) -> np.ndarray:
    """A row of 16-bit components for each seed: the high bits of a chain of mixed states."""
    state, out = seeds.astype(np.uint64), np.empty((len(seeds), dimension), np.int16)
    with np.errstate(over="ignore"):
        for i in range(dimension):
            z = state + GOLDEN
            z = (z ^ (z >> np.uint64(30))) * MIX_A
            z = (z ^ (z >> np.uint64(27))) * MIX_B
            state = z ^ (z >> np.uint64(31))
            out[:, i] = (state >> np.uint64(48)).astype(np.uint16).view(np.int16)
    return out


def deterministic_vector(text: Column, dimension: int) -> Column:
    """Equal texts have equal vectors; null counts as empty."""

    @F.pandas_udf("array<smallint>")
    def made(texts: pd.Series) -> pd.Series:
        seeds = np.array([fnv1a64((t or "").encode()) | 1 for t in texts], np.uint64)
        return pd.Series(list(lanes(seeds, dimension)))

    return made(text)


def hashed_text(payload: Column) -> Column:
    """A payload without the lines of its vector: the text that a vector is of."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.coalesce(payload, F.lit("")), r"\r?\n\z", ""), "\r?\n"), lambda x: ~F.rlike(F.trim(x), F.lit(VECTOR_LINE))), "\n")


def text_hash(payload: Column) -> Column:
    """16 hexadecimal digits of that text."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fnv1a64(t.encode()):016x}")

    return hashed(hashed_text(payload))
