"""Fuzzy similarity from 0 to 100: by rapidfuzz where it is installed, else by longest matching blocks."""

from __future__ import annotations

import difflib
import importlib.util

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rapid_installed() -> bool:
    return importlib.util.find_spec("rapidfuzz") is not None


def fuzzy_score(query: str, text: str, rapid: bool = False) -> float:
    if not text:
        return 0.0
    if rapid:
        from rapidfuzz import fuzz

        return max(fuzz.partial_ratio(query, text), 0.9 * fuzz.token_set_ratio(query, text))
    return 100 * difflib.SequenceMatcher(None, query.lower(), text.lower()).ratio()


def may_pass(query_length: int, text_length: int, gate: float) -> bool:
    """False if two texts of these lengths can't have a block ratio above ``gate``."""
    total = query_length + text_length
    return bool(total) and 200 * min(query_length, text_length) / total > gate


@F.pandas_udf(T.DoubleType())
def fuzzy_udf(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_score(q, t or "") for q, t in zip(query, text)], dtype=float)
