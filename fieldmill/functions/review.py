"""Confidence policy, decisions and review scores as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from fieldmill import constants as K
from fieldmill.functions.common import strip


def threshold_column(raw: Column) -> Column:
    """0..1; above 1 is a percentage; anything unreadable is the default."""
    value = F.coalesce(strip(raw).try_cast("double"), F.lit(K.DEFAULT_THRESHOLD))
    value = F.when(value > 1, value / 100).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def low_confidence(confidence: Column, threshold: float = K.DEFAULT_THRESHOLD) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < F.lit(threshold)


def needs_review(requires_review: Column, confidence: Column, auto_accept: Column,
                 threshold: float = K.DEFAULT_THRESHOLD) -> Column:
    return requires_review | low_confidence(confidence, threshold) | ~auto_accept


def for_review(c: Column) -> Column:
    """Lower case with collapsed whitespace, for comparing two readings of a value."""
    return F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")


def cheap_review_confidence(confidence: Column, original: Column, reviewed: Column,
                            corrected: Column) -> Column:
    """Review confidence where no text comparison is needed, else NULL."""
    a, b = for_review(original), for_review(reviewed)
    return (F.when(~corrected, F.round(confidence, 4))
            .when(F.coalesce(original, F.lit("")) == F.coalesce(reviewed, F.lit("")), 1.0)
            .when((a != "") & (a == b), 0.98)
            .when((a == "") & (b == ""), 1.0)
            .when((a == "") | (b == ""), 0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 4 places (the one measure Spark has no expression for); NULL where a text is."""
    from difflib import SequenceMatcher
    pairs = list(zip(a, b, strict=True))
    ratio = {p: round(SequenceMatcher(None, *p).ratio(), 4) for p in set(pairs) if None not in p}
    return pd.Series([ratio.get(p) for p in pairs], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """JVM-side alternative: 1 - edit distance / longer length."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 4)


def review_status(accepted: Column, needs: Column, corrected: Column, score: Column) -> Column:
    return (F.when(~accepted & needs, "needs_review")
            .when(~accepted, "awaiting_acceptance")
            .when(~corrected, "accepted_original")
            .when(score >= 0.98, "accepted_same")
            .when(score >= 0.75, "accepted_minor_change")
            .otherwise("accepted_modified"))


def blocks_approval(needs: Column, accepted: Column) -> Column:
    return needs | ~accepted


def blocked_by_validation(status: Column) -> Column:
    return F.coalesce(status, F.lit("")).isin("invalid", "missing_required")
