"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import settings as s


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero for empty, unequally long or zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(usable, _dot(a, b) / norms).otherwise(F.lit(0.0))


def boosted(score: Column, category: Column, llm_category: Column, boost: float) -> Column:
    """``score`` raised by ``boost`` (at most to 1) when a decided model label agrees."""
    agrees = (llm_category != s.UNSURE) & (llm_category == category)
    return F.when(F.coalesce(agrees, F.lit(False)), F.least(F.lit(1.0), score + F.lit(boost))).otherwise(score)
