"""Amount gates, buckets and labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import settings as s


def magnitude(out_flow: Column, in_flow: Column) -> Column:
    return F.coalesce(out_flow, in_flow)


def amounts_in_range(a: Column, b: Column, ratio: Decimal, floor: Decimal) -> Column:
    """Close in absolute terms, or the larger at most ``ratio`` times a positive smaller one."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (high - low <= F.lit(floor)) | ((low > 0) & (high <= low * F.lit(ratio)))


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def cents_window(amount_cents: Column, ratio: Decimal, floor: Decimal) -> tuple[Column, Column]:
    """Lowest and highest cents that are in range of a positive amount; the gate is one interval."""
    num, den = Decimal(str(ratio)).as_integer_ratio()
    step = int(floor * 100)
    by_ratio_low = F.ceil((amount_cents * den).cast("decimal(30,0)") / F.lit(num)).cast("bigint")
    by_ratio_high = F.floor((amount_cents * num).cast("decimal(30,0)") / F.lit(den)).cast("bigint")
    return (
        F.least(amount_cents - step, by_ratio_low),
        F.greatest(amount_cents + step, by_ratio_high),
    )


def price_bucket(amount: Column, boundaries: tuple[int, ...] = s.PRICE_BOUNDARIES) -> Column:
    """Label of the price range of ``|amount|``; a boundary belongs to the lower range."""
    size = F.abs(amount)
    lows = (0, *boundaries[:-1])
    label = F.lit(f"${boundaries[-1]}+")
    for low, high in reversed(list(zip(lows, boundaries, strict=True))):
        label = F.when(size <= high, F.lit(f"${low} to ${high}")).otherwise(label)
    return label


def embedding_text(description: Column, amount: Column) -> Column:
    return F.concat(description, F.lit(" | "), price_bucket(amount))


def amount_label(amount_sgd: Column) -> Column:
    return F.when(
        amount_sgd.isNotNull(), F.concat(amount_sgd.cast("string"), F.lit(f" {s.REPORTING_CURRENCY}"))
    ).otherwise(F.lit("unknown"))
