"""Due-date and month arithmetic. "Today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First and last day of a ``yyyy-MM`` text."""
    first = F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return first, F.last_day(first)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_instance(first_of_month: Column, due_day: Column) -> Column:
    """The due day in that month, clamped to the month's length."""
    length = F.dayofmonth(F.last_day(first_of_month))
    return F.date_add(first_of_month, F.least(due_day.cast("int"), length) - 1)


def shift_months(first_of_month: Column, months: Column | int) -> Column:
    return F.add_months(first_of_month, months)


def _closer(day: Column, here: Column, there: Column) -> Column:
    return F.when(
        F.abs(F.datediff(day, here)) <= F.abs(F.datediff(day, there)), here
    ).otherwise(there)


def nearest_monthly(due_day: Column, day: Column) -> Column:
    here = month_start(day)
    step = F.when(F.dayofmonth(day) < due_day, F.lit(-1)).otherwise(F.lit(1))
    return _closer(day, month_instance(here, due_day), month_instance(F.add_months(here, step), due_day))


def nearest_annual(due_month: Column, due_day: Column, day: Column) -> Column:
    here = F.make_date(F.year(day), due_month.cast("int"), F.lit(1))
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (due_month * 100 + due_day)
    step = F.when(before, F.lit(-12)).otherwise(F.lit(12))
    return _closer(day, month_instance(here, due_day), month_instance(F.add_months(here, step), due_day))


def nearest_due_date(frequency: Column, due_month: Column, due_day: Column, day: Column) -> Column:
    return F.when(frequency == "monthly", nearest_monthly(due_day, day)).otherwise(
        nearest_annual(due_month, due_day, day)
    )


def nearest_due_steps(frequency: Column, due_month: Column, due_day: Column, day: Column) -> list[tuple[str, Column]]:
    """``nearest_due_date`` as columns to be added one after the other: ``_here``, ``_there`` and ``due_date``."""
    monthly = frequency == "monthly"
    here = F.when(monthly, month_start(day)).otherwise(F.make_date(F.year(day), due_month.cast("int"), F.lit(1)))
    this_month = F.when(monthly, F.lit(0)).otherwise((F.month(day) - due_month) * 100)
    months = F.when(monthly, F.lit(1)).otherwise(F.lit(12))
    ahead = F.when(this_month + F.dayofmonth(day) < due_day, -months).otherwise(months)
    return [
        ("_here", here),
        ("_there", month_instance(F.add_months(F.col("_here"), ahead), due_day)),
        ("_here", month_instance(F.col("_here"), due_day)),
        ("due_date", _closer(day, F.col("_here"), F.col("_there"))),
    ]


def cycle_period(frequency: Column, instance: Column) -> Column:
    return F.when(frequency == "monthly", F.date_format(instance, "yyyy-MM")).otherwise(
        F.date_format(instance, "yyyy")
    )


def current_due_date(frequency: Column, due_month: Column, due_day: Column, as_of: Column) -> Column:
    """Latest due date on or before ``as_of``."""
    month = F.when(frequency == "monthly", month_start(as_of)).otherwise(
        F.make_date(F.year(as_of), due_month.cast("int"), F.lit(1))
    )
    back = F.when(frequency == "monthly", F.lit(-1)).otherwise(F.lit(-12))
    here = month_instance(month, due_day)
    return F.when(here <= as_of, here).otherwise(month_instance(F.add_months(month, back), due_day))


def next_due_date(frequency: Column, due_day: Column, instance: Column) -> Column:
    """The due date that follows ``instance``."""
    ahead = F.when(frequency == "monthly", F.lit(1)).otherwise(F.lit(12))
    return month_instance(F.add_months(month_start(instance), ahead), due_day)


def swapped_day_month(day: Column) -> Column:
    """Day and month exchanged; null when that is no date or no change."""
    d, m = F.dayofmonth(day), F.month(day)
    return F.when((d <= 12) & (d != m), F.make_date(F.year(day), d, m))
