"""Scalar expressions that turn raw event fields into encoded ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.schemas import CODE_CLASSES, MISSING_TEXTS


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_event_code(code: Column | str) -> Column:
    """Whole-value replacement of the codes in ``CODE_CLASSES``; all others pass unchanged."""
    code = _column(code)
    (first, target), *rest = CODE_CLASSES.items()
    recoded = F.when(code == first, F.lit(target))
    for value, target in rest:
        recoded = recoded.when(code == value, F.lit(target))
    return recoded.otherwise(code)


def root_code(code: Column | str) -> Column:
    """The first two characters, i.e. the root of a hierarchical code."""
    return F.substring(_column(code), 1, 2)


def lenient_number(text: Column | str, dtype: str = "double") -> Column:
    """Tolerant parse that keeps null: missing or malformed text is null.

    The cast alone would read a type suffix ("1d", "2.5f") as part of the number.
    """
    text = _column(text).cast("string")
    number = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.nanvl(number, F.lit(None).cast("double")).try_cast(dtype)


def lenient_int(text: Column | str) -> Column:
    """Integer value of a text; 0 where it is missing or not a number."""
    return F.coalesce(_column(text).try_cast("decimal(38,10)").try_cast("int"), F.lit(0))


def event_class(code: Column | str) -> Column:
    """The class number of an event code: recode, take the root, parse tolerantly."""
    return lenient_int(root_code(recode_event_code(code)))


def missing_as_null(value: Column | str) -> Column:
    """The number as a double; NaN is a missing one."""
    return F.nanvl(_column(value).cast("double"), F.lit(None).cast("double"))


def missing_text_as_null(value: Column | str) -> Column:
    """The text, or null where it spells a missing value."""
    value = _column(value)
    return F.when(~value.isin(MISSING_TEXTS), value)


def strict_int(value: Column | str) -> Column:
    """Integer value, missing as 0; malformed text raises."""
    return F.coalesce(missing_as_null(value).cast("int"), F.lit(0))


def degree_bucket(degrees: Column | str) -> Column:
    """Whole degrees, truncated toward zero, missing as 0."""
    return F.coalesce(missing_as_null(degrees).cast("int"), F.lit(0))


def month_of(date: Column | str) -> Column:
    """Month of a ``yyyyMMdd`` text."""
    return F.substring(_column(date), 5, 2).cast("int")


def year_of(date: Column | str) -> Column:
    """Year of a ``yyyyMMdd`` text."""
    return F.substring(_column(date), 1, 4).cast("int")


def round_prediction(value: Column | str) -> Column:
    """Nearest whole number, halves to the even neighbour."""
    return F.rint(_column(value))
