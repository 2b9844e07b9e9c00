"""Column rules used by cleaning: pure expressions, evaluated inside codegen."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

# The labels of an order's status.
CANCELLED, COMPLETED = "Cancelled", "Completed"

ISO_DATE = "yyyy-MM-dd"
_ISO_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}


def _col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Col, token: str = "null", fold: bool = True) -> Column:
    """Not null and not the text ``token``; ``fold`` ignores case and outer blanks."""
    c = _col(c)
    text = F.lower(F.trim(c)) if fold else c
    return c.isNotNull() & (text != F.lit(token))


def clamp(c: Col, lo: float | None = None, hi: float | None = None) -> Column:
    """Bring values into [lo, hi]; null stays null (``greatest`` would turn it into ``lo``)."""
    c = _col(c)
    bounded = F
    if lo is not None:
        bounded = bounded.when(c < F.lit(lo), F.lit(lo))
    if hi is not None:
        bounded = bounded.when(c > F.lit(hi), F.lit(hi))
    return c if bounded is F else bounded.otherwise(c)


def whole_number(c: Col) -> Column:
    """Integer part of a number kept as text, null when it is no number or too large."""
    return _col(c).try_cast("double").try_cast("int")


def clamp_text(c: Col, lo: int) -> Column:
    """``clamp`` for numbers kept as text: too small becomes ``lo``, other text is untouched."""
    c = _col(c)
    return F.when(whole_number(c) < F.lit(lo), F.lit(str(lo))).otherwise(c)


def ladder(c: Col, steps: Iterable[tuple[str, float, str]], default: str) -> Column:
    """First label whose ``(op, bound)`` holds, else ``default`` (also for null)."""
    c = _col(c)
    rungs = F
    for op, bound, label in steps:
        rungs = rungs.when(_COMPARE[op](c, F.lit(bound)), F.lit(label))
    return rungs.otherwise(F.lit(default))


def order_status(quantity: Col, amount: Col) -> Column:
    """Cancelled when nothing was bought or paid; an unknown alone never cancels."""
    cancelled = (_col(quantity) == F.lit(0)) | (_col(amount) == F.lit(0))
    return F.when(cancelled, F.lit(CANCELLED)).otherwise(F.lit(COMPLETED))


def safe_date(c: Col, fmt: str = ISO_DATE) -> Column:
    """Text to DATE; null where it does not parse.

    ISO dates take the plain cast behind a check of their shape (the cast alone also accepts
    ``2024``, ``2024-1`` or trailing text), several times cheaper than a format parser.
    """
    c = _col(c)
    if fmt == ISO_DATE:
        return F.when(c.rlike(_ISO_SHAPE), c.try_cast("date"))
    return F.try_to_date(c, fmt)


def days_since(c: Col, as_of: Column | date | None = None) -> Column:
    """Whole days from ``c`` to ``as_of`` (today when not given)."""
    return F.datediff(F.current_date() if as_of is None else F.lit(as_of), _col(c))


def month_of(c: Col) -> Column:
    """``yyyy-MM`` of a date: the layout column of date-keyed tables."""
    return F.date_format(_col(c), "yyyy-MM")


def row_fingerprint(*cols: Col) -> Column:
    """md5 over text and whole-number columns.

    Each value is written as ``length:text`` and null as ``-``, so neither nulls nor
    separators inside the text can make two different rows look alike.
    """
    texts = [_col(c).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat_ws("|", *parts))
