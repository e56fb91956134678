"""Column expressions that several plans share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Col, b: Col) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def known(x: Col, default: float | int | str = 0.0) -> Column:
    return F.coalesce(col(x), F.lit(default))


def round_away(x: Col, digits: int = 4, nudge: float = 0.0) -> Column:
    """Rounds halves away from zero on the double itself, as DuckDB does (Spark's own goes by the decimal text).

    ``nudge`` counts what falls short of a half by less as a half, for sums whose last bits depend on their order.
    """
    x, by = col(x), float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * by + (0.5 + nudge)) / by + F.lit(0.0)


def boundaries(unit: str, start: Col, end: Col) -> Column:
    """Unit boundaries crossed between two timestamps (whole units passed is another thing)."""
    cut = lambda x: F.date_trunc(unit, col(x)).cast("timestamp")
    return F.timestamp_diff(unit.upper(), cut(start), cut(end))


def clamp(x: Col, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def ladder(x: Col, steps: Sequence[tuple[float, str | int | float]], default: str | int | float) -> Column:
    """The value of the first step (highest first) that ``x`` reaches."""
    x = col(x)
    out = None
    for least, value in steps:
        out = F.when(x >= least, F.lit(value)) if out is None else out.when(x >= least, F.lit(value))
    return out.otherwise(F.lit(default))


def last_wins(default: Column, rules: Sequence[tuple[Column, str]]) -> Column:
    """Overrides in the order they are applied: the last one that holds wins."""
    out = None
    for when, value in reversed(rules):
        out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
    return out.otherwise(default)


def largest_name(names: Sequence[str]) -> Column:
    """The name of the largest of several columns, the first among equals."""
    top = F.greatest(*names)
    return F.coalesce(*(F.when(F.col(n) == top, F.lit(n)) for n in names))


def weighted(parts: dict[str, float] | Sequence[tuple[float, Col]]) -> Column:
    """A weighted sum, added from left to right."""
    items = [(w, F.col(c)) for c, w in parts.items()] if isinstance(parts, dict) else [(w, col(c)) for w, c in parts]
    return reduce(lambda a, b: a + b, (F.lit(float(w)) * c for w, c in items))


def severity_rank(x: Col) -> Column:
    """critica 4, alta 3, media 2, anything else 1."""
    x = col(x)
    return F.when(x == "critica", 4).when(x == "alta", 3).when(x == "media", 2).otherwise(1)


def count_if(x: Column) -> Column:
    """How often a condition holds; null counts as no."""
    return F.sum(F.when(x, 1).otherwise(0)).cast("long")


def risk_tier(x: Col) -> Column:
    return ladder(x, ((80, "critico"), (60, "alto"), (40, "medio")), "bajo")


def urgency_tier(x: Col) -> Column:
    return ladder(x, ((85, "inmediata"), (70, "alta"), (55, "planificada")), "monitorizacion")


def anomaly_severity(x: Col) -> Column:
    return ladder(x, ((4, "critica"), (3, "alta"), (2, "media")), "baja")
