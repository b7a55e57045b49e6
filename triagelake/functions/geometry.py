"""Sizes of parts in words."""

from __future__ import annotations

from pyspark.sql import Column

from . import lazy as F

#: Shapes by the numbers that describe them.
ROUND3 = ("bushing", "spacer", "ring")
ROUND2 = ("shaft", "pin", "disc", "nozzle", "threaded_fitting")
ROUND = ROUND3 + ROUND2
#: Sizes where none are given.
DEFAULTS3, DEFAULTS2, DEFAULTS = (1.0, 1.0, 0.5), (2.0, 0.5), (4.0, 3.0, 1.0)


def _at(size: Column, i: int, default: float) -> Column:
    return F.coalesce(F.try_element_at(size, F.lit(i + 1)), F.lit(default))


def _least(c: Column) -> Column:
    return F.greatest(c, F.lit(1e-3))


def dims(size: Column, shape: Column) -> Column:
    """Two numbers for bars and discs, three for the rest; a bore is smaller than what is around it."""
    a3 = [_at(size, i, d) for i, d in enumerate(DEFAULTS3)]
    bore = F.when(a3[2] >= a3[1], a3[1] * 0.5).otherwise(a3[2])
    return (
        F.when(shape.isin(*ROUND3), F.array(_least(a3[0]), _least(a3[1]), _least(bore)))
        .when(shape.isin(*ROUND2), F.array(*[_least(_at(size, i, d)) for i, d in enumerate(DEFAULTS2)]))
        .otherwise(F.array(*[_least(_at(size, i, d)) for i, d in enumerate(DEFAULTS)]))
    )


def measure(x: Column, units: Column) -> Column:
    """Inches with three decimals and no leading zero; millimetres with one at most, none from 100 on."""
    fixed = lambda n: F.replace(F.format_number(x, n), F.lit(","), F.lit(""))  # noqa: E731  half-even; format_string rounds half up
    mm = F.when(x < 100, F.regexp_replace(fixed(1), r"\.?0+$", "")).otherwise(fixed(0))
    return F.when(units == "mm", mm).otherwise(F.regexp_replace(fixed(3), r"^0\.", "."))


def _unit(units: Column) -> Column:
    return F.when(units == "mm", F.lit("MM")).otherwise(F.lit("IN"))


def size_phrase(size: Column, shape: Column, units: Column) -> Column:
    d = dims(size, shape)
    m = lambda i: measure(F.try_element_at(d, F.lit(i + 1)), units)
    u = F.concat(F.lit(" ("), _unit(units), F.lit(")"))
    word = F.when(shape == "disc", F.lit(" THICK")).otherwise(F.lit(" LONG"))
    return (
        F.when(shape.isin(*ROUND3), F.concat(F.lit("Ø"), m(1), F.lit(" OD x Ø"), m(2), F.lit(" ID x "), m(0), F.lit(" LONG"), u))
        .when(shape.isin(*ROUND2), F.concat(F.lit("Ø"), m(1), F.lit(" x "), m(0), word, u))
        .otherwise(F.concat(m(0), F.lit(" x "), m(1), F.lit(" x "), m(2), u))
    )


def bbox(size: Column, shape: Column) -> Column:
    d = dims(size, shape)
    at = lambda i: F.try_element_at(d, F.lit(i))
    return F.when(shape.isin(*ROUND), F.array(at(1), at(2), at(2))).otherwise(F.array(at(1), at(2), at(3)))


def bbox_phrase(size: Column, shape: Column, units: Column) -> Column:
    return F.concat(F.array_join(F.transform(bbox(size, shape), lambda x: measure(x, units)), " x "), F.lit(" "), _unit(units))


def default_tolerances(units: Column) -> Column:
    return F.when(units == "mm", F.lit("X.X ±0.2  X.XX ±0.05  ANGLES ±0.5°")).otherwise(F.lit(".XX ±.01  .XXX ±.005  ANGLES ±0.5°"))
