"""Widths of text in Helvetica, and what follows from them: fitted sizes and wrapped lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column

from . import lazy as F

from .text import clean

#: Widths of the characters from space to tilde in thousandths of the size, plain and bold
#: (the font's published metrics), of some others, and of all the rest.
PLAIN = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611,
    611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
OTHERS = {"±": 584, "°": 400, "Ø": 778, "µ": 556, "×": 584, "·": 278}
REST = 556
#: The least size that text is set in, and the step by which it shrinks.
LEAST_SIZE, SIZE_STEP = 4.5, 0.25

_TABLES = [{**{chr(32 + i): n for i, n in enumerate(t)}, **OTHERS} for t in (PLAIN, BOLD)]


def width(text: str, size: float, bold: bool = False) -> float:
    """The same as text_width, of one string."""
    table = _TABLES[bold]
    return sum(table.get(c, REST) for c in text) * size / 1000


def text_width(text: Column, size: Column | float, bold: bool = False) -> Column:
    """The width of a text set in a size: a sum over its characters."""
    table = F.array(*map(F.lit, BOLD if bold else PLAIN))
    others = F.create_map(*[F.lit(x) for kv in OTHERS.items() for x in kv])
    of = lambda c: F.coalesce(F.when((c >= " ") & (c <= "~"), F.get(table, F.ascii(c) - 32)), F.try_element_at(others, c), F.lit(REST))
    units = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + of(c))
    return units * (F.lit(size) if isinstance(size, int | float) else size) / 1000


def fitted_size(text: Column, room: Column | float, size: float, bold: bool = False, least: float = LEAST_SIZE) -> Column:
    """The size in which a text fits into the room: the given one, less as many steps as are needed, but not
    below the first that is no more than `least` (a text that is too long even then has to be cut)."""
    room = F.lit(room) if isinstance(room, int | float) else room
    sizes, s = [size], size
    while s > least:
        s -= SIZE_STEP
        sizes.append(s)
    units = text_width(clean(text), 1.0, bold)
    fits = F.lit(None).cast("double")
    for s in reversed(sizes[:-1]):
        fits = F.when(units * s <= room, F.lit(s)).otherwise(fits)
    return F.coalesce(fits, F.lit(sizes[-1]))


def fit(text: str, room: float, size: float, bold: bool = False) -> tuple[str, float]:
    """A text and the size it fits in; one that is too long even in the least size ends in two dots."""
    while size > LEAST_SIZE and width(text, size, bold) > room:
        size -= SIZE_STEP
    if width(text, size, bold) <= room:
        return text, size
    keep = next((n for n in range(len(text), 0, -1) if width(text[:n] + "..", size, bold) <= room), 0)
    return text[:keep].rstrip() + "..", size


def wrap(text: str, room: float, size: float, bold: bool = False) -> list[str]:
    """Words of a clean text in lines, each as full as it gets; a word that is wider than a line is cut."""
    lines: list[str] = []
    held = ""
    for word in text.split():
        while len(word) > 1 and width(word, size, bold) > room:
            head = next((n for n in range(len(word) - 1, 1, -1) if width(word[:n], size, bold) <= room), 1)
            lines += [held, word[:head]] if held else [word[:head]]
            held, word = "", word[head:]
        longer = f"{held} {word}" if held else word
        if width(longer, size, bold) <= room:
            held = longer
        else:
            lines += [held] if held else []
            held = word
    return lines + [held] if held else lines


def wrapped(text: Column, room: float, size: float, bold: bool = False) -> Column:
    """The lines of a text (cleaned first). Each line depends on those before it, so this is Python, in
    Arrow batches. Null and blank texts have no lines."""

    @F.pandas_udf("array<string>")
    def lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: wrap(t, room, size, bold))

    return lines(clean(text))


__all__ = ["fit", "fitted_size", "text_width", "width", "wrap", "wrapped"]
