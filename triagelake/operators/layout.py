"""Attachments as printed pages: drawings with views and dimensions, forms and orders with tables, documents.

A sheet is a list of drawing operations; a file (PDF) and a thumbnail (SVG of the first sheet) are made
from the same operations. Coordinates are points from the upper left corner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column

from ..functions import lazy as F
from pyspark.sql import types as T

from ..functions import geometry
from ..functions.geometry import ROUND2, ROUND3
from ..functions.metrics import fit, width, wrap
from ..schemas import DOC_TYPE_LABELS
from . import attachments as att
from .render import LOOKS, Solid, _fit, escaped, literal, pdf_file, plain_dims, shaded, solid, to_svg

PORTRAIT, LANDSCAPE = (612, 792), (792, 612)
EDGE, BODY, SMALL, LEADING = 40.0, 9.0, 7.0, 1.25
#: How many callouts and revisions a drawing shows.
MOST_CALLOUTS, MOST_REVISIONS = 4, 4


class Sheet:
    """Operations of one page: (kind, numbers or points, ...)."""

    def __init__(self, size: tuple[int, int] = PORTRAIT):
        self.size, self.ops = size, []

    def line(self, x1: float, y1: float, x2: float, y2: float, weight: float = 0.6) -> None:
        self.ops.append(("path", [(x1, y1), (x2, y2)], weight, None, False))

    def polygon(self, points: list[tuple[float, float]], weight: float = 0.6, fill: float | None = None) -> None:
        self.ops.append(("path", points, weight, fill, True))

    def rect(self, x: float, y: float, w: float, h: float, weight: float = 0.6, fill: float | None = None) -> None:
        self.polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], weight, fill)

    def arc(self, x: float, y: float, r: float, begin: float = 0.0, end: float = 360.0, weight: float = 0.6) -> None:
        steps = max(2, math.ceil(abs(end - begin) / 10))
        at = [math.radians(begin + (end - begin) * i / steps) for i in range(steps + 1)]
        self.ops.append(("path", [(x + r * math.cos(a), y + r * math.sin(a)) for a in at], weight, None, False))

    def circle(self, x: float, y: float, r: float, weight: float = 0.6) -> None:
        self.arc(x, y, r, weight=weight)

    def text(self, x: float, y: float, text: str, size: float = BODY, bold: bool = False, room: float | None = None, middle: bool = False) -> None:
        """One line from x (or about x) with its foot at y; with room it is shrunk or cut to fit."""
        if room is not None:
            text, size = fit(text, room, size, bold)
        if text:
            self.ops.append(("text", x - width(text, size, bold) / 2 if middle else x, y, text, size, bold))

    def paragraph(self, x: float, y: float, text: str, room: float, size: float = BODY, bold: bool = False) -> float:
        """Wrapped lines below y; returns the place below them."""
        for line in wrap(text, room, size, bold):
            y += size * LEADING
            self.text(x, y, line, size, bold)
        return y

    def dimension(self, a: tuple[float, float], b: tuple[float, float], label: str) -> None:
        """A dimension line with arrow heads from a to b (level or upright) and its label."""
        self.line(*a, *b, 0.4)
        for (x, y), (u, v) in ((a, b), (b, a)):
            turn = math.atan2(v - y, u - x)
            self.polygon([(x, y), *((x + 5 * math.cos(turn + s), y + 5 * math.sin(turn + s)) for s in (0.3, -0.3))], 0.2, 0.0)
        self.text((a[0] + b[0]) / 2, (a[1] + b[1]) / 2 - 3, label, SMALL, middle=True)

    def pdf(self) -> bytes:
        w, h = self.size
        out = []
        for kind, *op in self.ops:
            if kind == "made":
                out.append(op[0])
            elif kind == "text":
                x, y, text, size, bold = op
                out.append(b"BT /F%d %.2f Tf %.2f %.2f Td (" % (2 if bold else 1, size, x, h - y) + literal(text) + b") Tj ET")
            else:
                points, weight, fill, closed = op
                path = " ".join(f"{x:.2f} {h - y:.2f} {'l' if i else 'm'}" for i, (x, y) in enumerate(points))
                paint = ("b" if fill is not None else "s") if closed else "S"
                out.append((f"{fill:.3f} g " if fill is not None else "").encode() + f"{weight:.2f} w {path} {paint} 0 g".encode())
        return b"\n".join(out)

    def svg(self, title: str = "") -> str:
        w, h = self.size
        head = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" width="{w}" height="{h}">', f"<title>{escaped(title)}</title>", f'<rect width="{w}" height="{h}" fill="white"/>']
        return "\n".join([*head, self.marks(), "</svg>"])

    def marks(self) -> str:
        """The operations as elements of SVG."""
        out = []
        for kind, *op in self.ops:
            if kind == "made":
                out.append(op[1])
            elif kind == "text":
                x, y, text, size, bold = op
                out.append(f'<text x="{x:.2f}" y="{y:.2f}" font-family="Helvetica, Arial, sans-serif" font-size="{size:g}"{" font-weight=\"bold\"" if bold else ""}>{escaped(text)}</text>')
            else:
                points, weight, fill, closed = op
                grey = "none" if fill is None else f"rgb({round(255 * fill)},{round(255 * fill)},{round(255 * fill)})"
                tag = "polygon" if closed else "polyline"
                out.append(f'<{tag} points="{" ".join(f"{x:.2f},{y:.2f}" for x, y in points)}" fill="{grey}" stroke="black" stroke-width="{weight:g}"/>')
        return "\n".join(out)


def row_height(cells: list[str], rooms: list[float], size: float = BODY) -> float:
    """As high as the cell with the most lines."""
    return max([len(wrap(c, r - 6, size)) for c, r in zip(cells, rooms)] + [1]) * size * LEADING + 5


class Flow:
    """Blocks one below the other, on as many sheets as they need; sheets are numbered at the end."""

    def __init__(self, heading: str, legend: str):
        self.heading, self.legend, self.sheets = heading, legend, []
        self._next()

    def _next(self) -> None:
        self.sheets.append(Sheet())
        self.y = EDGE
        self.foot = PORTRAIT[1] - EDGE - 12
        if self.legend:
            lines = wrap(self.legend, PORTRAIT[0] - 2 * EDGE, SMALL)
            self.foot -= len(lines) * SMALL * LEADING + 6
            y = self.foot + 4
            for x in lines:
                y += SMALL * LEADING
                self.sheets[-1].text(EDGE, y, x, SMALL)
        self.sheets[-1].text(EDGE, self.y, self.heading, 14, True, PORTRAIT[0] - 2 * EDGE)
        self.y += 8
        self.sheets[-1].line(EDGE, self.y, PORTRAIT[0] - EDGE, self.y, 1.0)

    def room(self, height: float) -> Sheet:
        if self.y + height > self.foot:
            self._next()
        return self.sheets[-1]

    def say(self, text: str, size: float = BODY, bold: bool = False, gap: float = 2.0) -> None:
        for line in wrap(text, PORTRAIT[0] - 2 * EDGE, size, bold):
            sheet = self.room(size * LEADING)
            self.y += size * LEADING
            sheet.text(EDGE, self.y, line, size, bold)
        self.y += gap

    def table(self, heads: list[str], shares: list[float], rows: list[list[str]]) -> None:
        rooms = [s * (PORTRAIT[0] - 2 * EDGE) / sum(shares) for s in shares]
        for k, cells in enumerate([heads, *rows]):
            high = row_height(cells, rooms)
            before = len(self.sheets)
            self.room(high)
            if k and len(self.sheets) > before:
                self._row(heads, rooms, row_height(heads, rooms), True)  # again at the top of a new sheet
            self._row(cells, rooms, high, k == 0)
        self.y += 6

    def _row(self, cells: list[str], rooms: list[float], high: float, bold: bool) -> None:
        sheet, x = self.sheets[-1], EDGE
        for cell, room in zip(cells, rooms):
            sheet.rect(x, self.y, room, high, 0.4, 0.92 if bold else None)
            sheet.paragraph(x + 3, self.y, cell, room - 6, BODY, bold)
            x += room
        self.y += high

    def done(self) -> list[Sheet]:
        for i, sheet in enumerate(self.sheets, 1):
            sheet.text(sheet.size[0] - EDGE - 70, sheet.size[1] - EDGE + 12, f"PAGE {i} OF {len(self.sheets)}", SMALL)
        return self.sheets


def _said(*pairs: tuple[str, str | None]) -> str:
    return "   ".join(f"{k}: {v}" for k, v in pairs if v)


def rfq_form(a: dict) -> list[Sheet]:
    f = Flow(f"REQUEST FOR QUOTATION {a['rfq_number'] or ''}", a["legend_text"])
    f.say(a["company"] or "", 11, True)
    f.say(a["company_address"] or "")
    f.say(_said(("Date", a["date"]), ("Respond by", a["respond_by"]), ("Terms", a["terms"])))
    f.say(_said(("Buyer", a["buyer"]), ("E-mail", a["buyer_email"]), ("Phone", a["buyer_phone"])), gap=6)
    rows = [
        [str(i), f"{x['part_number'] or ''}{' REV ' + x['rev'] if x['rev'] else ''}", x["description"] or "", " / ".join(v for v in (x["material"], x["finish"]) if v), " / ".join(f"{q:,.0f}" for q in _list(x["quantities"])) or "NOT STATED", x["notes"] or ""]
        for i, x in enumerate(_list(a["rfq_lines"]), 1)
    ]
    f.table(["#", "PART / REV", "DESCRIPTION", "MATERIAL / FINISH", "QUANTITIES", "NOTES"], [0.5, 2, 3, 3, 2, 2], rows)
    for i, x in enumerate(_list(a["requirements"]), 1):
        f.say(f"{i}. {x or ''}")
    return f.done()


def po(a: dict) -> list[Sheet]:
    f = Flow(f"PURCHASE ORDER {a['po_number'] or ''}{' REV ' + a['po_rev'] if a['po_rev'] else ''}", a["legend_text"])
    f.say(a["company"] or "", 11, True)
    f.say(_said(("Date", a["date"]), ("Buyer", a["buyer"]), ("Quote ref", a["quote_ref"])))
    f.say(_said(("Terms", a["terms"]), ("Ship via", a["ship_via"]), ("Ship to", a["ship_to"])), gap=6)
    rows, total = [], 0.0
    for i, x in enumerate(_list(a["po_lines"]), 1):
        n, price = _number(x["qty"]), _number(x["unit_price"])
        total += n * price
        rows.append([str(i), f"{x['part_number'] or ''}{' REV ' + x['rev'] if x['rev'] else ''}", x["description"] or "", f"{n:,.0f}", f"${price:,.2f}", f"${n * price:,.2f}", x["due"] or ""])
    f.table(["#", "PART / REV", "DESCRIPTION", "QTY", "PRICE", "AMOUNT", "DUE"], [0.5, 2, 3, 1, 1.4, 1.6, 1.4], rows)
    f.say(f"ORDER TOTAL: ${total:,.2f}", 11, True)
    for i, x in enumerate(_list(a["notes"]), 1):
        f.say(f"{i}. {x or ''}")
    return f.done()


def document(a: dict) -> list[Sheet]:
    f = Flow(a["title"] or DOC_TYPE_LABELS.get(a["doc_type"], "Document"), a["legend_text"])
    f.say(DOC_TYPE_LABELS.get(a["doc_type"], "Document").upper(), SMALL)
    f.say(a["subtitle"] or "", 10, True, 6)
    for s in _list(a["sections"]):
        f.say(s["heading"] or "", 10, True)
        for x in _list(s["lines"]):
            f.say(x or "")
        f.y += 4
    return f.done()


def _views(sheet: Sheet, s: Solid, dims: list[float], labels: list[str], w: float, h: float) -> None:
    """Front, top and right side of a part as its outlines to one scale, each with its dimensions."""
    lx, wy, hz = dims
    k = min((w - 150) / (lx + wy), (h - 110) / (hz + wy))
    x0, y0 = EDGE + 30, EDGE + 30
    front, top, side = (x0, y0 + k * wy + 40), (x0, y0), (x0 + k * lx + 60, y0 + k * wy + 40)
    flat = {"front": (lambda p: (front[0] + k * p[0], front[1] + k * (hz - p[2])), 1, -1), "top": (lambda p: (top[0] + k * p[0], top[1] + k * (wy - p[1])), 2, 1), "side": (lambda p: (side[0] + k * p[1], side[1] + k * (hz - p[2])), 0, 1)}
    for place, axis, sign in flat.values():
        shown = []
        for face in s.faces:
            corners = [s.points[i] for i in face]
            flat_corners = [place(p) for p in corners]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(flat_corners, [*flat_corners[1:], flat_corners[0]])) / 2
            if area < -1e-9:  # turned to the viewer, on a page whose second axis points down
                shown.append((sign * sum(p[axis] for p in corners) / len(corners), flat_corners))
        for _, polygon in sorted(shown, key=lambda x: x[0]):
            sheet.polygon(polygon, 0.4, 1.0)
    sheet.dimension((top[0], top[1] - 10), (top[0] + k * lx, top[1] - 10), labels[0])
    sheet.dimension((top[0] - 12, top[1]), (top[0] - 12, top[1] + k * wy), labels[1])
    sheet.dimension((front[0] - 12, front[1]), (front[0] - 12, front[1] + k * hz), labels[2])


@lru_cache(maxsize=256)
def _pictures(shape: str | None, size: tuple[float, ...], labels: tuple[str, ...]) -> tuple[bytes, str]:
    """A part's views as operations of a page and as elements of SVG. Many parts have a shape and a size in
    common, and their pictures are most of a drawing; what is kept is some tens of MB at most."""
    sheet = Sheet(LANDSCAPE)
    w, h = LANDSCAPE
    s = solid(shape, size)
    box = [b for _, b in s.extents()]
    _views(sheet, s, box, list(labels), w * 0.6, h - 190)
    for polygon, light in _fit(shaded(s), 180, 140, 4):
        sheet.polygon([(w - 230 + x, EDGE + 20 + y) for x, y in polygon], 0.3, min(1.0, 0.3 + 0.7 * light))
    return sheet.pdf(), sheet.marks()


def drawing(a: dict) -> list[Sheet]:
    sheet = Sheet(LANDSCAPE)
    w, h = LANDSCAPE
    sheet.rect(EDGE / 2, EDGE / 2, w - EDGE, h - EDGE, 1.2)
    known = a["shape"] if a["shape"] in LOOKS or a["shape"] in ROUND3 or a["shape"] in ROUND2 else None
    sheet.ops.append(("made", *_pictures(known, tuple(float(x) for x in _list(a["size"])), tuple(_list(a["box_labels"])))))
    y = 220.0
    for x in _list(a["callouts"])[:MOST_CALLOUTS]:
        sheet.text(w - 230, y, x or "", SMALL, room=190)
        y += 11
    y = sheet.paragraph(w - 230, y + 6, "NOTES:" if len(_list(a["notes"])) else "", 190, SMALL, True)
    for i, x in enumerate(_list(a["notes"]), 1):
        y = sheet.paragraph(w - 230, y, f"{i}. {x or ''}", 190, SMALL)
    y = max(y + 8, 330)
    for r in _list(a["revisions"])[:MOST_REVISIONS]:
        sheet.text(w - 230, y, " ".join(v for v in (r["rev"], r["description"], r["date"]) if v), SMALL, room=190)
        y += 10
    left, top, cell = w - 372, h - 132, 176
    blocks = [
        ("COMPANY", a["company"]), ("TITLE", a["title"]), ("DWG NO", f"{a['part_number'] or ''} REV {a['rev'] or '-'}"), ("MATERIAL", a["material"]), ("FINISH", a["finish"] or "NONE"),
        ("TOLERANCES", a["tolerances"]), ("SCALE / SHEET", f"{a['scale'] or '1:1'}   {a['sheet'] or '1 OF 1'}"), ("DRAWN", f"{a['drawn_by'] or ''} {a['date'] or ''}".strip()),
    ]
    for i, (k, v) in enumerate(blocks):
        x, y = left + i % 2 * cell, top + i // 2 * 28
        sheet.rect(x, y, cell, 28)
        sheet.text(x + 3, y + 8, k, 5)
        sheet.text(x + 3, y + 22, v or "", BODY, room=cell - 6)
    sheet.paragraph(EDGE, h - 130, a["legend_text"], left - EDGE - 16, SMALL)
    sheet.text(EDGE, h - EDGE / 2 - 6, "PAGE 1 OF 1", SMALL)
    return [sheet]


def _list(x) -> list:
    return [] if x is None else list(x)


def _number(x: str | None) -> float:
    try:
        return float((x or "").replace(",", "").replace("$", ""))
    except ValueError:
        return 0.0


PAGES = {"drawing": drawing, "rfq_form": rfq_form, "po": po, "document": document}
MADE = T.StructType(
    [T.StructField("content", T.BinaryType()), T.StructField("media", T.StringType()), T.StructField("thumb", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("error", T.StringType())]
)


def make(a: dict) -> tuple[bytes | None, str | None, str | None, int | None, str | None]:
    """(file, media type, thumbnail, pages, error) of a specification; other kinds have no file."""
    from .render import to_step

    kind = a["kind"]
    try:
        if kind == "model":
            s = solid(a["shape"], a["size"])
            text = to_step(s, a["part_number"] or "PART", a["title"] or "", a["rev"] or "-", a["units"] or "in", a["schema"] or "AP214")
            return text.encode(), "model/step", to_svg(s, a["title"] or ""), None, None
        if kind in PAGES:
            sheets = PAGES[kind](a)
            title = " ".join(x for x in (a["part_number"] or a["rfq_number"] or a["po_number"], a["title"]) if x)
            return pdf_file([x.pdf() for x in sheets], title, sheets[0].size), "application/pdf", sheets[0].svg(title), len(sheets), None
        return None, None, None, None, f"no file for kind {kind}"
    except Exception as e:  # noqa: BLE001 - a specification that cannot be drawn has its error as status
        return None, None, None, None, f"{type(e).__name__}: {e}"[:300]


@F.pandas_udf(MADE)
def _made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame([make(a) for a in frame.to_dict("records")], columns=MADE.names).astype({"pages": "Int32"})


def derived(a: Column) -> Column:
    """content, media, thumb, pages, error of an attachment's file, made from its (cleaned) specification."""
    size, shape, units = a["size"], a["shape"], a["units"]
    box = F.transform(geometry.bbox(size, shape), lambda x: geometry.measure(x, units))
    plain = {"string": lambda c: F.when(c.isNotNull(), att.clean(c)), "array<string>": lambda c: F.transform(c, att.clean)}
    fields = [plain.get(t, lambda c: c)(a[n]).alias(n) for n, t in att.ATTACHMENT_FIELDS.items() if n not in ("text", "tolerances")]
    rest = [att._or(a["tolerances"], geometry.default_tolerances(units)).alias("tolerances"), att._legend(a).alias("legend_text"), box.alias("box_labels")]
    return _made(F.struct(*fields, *rest))


__all__ = ["Sheet", "derived", "make", "plain_dims", "row_height"]
