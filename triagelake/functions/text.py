"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column

from . import lazy as F

#: What `clean` maps one to one (each of CR, LF, TAB to a space, dashes and curly quotes).
CLEAN_FROM, CLEAN_TO = "\r\n\t—–‘’“”", "   --''\"\""
#: Words that make a sender's name impersonal.
GENERIC_NAME_WORDS = (
    "quality", "supplier", "purchasing", "procurement", "accounts", "accounting", "sales", "team",
    "the", "unknown", "customer", "info", "admin", "support", "buyer", "receiving", "shipping",
    "engineering", "department", "dept", "office", "orders", "service", "noreply", "no-reply",
)
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Printable text on one line; null is empty."""
    return F.regexp_replace(F.translate(blank(c), CLEAN_FROM, CLEAN_TO), r"[\x00-\x1f]", "")


def strip(c: Column) -> Column:
    """Without white space (of any alphabet) at either end."""
    return F.regexp_replace(c, _EDGE, "")


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, runs of blank lines as one line break, edges stripped. The vertical
    tab is written as \\x0B: \\v is a class with line breaks in Java's expressions."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\f\x0B]+", " "), r"\n\s*\n+", "\n"))


def shorten(c: Column, limit: Column | int, rstrip: bool = True) -> Column:
    """At most limit characters, then a mark if anything was cut."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(c, F.lit(1), n.cast("int"))
    if rstrip:
        head = F.regexp_replace(head, r"(?U)\s+$", "")
    return F.when(F.length(c) > n, F.concat(head, F.lit(" [truncated]"))).otherwise(c)


def domain(email: Column) -> Column:
    """What follows the last @, lower-case; a value without one as a whole."""
    return strip(F.lower(F.substring_index(blank(email), "@", -1)))


def extension(name: Column) -> Column:
    """From the last dot of the lower-case name on, or nothing."""
    low = strip(F.lower(name))
    return F.when(F.instr(low, ".") > 0, F.concat(F.lit("."), F.substring_index(low, ".", -1))).otherwise(F.lit(""))


def first_name(name: Column) -> Column:
    """The first word of a personal name without its title; `there` for impersonal ones."""
    bare = F.regexp_replace(strip(blank(name)), r"(?i)^(dr|mr|mrs|ms)\.?\s+", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
    impersonal = (F.size(words) == 0) | F.arrays_overlap(plain, F.array(*map(F.lit, GENERIC_NAME_WORDS))) | F.contains(bare, F.lit("@"))
    return F.when(impersonal, F.lit("there")).otherwise(F.regexp_replace(F.try_element_at(words, F.lit(1)), r"^[.,]+|[.,]+$", ""))


def pct(x: Column) -> Column:
    """Half-even percent, or n/a."""
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%")))


def number(c: Column) -> Column:
    """A number written with , or $; zero where it is none."""
    return F.coalesce(F.translate(c.cast("string"), ",$", "").try_cast("double"), F.lit(0.0))


def quantity_list(q: Column) -> Column:
    """`10 / 25 / 1,000`, or NOT STATED."""
    return F.when(F.coalesce(F.size(q), F.lit(0)) > 0, F.array_join(F.transform(q, lambda x: F.format_number(x.cast("bigint"), 0)), " / ")).otherwise(F.lit("NOT STATED"))


def tidy_lines(c: Column) -> Column:
    """Without lines of up to two characters or of single characters only; squeezed."""
    lines = F.split(blank(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    # a search of two characters first: few lines have white space at an edge
    edged = lambda x: F.regexp_like(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)), F.lit(r"(?U)[\s\x1c-\x1f]"))
    stripped = F.transform(lines, lambda x: F.when(edged(x), strip(x)).otherwise(x))
    keep = F.filter(stripped, lambda x: (F.length(x) > 2) & F.regexp_like(x, F.lit(r"(?U)\S\S")))
    # no line is blank or has an edge left, so this is all of squeeze that there is to do
    return F.regexp_replace(F.array_join(keep, "\n"), r"[ \t\f\x0B]+", " ")


def join_lines(parts: list[Column]) -> Column:
    """The parts that are not blank, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n")


#: File endings of each kind of upload, the first one is added where none fits.
UPLOAD_ENDINGS = {"pdf": (".pdf",), "png": (".png",), "jpg": (".jpg", ".jpeg")}


def safe_filename(name: Column, media: Column) -> Column:
    """The base name without control characters and \"<>|:*?, with the ending of its kind, and 100
    characters at most (the ending stays)."""
    base = F.substring_index(F.translate(blank(name), "\\", "/"), "/", -1)
    base = F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f\x7f"<>|:*?]', ""), r"(?U)\s+", " ")
    base = F.regexp_replace(clean(base), r"^[ .]+|[ .]+$", "")
    base = F.when(F.nullif(base, F.lit("")).isNull(), F.lit("upload")).otherwise(base)

    def ended(b: Column) -> Column:
        stem = F.when(F.instr(F.substring(b, -6, 6), ".") > 0, F.regexp_replace(b, r"\.[^.]*$", "")).otherwise(b)
        out = F.lit(None).cast("string")
        for kind, endings in UPLOAD_ENDINGS.items():
            fits = F.lit(False)
            for e in endings:
                fits = fits | F.endswith(F.lower(b), F.lit(e))
            out = F.when(media == kind, F.when(fits, b).otherwise(F.concat(stem, F.lit(endings[0])))).otherwise(out)
        return out

    def cut(n: Column) -> Column:
        end = F.substring_index(n, ".", -1)
        stem = F.substring(n, F.lit(1), F.length(n) - F.length(end) - 1)
        return F.when(F.length(n) > 100, F.concat(F.substring(stem, F.lit(1), F.lit(95) - F.length(end)), F.lit("."), end)).otherwise(n)

    return F.let(F.let(base, ended), cut)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def key_hint(key: Column) -> Column:
    """The first six characters of a secret and its length; nothing of a short one."""
    return F.when(F.length(key) <= 8, F.lit("(short key)")).otherwise(F.concat(F.substring(key, 1, 6), F.lit("...("), F.length(key).cast("string"), F.lit(" chars)")))


def bar(p: Column, width: int = 20) -> Column:
    """A bar chart line for a probability."""
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))


def xml_escape(c: Column) -> Column:
    out = blank(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)
