"""Column expressions that stay text until Spark needs them.

A plan of a few thousand expressions built call by call asks the JVM tens of thousands of times. Here
the same expressions are put together as SQL text in Python, and a whole one is parsed by a single call when it
meets a DataFrame. `Text` is a Column in every respect: it can be selected, compared or mixed with other
columns. A function given anything but texts and plain values is PySpark's own.

Use as PySpark's functions module: `from ..functions import lazy as F`.
"""

from __future__ import annotations

import datetime as dt
import inspect
import itertools
import math
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import functions as spark_functions
from pyspark.sql.classic.column import Column as ClassicColumn

_names = itertools.count()


def quoted(s: str) -> str:
    """A string literal: whatever the parser would take apart is escaped."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0"), ("\x1a", "\\Z")):
        s = s.replace(a, b)
    return f"'{s}'"


def literal(v) -> str | None:
    """The text of a plain value, None where it has none."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, int):
        return str(v) if -(1 << 31) < v < 1 << 31 else f"{v}L" if -(1 << 63) < v < 1 << 63 else None
    if isinstance(v, float) and math.isfinite(v):
        return f"{v!r}D"
    if type(v) is dt.date:
        return f"DATE'{v.isoformat()}'"
    return None


class Text(ClassicColumn):
    """A column known by its SQL text, and perhaps by a name."""

    def __new__(cls, text: str, name: str | None = None) -> Text:
        self = object.__new__(cls)
        self.text, self.name, self._parsed = text, name, None
        return self

    def __init__(self, *_: object) -> None: ...

    @property
    def _jc(self):
        context = SparkContext._active_spark_context
        if self._parsed is None or self._parsed[0] is not context:
            column = spark_functions.expr(self.text)
            self._parsed = (context, (column.alias(self.name) if self.name else column)._jc)
        return self._parsed[1]

    def __repr__(self) -> str:
        return f"Text<{self.text}>"

    def alias(self, *names: str, **kwargs):
        return Text(self.text, names[0]) if len(names) == 1 and not kwargs else super().alias(*names, **kwargs)

    def cast(self, to):
        return Text(f"cast({self.text} AS {to})") if isinstance(to, str) else super().cast(to)

    def try_cast(self, to):
        return Text(f"try_cast({self.text} AS {to})") if isinstance(to, str) else super().try_cast(to)

    def __getitem__(self, k):
        if isinstance(k, str):
            return Text(f"({self.text}).`{k}`" if not _is_name(self.text) else f"{self.text}.`{k}`")
        if isinstance(k, int | Text) and not isinstance(k, bool):
            return Text(f"({self.text})[{_of(k)}]")
        return super().__getitem__(k)

    getItem = getField = __getitem__

    def isNull(self):
        return Text(f"({self.text} IS NULL)")

    def isNotNull(self):
        return Text(f"({self.text} IS NOT NULL)")

    def isin(self, *values):
        values = values[0] if len(values) == 1 and isinstance(values[0], list | tuple | set) else values
        texts = [_of(v) for v in values]
        if None in texts:
            return super().isin(*values)
        return Text(f"({self.text} IN ({', '.join(texts)}))") if texts else Text("false")

    def eqNullSafe(self, other):
        return self._with(other, "<=>", super().eqNullSafe)

    def _with(self, other, sign: str, spark: Callable, swapped: bool = False):
        text = _of(other)
        if text is None:
            return spark(other)
        return Text(f"({text} {sign} {self.text})" if swapped else f"({self.text} {sign} {text})")

    def __neg__(self):
        return Text(f"(- {self.text})")

    def __invert__(self):
        return Text(f"(NOT {self.text})")

    __hash__ = ClassicColumn.__hash__


def _operators() -> None:
    signs = {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "AND", "or": "OR", "eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    for name, sign in signs.items():
        plain, turned = f"__{name}__", f"__r{name}__"
        setattr(Text, plain, lambda self, other, s=sign, m=plain: self._with(other, s, lambda o: getattr(ClassicColumn, m)(self, o)))
        if name in ("add", "sub", "mul", "truediv", "mod", "and", "or"):
            # Python asks a subclass's turned operator first, so `other` may be any column
            setattr(Text, turned, lambda self, other, s=sign, m=plain, r=turned: self._with(other, s, lambda o: getattr(ClassicColumn, m)(o, self) if isinstance(o, ClassicColumn) else getattr(ClassicColumn, r)(self, o), swapped=True))


_operators()


class Cases(Text):
    """WHEN ... THEN ..., to which more cases and an end can be added."""

    def __new__(cls, cases: list[tuple]) -> Cases:
        self = Text.__new__(cls, "CASE " + " ".join(f"WHEN {_of(a)} THEN {_of(b)}" for a, b in cases) + " END")
        self.cases = cases
        return self

    def _spark(self):
        """The same cases as PySpark's own column."""
        out = spark_functions
        for condition, value in self.cases:
            out = out.when(condition, value)
        return out

    def when(self, condition, value):
        return Cases([*self.cases, (condition, value)]) if None not in (_of(condition), _of(value)) else self._spark().when(condition, value)

    def otherwise(self, value):
        last = _of(value)
        return Text(f"{self.text[:-4]} ELSE {last} END") if last is not None else self._spark().otherwise(value)


def _is_name(text: str) -> bool:
    return text.replace("`", "").replace(".", "").replace("_", "").isalnum() and text[:1] == "`"


def _of(v) -> str | None:
    """The text of a value or Text; None for other columns."""
    return v.text if isinstance(v, Text) else None if isinstance(v, ClassicColumn) else literal(v)


def col(name: str):
    """A column or field by its (dotted) name."""
    if "*" in name or "`" in name:
        return spark_functions.col(name)
    return Text(".".join(f"`{part}`" for part in name.split(".")))


def expr(text: str) -> Text:
    return Text(f"({text})")


def lit(v):
    text = literal(v)
    return v if isinstance(v, ClassicColumn) else spark_functions.lit(v) if text is None else Text(text)


def when(condition, value):
    return Cases([(condition, value)]) if None not in (_of(condition), _of(value)) else spark_functions.when(condition, value)


def _named(c) -> tuple[str, str] | None:
    c = col(c) if isinstance(c, str) else c
    if not isinstance(c, Text):
        return None
    if c.name:
        return c.name, c.text
    last = c.text.rpartition(".")[2]
    return (last.strip("`"), c.text) if last[:1] == last[-1:] == "`" else ("", c.text)


def struct(*cols):
    cols = cols[0] if len(cols) == 1 and isinstance(cols[0], list | tuple) else cols
    parts = [_named(c) for c in cols]
    if None in parts:
        return spark_functions.struct(*cols)
    return Text("named_struct(" + ", ".join(f"{quoted(n or f'col{i}')}, {t}" for i, (n, t) in enumerate(parts, 1)) + ")")


def _higher_order(name: str):
    """A function whose last arguments are Python functions of elements."""

    def call(*args, **kwargs):
        plain = [a for a in args if not inspect.isfunction(a)]
        texts = [_of(col(a) if isinstance(a, str) else a) for a in plain]
        if None not in texts and not kwargs:
            parts = []
            for f in args[len(plain) :]:
                given = [Text(f"x{next(_names)}") for p in inspect.signature(f).parameters.values() if p.default is p.empty]
                body = _of(f(*given))
                if body is None:
                    break
                names = ", ".join(g.text for g in given)
                parts.append(f"{names} -> {body}" if len(given) == 1 else f"({names}) -> {body}")
            else:
                return Text(f"{name}({', '.join([*texts, *parts])})")
        return getattr(spark_functions, name)(*args, **kwargs)

    return call


transform, filter, aggregate, exists, forall = map(_higher_order, ("transform", "filter", "aggregate", "exists", "forall"))  # noqa: A001

def let(value, body: Callable):
    """body(value) with the value written (and made) once, however often the body uses it."""
    return element_at(transform(array(value), body), 1)  # noqa: F821


#: Places of arguments that are plain strings and no column names, by function; SQL names that differ.
_PLAIN = {
    "regexp_replace": (1, 2), "regexp_extract": (1,), "translate": (1, 2), "split": (1,), "array_join": (1, 2), "concat_ws": (0,), "format_string": (0,), "date_format": (1,),
    "get_json_object": (1,), "substring_index": (1,), "lpad": (2,), "rpad": (2,), "try_variant_get": (1, 2), "variant_get": (1, 2), "instr": (1,), "locate": (0,), "encode": (1,), "decode": (1,),
}
_SQL_NAMES = {"create_map": "map", "ceil": "ceil"}
_TEXT_FUNCTIONS = {
    *_PLAIN, "create_map", "coalesce", "concat", "array", "substring", "size", "length", "lower", "upper", "to_json", "nullif", "startswith", "endswith", "contains", "least", "greatest",
    "format_number", "regexp_like", "array_compact", "round", "bround", "get", "replace", "floor", "ceil", "array_sort", "trim", "btrim", "sha1", "sha2", "md5", "repeat", "hex", "unhex", "array_max", "array_min",
    "array_contains", "weekday", "slice", "sequence", "schema_of_variant", "regexp_extract_all", "initcap", "element_at", "try_element_at", "date_add", "datediff", "date_diff", "conv", "ascii", "arrays_overlap",
    "array_append", "abs", "flatten", "array_distinct", "map_from_entries", "encode", "decode", "octet_length", "xxhash64", "pmod", "inline", "raise_error", "reverse", "array_size", "dayofweek", "to_date",
}


def _function(name: str):
    plain, sql = _PLAIN.get(name, ()), _SQL_NAMES.get(name, name)

    def call(*args, **kwargs):
        if not kwargs:
            given = args[0] if len(args) == 1 and isinstance(args[0], list | tuple) and name in ("array", "create_map") else args
            texts = [_of(col(a)) if isinstance(a, str) and i not in plain and "*" not in a else _of(a) for i, a in enumerate(given)]
            if None not in texts:
                return Text(f"{sql}({', '.join(texts)})")
        return getattr(spark_functions, name)(*args, **kwargs)

    return call


for _name in _TEXT_FUNCTIONS:
    if hasattr(spark_functions, _name):
        globals()[_name] = _function(_name)


def __getattr__(name: str):
    return getattr(spark_functions, name)
