"""The filter language: strings to boolean Columns.

    field:value   field:(words in one)   field:[low TO high]   field IN (a, (b c), d)   NOT   AND   OR   ( )

AND, OR and NOT are in capitals; a backslash takes the next character as it is; `*` leaves a range
open.  NOT binds closest, then AND, then OR.  A document without a field does not match a term of it and
does match the term's negation: what NOT stands before is made true or false.  Elsewhere null is left to
`where`, which takes it as false, so that comparisons reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FilterError(ValueError):
    """A filter that can't be read, or that a table has no field for."""


_TERM = re.compile(r"\s*(?P<field>(?:\\.|[^\s():\[\]\\,])++)(?:\s*:\s*(?:\[(?P<range>[^\]]*)\]|\((?P<group>(?:\\.|[^()\\])*)\)|(?P<value>(?:\\.|[^\s()\\])+))|\s+[Ii][Nn]\s*\((?P<list>(?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*)\))")
_KEYWORD = re.compile(r"\s*(AND|OR|NOT)(?=[\s(])")
_LISTED = re.compile(r"\s*(?:\((?P<group>(?:\\.|[^()\\])*)\)|(?P<plain>(?:\\.|[^,()\\])*))\s*(?:,|$)")


def _plain(value: str) -> str:
    return re.sub(r"\\(.)", r"\1", value)


def read_filter(text: str, term: Callable[[str, str, object], Column]) -> Column:
    """`text` as a Column; `term` gives the Column of (field, kind, value) with kind equals, between or in."""
    at = 0

    def fail(what: str):
        raise FilterError(f"{what} at character {at} of {text!r}")

    def keyword() -> str | None:
        found = _KEYWORD.match(text, at)
        return found[1] if found else None

    def one() -> Column:
        nonlocal at
        if keyword() == "NOT":
            at = _KEYWORD.match(text, at).end()
            return ~F.coalesce(one(), F.lit(False))
        rest = text[at:].lstrip()
        if rest.startswith("("):
            at = len(text) - len(rest) + 1
            inner = either()
            rest = text[at:].lstrip()
            if not rest.startswith(")"):
                fail("a closing parenthesis is missing")
            at = len(text) - len(rest) + 1
            return inner
        if keyword() or not (found := _TERM.match(text, at)):
            fail("a term is missing")
        at = found.end()
        if at < len(text) and text[at] not in " )\t\n":
            fail("an operator is missing")
        name = _plain(found["field"])
        if found["range"] is not None:
            bounds = re.fullmatch(r"\s*(\S+)\s+TO\s+(\S+)\s*", found["range"], re.IGNORECASE)
            if not bounds or bounds.group(1, 2) == ("*", "*"):
                fail("a range needs two bounds, one of which is a number")
            try:
                low, high = (None if x == "*" else int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x) for x in bounds.groups())
            except ValueError:
                fail("a bound of a range is no number")
            return term(name, "between", (low, high))
        if found["list"] is not None:
            values, rest = [], found["list"].strip()
            if not rest:
                fail("a list is empty")
            for x in _LISTED.finditer(rest) if not rest.endswith(",") else _LISTED.finditer(rest + " "):
                if x.end() == x.start() and x.start() == len(rest):
                    break
                values.append(_plain(x["group"] if x["group"] is not None else x["plain"].strip()))
            return term(name, "in", values)
        return term(name, "equals", _plain(found["group"] if found["group"] is not None else found["value"]))

    def chain(word: str, lower: Callable[[], Column], join: Callable[[Column, Column], Column]) -> Column:
        nonlocal at
        out = lower()
        while keyword() == word:
            at = _KEYWORD.match(text, at).end()
            out = join(out, lower())
        return out

    def both() -> Column:
        return chain("AND", one, lambda a, b: a & b)

    def either() -> Column:
        return chain("OR", both, lambda a, b: a | b)

    if not text or not text.strip():
        raise FilterError("the filter is empty")
    try:
        out = either()
    except RecursionError:
        fail("parentheses or negations are nested too deep")
    if text[at:].strip():
        fail("an operator is missing" if not text[at:].lstrip().startswith(")") else "an opening parenthesis is missing")
    return out


def _number(value: str, whole: bool) -> int | float | None:
    try:
        return int(value) if whole else float(value)
    except ValueError:
        return None


def _equal(column: Column, kind: T.DataType, value: str, name: str) -> Column:
    if isinstance(kind, T.ArrayType):
        item = value if isinstance(kind.elementType, T.StringType) else _number(value, isinstance(kind.elementType, T.IntegralType))
        return F.lit(False) if item is None else F.array_contains(column, F.lit(item).cast(kind.elementType))
    if isinstance(kind, T.BooleanType):
        if value.lower() not in ("true", "false"):
            raise FilterError(f"{name} is true or false")
        return column == F.lit(value.lower() == "true")
    if isinstance(kind, T.NumericType):
        number = _number(value, isinstance(kind, T.IntegralType))
        if number is None:
            raise FilterError(f"{name} is a number")
        return column == F.lit(number).cast(kind)
    return column == F.lit(value)


def structured_filter(frame: DataFrame, text: str, *, filterable: set[str] | None = None) -> Column:
    """A filter on the columns of `frame`; a field that is none of them, or not in `filterable`, is an error."""
    kinds = {x.name: x.dataType for x in frame.schema}

    def term(name: str, kind: str, value) -> Column:
        if name not in kinds or filterable is not None and name not in filterable and name != "_id":
            raise FilterError(f"{name} can't be filtered by")
        column, of = F.col(f"`{name}`"), kinds[name]
        if kind == "equals":
            return _equal(column, of, value, name)
        if kind == "between":
            if not isinstance(of, T.NumericType):
                raise FilterError(f"a range needs a number; {name} is none")
            low, high = value
            return reduce(lambda a, b: a & b, [*([column >= F.lit(low)] if low is not None else []), *([column <= F.lit(high)] if high is not None else [])])
        item = of.elementType if isinstance(of, T.ArrayType) else of
        if not isinstance(item, T.StringType | T.IntegralType):
            raise FilterError(f"IN needs text or whole numbers; {name} is neither")
        values = [_number(x, True) for x in value] if isinstance(item, T.IntegralType) else value
        if None in values:
            raise FilterError(f"IN needs whole numbers for {name}")
        if isinstance(of, T.ArrayType):
            return F.arrays_overlap(column, F.array(*(F.lit(x).cast(item) for x in values)))
        return column.isin(*values)

    return read_filter(text, term)


def inferred_filter(text: str, *, short_strings: str = "short_strings", string_arrays: str = "string_arrays", bools: str = "bools", ints: str = "ints", floats: str = "floats") -> Column:
    """A filter on documents whose fields stand in maps by kind: a value is looked up in each kind that it may be.

    string_arrays is one list of `field::element`.  IN is an error here.
    """
    found = lambda place, name: F.try_element_at(F.col(place), F.lit(name))

    def term(name: str, kind: str, value) -> Column:
        if kind == "in":
            raise FilterError("IN needs declared fields")
        if kind == "between":
            tests = []
            for place in (ints, floats):
                low, high = value
                x = found(place, name)
                tests.append(reduce(lambda a, b: a & b, [*([x >= F.lit(low)] if low is not None else []), *([x <= F.lit(high)] if high is not None else [])]))
            return tests[0] | tests[1]
        if name == "_id":
            return F.col("_id") == F.lit(value)
        tests = [found(short_strings, name) == F.lit(value), F.array_contains(F.col(string_arrays), F.lit(f"{name}::{value}"))]
        if value.lower() in ("true", "false"):
            tests.append(found(bools, name) == F.lit(value.lower() == "true"))
        for place, whole in ((ints, True), (floats, False)):
            if (number := _number(value, whole)) is not None:
                tests.append(found(place, name) == F.lit(number))
        return reduce(lambda a, b: a | b, tests)

    return read_filter(text, term)
