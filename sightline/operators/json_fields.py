"""Field names of JSON bodies, also of bodies cut short.

Valid JSON and JSON cut off somewhere are read the same way: an expression steps over
whole strings, so a name is a string followed by a colon, wherever the text ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STR = r'"(?:[^"\\]|\\.)*+"'
_TOKEN = rf'(?s){_STR}(?:\s*+:(?:\s*+(?:{_STR}|-?[0-9][0-9.eE+-]*+))?)?'
_NAME = rf'(?s)\A"((?:[^"\\]|\\.)*+)"\s*+:'


def _usable(body: Column) -> Column:
    return F.left(F.ltrim(body), F.lit(1)).isin("{", "[")


def _unescape(s: Column) -> Column:
    return F.when(
        s.contains("\\"), F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0)), s)
    ).otherwise(s)


def let(value: Column, body) -> Column:
    """Bind ``value`` once: an expression captured by a lambda is otherwise evaluated for
    every element the lambda sees."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _new_name(f: Column, before: Column) -> Column:
    """Of fields in the order of their names: the first of each name, its place in front."""
    first = f.isNotNull() & (before.isNull() | (before["name"] != f["name"]))
    return F.when(first, F.struct(f["i"].alias("i"), f["name"].alias("name"), f["value"].alias("value")))


def json_fields(body: Column, names: str | None = None) -> Column:
    """Array of (name, value): distinct names in document order with the value of the first
    one, NULL where that is not a string or a number.  ``names`` limits them to whole names
    that match, before anything else is done with them."""
    wanted = _NAME if names is None else rf'(?is)\A"(?:{names})"\s*+:'
    named = F.filter(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike(wanted))

    def field(t: Column) -> Column:
        rest = F.regexp_replace(t, _NAME + r"\s*+", "")
        text = F.regexp_extract(rest, r'(?s)\A"(.*)"\z', 1)
        return F.struct(
            _unescape(F.regexp_extract(t, _NAME, 1)).alias("name"),
            F.when(rest == "", F.lit(None)).when(rest.startswith('"'), _unescape(text)).otherwise(rest).alias("value"),
        )

    first = let(
        F.transform(named, field),
        lambda fs: let(
            F.array_sort(F.transform(fs, lambda f, i: F.struct(f["name"].alias("name"), i.alias("i"), f["value"].alias("value")))),
            lambda placed: let(
                F.concat(F.array(F.lit(None)), placed),
                lambda before: F.array_sort(F.filter(F.zip_with(placed, before, _new_name), lambda f: f.isNotNull())),
            ),
        ),
    )
    first = F.transform(first, lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return F.when(_usable(body), first).otherwise(empty)


def shallow_names(body: Column) -> Column:
    """Names inside at most two objects and no array, in document order."""
    tokens = F.regexp_extract_all(body, F.lit(rf"(?s){_STR}(?:\s*+:)?|[\[\]{{}}]"), F.lit(0))
    kept = F.filter(tokens, lambda t: t.isin("{", "}", "[", "]") | t.endswith(":"))
    start = F.struct(
        F.lit(0).alias("objects"), F.lit(0).alias("arrays"), F.array().cast("array<string>").alias("names")
    )

    def step(acc: Column, t: Column) -> Column:
        shallow = t.endswith(":") & (acc["arrays"] == 0) & (acc["objects"] <= 2)
        delta = lambda up, down: F.when(t == up, 1).when(t == down, -1).otherwise(0)
        return F.struct(
            (acc["objects"] + delta("{", "}")).alias("objects"),
            (acc["arrays"] + delta("[", "]")).alias("arrays"),
            F.when(shallow, F.array_append(acc["names"], _unescape(F.regexp_extract(t, _NAME, 1))))
            .otherwise(acc["names"]).alias("names"),
        )

    out = F.aggregate(kept, start, step, lambda acc: F.array_distinct(acc["names"]))
    return F.when(_usable(body), out).otherwise(F.array().cast("array<string>"))
