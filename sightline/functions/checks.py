"""Checksums, entropy, cookies and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import blank, first_match, nz, rl
from sightline.rules import packs


def _int(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n).try_cast("int")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def plausible_card(d: Column) -> Column:
    """Length, checksum, brand range, not one repeated digit, not a run of digits."""
    n = F.length(d)
    p2, p3, p4 = _int(d, 1, 2), _int(d, 1, 3), _int(d, 1, 4)
    brand = (
        (d.startswith("4") & n.isin(13, 16, 19))
        | ((n == 16) & (p2.between(51, 55) | p4.between(2221, 2720)))
        | ((n == 15) & p2.isin(34, 37))
        | (n.isin(16, 19) & (d.startswith("6011") | (p2 == 65) | p3.between(644, 649)))
        | ((n == 14) & (p2.isin(36, 38) | p3.between(300, 305)))
        | ((n == 16) & p4.between(3528, 3589))
    )
    # A strictly ascending or descending run has at most ten digits, so none reaches 13.
    same = d.rlike(r"^(\d)\1+$")
    return F.coalesce(d.rlike(r"^\d+$") & n.isin(13, 14, 15, 16, 19) & brand & ~same & luhn(d), F.lit(False))


_RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]


def valid_rrn(d: Column) -> Column:
    """13 digits, month and day in range, weighted checksum."""
    total = reduce(lambda a, b: a + b, [_int(d, i + 1, 1) * w for i, w in enumerate(_RRN_WEIGHTS)])
    check = (F.lit(11) - (total % 11)) % 10
    ok = (
        (F.length(d) == 13)
        & _int(d, 3, 2).between(1, 12)
        & _int(d, 5, 2).between(1, 31)
        & (check == _int(d, 13, 1))
    )
    return F.coalesce(ok, F.lit(False))


def shannon(s: Column) -> Column:
    """Bits per character over the ASCII characters."""
    ascii_only = F.regexp_replace(nz(s), r"[^\x00-\x7f]", "")
    n = F.length(ascii_only)
    chars = F.array_distinct(F.split(ascii_only, ""))
    terms = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c: (n - F.length(F.replace(ascii_only, c, F.lit("")))).cast("double") / n.cast("double"),
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    )


def high_entropy(v: Column) -> Column:
    return (
        (F.length(nz(v)) >= 20)
        & rl(v, r"\p{L}")
        & rl(v, r"\p{Nd}")
        & (shannon(v) >= 3.5)
    )


def is_jwt(v: Column) -> Column:
    return rl(v, rf"\A{packs.JWT_STRICT}\z")


def looks_like_token(value: Column) -> Column:
    v = F.trim(nz(value))
    low = F.lower(v)
    scheme = low.startswith("bearer ") | low.startswith("basic ") | low.startswith("token ")
    chars = rl(v, packs.TOKEN_CHARS) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return scheme | is_jwt(v) | chars


def cookie_pairs(header: Column) -> Column:
    """Ordered (name, value) pairs; a repeated name keeps its place and its last value."""
    raw = F.filter(F.transform(F.split(nz(header), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def pair(p: Column) -> Column:
        eq = F.locate("=", p)
        return F.struct(
            F.when(eq > 1, F.trim(F.substr(p, F.lit(1), eq - 1))).otherwise(p).alias("name"),
            F.when(eq > 1, F.trim(F.substr(p, eq + 1))).otherwise(F.lit("")).alias("value"),
        )

    def last_wins(pairs: Column) -> Column:
        distinct = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.transform(
            distinct,
            lambda nm: F.struct(
                nm.alias("name"),
                F.element_at(F.filter(pairs, lambda p: p["name"] == nm), -1)["value"].alias("value"),
            ),
        )

    # Bound once: see ``let`` in operators.json_fields.
    return F.get(F.transform(F.array(F.transform(raw, pair)), last_wins), F.lit(0))


def join_cookies(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "; ")


def cookie_name(set_cookie: Column) -> Column:
    eq = F.locate("=", set_cookie)
    n = F.trim(F.when(eq > 1, F.substr(set_cookie, F.lit(1), eq - 1)).otherwise(set_cookie))
    return F.when(n == "", F.lit("(cookie)")).otherwise(n)


def cookie_value(set_cookie: Column) -> Column:
    return F.trim(F.regexp_extract(set_cookie, r"^[^=]*=([^;]*)", 1))


def _segment(token: Column, i: int) -> Column:
    seg = F.translate(F.split_part(token, F.lit("."), F.lit(i)), "-_", "+/")
    padded = F.concat(seg, F.repeat(F.lit("="), (4 - F.length(seg) % 4) % 4))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def jwt_part(token: Column, i: int) -> Column:
    """Header (1) or payload (2) as text; NULL unless it is a JSON object."""
    text = _segment(token, i)
    return F.when(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>").isNotNull(), text)


def json_map(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def has_key(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def scalar(text: Column, key: str) -> Column:
    """A scalar member as text, NULL for objects, arrays and absent members."""
    v = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "string")
    return F.when(v.rlike(r"^[\[{]"), F.lit(None)).otherwise(v)


def number(text: Column, key: str) -> Column:
    return F.coalesce(scalar(text, key).try_cast("double").cast("bigint"), F.lit(-1))


def token_subject(payload: Column) -> Column:
    return nz(
        F.coalesce(*[F.concat(F.lit(f"{c}="), scalar(payload, c)) for c in packs.SUBJECT_CLAIMS])
    )


def token_expiry(payload: Column) -> Column:
    return F.coalesce(scalar(payload, "exp").try_cast("double").cast("bigint"), F.lit(0))


def header_confidence(lower_name: Column, value: Column) -> Column:
    skip = (
        lower_name.isin(packs.NOT_AUTH_HEADERS)
        | lower_name.startswith("sec-")
        | lower_name.startswith("content-")
        | lower_name.startswith("accept")
        | blank(value)
    )
    return first_match(
        [(skip, F.lit(None)), (rl(lower_name, packs.AUTH_HEADER), "CONFIRMED"), (looks_like_token(value), "LIKELY")]
    )


def cookie_confidence(name: Column, value: Column) -> Column:
    skip = (name == "") | rl(name, packs.ANALYTICS_COOKIE)
    return first_match(
        [(skip, F.lit(None)), (rl(name, packs.SESSION_COOKIE), "CONFIRMED"), (looks_like_token(value), "LIKELY")]
    )


def auth_parts(req_headers: Column) -> Column:
    """Array of (kind, name, value, confidence) of a request's credentials, in order."""
    def header_part(h):
        return F.struct(
            F.lit("HEADER").alias("kind"), F.trim(h["name"]).alias("name"), F.trim(nz(h["value"])).alias("value"),
            header_confidence(F.lower(F.trim(h["name"])), F.trim(nz(h["value"]))).alias("confidence"),
        )

    def cookie_part(c):
        return F.struct(
            F.lit("COOKIE").alias("kind"), c["name"].alias("name"), c["value"].alias("value"),
            cookie_confidence(c["name"], c["value"]).alias("confidence"),
        )

    parts = F.flatten(
        F.transform(
            req_headers,
            lambda h: F.when(
                F.lower(F.trim(h["name"])) == "cookie", F.transform(cookie_pairs(h["value"]), cookie_part)
            ).otherwise(F.array(header_part(h))),
        )
    )
    return F.filter(parts, lambda p: p["confidence"].isNotNull())
