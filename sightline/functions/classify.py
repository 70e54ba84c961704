"""Classification of names, values and finding types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import blank, first_match, has_any, nz, rl
from sightline.rules import packs


def looks_serialized(name: Column | None, value: Column) -> Column:
    v = F.trim(nz(value))
    hit = v.startswith("rO0") | rl(v, packs.KIND_PATTERNS["php"])
    if name is None:
        return hit
    return F.lower(nz(name)).isin("__viewstate", "__eventvalidation") | hit


def value_kind(value: Column) -> Column:
    """Shape of a parameter's example value; the first kind that fits wins."""
    v = F.regexp_replace(F.trim(nz(value)), "…$", "")
    v = F.when(v.contains("%"), F.coalesce(F.trim(F.try_url_decode(v)), v)).otherwise(v)
    k = packs.KIND_PATTERNS
    return first_match(
        [
            (blank(value) | (v == ""), ""),
            (looks_serialized(None, v), "serialized"),
            (rl(v, k["digits"]) & (F.length(v) >= 3), "numeric-id"),
            (rl(v, k["digits"]), "number"),
            (rl(v, k["uuid"]), "uuid"),
            (rl(v, k["jwt"]), "jwt"),
            (rl(v, k["url"]), "url"),
            (rl(v, k["email"]), "email"),
            (rl(v, k["path"]), "path"),
            ((F.length(v) % 4 == 0) & rl(v, k["base64"]), "base64"),
        ],
        "",
    )


def name_classes(name: Column) -> Column:
    return F.array_compact(F.array(*[F.when(rl(name, rx), F.lit(c)) for c, rx in packs.PARAM_CLASSES]))


def classes(name: Column, kind: Column) -> Column:
    implied = first_match([(kind == k, c) for k, c in packs.KIND_CLASS.items()])
    found = name_classes(name)
    return F.when(implied.isNull(), found).otherwise(F.array_distinct(F.array_append(found, implied)))


def in_class(name: Column, cls: str) -> Column:
    return rl(name, dict(packs.PARAM_CLASSES)[cls])


def category(ftype: Column) -> Column:
    t = F.lower(nz(ftype))
    flow = t.startswith("client flow")
    pairs = [
        (blank(ftype), "Other"),
        (flow & (t.contains("idor") | t.contains("no auth")), "Auth"),
        (flow, "API"),
    ]
    for how, words, cat in packs.TAXONOMY:
        cond = (
            reduce(lambda a, b: a | b, [t.startswith(w) for w in words]) if how == "prefix" else has_any(t, words)
        )
        pairs.append((cond, cat))
    return first_match(pairs, "Other")


def with_category(df: DataFrame, out: str = "category") -> DataFrame:
    return df.withColumn(out, category(F.col("type")))


def hint_for_type(ftype: Column) -> Column:
    t = F.lower(nz(ftype))
    return first_match([(t.contains(m), h) for m, h in packs.HINTS], "")


def own_hint(evidence: Column) -> Column:
    e = nz(evidence)
    at = F.locate("Try:", e)
    return F.when(at > 0, F.trim(F.substr(e, at + 4))).otherwise(F.lit(""))


def hint(ftype: Column, evidence: Column) -> Column:
    own = own_hint(evidence)
    return F.when(own != "", own).otherwise(hint_for_type(ftype))


def guide_for_class(cls: Column) -> Column:
    return F.when(cls.isin(packs.GUIDE_CLASSES), cls)


# Fixed values: (guide, words in a finding type), (guide, words in a content type)
GUIDE_BY_TYPE = [("XSS", ["reflected param"]), ("Open Redirect", ["open redirect"])]
GUIDE_BY_CONTENT = [("XXE", ["xml", "soap"])]


def guide_for_type(ftype: Column) -> Column:
    return first_match([(has_any(F.lower(nz(ftype)), words), g) for g, words in GUIDE_BY_TYPE])


def guide_for_content(content_type: Column) -> Column:
    return first_match([(has_any(F.lower(nz(content_type)), words), g) for g, words in GUIDE_BY_CONTENT])


def finding_value(ftype: Column, raw: Column, masked: Column, evidence: Column, sensitive: Column) -> Column:
    """Text shown as the value: masked match, else the evidence before its hint."""
    shown = F.when(masked != "", masked).otherwise(
        F.when(~sensitive, F.split_part(nz(evidence), F.lit("  |  Try: "), F.lit(1))).otherwise(F.lit(""))
    )
    v = F.trim(F.regexp_replace(shown, r"\s+", " "))
    return F.when((nz(raw) != "") & F.endswith(ftype, raw), F.lit("")).otherwise(v)
