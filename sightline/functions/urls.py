"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import blank, nz
from sightline.rules import packs


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def host_of(url: Column) -> Column:
    return nz(part(url, "HOST"))


def host_label(host: Column) -> Column:
    return F.when(blank(host), F.lit("(relative / JS)")).otherwise(host)


def port_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(nz(part(url, "AUTHORITY")), r":(\d{1,5})$", 1), F.lit(""))


def _percent_decode(c: Column) -> Column:
    """Percent escapes only: ``+`` stays as it is in a path."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def path_of(url: Column) -> Column:
    return nz(_percent_decode(part(url, "PATH")))


def port_suffix(scheme: Column, port: Column) -> Column:
    default = ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    return F.when(port.isNull() | (port == "0") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))


def param_names(params: Column, location: str | None = None) -> Column:
    kept = params if location is None else F.filter(params, lambda p: p["location"] == location)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["name"])))


def endpoint_path(url: Column, path: Column) -> Column:
    decoded = path_of(url)
    return F.when(decoded != "", decoded).otherwise(nz(path))


def normalized_url(url: Column, host: Column, path: Column, params: Column) -> Column:
    """scheme://host[:port]path[?sorted query names]"""
    scheme = F.coalesce(part(url, "PROTOCOL"), F.lit("http"))
    names = F.array_join(param_names(params, "QUERY"), "&")
    return F.concat(
        scheme, F.lit("://"), nz(host), port_suffix(scheme, port_of(url)), endpoint_path(url, path),
        F.when(nz(names) != "", F.concat(F.lit("?"), names)).otherwise(F.lit("")),
    )


def base_authority(url: Column) -> Column:
    scheme, host = part(url, "PROTOCOL"), part(url, "HOST")
    return F.when(
        scheme.isNotNull() & host.isNotNull(),
        F.concat(scheme, F.lit("://"), host, port_suffix(scheme, port_of(url))),
    ).otherwise(F.lit(""))


def route_path(link: Column) -> Column:
    """Path of a link found in code: no scheme, host, query or fragment; one leading slash.

    A chain of replacements without branches, so that the plan holds the link once.
    """
    p = F.trim(nz(link))
    for regex, by in (
        (r"(?s)\A(?:.*?://|//)[^/]*", ""),
        (r"(?s)[?#].*\z", ""),
        (r"\A\./", "/"),
        (r"\A(?!/)", "/"),
        (r"(?<=.)/+\z", ""),
    ):
        p = F.regexp_replace(p, regex, by)
    return p


def path_only(path: Column) -> Column:
    p = F.trim(nz(path))
    cut = F.regexp_replace(p, r"^https?://[^/]*", "")
    return F.when(p.rlike(r"^https?://"), F.when(cut == "", F.lit("/")).otherwise(cut)).otherwise(p)


def file_part(url: Column) -> Column:
    """Lower-cased last path segment."""
    return F.lower(F.regexp_extract(F.regexp_replace(nz(url), r"[?#].*$", ""), r"([^/]*)$", 1))


def is_static_route(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return ext.isin(packs.ROUTE_STATIC_EXTENSIONS)


def js_file_label(url: Column) -> Column:
    p = path_of(url)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return (
        F.when(blank(url), F.lit("(unknown)"))
        .when(blank(p) | p.endswith("/") | blank(name), url)
        .otherwise(name)
    )


def stored_file_name(url: Column, sha: Column) -> Column:
    """host_path, sanitised, at most 100 characters, and the start of the hash."""
    host = F.coalesce(part(url, "HOST"), F.lit("unknown"))
    raw = path_of(url)
    path = F.when(blank(raw), F.lit("root")).otherwise(raw)
    base = F.lower(F.concat(host, F.lit("_"), path))
    base = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9._-]", "_"), r"_+", "_")
    base = F.left(base, F.lit(100))
    stem = F.regexp_replace(base, r"\.js$", "")
    return F.concat(stem, F.lit("_"), F.left(sha, F.lit(8)), F.lit(".js"))
