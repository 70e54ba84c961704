"""Sessions seen in traffic, and rewriting of stored requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import checks
from sightline.functions.text import nz, rl
from sightline.operators.json_fields import let
from sightline.rules import packs


@dataclass(frozen=True)
class Identity:
    name: str
    headers: dict[str, str] = field(default_factory=dict)
    cookies: dict[str, str] = field(default_factory=dict)


def auth_part_rows(ex: DataFrame) -> DataFrame:
    return ex.select("seq", F.posexplode(checks.auth_parts(F.col("req_headers"))).alias("pos", "p")).select("seq", "pos", "p.*")


def _is_csrf(name: Column) -> Column:
    return F.lower(name).contains("csrf") | F.lower(name).contains("xsrf")


def _credential_key(parts: Column) -> Column:
    """Canonical text of the credential values without CSRF tokens: kind, name, value, sorted."""
    kept = F.filter(parts, lambda p: ~_is_csrf(p["name"]))
    text = F.transform(
        kept,
        lambda p: F.concat(p["kind"], F.lit(" "), F.when(p["kind"] == "HEADER", F.lower(p["name"])).otherwise(p["name"]), F.lit("="), p["value"]),
    )
    return F.array_join(F.array_sort(F.array_distinct(text)), "\n")


def _identity_key(i: Identity) -> str:
    rows = [f"HEADER {k.lower()}={v}" for k, v in i.headers.items()] + [f"COOKIE {k}={v}" for k, v in i.cookies.items()]
    return "\n".join(sorted(r for r in rows if "csrf" not in r.split("=")[0].lower() and "xsrf" not in r.split("=")[0].lower()))


def discover(ex: DataFrame, saved: list[Identity] = (), newest: int | None = None) -> DataFrame:
    """Sessions in the requests, or in the ``newest`` of them if asked: one row per (host, credential values)."""
    recent = ex.select("seq", "observed_at", "host", "path", "req_headers")
    if newest is not None:
        recent = recent.orderBy(F.desc("observed_at"), F.desc("seq")).limit(newest)
    parts = F.filter(checks.auth_parts(F.col("req_headers")), lambda p: p["confidence"] == "CONFIRMED")
    df = recent.withColumn("parts", parts).withColumn("cred", _credential_key(F.col("parts"))).where(F.col("cred") != "")
    g = df.groupBy("host", "cred").agg(
        F.count("*").alias("requests"),
        F.max(F.struct("observed_at", "seq", "path", "parts")).alias("m"),
    )
    known = F.lit("")
    for i in saved:
        known = F.when((F.col("cred") == _identity_key(i)) & (known == ""), F.lit(i.name)).otherwise(known)
    values = F.transform(F.col("m.parts"), lambda p: F.regexp_replace(p["value"], r"(?i)\Abearer\s+", ""))
    token = F.get(F.filter(values, lambda v: checks.is_jwt(v)), F.lit(0))
    out = g.select(
        "host", "requests", F.col("m.observed_at").alias("last_seen"), nz(F.col("m.path")).alias("sample_path"),
        F.array_join(F.transform("m.parts", lambda p: p["name"]), ", ").alias("credentials"),
        F.col("m.parts").alias("parts"), known.alias("registered_as"), checks.jwt_part(token, 2).alias("payload"),
    )
    return out.select(
        "host", "requests", "last_seen", "sample_path", "credentials", "parts", "registered_as",
        F.when(F.col("payload").isNotNull(), checks.token_subject(F.col("payload"))).alias("subject"),
        F.when(F.col("payload").isNotNull(), checks.token_expiry(F.col("payload"))).alias("expires"),
    ).orderBy(F.asc_nulls_first("host"), F.desc("last_seen"))


# --- rewriting ------------------------------------------------------------------------------


@dataclass(frozen=True)
class RewriteRule:
    mode: str  # HEADER | RAW | REMOVE_HEADER | COOKIE | REMOVE_COOKIE | STRIP_AUTH
    name: str = ""
    match: str = ""
    regex: bool = False
    replacement: str = ""
    add_if_missing: bool = False
    keep_headers: tuple[str, ...] = ()
    keep_cookies: tuple[str, ...] = ()
    keep_app_keys: bool = False


def _named(h: Column, name: str) -> Column:
    return F.lower(h["name"]) == name.lower()


def _has(headers: Column, name: str) -> Column:
    return F.exists(headers, lambda h: _named(h, name))


def _hdr(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"))


def _apply_text(text: Column, rule: RewriteRule) -> Column:
    if not rule.match:
        return F.lit(rule.replacement)
    if rule.regex:
        return F.regexp_replace(text, rule.match, rule.replacement)
    return F.replace(text, F.lit(rule.match), F.lit(rule.replacement))


def _map_header(headers: Column, name: str, fn) -> Column:
    return F.transform(headers, lambda h: F.when(_named(h, name), _hdr(h["name"], fn(h["value"]))).otherwise(h))


def _drop(headers: Column, name: str) -> Column:
    return F.filter(headers, lambda h: ~_named(h, name))


def _with_cookies(headers: Column, change) -> Column:
    """Change the cookie pairs; an emptied Cookie header goes away."""
    changed = _map_header(headers, "cookie", lambda v: checks.join_cookies(change(checks.cookie_pairs(v))))
    return F.filter(changed, lambda h: ~(_named(h, "cookie") & (h["value"] == "")))


def strip_auth(headers: Column, rule: RewriteRule = RewriteRule("STRIP_AUTH")) -> Column:
    """Remove confirmed credentials other than the kept ones."""
    keep_h = [k.lower() for k in rule.keep_headers]

    def drop_header(h: Column) -> Column:
        low = F.lower(F.trim(h["name"]))
        confirmed = checks.header_confidence(low, F.trim(nz(h["value"]))) == "CONFIRMED"
        gone = F.coalesce(confirmed, F.lit(False))
        if keep_h:
            gone = gone & ~low.isin(keep_h)
        if rule.keep_app_keys:
            gone = gone & ~rl(low, packs.APP_KEY_HEADER)
        return gone

    def keep_cookie(c: Column) -> Column:
        gone = F.coalesce(checks.cookie_confidence(c["name"], c["value"]) == "CONFIRMED", F.lit(False))
        return ~(gone & ~c["name"].isin(list(rule.keep_cookies))) if rule.keep_cookies else ~gone

    kept = F.filter(headers, lambda h: _named(h, "cookie") | ~drop_header(h))
    return _with_cookies(kept, lambda pairs: F.filter(pairs, keep_cookie))


def rewrite_headers(headers: Column, rules: list[RewriteRule]) -> Column:
    """Apply a chain to a header array; NULL as soon as one rule does not apply."""
    out = headers
    for r in rules:
        if r.mode == "STRIP_AUTH":
            out = strip_auth(out, r)
        elif r.mode == "REMOVE_HEADER":
            out = _drop(out, r.name)
        elif r.mode == "HEADER":
            if r.add_if_missing:
                added = F.concat(out, F.array(_hdr(F.lit(r.name), F.lit(r.replacement))))
            else:
                added = F.lit(None)
            out = F.when(_has(out, r.name), _rewrite_named(out, r)).otherwise(added)
        elif r.mode == "REMOVE_COOKIE":
            out = _with_cookies(out, _without(r.name))
        elif r.mode == "COOKIE":
            fresh = F.concat(out, F.array(_hdr(F.lit("Cookie"), F.lit(f"{r.name}={r.replacement}"))))
            out = F.when(_has(out, "cookie"), _with_cookies(out, _set_cookie(r))).otherwise(fresh)
    return out


def _rewrite_named(headers: Column, r: RewriteRule) -> Column:
    return _map_header(headers, r.name, lambda v: _apply_text(v, r))


def _without(name: str):
    return lambda pairs: F.filter(pairs, lambda c: c["name"] != name)


def _set_cookie(r: RewriteRule):
    def change(pairs: Column) -> Column:
        new = F.struct(F.lit(r.name).alias("name"), F.lit(r.replacement).alias("value"))
        return let(
            pairs,
            lambda ps: F.when(
                F.exists(ps, lambda c: c["name"] == r.name),
                F.transform(ps, lambda c: F.when(c["name"] == r.name, new).otherwise(c)),
            ).otherwise(F.concat(ps, F.array(new))),
        )

    return change


def raw_request(method: Column, path: Column, headers: Column, body: Column) -> Column:
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), nz(h["value"]))), "\r\n")
    return F.concat(method, F.lit(" "), path, F.lit(" HTTP/1.1\r\n"), lines, F.lit("\r\n\r\n"), nz(body))


def rewrite_requests(ex: DataFrame, rules: list[RewriteRule]) -> DataFrame:
    """Stored requests after a rule chain; rows a rule does not apply to have NULL headers.

    RAW rules work on the request text, which is added as ``raw``.
    """
    head = [r for r in rules if r.mode != "RAW"]
    df = ex.withColumn("req_headers", rewrite_headers(F.col("req_headers"), head))
    raws = [r for r in rules if r.mode == "RAW"]
    if raws:
        text = raw_request(F.col("method"), F.col("path"), F.col("req_headers"), F.col("req_body"))
        for r in raws:
            text = _apply_text(text, r)
        df = df.withColumn("raw", text)
    return df


NO_AUTH = [RewriteRule("REMOVE_HEADER", "Cookie"), RewriteRule("REMOVE_HEADER", "Authorization"), RewriteRule("STRIP_AUTH")]


def rules_for(i: Identity, keep_app_keys: bool = False) -> list[RewriteRule]:
    """Strip every other credential, then set this identity's own."""
    out = [RewriteRule("STRIP_AUTH", keep_headers=tuple(i.headers), keep_cookies=tuple(i.cookies), keep_app_keys=keep_app_keys)]
    out += [RewriteRule("HEADER", k, replacement=v, add_if_missing=True) for k, v in i.headers.items()]
    return out + [RewriteRule("COOKIE", k, replacement=v) for k, v in i.cookies.items()]


def identity_rewrite(ex: DataFrame, identities: list[Identity], keep_app_keys: bool = False) -> DataFrame:
    """Targets times identities: every request once per identity, with its credentials.

    The identities are a short list in the job's configuration, so each row is expanded
    in place; nothing is shuffled.
    """
    strip = RewriteRule("STRIP_AUTH", keep_app_keys=keep_app_keys)
    variants = [
        F.struct(F.lit("Original").alias("identity"), F.col("req_headers").alias("headers")),
        F.struct(F.lit("No auth").alias("identity"), rewrite_headers(F.col("req_headers"), NO_AUTH[:2] + [strip]).alias("headers")),
    ] + [
        F.struct(F.lit(i.name).alias("identity"), rewrite_headers(F.col("req_headers"), rules_for(i, keep_app_keys)).alias("headers"))
        for i in identities
    ]
    return ex.select("seq", "method", "host", "path", F.explode(F.array(*variants)).alias("v")).select(
        "seq", "method", "host", "path", F.col("v.identity").alias("identity"), F.col("v.headers").alias("req_headers")
    )


def rewrite_precheck(ex: DataFrame, in_scope: Column, rules: list[RewriteRule], identities: list[Identity], now: int) -> DataFrame:
    """Targets out of scope, rewrites that do not apply, identities with an expired token."""
    spark = ex.sparkSession
    done = rewrite_requests(ex.withColumn("_in", in_scope), rules)
    a = done.agg(
        F.count_if(~F.col("_in")).alias("out_of_scope"),
        F.count_if(F.col("_in") & F.col("req_headers").isNull()).alias("not_applicable"),
    )
    tokens = [v.split(" ", 1)[-1] for i in identities for v in list(i.headers.values()) + list(i.cookies.values())]
    exp = [checks.token_expiry(checks.jwt_part(F.lit(t), 2)) for t in tokens]
    expired = sum((F.when((e > 0) & (e <= now), 1).otherwise(0) for e in exp), F.lit(0))
    return a.withColumn("expired_tokens", expired.cast("bigint"))


def curl_text(method: Column, url: Column, headers: Column, body: Column) -> Column:
    q = lambda c: F.replace(nz(c), F.lit("'"), F.lit("'\\''"))
    hs = F.transform(
        F.filter(headers, lambda h: F.lower(h["name"]) != "content-length"),
        lambda h: F.concat(F.lit(" -H '"), q(F.concat(h["name"], F.lit(": "), nz(h["value"]))), F.lit("'")),
    )
    data = F.when(nz(body) != "", F.concat(F.lit(" --data '"), q(body), F.lit("'"))).otherwise(F.lit(""))
    return F.concat(F.lit("curl -X "), method, F.lit(" '"), q(url), F.lit("'"), F.array_join(hs, ""), data)
