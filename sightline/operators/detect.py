"""Passive detectors: each gives an array of finding structs for one exchange.

``prepare`` derives the columns the detectors share (header lookups, kinds, endpoint
key) once; ``events`` concatenates the arrays of all detectors and explodes once, so the
capture is read a single time however many detectors run.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.config import Settings
from sightline.functions import checks, headers, urls
from sightline.functions.classify import in_class
from sightline.functions.text import cut, first_match, nz, rl, whole
from sightline.operators import filters
from sightline.operators.json_fields import json_fields, let, shallow_names
from sightline.rules import js_packs, packs
from sightline.schemas import FINDING_DDL

TRY = "  |  Try: "


def prepare(ex: DataFrame) -> DataFrame:
    """Exchanges plus the derived columns detectors read; all are per-row expressions."""
    df = headers.with_header_names(ex)
    df = df.select(
        "*",
        headers.req("authorization").alias("rq_auth"),
        headers.req("cookie").alias("rq_cookie"),
        headers.req("origin").alias("rq_origin"),
        headers.req("content-type").alias("rq_ct"),
        F.col("status").isNotNull().alias("has_resp"),
        F.coalesce("status", F.lit(0)).alias("st"),
        nz(F.col("content_type")).alias("ct"),
        F.upper(nz(F.col("method"))).alias("verb"),
        urls.endpoint_path(F.col("url"), F.col("path")).alias("ep_path"),
        urls.normalized_url(F.col("url"), F.col("host"), F.col("path"), F.col("params")).alias("nurl"),
        nz(F.col("resp_body")).alias("body"),
    )
    return df.select(
        "*",
        (F.col("rq_auth").isNotNull() | F.col("rq_cookie").isNotNull()).alias("authed"),
        filters.is_html(F.col("ct")).alias("is_html"),
        filters.is_json(F.col("ct")).alias("is_json"),
        filters.is_javascript(F.col("url"), F.col("ct")).alias("is_js"),
        F.concat(F.col("verb"), F.lit(" "), F.col("nurl")).alias("ep_key"),
        urls.route_path(F.col("ep_path")).alias("ep_route"),
        urls.path_of(F.col("url")).alias("url_path"),
        urls.host_of(F.col("url")).alias("url_host"),
    ).select(
        "*",
        route_rule(F.col("ep_route")).alias("ep_route_rule"),
        auth_flow_name(F.col("ep_path")).alias("ep_flow"),
    )


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(ftype, severity, raw, location, evidence, sensitive=False) -> Column:
    return F.struct(
        _c(ftype).alias("type"), _c(severity).alias("severity"), _c(raw).alias("raw_match"),
        _c(location).alias("location"), _c(evidence).alias("evidence"), _c(sensitive).alias("sensitive"),
    )


def none() -> Column:
    return F.array().cast(f"array<{FINDING_DDL}>")


def some(*pairs) -> Column:
    """Array of the findings whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, f) for c, f in pairs]))


def gate(cond: Column, arr: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), arr).otherwise(none())


def note(text: str) -> str:
    return f"{TRY}{text}" if text else ""


# --- rule scans -----------------------------------------------------------------------


def sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_sql(text: str, rule, location: str, sensitive: bool, group: int) -> str:
    tail = sql_str(note(rule.note))
    shown = f"ltrim({tail})" if sensitive else f"concat(if(length(m) > 160, concat(left(m, 160), '…'), m), {tail})"
    hits = (
        f"transform(regexp_extract_all({text}, {sql_str(rule.regex)}, {group}), m -> named_struct("
        f"'type', {sql_str(rule.name)}, 'severity', '{rule.severity}', 'raw_match', m, 'location', {location}, "
        f"'evidence', {shown}, 'sensitive', {str(sensitive).lower()}))"
    )
    groups = ([(text, rule.guard)] if rule.guard else []) + [("lowered", words) for words in rule.folded]
    if groups:
        seen = " AND ".join("(" + " OR ".join(f"contains({t}, {sql_str(w)})" for w in words) + ")" for t, words in groups)
        return f"if({seen}, {hits}, CAST(array() AS array<{FINDING_DDL}>))"
    return hits


def scan_sql(text: str, rules, location: str = "url", sensitive: bool = True, group: int = 0) -> str:
    """The text is lower-cased once for all rules that are met in any case (see ``let``)."""
    found = "concat(" + ", ".join(_rule_sql(text, r, location, sensitive, group) for r in rules) + ")"
    return f"get(transform(array(lower({text})), lowered -> {found}), 0)" if any(r.folded for r in rules) else found


def scan_rules(text: str, rules, location: str = "url", sensitive: bool = True, group: int = 0) -> Column:
    """All matches of every rule; literals a match must contain are tested first."""
    return F.expr(scan_sql(text, rules, location, sensitive, group))


def secret_scan() -> Column:
    return gate(F.col("has_resp") & ~F.col("is_js"), scan_rules("body", packs.SECRETS))


def signature_scan() -> Column:
    return gate(F.col("has_resp"), scan_rules("body", packs.SIGNATURES, sensitive=False))


def authz_scan() -> Column:
    return gate(F.col("has_resp"), scan_rules("body", packs.AUTHZ, sensitive=False))


def user_rules(rules) -> Column:
    return gate(F.col("has_resp"), scan_rules("body", rules))


def _pii_matches(regex: str) -> Column:
    return F.regexp_extract_all(F.col("body"), F.lit(regex), F.lit(0))


def _pii_ok() -> Column:
    return F.col("has_resp")


def pii_rrn() -> Column:
    good = F.filter(_pii_matches(packs.RRN), lambda m: checks.valid_rrn(F.replace(m, F.lit("-"), F.lit(""))))
    return gate(_pii_ok(), F.transform(good, lambda m: finding(packs.RRN_TYPE, "HIGH", m, F.col("url"), "", True)))


def pii_card() -> Column:
    good = F.filter(_pii_matches(packs.CARD), lambda m: checks.plausible_card(F.translate(m, " -", "")))
    return gate(
        _pii_ok(), F.transform(good, lambda m: finding(packs.CARD_TYPE, "HIGH", F.trim(m), F.col("url"), "", True))
    )


def pii_phone() -> Column:
    return gate(
        _pii_ok() & F.col("body").contains("01"),
        F.transform(
            _pii_matches(packs.PHONE_KR), lambda m: finding(packs.PHONE_TYPE, "LOW", m, F.col("url"), "", True)
        ),
    )


# --- response headers -------------------------------------------------------------------


def cors() -> Column:
    acao, acac = headers.resp("access-control-allow-origin"), headers.resp("access-control-allow-credentials")
    acam, acah = headers.resp("access-control-allow-methods"), headers.resp("access-control-allow-headers")
    url, origin, t = F.col("url"), F.col("rq_origin"), F.trim(acao)
    cred = F.lower(nz(acac)) == "true"
    star = t == "*"
    reflected = origin.isNotNull() & (F.lower(origin) == F.lower(t))
    first = F.when(star & cred, finding("CORS wildcard +creds", "HIGH", "acao=*|cred", url, "any origin may read, with credentials"))
    first = first.when(
        reflected & cred,
        finding("CORS reflected +creds", "HIGH", F.concat(F.lit("acao=reflected|"), acao), url, "the asking origin is echoed, with credentials"),
    )
    first = first.when(star, finding("CORS wildcard", "LOW", "acao=*", url, "any origin may read"))
    first = first.when(
        reflected, finding("CORS reflected", "LOW", F.concat(F.lit("acao=reflected|"), acao), url, "the asking origin is echoed")
    )
    first = first.when(
        origin.isNull(),
        finding(
            "CORS ACAO without Origin request", "LOW", F.concat(F.lit("acao=no-origin|"), acao), url,
            F.concat(F.lit("ACAO="), acao, F.lit(", although the request named no origin")),
        ),
    )
    vary = F.lower(nz(headers.resp("vary"))).contains("origin")
    rest = [
        F.when(nz(acam).contains("*"), finding("CORS wildcard Allow-Methods", "LOW", "acam=*", url, F.concat(F.lit("Access-Control-Allow-Methods: "), acam))),
        F.when(nz(acah).contains("*"), finding("CORS wildcard Allow-Headers", "LOW", "acah=*", url, F.concat(F.lit("Access-Control-Allow-Headers: "), acah))),
        F.when(~star & reflected & ~vary, finding("CORS reflected without Vary: Origin", "LOW", F.concat(F.lit("acao=novary|"), acao), url, "the asking origin is echoed, and caches are not told (Vary)")),
    ]
    return gate(F.col("has_resp") & acao.isNotNull(), F.array_compact(F.array(first, *rest)))


def _set_cookies() -> Column:
    return headers.values_of(F.col("resp_headers"), "set-cookie")


def cookie_flags() -> Column:
    url, host = F.col("url"), nz(F.col("host"))

    def flags(sc: Column) -> Column:
        name, low = checks.cookie_name(sc), F.lower(sc)

        def miss(word: str, label: str, sev: str):
            return (
                ~low.contains(word),
                finding(f"Cookie no {label}", sev, F.concat(host, F.lit("|"), name, F.lit(f"|{word}")), url, F.concat(name, F.lit(f": no {label}"))),
            )

        return some(miss("httponly", "HttpOnly", "LOW"), miss("secure", "Secure", "LOW"), miss("samesite", "SameSite", "INFO"))

    return gate(F.col("has_resp"), F.flatten(F.transform(_set_cookies(), flags)))


def cookie_secrets() -> Column:
    values = "transform(filter(resp_headers, h -> lower(h.name) = 'set-cookie'), h -> trim(regexp_extract(h.value, '^[^=]*=([^;]*)', 1)))"
    return gate(
        F.col("has_resp") & F.array_contains("rs_names", "set-cookie"),
        F.expr(f"flatten(transform({values}, v -> {scan_sql('v', packs.SECRETS)}))"),
    )


def csp() -> Column:
    value = headers.resp("content-security-policy")
    low, host, url = F.lower(nz(value)), nz(F.col("host")), F.col("url")
    script = low.contains("script-src") | low.contains("default-src")
    wildcard = F.exists(
        F.split(low, ";"),
        lambda d: F.trim(d).rlike(r"^(?:script-src|default-src)") & F.array_contains(F.split(F.trim(d), r"\s+"), "*"),
    )

    def f(cond, label, sev, issue, ev):
        return (cond, finding(label, sev, F.concat(host, F.lit(f"|csp|{issue}")), url, ev))

    return gate(
        F.col("has_resp") & (F.trim(nz(value)) != ""),
        some(
            f(script & low.contains("'unsafe-inline'"), "CSP unsafe-inline", "MEDIUM", "unsafe-inline", "unsafe-inline"),
            f(script & low.contains("'unsafe-eval'"), "CSP unsafe-eval", "MEDIUM", "unsafe-eval", "unsafe-eval"),
            f(wildcard, "CSP wildcard src", "MEDIUM", "wildcard", "wildcard src"),
            f(~low.contains("frame-ancestors"), "CSP no frame-ancestors", "LOW", "frame-ancestors", "no frame-ancestors"),
            f(~low.contains("object-src") & ~low.contains("default-src"), "CSP no object-src", "LOW", "object-src", "no object-src"),
        ),
    )


def cacheable() -> Column:
    cc = headers.resp("cache-control")
    low = F.lower(nz(cc))
    safe = low.contains("no-store") | low.contains("private") | low.contains("no-cache")
    return some(
        (
            (F.col("st") == 200) & F.col("authed") & F.col("is_json") & ~safe,
            finding(
                "Sensitive response cacheable", "LOW", F.concat(nz(F.col("host")), F.lit("|cache|"), F.col("url")), F.col("url"),
                F.when(cc.isNull(), F.lit("no Cache-Control")).otherwise(F.concat(F.lit("Cache-Control: "), cc)),
            ),
        )
    )


def missing_header_names() -> Column:
    wanted = F.array(*[F.lit(h) for h in packs.SECURITY_HEADERS])
    return F.filter(wanted, lambda h: ~F.array_contains(F.col("rs_names"), F.lower(h)))


def missing_headers() -> Column:
    miss = missing_header_names()
    return some(
        (
            F.col("has_resp") & F.col("is_html") & (F.trim(nz(F.col("host"))) != "") & (F.size(miss) > 0),
            finding(
                "Missing security headers", "LOW", F.concat(F.lit("missing-headers|"), F.col("host")),
                F.concat(F.lit("https://"), F.col("host")), F.array_join(miss, ", "),
            ),
        )
    )


def technologies() -> Column:
    """Array of technology labels for one response."""
    jar = F.concat(F.array_join(_set_cookies(), "\n"), F.when(F.array_contains("rs_names", "set-cookie"), F.lit("\n")).otherwise(F.lit("")))
    out = []
    for where, header, regex, label in packs.TECH_RULES:
        if where == "header":
            text = headers.resp(header)
            cond = text.isNotNull() & (text != "") & rl(text, regex)
        elif where == "cookie":
            text, cond = jar, rl(jar, regex)
        else:
            text = F.col("body")
            cond = F.col("is_html") & rl(text, regex)
        if "$1" in label:
            pre, post = label.split("$1")
            value = F.trim(F.concat(F.lit(pre), F.trim(F.regexp_extract(text, regex, 1)), F.lit(post)))
        else:
            value = F.lit(label)
        out.append(F.when(cond, value))
    return F.when(
        F.col("has_resp") & (F.trim(nz(F.col("host"))) != ""), F.array_distinct(F.array_compact(F.array(*out)))
    ).otherwise(F.array().cast("array<string>"))


# --- requests ---------------------------------------------------------------------------


def exposed_files() -> Column:
    p, url = F.col("url_path"), F.col("url")
    ok = F.col("st").between(200, 299)
    served = F.concat(F.lit("served: "), p)
    return F.array_compact(
        F.array(
            F.when(ok & rl(p, packs.SENSITIVE_FILE), finding("Exposed sensitive file", "HIGH", F.concat(F.lit("file|"), url), url, served))
            .when(ok & rl(p, packs.BACKUP_FILE), finding("Exposed backup file", "MEDIUM", F.concat(F.lit("backup|"), url), url, served))
        )
    )


def mixed_content() -> Column:
    url = F.col("url")
    return some(
        (
            F.col("has_resp") & F.col("is_html") & url.startswith("https://") & rl(F.col("body"), packs.MIXED_CONTENT),
            finding("Mixed content", "LOW", F.concat(F.lit("mixed|"), F.col("url_host")), url, "a page over https loads parts over http"),
        )
    )


def param_leads() -> Column:
    """Secret in URL, open redirect or reflection: the first that applies per parameter."""
    url, host, path = F.col("url"), F.col("url_host"), F.col("url_path")
    target = headers.resp("location")
    quote = lambda n, tail: F.concat(F.lit("'"), n, F.lit(tail))

    def lead(p: Column) -> Column:
        n, v, loc = p["name"], p["value"], p["location"]
        secret = (loc == "QUERY") & (in_class(n, "Secret/Token") | checks.is_jwt(v) | checks.high_entropy(v))
        redirect = (
            F.col("st").between(300, 399) & (F.trim(nz(target)) != "") & (F.length(v) >= 4)
            & in_class(n, "Redirect/SSRF") & target.contains(v)
        )
        distinctive = v.rlike(r"""[<>"'();{}=]""") | ((F.length(v) >= 10) & v.rlike(r"\P{L}"))
        reflected = (
            F.col("is_html") & (F.length(v) >= 6) & loc.isin("QUERY", "BODY") & distinctive & F.col("body").contains(v)
        )
        return F.when(
            F.coalesce(secret, F.lit(False)),
            finding("Secret in URL", "MEDIUM", F.concat(host, F.lit("|"), n), url, quote(n, "' in URL")),
        ).when(
            F.coalesce(redirect, F.lit(False)),
            finding("Open redirect (candidate)", "MEDIUM", F.concat(host, F.lit("|"), path, F.lit("|"), n), url, quote(n, "' → Location")),
        ).when(
            F.coalesce(reflected, F.lit(False)),
            finding("Reflected param (XSS?)", "INFO", F.concat(host, F.lit("|"), path, F.lit("|"), n), url, quote(n, "' reflected")),
        )

    named = F.filter("params", lambda p: p["name"].isNotNull())
    return gate(
        F.col("has_resp"), F.array_compact(F.transform(named, lead))
    )


def route_rule(p: Column, part: str = "name") -> Column:
    """Name, severity or note of the first sensitive-route family of a route path."""
    get = {"name": lambda r: r.name, "severity": lambda r: r.severity, "note": lambda r: r.note}[part]
    return F.when(~urls.is_static_route(p), first_match([(rl(p, r.regex), get(r)) for r in js_packs.ROUTES]))


ACCESS_TRY = "confirm the answer with another account and with none"


def unauth_access() -> Column:
    rule = F.regexp_replace(F.col("ep_route_rule"), "^" + js_packs.ROUTE_PREFIX, "")
    ok = (
        ~F.col("authed") & F.col("st").between(200, 299) & (F.col("st") != 204)
        & ~F.col("verb").isin("OPTIONS", "HEAD")
    )
    label = F.coalesce(rule, F.when(filters.is_api(F.col("ct")), F.lit("API")))
    sev = F.when(rule.isNotNull(), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    ev = F.concat(F.lit("HTTP "), F.col("st").cast("string"), F.lit(" to "), F.col("verb"),
                  F.lit(" answered a request that carried no credentials" + note(ACCESS_TRY)))
    return some((ok & label.isNotNull(), finding(F.concat(F.lit("Unauthenticated access: "), label), sev, F.col("ep_key"), F.col("nurl"), ev)))


def auth_flow_name(path: Column) -> Column:
    return first_match([(rl(path, "(?i)" + rx), n) for n, rx, _ in packs.AUTH_FLOWS])


def csrf() -> Column:
    ct = F.lower(nz(F.col("rq_ct")))
    json = ct.contains("json")
    simple = (F.trim(ct) == "") | ct.contains("x-www-form-urlencoded") | ct.contains("multipart/form-data") | ct.startswith("text/plain")
    token = F.exists("rq_names", lambda n: whole(n, packs.CSRF_HEADERS)) | F.exists(
        F.filter("params", lambda p: (p["location"] != "COOKIE") & p["name"].isNotNull()),
        lambda p: whole(p["name"], packs.CSRF_TOKEN_NAMES),
    )
    flow = nz(F.col("ep_flow"))
    kind = F.when(json, F.lit("JSON")).when(F.trim(ct) == "", F.lit("no body type")).otherwise(F.trim(F.split_part(ct, F.lit(";"), F.lit(1))))
    cond = (
        (F.col("verb") == "POST") & F.col("rq_cookie").isNotNull() & F.col("rq_auth").isNull()
        & F.col("st").between(200, 399) & ~token & ~flow.isin("login", "signup") & (json | simple)
    )
    ev = F.concat(F.lit("a cookie alone carries this POST ("), kind, F.lit("); no token and no custom header guards it" + note("confirm that a cross-site submission is refused")))
    return some((cond, finding("CSRF candidate", F.when(json, F.lit("INFO")).otherwise(F.lit("LOW")), F.concat(F.lit("POST "), F.col("nurl")), F.col("nurl"), ev)))


def upload() -> Column:
    head = nz(F.col("req_body"))
    file = F.trim(F.regexp_extract(head, packs.FILE_PART, 1))
    ev = F.concat(
        F.lit("multipart file part"),
        F.when(file == "", F.lit("")).otherwise(F.concat(F.lit(' (filename "'), file, F.lit('")'))),
        F.lit(note("confirm that type, name and size are checked on the server")),
    )
    return some((
        F.lower(nz(F.col("rq_ct"))).contains("multipart/") & rl(head, packs.FILE_PART),
        finding("File upload endpoint", "INFO", F.col("ep_key"), F.col("nurl"), ev),
    ))


def auth_flow() -> Column:
    name = F.col("ep_flow")
    hint = first_match([(name == n, note(t)) for n, _, t in packs.AUTH_FLOWS], "")
    limited = F.exists("rs_names", lambda n: whole(n, packs.RATE_LIMIT_HEADERS))
    ev = F.concat(
        F.col("verb"), F.lit(" to a "), name, F.lit(" endpoint (HTTP "), F.col("st").cast("string"), F.lit(")"),
        F.when(limited, F.lit("")).otherwise(F.lit("; the answer names no request limit")), hint,
    )
    return some((
        F.col("verb").isin("POST", "PUT") & (F.col("st") != 0) & name.isNotNull(),
        finding(F.concat(F.lit("Auth flow endpoint: "), name), "INFO", F.col("ep_key"), F.col("nurl"), ev),
    ))


# --- JSON bodies ----------------------------------------------------------------------------

def _json_2xx() -> Column:
    return F.col("is_json") & F.col("st").between(200, 299)


def sensitive_fields() -> Column:
    def ok(f: Column) -> Column:
        v = f["value"]
        return v.isNotNull() & ~rl(v, r"\A[*xX•# ]*\z") & (F.trim(v) != "")

    def lead(f: Column) -> Column:
        ev = F.concat(F.lit("'"), f["name"], F.lit("' returned with a "), F.length(f["value"]).cast("string"),
                      F.lit("-char value" + note("remove the field from the response")))
        return finding(F.concat(F.lit("Sensitive field in response: "), f["name"]), "MEDIUM", F.col("nurl"), F.col("nurl"), ev)

    hits = F.filter(json_fields(F.col("body"), packs.SENSITIVE_FIELDS.strip("^$")), ok)
    return gate(_json_2xx(), F.transform(hits, lead))


def _plain(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", ""))


def mass_assignment() -> Column:
    sent = F.transform(json_fields(nz(F.col("req_body"))), lambda f: _plain(f["name"]))
    privileged = F.filter(shallow_names(F.col("body")), lambda n: whole(n, packs.PRIVILEGED_FIELDS))
    got = let(
        sent,
        lambda names: F.filter(privileged, lambda n: (F.size(names) > 0) & ~F.array_contains(names, _plain(n))),
    )

    def lead(n: Column) -> Column:
        ev = F.concat(F.col("verb"), F.lit(" answered with '"), n, F.lit("', a field that the request left out" + note("confirm that the server ignores it when sent")))
        return finding(F.concat(F.lit("Mass assignment candidate: "), n), "LOW", F.col("ep_key"), F.col("nurl"), ev)

    cond = _json_2xx() & F.col("verb").isin("POST", "PUT", "PATCH") & filters.is_json(F.col("rq_ct"))
    return gate(cond, F.transform(got, lead))


# --- comments, source maps, API surface ------------------------------------------------------


def comment_hits(text: Column, comment: tuple[str, str, str], ftype: str, location: Column) -> Column:
    """``comment``: expression, what opens it and what closes it."""
    regex, opening, closing = comment
    ends = len(opening) + len(closing)
    whole = F.filter(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: m.endswith(closing) & (F.length(m) >= ends))
    found = F.transform(whole, lambda m: F.substr(m, F.lit(len(opening) + 1), F.length(m) - ends))
    trimmed = F.transform(found, lambda m: F.regexp_replace(m, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""))
    kept = F.filter(trimmed, lambda t: (F.length(t) >= 4) & t.rlike(packs.COMMENT_INTERESTING))
    return F.transform(
        kept, lambda t: finding(ftype, "INFO", F.sha2(F.concat(F.lit(ftype), t), 256), location, cut(t, 300))
    )


def html_comments() -> Column:
    cond = F.col("has_resp") & F.col("is_html") & F.col("body").contains("<!--")
    return gate(cond, comment_hits(F.col("body"), packs.HTML_COMMENT, "HTML Comment", F.col("url")))


def js_comments(body: Column, url: Column) -> Column:
    return F.concat(
        gate(body.contains("/*"), comment_hits(body, packs.JS_BLOCK_COMMENT, "JS Comment", url)),
        gate(body.contains("//"), comment_hits(body, packs.JS_LINE_COMMENT, "JS Comment", url)),
    )


def resolve_ref(base: Column, ref: Column) -> Column:
    """Relative reference against a base URL (path references and absolute ones)."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)", 1)
    joined = F.concat(folder, F.regexp_replace(ref, r"^(?:\./)+", ""))
    up = joined
    for _ in range(6):
        up = F.regexp_replace(up, r"(?<=[^/:]/)(?!\.\./)[^/]+/\.\./", "")
    return (
        F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(up)
    )


def sourcemap_refs(body: Column, url: Column) -> Column:
    ref = F.trim(F.regexp_extract(body, packs.SOURCE_MAP_REF, 1))
    prefix = F.when(ref.contains(","), F.regexp_extract(ref, r"^([^,]*,)", 1)).otherwise(ref)
    inline_ev = F.concat(F.lit("embedded "), cut(prefix, 60), F.lit(", "), F.length(ref).cast("string"), F.lit(" chars in body"))
    resolved = resolve_ref(url, ref)
    return gate(
        body.contains("sourceMappingURL") & (ref != ""),
        F.array(
            F.when(
                F.lower(ref).startswith("data:"),
                finding("Inline source map exposed", "MEDIUM", F.concat(F.lit("sourcemap-inline|"), url), url, cut(inline_ev, 300)),
            ).otherwise(
                finding("Source map reference exposed", "LOW", F.concat(F.lit("sourcemap-ref|"), resolved), url,
                        cut(F.concat(F.lit("sourceMappingURL="), ref, F.lit(" → "), resolved, F.lit(" (not fetched)")), 300))
            )
        ),
    )


def sourcemap_exposed() -> Column:
    body, url = F.col("body"), F.col("url")
    plain = F.regexp_replace(F.lower(nz(url)), r"[?#].*$", "")
    is_map = plain.endswith(".map")
    shaped = (
        F.ltrim(body).startswith("{") & body.contains('"version"') & body.contains('"sources"') & body.contains('"mappings"')
    )
    v = F.try_parse_json(body)
    sources = F.try_variant_get(v, "$.sources", "array<variant>")
    mapping = F.try_variant_get(v, "$.mappings", "variant")
    text_mapping = F.schema_of_variant(mapping) == "STRING"
    sample = F.array_join(
        F.slice(F.filter(F.transform(sources, lambda s: F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string"))), lambda s: s.isNotNull()), 1, 3), ", "
    )
    # a document that the parser refuses (too large or too deep) is judged by its shape
    parsed = v.isNotNull()
    ev_small = F.concat(F.size(sources).cast("string"), F.lit(" original sources: "), sample)
    ev_big = F.concat(F.lit("valid source map, "), F.length(body).cast("string"), F.lit(" characters long; its sources were not listed"))
    raw = F.concat(F.lit("sourcemap|"), url)
    looked = F.col("has_resp") & (body != "") & (is_map | shaped)
    return some(
        (looked & sources.isNotNull() & text_mapping, finding("Source map exposed", "MEDIUM", raw, url, cut(ev_small, 300))),
        (looked & ~parsed & shaped & F.rtrim(body).endswith("}"), finding("Source map exposed", "MEDIUM", raw, url, ev_big)),
    )


def graphql_endpoint() -> Column:
    url = F.col("url")
    key = F.when(F.col("url_host") == "", url).otherwise(F.col("url_host"))
    jsonish = F.col("is_json") | F.ltrim(F.col("body")).startswith("{")
    looked = F.col("has_resp") & (F.col("body") != "")
    schema = jsonish & F.col("body").contains('"__schema"') & F.col("body").contains('"types"')
    return some(
        (looked & F.lower(url).contains("graphql"), finding("GraphQL endpoint", "INFO", F.concat(F.lit("graphql|"), key), url, "graphql")),
        (looked & schema, finding("GraphQL introspection enabled", "MEDIUM", F.concat(F.lit("gql-introspection|"), key), url, "introspection on")),
    )


# --- the plan -----------------------------------------------------------------------------------


def static_filter(ex: DataFrame, settings: Settings) -> DataFrame:
    return ex.where(~filters.is_static_asset(F.col("url"), F.col("content_type"))) if settings.ignore_static_assets else ex


def detector_columns(settings: Settings) -> list[Column]:
    out = []
    if settings.run_passive_checks:
        out += [unauth_access(), auth_flow(), csrf(), upload()]
    if settings.scan_secrets:
        out.append(secret_scan())
        if settings.user_rules:
            out.append(user_rules(settings.user_rules))
    out += [missing_headers(), graphql_endpoint(), sourcemap_exposed()]
    if settings.run_passive_checks:
        out += [
            signature_scan(), authz_scan(), pii_rrn(), pii_card(), pii_phone(), exposed_files(), mixed_content(),
            param_leads(), sensitive_fields(), mass_assignment(), cors(), cookie_flags(), csp(), cacheable(),
            html_comments(),
        ]
        if settings.scan_secrets:
            out.append(cookie_secrets())
    return out


EVENT_COLS = ["seq", "ord", "type", "severity", "raw_match", "location", "evidence", "sensitive"]


def explode_findings(df: DataFrame, *arrays: Column) -> DataFrame:
    """One row per finding; ``ord`` is its place within the exchange."""
    arr = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return df.select("seq", F.posexplode(arr).alias("ord", "f")).select("seq", "ord", "f.*")


def events(prepared: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Finding events of the network detectors (JWT and JavaScript have their own)."""
    return explode_findings(prepared, *detector_columns(settings))
