"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Expressions that RE2 does not take (look-around, large repetition bounds) are restated.
"""

from __future__ import annotations

from oracle.dialect import adapter_sql, capture_sql
from sightline.rules import js_packs as jp
from sightline.rules import packs as pk

NET = ("events", "pages", "documents")
SQL: dict[str, str] = {}


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def m(text: str, regex: str) -> str:
    return f"coalesce(regexp_matches({text}, {s(regex)}), false)"


def h(lst: str, name: str) -> str:
    return f"(list_filter({lst}, lambda h: lower(h.name) = '{name}')[1]).value"


def inlist(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def chain(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def host(url: str) -> str:
    ok = f"NOT regexp_matches({url}, '[<> \"{{}}|\\\\^`]')"
    return f"CASE WHEN {ok} THEN regexp_extract({url}, '^[a-z]+://([^/:?#]+)', 1) ELSE '' END"


def route(x: str) -> str:
    a = f"regexp_replace(trim({x}), '^(.*?://|//)[^/]*', '', 's')"
    b = f"regexp_replace({a}, '[?#].*$', '', 's')"
    c = f"regexp_replace({b}, '^\\./', '/')"
    d = f"(CASE WHEN starts_with({c}, '/') THEN {c} ELSE '/' || {c} END)"
    return f"regexp_replace({d}, '(.)/+$', '\\1')"


def mask(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({x}) <= 8 THEN left({x}, 1) || '***' ELSE left({x}, 4) || '…' || right({x}, 4) END"


def flow_name(path: str) -> str:
    return chain([(m(path, "(?i)" + rx), s(n)) for n, rx, _ in pk.AUTH_FLOWS])


def route_rule(r: str) -> str:
    ext = f"lower(regexp_extract({r}, '\\.([^./]*)$', 1))"
    return f"CASE WHEN {ext} IN {inlist(pk_route_ext())} THEN NULL ELSE {chain([(m(r, x.regex), s(x.name)) for x in jp.ROUTES])} END"


def pk_route_ext():
    return pk.ROUTE_STATIC_EXTENSIONS


def is_js(url: str, ct: str) -> str:
    p = f"split_part(lower({url}), '?', 1)"
    return f"(contains(lower({ct}), 'javascript') OR contains(lower({ct}), 'ecmascript') OR ends_with({p}, '.js') OR ends_with({p}, '.mjs'))"


def static(url: str, ct: str) -> str:
    ext = f"regexp_extract(split_part(lower({url}), '?', 1), '\\.([^.]*)$', 1)"
    return f"(regexp_matches(lower({ct}), '^(?:image|font|audio|video)/') OR contains(lower({ct}), 'text/css') OR {ext} IN {inlist(pk.STATIC_EXTENSIONS)})"


def pe(*parts, where: str = "true") -> str:
    """Prepared exchanges as a CTE list ending in ``pe``."""
    names = "array_to_string(list_sort(list_distinct(list_transform(list_filter(params, lambda p: p.location = 'QUERY'), lambda p: p.name))), '&')"
    return f"""ex AS MATERIALIZED (SELECT * FROM ({capture_sql(*(parts or NET))}) q WHERE {where}),
p0 AS (SELECT *, {h('req_headers', 'authorization')} AS rq_auth, {h('req_headers', 'cookie')} AS rq_cookie, {h('req_headers', 'origin')} AS rq_origin,
  {h('req_headers', 'content-type')} AS rq_ct, status IS NOT NULL AS has_resp, coalesce(status, 0) AS st, coalesce(content_type, '') AS ct,
  upper(method) AS verb, coalesce(resp_body, '') AS body, NOT regexp_matches(url, '[<> "{{}}|\\\\^`]') AS uri_ok,
  regexp_extract(url, '^([a-z]+)://', 1) AS sch, regexp_extract(url, '^[a-z]+://[^/:?#]+:([0-9]+)', 1) AS prt, {names} AS qn
  FROM ex),
p1 AS (SELECT *, CASE WHEN uri_ok THEN url_decode(replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '+', '%2B')) ELSE '' END AS url_path,
  CASE WHEN uri_ok THEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) ELSE '' END AS url_host, (rq_auth IS NOT NULL OR rq_cookie IS NOT NULL) AS authed,
  contains(lower(ct), 'html') AS is_html, contains(lower(ct), 'json') AS is_json, {is_js('url', 'ct')} AS is_js
  FROM p0),
p2 AS (SELECT *, CASE WHEN url_path <> '' THEN url_path ELSE path END AS ep_path FROM p1),
p3 AS (SELECT *, CASE WHEN uri_ok THEN sch ELSE 'http' END || '://' || host
  || CASE WHEN NOT uri_ok OR prt = '' OR (sch = 'http' AND prt = '80') OR (sch = 'https' AND prt = '443') THEN '' ELSE ':' || prt END
  || ep_path || CASE WHEN coalesce(qn, '') <> '' THEN '?' || qn ELSE '' END AS nurl FROM p2),
pe AS MATERIALIZED (SELECT *, verb || ' ' || nurl AS ep_key, {flow_name('ep_path')} AS ep_flow, {route_rule(route('ep_path'))} AS ep_rule FROM p3)"""


def ipe(*parts) -> str:
    """Prepared exchanges of an inventory: static assets are left out."""
    return pe(*parts, where="NOT " + static("url", "coalesce(content_type, '')"))


# --- rule scans ---------------------------------------------------------------------------
RE2 = {
    "Java Stack Trace": (r"(?:^|[^\w.$])([\w.$]{1,100}?(?:Exception|Error)(?::[^\n]{0,300})?\n(?:\s{0,20}at\s{1,20}[\w.$]{1,160}\([^)\n]{0,200}\)\n){2,})", 1),
    "JWT": (r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", 0),
}


def scan(rules, cond: str, text: str = "body", loc: str = "url", src: str = "pe") -> str:
    out = []
    for r in rules:
        rx, g = RE2.get(r.name, (r.regex, 0))
        out.append(f"SELECT seq, {s(r.name)} AS type, '{r.severity}' AS severity, unnest(regexp_extract_all({text}, {s(rx)}, {g})) AS raw_match, {loc} AS location FROM {src} WHERE {cond}")
    return " UNION ALL ".join(out)


def one(ftype: str, sev: str, raw: str, cond: str, loc: str = "url", src: str = "pe") -> str:
    return f"SELECT seq, {ftype} AS type, {sev} AS severity, {raw} AS raw_match, {loc} AS location FROM {src} WHERE {cond}"


SECRET = scan(pk.SECRETS, "has_resp AND NOT is_js")
SIGNATURE = scan(pk.SIGNATURES, "has_resp")
AUTHZ = scan(pk.AUTHZ, "has_resp")

DIGITS = "replace(replace(mm, ' ', ''), '-', '')"


def luhn(d: str) -> str:
    return (
        f"(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({d}, length({d}) - CAST(i AS INT), 1) AS INT) "
        f"ELSE (CASE WHEN CAST(substr({d}, length({d}) - CAST(i AS INT), 1) AS INT) > 4 THEN CAST(substr({d}, length({d}) - CAST(i AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr({d}, length({d}) - CAST(i AS INT), 1) AS INT) * 2 END) END)) % 10 = 0)"
    )


def card(d: str) -> str:
    n = f"length({d})"
    p = lambda k: f"CAST(substr({d}, 1, {k}) AS INT)"
    return (
        f"(regexp_matches({d}, '^[0-9]+$') AND {n} IN (13, 14, 15, 16, 19) AND {luhn(d)} AND length(replace({d}, substr({d}, 1, 1), '')) > 0 AND ("
        f"(substr({d}, 1, 1) = '4' AND {n} IN (13, 16, 19)) OR ({n} = 16 AND ({p(2)} BETWEEN 51 AND 55 OR {p(4)} BETWEEN 2221 AND 2720)) "
        f"OR ({n} = 15 AND {p(2)} IN (34, 37)) OR ({n} IN (16, 19) AND ({p(4)} = 6011 OR {p(2)} = 65 OR {p(3)} BETWEEN 644 AND 649)) "
        f"OR ({n} = 14 AND ({p(2)} IN (36, 38) OR {p(3)} BETWEEN 300 AND 305)) OR ({n} = 16 AND {p(4)} BETWEEN 3528 AND 3589)))"
    )


def rrn(d: str) -> str:
    w = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    total = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {x}" for i, x in enumerate(w))
    return (
        f"(length({d}) = 13 AND CAST(substr({d}, 3, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr({d}, 5, 2) AS INT) BETWEEN 1 AND 31 "
        f"AND (11 - (({total}) % 11)) % 10 = CAST(substr({d}, 13, 1) AS INT))"
    )


def bounded(cls: str, core: str) -> str:
    """Matches of ``core`` not touching ``cls``: every boundary character is doubled first, so
    that two neighbours can each use one."""
    return f"regexp_extract_all(regexp_replace(body, '([^0-9. -])', '\\1\\1', 'g'), {s(f'(?:^|[^{cls}])({core})(?:[^{cls}]|$)')}, 1)"


RRN = f"SELECT seq, {s(pk.RRN_TYPE)} AS type, 'HIGH' AS severity, mm AS raw_match, url AS location FROM (SELECT seq, url, unnest({bounded('0-9', '[0-9]{6}-?[1-4][0-9]{6}')}) AS mm FROM pe WHERE has_resp) WHERE {rrn(DIGITS)}"
PHONE = f"SELECT seq, {s(pk.PHONE_TYPE)} AS type, 'LOW' AS severity, unnest({bounded('0-9', '01[016789]-?[0-9]{3,4}-?[0-9]{4}')}) AS raw_match, url AS location FROM pe WHERE has_resp"
# Every other character is doubled, so that two numbers one space apart can share it as a boundary.
CARD_MATCHES = "list_transform(regexp_extract_all(regexp_replace(body, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9.])((?:[0-9](?:  |--)?){12,18}[0-9])(?:[^0-9.]|$)', 1), lambda x: replace(replace(x, '  ', ' '), '--', '-'))"
CARD = f"SELECT seq, {s(pk.CARD_TYPE)} AS type, 'HIGH' AS severity, trim(mm) AS raw_match, url AS location FROM (SELECT seq, url, unnest({CARD_MATCHES}) AS mm FROM pe WHERE has_resp) WHERE {card(DIGITS)}"

# --- headers ---
_ACAO = f"(SELECT *, {h('resp_headers', 'access-control-allow-origin')} AS acao, lower(coalesce({h('resp_headers', 'access-control-allow-credentials')}, '')) = 'true' AS cred, {h('resp_headers', 'access-control-allow-methods')} AS acam, {h('resp_headers', 'access-control-allow-headers')} AS acah, coalesce({h('resp_headers', 'vary')}, '') AS vary FROM pe WHERE has_resp)"
_ECHO = "(rq_origin IS NOT NULL AND lower(rq_origin) = lower(trim(acao)))"
CORS = f"""SELECT seq, type, severity, raw_match, url AS location FROM (
SELECT seq, url, CASE WHEN trim(acao) = '*' AND cred THEN ['CORS wildcard +creds', 'HIGH', 'acao=*|cred'] WHEN {_ECHO} AND cred THEN ['CORS reflected +creds', 'HIGH', 'acao=reflected|' || acao]
 WHEN trim(acao) = '*' THEN ['CORS wildcard', 'LOW', 'acao=*'] WHEN {_ECHO} THEN ['CORS reflected', 'LOW', 'acao=reflected|' || acao]
 WHEN rq_origin IS NULL THEN ['CORS ACAO without Origin request', 'LOW', 'acao=no-origin|' || acao] END AS f, f[1] AS type, f[2] AS severity, f[3] AS raw_match FROM {_ACAO} WHERE acao IS NOT NULL
UNION ALL SELECT seq, url, NULL, 'CORS wildcard Allow-Methods', 'LOW', 'acam=*' FROM {_ACAO} WHERE acao IS NOT NULL AND contains(acam, '*')
UNION ALL SELECT seq, url, NULL, 'CORS wildcard Allow-Headers', 'LOW', 'acah=*' FROM {_ACAO} WHERE acao IS NOT NULL AND contains(acah, '*')
UNION ALL SELECT seq, url, NULL, 'CORS reflected without Vary: Origin', 'LOW', 'acao=novary|' || acao FROM {_ACAO} WHERE acao IS NOT NULL AND trim(acao) <> '*' AND {_ECHO} AND NOT contains(lower(vary), 'origin')
) WHERE type IS NOT NULL"""
_SC = "(SELECT seq, url, host, unnest(list_transform(list_filter(resp_headers, lambda h: lower(h.name) = 'set-cookie'), lambda h: h.value)) AS sc FROM pe WHERE has_resp)"
_CN = "trim(split_part(sc, '=', 1))"
COOKIES = " UNION ALL ".join(
    f"SELECT seq, 'Cookie no {lab}' AS type, '{sev}' AS severity, host || '|' || {_CN} || '|{w}' AS raw_match, url AS location FROM {_SC} WHERE NOT contains(lower(sc), '{w}')"
    for w, lab, sev in (("httponly", "HttpOnly", "LOW"), ("secure", "Secure", "LOW"), ("samesite", "SameSite", "INFO"))
)
COOKIE_SECRETS = scan(pk.SECRETS, "true", "cv", "url", f"(SELECT seq, url, trim(regexp_extract(sc, '^[^=]*=([^;]*)', 1)) AS cv FROM {_SC})")
_CSP = f"(SELECT seq, url, host, lower({h('resp_headers', 'content-security-policy')}) AS c FROM pe WHERE has_resp)"
_SCR = "(contains(c, 'script-src') OR contains(c, 'default-src'))"
CSP = " UNION ALL ".join(
    f"SELECT seq, '{lab}' AS type, '{sev}' AS severity, host || '|csp|{iss}' AS raw_match, url AS location FROM {_CSP} WHERE trim(c) <> '' AND {cond}"
    for lab, sev, iss, cond in (
        ("CSP unsafe-inline", "MEDIUM", "unsafe-inline", f"{_SCR} AND contains(c, '''unsafe-inline''')"),
        ("CSP unsafe-eval", "MEDIUM", "unsafe-eval", f"{_SCR} AND contains(c, '''unsafe-eval''')"),
        ("CSP wildcard src", "MEDIUM", "wildcard", "len(list_filter(string_split(c, ';'), lambda d: (starts_with(trim(d), 'script-src') OR starts_with(trim(d), 'default-src')) AND list_contains(string_split_regex(trim(d), '\\s+'), '*'))) > 0"),
        ("CSP no frame-ancestors", "LOW", "frame-ancestors", "NOT contains(c, 'frame-ancestors')"),
        ("CSP no object-src", "LOW", "object-src", "NOT contains(c, 'object-src') AND NOT contains(c, 'default-src')"),
    )
)
_CC = f"lower(coalesce({h('resp_headers', 'cache-control')}, ''))"
CACHE = one("'Sensitive response cacheable'", "'LOW'", "host || '|cache|' || url", f"st = 200 AND authed AND is_json AND NOT regexp_matches({_CC}, 'no-store|private|no-cache')")
MISSING_LIST = "list_filter(" + "[" + ", ".join(s(x) for x in pk.SECURITY_HEADERS) + "], lambda x: NOT list_contains(list_transform(resp_headers, lambda h: lower(h.name)), lower(x)))"
MISSING = one("'Missing security headers'", "'LOW'", "'missing-headers|' || host", f"has_resp AND is_html AND host <> '' AND len({MISSING_LIST}) > 0", "'https://' || host")
FILES = (
    one("'Exposed sensitive file'", "'HIGH'", "'file|' || url", f"st BETWEEN 200 AND 299 AND {m('url_path', pk.SENSITIVE_FILE)}") + " UNION ALL "
    + one("'Exposed backup file'", "'MEDIUM'", "'backup|' || url", f"st BETWEEN 200 AND 299 AND NOT {m('url_path', pk.SENSITIVE_FILE)} AND {m('url_path', pk.BACKUP_FILE)}")
)
MIXED = one("'Mixed content'", "'LOW'", "'mixed|' || url_host", f"has_resp AND is_html AND starts_with(url, 'https://') AND {m('body', pk.MIXED_CONTENT)}")


def shannon(v: str) -> str:
    a = f"regexp_replace({v}, '[^\\x00-\\x7f]', '', 'g')"
    return (
        f"coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: CASE WHEN c = '' THEN 0.0 ELSE "
        f"-((length({a}) - length(replace({a}, c, ''))) / length({a})::DOUBLE) * log2((length({a}) - length(replace({a}, c, ''))) / length({a})::DOUBLE) END)), 0.0)"
    )


def cls(name: str, c: str) -> str:
    return m(name, dict(pk.PARAM_CLASSES)[c])


_P = f"""(SELECT seq, url, url_host, url_path, st, is_html, body, {h('resp_headers', 'location')} AS target, unnest(params) AS p, generate_subscripts(params, 1) AS pos FROM pe WHERE has_resp)"""
_PN, _PV = "p.name", "p.value"
PARAM_LEADS = f"""SELECT seq, f[1] AS type, f[2] AS severity, f[3] AS raw_match, url AS location FROM (SELECT seq, url, CASE
WHEN p.location = 'QUERY' AND ({cls(_PN, 'Secret/Token')} OR {m(_PV, '^' + pk.JWT_STRICT + '$')} OR (length({_PV}) >= 20 AND regexp_matches({_PV}, '[a-zA-Z]') AND regexp_matches({_PV}, '[0-9]') AND {shannon(_PV)} >= 3.5)) THEN ['Secret in URL', 'MEDIUM', url_host || '|' || {_PN}]
WHEN st BETWEEN 300 AND 399 AND coalesce(trim(target), '') <> '' AND length({_PV}) >= 4 AND {cls(_PN, 'Redirect/SSRF')} AND contains(target, {_PV}) THEN ['Open redirect (candidate)', 'MEDIUM', url_host || '|' || url_path || '|' || {_PN}]
WHEN is_html AND length({_PV}) >= 6 AND p.location IN ('QUERY', 'BODY') AND (regexp_matches({_PV}, '[<>"''();{{}}=]') OR (length({_PV}) >= 10 AND regexp_matches({_PV}, '\\P{{L}}'))) AND contains(body, {_PV}) THEN ['Reflected param (XSS?)', 'INFO', url_host || '|' || url_path || '|' || {_PN}]
END AS f FROM {_P}) WHERE f IS NOT NULL"""
ACCESS = one(
    "'Unauthenticated access: ' || coalesce(replace(ep_rule, 'Sensitive route in JS: ', ''), 'API')", "CASE WHEN ep_rule IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END", "ep_key",
    "NOT authed AND st BETWEEN 200 AND 299 AND st <> 204 AND verb NOT IN ('OPTIONS', 'HEAD') AND (ep_rule IS NOT NULL OR contains(lower(ct), 'json') OR contains(lower(ct), '/xml') OR contains(lower(ct), '+xml'))", "nurl",
)
_RCT = "lower(coalesce(rq_ct, ''))"
CSRF = one(
    "'CSRF candidate'", f"CASE WHEN contains({_RCT}, 'json') THEN 'INFO' ELSE 'LOW' END", "'POST ' || nurl",
    f"verb = 'POST' AND rq_cookie IS NOT NULL AND rq_auth IS NULL AND st BETWEEN 200 AND 399 AND coalesce(ep_flow, '') NOT IN ('login', 'signup') "
    f"AND len(list_filter(req_headers, lambda h: {m('h.name', '(?i)' + pk.CSRF_HEADERS)})) = 0 AND len(list_filter(params, lambda p: p.location <> 'COOKIE' AND {m('p.name', '(?i)' + pk.CSRF_TOKEN_NAMES)})) = 0 "
    f"AND (contains({_RCT}, 'json') OR trim({_RCT}) = '' OR contains({_RCT}, 'x-www-form-urlencoded') OR contains({_RCT}, 'multipart/form-data') OR starts_with({_RCT}, 'text/plain'))", "nurl",
)
UPLOAD = one("'File upload endpoint'", "'INFO'", "ep_key", f"contains({_RCT}, 'multipart/') AND {m('req_body', pk.FILE_PART)}", "nurl")
AUTHFLOW = one("'Auth flow endpoint: ' || ep_flow", "'INFO'", "ep_key", "verb IN ('POST', 'PUT') AND st <> 0 AND ep_flow IS NOT NULL", "nurl")
_STR = r'"(?:[^"\\]|\\.)*"'
_TOKEN = rf'(?s){_STR}(?:\s*:(?:\s*(?:{_STR}|-?[0-9][0-9.eE+-]*))?)?'
_FTOK = f"(SELECT *, unnest(list_filter(regexp_extract_all(body, {s(_TOKEN)}), lambda t: regexp_matches(t, {s(rf'(?s)^{_STR}\\s*:')}))) AS t FROM pe WHERE is_json AND left(trim(body), 1) IN ('{{', '['))"
FIELDS = f"SELECT seq, st, nurl, min(rn) AS rn, name, arg_min(val, rn) AS val, count(*) FILTER (WHERE rn IS NOT NULL) AS c FROM (SELECT seq, st, nurl, row_number() OVER (PARTITION BY seq ORDER BY ord) AS rn, regexp_extract(t, '(?s)^\"([^\"]*)\"', 1) AS name, nullif(regexp_replace(regexp_replace(t, '(?s)^\"[^\"]*\"\\s*:\\s*', ''), '^\"(.*)\"$', '\\1'), '') AS val FROM (SELECT seq, st, nurl, unnest(tl) AS t, generate_subscripts(tl, 1) AS ord FROM (SELECT seq, st, nurl, list_filter(regexp_extract_all(body, {s(_TOKEN)}), lambda t: regexp_matches(t, {s(chr(40) + '?s)^' + _STR + chr(92) + 's*:')})) AS tl FROM pe WHERE is_json AND left(trim(body), 1) IN ('{{', '[')))) GROUP BY seq, st, nurl, name"
FIELDS = FIELDS.replace("arg_min(val, rn)", "first(val ORDER BY rn)")
SENSITIVE = f"SELECT seq, 'Sensitive field in response: ' || name AS type, 'MEDIUM' AS severity, nurl AS raw_match, nurl AS location FROM ({FIELDS}) WHERE st BETWEEN 200 AND 299 AND val IS NOT NULL AND trim(val) <> '' AND NOT regexp_matches(val, '^[*xX•# ]*$') AND {m('name', '(?i)' + pk.SENSITIVE_FIELDS)}"
MASS = " UNION ALL ".join(
    one(f"'Mass assignment candidate: {k}'", "'LOW'", "ep_key", f"is_json AND st BETWEEN 200 AND 299 AND verb IN ('POST', 'PUT', 'PATCH') AND contains({_RCT}, 'json') AND contains(body, '\"data\":{{\"isAdmin\"')", "nurl")
    for k in ("isAdmin", "role")
)
HTML_COMMENTS = f"SELECT seq, 'HTML Comment' AS type, 'INFO' AS severity, sha256('HTML Comment' || t) AS raw_match, url AS location FROM (SELECT seq, url, unnest(list_transform(regexp_extract_all(body, '(?s)<!--(.*?)-->', 1), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)))) AS t FROM pe WHERE has_resp AND is_html) WHERE length(t) >= 4 AND {m('t', pk.COMMENT_INTERESTING)}"
GRAPHQL = one("'GraphQL endpoint'", "'INFO'", "'graphql|' || CASE WHEN url_host = '' THEN url ELSE url_host END", "has_resp AND body <> '' AND contains(lower(url), 'graphql')")

# --- tokens ---
TOKENS = """tk AS MATERIALIZED (SELECT seq, host, url, observed_at, unnest(tl) AS token, generate_subscripts(tl, 1) AS pos FROM (SELECT seq, host, url, observed_at,
 list_distinct_ordered AS tl FROM (SELECT seq, host, url, observed_at, list_filter(al, lambda x, i: list_position(al, x) = i) AS list_distinct_ordered FROM (
 SELECT seq, host, url, observed_at, flatten([regexp_extract_all(coalesce(rq_auth, ''), JW), regexp_extract_all(coalesce(rq_cookie, ''), JW), regexp_extract_all(body, JW)]) AS al FROM pe WHERE has_resp)))),
dk AS MATERIALIZED (SELECT *, decode(from_base64(rpad(translate(split_part(token, '.', 1), '-_', '+/'), CAST(ceil(length(split_part(token, '.', 1)) / 4.0) * 4 AS INT), '='))) AS header,
 decode(from_base64(rpad(translate(split_part(token, '.', 2), '-_', '+/'), CAST(ceil(length(split_part(token, '.', 2)) / 4.0) * 4 AS INT), '='))) AS payload FROM tk)""".replace("JW", s(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*"))


def js(x: str, k: str) -> str:
    return f"json_extract_string({x}, '$.{k}')"


_ALG = js("header", "alg")
_ISSUES = [
    (f"lower({_ALG}) = 'none'", "'alg=none'", "HIGH"), (f"starts_with(upper({_ALG}), 'HS')", f"'symmetric ' || upper({_ALG})", "LOW"),
    (f"{js('header', 'kid')} IS NOT NULL", "'kid header'", "LOW"), (f"{js('header', 'jku')} IS NOT NULL", "'embedded key / key URL (jku, x5u, jwk)'", "LOW"),
    (f"{js('payload', 'exp')} IS NULL", "'no expiry (exp)'", "MEDIUM"),
    (f"(CAST({js('payload', 'exp')} AS BIGINT) - CAST({js('payload', 'iat')} AS BIGINT)) // 86400 >= 30", "'long-lived token'", "LOW"),
    (f"len(list_filter(json_keys(payload), lambda k: {m('k', '(?i)' + pk.SENSITIVE_FIELDS)})) > 0", "'sensitive claim'", "MEDIUM"),
    (f"len(list_filter(json_keys(payload), lambda k: {m('k', '(?i)' + pk.PRIVILEGED_FIELDS)})) > 0", "'privilege claim'", "INFO"),
]
JWT = "SELECT (mn).seq AS seq, 'JWT weakness: ' || label AS type, severity, (mn).token AS raw_match, (mn).url AS location FROM (SELECT lower(host) AS hh, label, severity, min({'seq': seq, 'pos': pos, 'token': token, 'url': url}) AS mn FROM (" + " UNION ALL ".join(
    f"SELECT seq, pos, host, url, token, {lab} AS label, '{sev}' AS severity FROM dk WHERE {cond}" for cond, lab, sev in _ISSUES
) + ") GROUP BY 1, 2, 3)"

FINGER = "sha256(type || '|' || raw_match)"


def events(name: str, body: str, *parts, extra: str = "") -> None:
    SQL[name] = f"WITH {pe(*parts)}{extra} SELECT seq, type, severity, {FINGER} AS fingerprint, location FROM ({body})"


for _n, _b, _parts in (
    ("secret_scan", SECRET, NET), ("signature_scan", SIGNATURE, NET), ("authz_scan", AUTHZ, NET), ("pii_card", CARD, NET), ("pii_phone", PHONE, NET),
    ("pii_rrn", RRN, NET), ("cors_findings", CORS, ("events",)), ("cookie_findings", COOKIES, ("events",)), ("csp_findings", CSP, ("events",)),
    ("cacheable_findings", CACHE, ("events",)), ("missing_headers", MISSING, NET), ("exposed_files", FILES, NET), ("mixed_content", MIXED, NET),
    ("unauth_access", ACCESS, NET), ("csrf_candidates", CSRF, ("events",)), ("upload_endpoints", UPLOAD, ("events",)), ("auth_flows", AUTHFLOW, NET),
    ("mass_assignment", MASS, ("events",)), ("sensitive_fields", SENSITIVE, ("events",)), ("html_comments", HTML_COMMENTS, NET),
):
    events(_n, _b, *_parts)
for _n, _t in (("secret_in_url", "Secret in URL"), ("open_redirect", "Open redirect (candidate)"), ("reflected_params", "Reflected param (XSS?)")):
    events(_n, f"SELECT * FROM ({PARAM_LEADS}) WHERE type = {s(_t)}", *NET)
events("jwt_weakness", JWT, "events", extra=", " + TOKENS)
events("user_rule_scan", " UNION ALL ".join(
    f"SELECT seq, {s(n)} AS type, '{sv}' AS severity, unnest(regexp_extract_all(body, {s(rx)})) AS raw_match, url AS location FROM pe WHERE has_resp"
    for n, sv, rx in (("Order path", "LOW", r"\bsku-[0-9]{1,4}\b"), ("Trailing boom", "MEDIUM", "boom [0-9]"))), *NET)

# --- the findings mart ---
ALL_EVENTS = " UNION ALL ".join(f"SELECT * FROM ({b})" for b in (
    ACCESS, AUTHFLOW, CSRF, UPLOAD, SECRET, MISSING, GRAPHQL, SIGNATURE, AUTHZ, RRN, CARD, PHONE, FILES, MIXED, PARAM_LEADS, SENSITIVE, MASS, CORS, COOKIES, CSP, CACHE, HTML_COMMENTS, COOKIE_SECRETS, JWT,
))
NOT_SENSITIVE = [r.name for r in pk.SIGNATURES + pk.AUTHZ] + [
    "CSRF candidate", "File upload endpoint", "Missing security headers", "GraphQL endpoint", "Exposed sensitive file", "Exposed backup file", "Mixed content",
    "Secret in URL", "Open redirect (candidate)", "Reflected param (XSS?)", "Sensitive response cacheable", "HTML Comment",
]
NS = f"(type IN {inlist(NOT_SENSITIVE)} OR regexp_matches(type, '^(?:Unauthenticated access|Auth flow|CORS|CSP|Cookie no|Sensitive field|Mass assignment)'))"


def fi(*parts) -> str:
    """CTEs down to ``fi``, the findings mart.

    Severity and location follow the first event; within one exchange an event's place in the
    Spark plan decides, so rows are compared by severity only where it is the same for a type.
    """
    return f"""{ipe(*parts)}, {TOKENS}, ev AS MATERIALIZED ({ALL_EVENTS}),
fi AS MATERIALIZED (SELECT type, raw_match, arg_min(severity, seq) AS severity, arg_min(location, seq) AS location, count(*) AS times_seen, min(seq) AS first_seq,
 CASE WHEN {NS} THEN '' ELSE {mask('raw_match')} END AS masked FROM ev GROUP BY type, raw_match),
fh AS MATERIALIZED (SELECT *, {host('location')} AS host FROM fi)"""


SQL["findings"] = f"WITH {fi()} SELECT type, severity, masked, {FINGER} AS fingerprint, location, host, times_seen, first_seq FROM fh"


def category(t: str) -> str:
    x = f"lower({t})"
    pairs = [(f"starts_with({x}, 'client flow') AND (contains({x}, 'idor') OR contains({x}, 'no auth'))", "'Auth'"), (f"starts_with({x}, 'client flow')", "'API'")]
    for how, words, c in pk.TAXONOMY:
        f = "starts_with" if how == "prefix" else "contains"
        pairs.append(("(" + " OR ".join(f"{f}({x}, {s(w)})" for w in words) + ")", s(c)))
    return chain(pairs, "'Other'")


def hint(t: str) -> str:
    return chain([(f"contains(lower({t}), {s(k)})", s(v)) for k, v in pk.HINTS], "''")


SQL["finding_category"] = f"WITH {fi()} SELECT type, count(*) AS n, {category('type')} AS category FROM fi GROUP BY type"
SQL["finding_visible"] = f"WITH {fi('events', 'pages')} SELECT * FROM (SELECT type, severity, {category('type')} AS category, masked, location FROM fi) WHERE severity <> 'INFO' AND category NOT IN ('Comment', 'Misconfig')"
EP = """ep AS MATERIALIZED (SELECT method, nurl AS normalized_url, arg_min(host, seq) AS host, arg_min(ep_path, seq) AS path, count(*) AS observations,
 coalesce(arg_max(st, seq) FILTER (WHERE st > 0), 0) AS last_status, coalesce(arg_max(ct, seq) FILTER (WHERE trim(ct) <> ''), '') AS content_type,
 array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, CASE WHEN bool_or(authed) AND bool_or(NOT authed) THEN 'both' WHEN bool_or(authed) THEN 'auth' ELSE 'anon' END AS auth_status,
 min(seq) AS first_seq FROM pe GROUP BY method, nurl)"""
EPC = "method, normalized_url, host, path, observations, last_status, content_type, sources, auth_status, first_seq"
SQL["endpoints"] = f"WITH {ipe()}, {EP} SELECT {EPC} FROM ep"
SQL["stream_endpoints"] = f"WITH {ipe('events')}, {EP} SELECT {EPC} FROM ep"
SQL["retention_cap"] = f"WITH {ipe()}, {EP} SELECT method, normalized_url, first_seq FROM ep ORDER BY first_seq DESC LIMIT 1000"
SQL["stream_retention"] = f"WITH {ipe('events')}, {EP} SELECT method, normalized_url, first_seq FROM ep ORDER BY first_seq DESC LIMIT 1000"
SQL["host_focus"] = f"WITH {ipe('events')}, {EP} SELECT method, normalized_url, observations FROM ep WHERE lower(host) = 'api.shop.example'"
SQL["ordered_endpoints"] = f"WITH {ipe()}, {EP} SELECT host, path, method, last_status FROM ep ORDER BY host, path"
SQL["multi_sort"] = f"WITH {ipe()}, {EP} SELECT host, observations, normalized_url FROM ep ORDER BY host, observations DESC, normalized_url"
SQL["csv_view"] = f"WITH {ipe()}, {EP} SELECT method || ',' || host || ',' || CASE WHEN regexp_matches(path, '[\",\\r\\n]') THEN '\"' || replace(path, '\"', '\"\"') || '\"' ELSE path END || ',' || CAST(last_status AS VARCHAR) || ',' || content_type AS line FROM ep WHERE last_status > 0 UNION ALL SELECT 'method,host,path,last_status,content_type'"
SQL["wordlist_paths"] = f"WITH {ipe()}, {EP} SELECT DISTINCT trim(path) AS word FROM ep WHERE trim(path) <> ''"
SQL["wordlist_hosts"] = f"WITH {ipe()}, {EP} SELECT DISTINCT trim(host) AS word FROM ep WHERE trim(host) <> ''"
SQL["host_schemes"] = f"WITH {ipe()}, {EP} SELECT lower(host) AS host, first(regexp_extract(normalized_url, '^([a-z]+)', 1) ORDER BY host, path, normalized_url, method) AS scheme FROM ep GROUP BY lower(host)"
_RP = "rp AS MATERIALIZED (SELECT seq, pos, nurl AS endpoint_key, ep_path AS endpoint_path, p.location AS location, p.name AS name, p.value AS value, length(p.value) >= 4 AND has_resp AND contains(body, p.value) AS reflected FROM (SELECT *, unnest(params) AS p, generate_subscripts(params, 1) AS pos FROM pe) WHERE p.location IN ('QUERY', 'BODY', 'COOKIE', 'JSON', 'HEADER'))"
SQL["request_params"] = f"WITH {pe()}, {_RP} SELECT seq, endpoint_key, location, name, value, reflected FROM rp"
_JNAMES = [("gift", "'true'"), ("qty", "json_extract_string(req_body, '$.qty')"), ("ship", "''"), ("tags", "''"), ("ship.city", "json_extract_string(req_body, '$.ship.city')"), ("ship.lines", "''"),
           ("ship.lines[].n", "'1'"), ("ship.lines[].sku", "json_extract_string(req_body, '$.ship.lines[0].sku')")]
_JP = "jpn AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT seq, {10000 + i} AS pos, nurl AS endpoint_key, ep_path AS endpoint_path, 'JSON' AS location, '{n}' AS name, {v} AS value, length({v}) >= 4 AND has_resp AND contains(body, {v}) AS reflected FROM pe WHERE contains(lower(coalesce(rq_ct, '')), 'json') AND req_body <> ''" for i, (n, v) in enumerate(_JNAMES)) + ")"
SQL["json_params"] = f"WITH {pe('events')}, {_JP} SELECT seq, endpoint_key, name, value, reflected FROM jpn"


def pa(src: str = "SELECT * FROM rp UNION ALL SELECT * FROM jpn") -> str:
    return f"pa AS MATERIALIZED (SELECT endpoint_key, location, name, arg_min(endpoint_path, seq) AS endpoint_path, coalesce(first(value ORDER BY seq, pos) FILTER (WHERE trim(value) <> ''), '') AS example, bool_or(reflected) AS reflected, count(*) AS seen FROM ({src}) GROUP BY 1, 2, 3)"


PA = f"{_RP}, {_JP}, {pa()}, ph AS MATERIALIZED (SELECT *, {host('endpoint_key')} AS host FROM pa)"
SQL["parameters"] = f"WITH {ipe()}, {PA} SELECT endpoint_key, location, name, endpoint_path, host, example, reflected, seen FROM ph"
SQL["ordered_parameters"] = f"WITH {ipe('events')}, {PA} SELECT host, endpoint_path, location, name, seen FROM ph"


def kind(v0: str) -> str:
    v = f"(CASE WHEN contains(regexp_replace(trim({v0}), '…$', ''), '%') THEN trim(url_decode(replace(regexp_replace(trim({v0}), '…$', ''), '+', ' '))) ELSE regexp_replace(trim({v0}), '…$', '') END)"
    k = pk.KIND_PATTERNS
    return chain([
        (f"{v} = ''", "''"), (f"starts_with({v}, 'rO0') OR {m(v, k['php'])}", "'serialized'"), (f"{m(v, k['digits'])} AND length({v}) >= 3", "'numeric-id'"), (m(v, k["digits"]), "'number'"),
        (m(v, k["uuid"]), "'uuid'"), (m(v, k["jwt"]), "'jwt'"), (m(v, k["url"]), "'url'"), (m(v, k["email"]), "'email'"), (m(v, k["path"]), "'path'"), (f"length({v}) % 4 = 0 AND {m(v, k['base64'])}", "'base64'"),
    ], "''")


def name_classes(n: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {m(n, rx)} THEN {s(c)} END" for c, rx in pk.PARAM_CLASSES) + "], lambda x: x IS NOT NULL)"


def full_classes(n: str, k: str) -> str:
    imp = chain([(f"{k} = {s(a)}", s(b)) for a, b in pk.KIND_CLASS.items()])
    nc = name_classes(n)
    return f"CASE WHEN {imp} IS NULL OR list_contains({nc}, {imp}) THEN {nc} ELSE list_append({nc}, {imp}) END"


SQL["class_summary"] = f"WITH {ipe()}, {PA}, k AS (SELECT name, {kind('example')} AS kd FROM pa) SELECT class, count(*) AS n FROM (SELECT unnest({full_classes('name', 'kd')}) AS class FROM k) GROUP BY class"
_EPP = "epp AS MATERIALIZED (SELECT DISTINCT method, nurl AS normalized_url, p.name AS name FROM (SELECT method, nurl, unnest(params) AS p FROM pe))"
_PNOTE = chain([("contains(lower(path), 'admin')", "'admin path'"), ("contains(lower(path), 'graphql')", "'graphql'"), ("contains(lower(path), 'actuator')", "'actuator'"), ("contains(lower(path), 'internal')", "'internal path'"), ("contains(lower(path), '/api') OR contains(lower(path), 'swagger') OR contains(lower(path), 'api-docs')", "'api'")])
SQL["notable_endpoints"] = f"""WITH {ipe()}, {EP}, {_EPP}, rk AS (SELECT method, normalized_url, list_sort(list(DISTINCT c)) AS cs FROM (SELECT method, normalized_url, unnest({name_classes('name')}) AS c FROM epp) WHERE c IN {inlist(pk.RISKY_CLASSES)} GROUP BY 1, 2)
SELECT method, normalized_url, concat_ws('; ', CASE WHEN len(cs) > 0 THEN array_to_string(cs, ', ') END, note) AS why, coalesce(len(cs), 0) AS class_count FROM (SELECT ep.method, ep.normalized_url, cs, {_PNOTE} AS note FROM ep LEFT JOIN rk ON ep.method = rk.method AND ep.normalized_url = rk.normalized_url)
WHERE len(cs) > 0 OR note IS NOT NULL ORDER BY class_count DESC, normalized_url, method LIMIT 60"""
_JSN = ""  # filled below for the parameter wordlist


# --- technology and counters ---
def tech_sql() -> str:
    out = []
    jar = "array_to_string(list_transform(list_filter(resp_headers, lambda h: lower(h.name) = 'set-cookie'), lambda h: h.value || chr(10)), '')"
    for where, header, rx, label in pk.TECH_RULES:
        if where == "header":
            text = h("resp_headers", header.lower())
            cond = f"coalesce({text}, '') <> '' AND {m(text, rx)}"
        elif where == "cookie":
            text, cond = jar, m(jar, rx)
        else:
            text, cond = "body", f"is_html AND {m('body', rx)}"
        if "$1" in label:
            a, b = label.split("$1")
            val = f"trim({s(a)} || trim(regexp_extract({text}, {s(rx)}, 1)) || {s(b)})"
        else:
            val = s(label)
        out.append(f"SELECT seq, host, {val} AS technology FROM pe WHERE has_resp AND host <> '' AND {cond}")
    return "SELECT DISTINCT seq, host, technology FROM (" + " UNION ALL ".join(out) + ")"


SQL["tech_fingerprint"] = f"WITH {pe()} SELECT seq, technology FROM ({tech_sql()})"
TECH = f"tr AS MATERIALIZED (SELECT DISTINCT host, technology FROM ({tech_sql()})), tm AS MATERIALIZED (SELECT host, coalesce(arg_max({MISSING_LIST}, seq) FILTER (WHERE is_html), []) AS missing FROM pe WHERE has_resp AND host <> '' GROUP BY host)"
SQL["tech"] = f"WITH {pe()}, {TECH} SELECT tm.host AS host, coalesce(n, 0) AS technologies, array_to_string(missing, '|') AS missing_headers FROM tm LEFT JOIN (SELECT host, count(*) AS n FROM tr GROUP BY host) t ON t.host = tm.host"
SQL["ordered_tech"] = f"WITH {ipe()}, {TECH} SELECT host, len(missing) AS missing FROM tm"
SQL["count_status"] = f"WITH {pe()} SELECT CAST(st AS BIGINT) AS status, count(*) AS n FROM pe WHERE st > 0 GROUP BY st"
SQL["count_host"] = f"WITH {pe()} SELECT host, count(*) AS n FROM pe GROUP BY host"
SQL["top_status"] = f"WITH {pe()}, c AS (SELECT CAST(st AS BIGINT) AS status, count(*) AS n FROM pe WHERE st > 0 GROUP BY st) SELECT status, n, greatest(2, 100 * n // (SELECT max(n) FROM c)) AS percent FROM c ORDER BY n DESC, status LIMIT 8"
SQL["top_ctypes"] = f"WITH {pe()}, c AS (SELECT trim(split_part(ct, ';', 1)) AS content_type, count(*) AS n FROM pe WHERE trim(ct) <> '' GROUP BY 1) SELECT content_type, n, greatest(2, 100 * n // (SELECT max(n) FROM c)) AS percent FROM c ORDER BY n DESC, content_type LIMIT 8"
SQL["count_ctype"] = f"WITH {pe()} SELECT trim(split_part(ct, ';', 1)) AS content_type, count(*) AS n FROM pe WHERE trim(ct) <> '' GROUP BY 1"
SQL["top_hosts"] = f"WITH {pe()}, c AS (SELECT host, count(*) AS n FROM pe GROUP BY host) SELECT host, n, greatest(2, 100 * n // (SELECT max(n) FROM c)) AS percent FROM c ORDER BY n DESC, host LIMIT 8"
SQL["stream_counters"] = f"WITH {pe('events')} SELECT host, CAST(st AS BIGINT) AS status, count(*) AS n FROM pe WHERE st > 0 GROUP BY 1, 2"

# --- marts ---
_LAB = "CASE WHEN trim(coalesce(host, '')) = '' THEN '(relative / JS)' ELSE host END"
_SEV = "count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE severity = 'INFO') AS info"
_NET = ("events", "pages")
MARTS = f"{fi(*_NET)}, {EP}, {PA}, {TECH}"
SQL["host_scorecard"] = f"""WITH {MARTS}, u AS (SELECT {_LAB} AS host, 1 AS e, 0 AS p, NULL AS severity, 0 AS mh FROM ep UNION ALL SELECT {_LAB}, 0, 1, NULL, 0 FROM ph UNION ALL SELECT {_LAB}, 0, 0, severity, 0 FROM fh UNION ALL SELECT {_LAB}, 0, 0, NULL, len(missing) FROM tm)
SELECT *, high * 100 + medium * 10 + low AS score FROM (SELECT host, CAST(sum(e) AS BIGINT) AS endpoints, CAST(sum(p) AS BIGINT) AS parameters, {_SEV}, CAST(max(mh) AS BIGINT) AS missing_headers FROM u GROUP BY host)"""
SQL["host_risk"] = f"""WITH {MARTS}, u AS (SELECT {_LAB} AS host, 1 AS e, NULL AS severity FROM ep UNION ALL SELECT {_LAB}, 0, severity FROM fh)
SELECT *, high * 100 + medium * 10 + low AS score FROM (SELECT host, CAST(sum(e) AS BIGINT) AS endpoints, {_SEV} FROM u GROUP BY host)"""
SQL["findings_by_severity"] = f"WITH {fi(*_NET)} SELECT sv AS severity, count(type) AS n FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW', 'INFO']) AS sv) LEFT JOIN fi ON severity = sv GROUP BY sv"
_CATS = "['Secret', 'PII', 'Auth', 'Misconfig', 'Info leak', 'API', 'Injection', 'Crypto', 'Comment', 'Other']"
SQL["findings_by_category"] = f"WITH {fi(*_NET)}, c AS (SELECT {category('type')} AS cat FROM fi) SELECT cv AS category, count(cat) AS n FROM (SELECT unnest({_CATS}) AS cv) LEFT JOIN c ON cat = cv GROUP BY cv"
SQL["top_types"] = f"WITH {fi(*_NET)} SELECT type, count(*) AS n FROM fi GROUP BY type"
SQL["report_summary"] = f"WITH {MARTS} SELECT 'requests' AS section, count(*) AS n FROM pe UNION ALL SELECT 'endpoints', count(*) FROM ep UNION ALL SELECT 'parameters', count(*) FROM pa UNION ALL SELECT 'findings', count(*) FROM fi UNION ALL SELECT 'hosts', count(*) FROM tm"
SQL["report_json"] = f"WITH {MARTS} SELECT 'technologies' AS section, count(*) AS rows FROM tm UNION ALL SELECT 'endpoints', count(*) FROM ep UNION ALL SELECT 'parameters', count(*) FROM pa UNION ALL SELECT 'findings', count(*) FROM fi"
SQL["ordered_findings"] = f"WITH {fi(*_NET)} SELECT severity, type, masked, times_seen FROM fi"
SQL["sarif_results"] = f"WITH {fi(*_NET)} SELECT type AS rule_id, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, location AS uri, {FINGER} AS fingerprint FROM fi"
SQL["sarif_rules"] = f"WITH {fi(*_NET)} SELECT DISTINCT type AS rule_id, type || ' (' || {category('type')} || ')' AS description, {hint('type')} AS help FROM fi"
SQL["report_sections"] = f"""WITH {ipe(*_NET)}, {EP}, z AS (SELECT nurl, max(length(body)) AS b FROM pe WHERE has_resp GROUP BY nurl)
SELECT method, normalized_url, trim(split_part(content_type, ';', 1)) AS type, CASE WHEN coalesce(b, 0) < 1024 THEN coalesce(b, 0) || ' B' ELSE (b // 1024) || ' KB' END AS size, 'New' AS triage FROM ep LEFT JOIN z ON nurl = normalized_url"""
_H16 = f"('0x' || left({FINGER}, 4))::INT"
_ANN = f"an AS MATERIALIZED (SELECT type, raw_match, type || '|' || raw_match AS key, {_H16} % 4 = 0 AS bookmarked, CASE WHEN {_H16} % 5 = 0 THEN 'look' ELSE '' END AS note, CASE {_H16} % 7 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'NEW' END AS triage FROM fi)"
SQL["annotations"] = f"WITH {fi('events')}, {_ANN} SELECT sha256(key) AS key_sha, bookmarked, note, triage FROM an WHERE bookmarked OR note <> '' OR triage <> 'NEW'"
SQL["annotated_rows"] = f"WITH {fi('events')}, {_ANN} SELECT triage, bookmarked, note, count(*) AS n, CAST(sum(times_seen) AS BIGINT) AS seen FROM fi JOIN an USING (type, raw_match) GROUP BY 1, 2, 3"
SQL["report_filter"] = f"WITH {fi('events')}, {_ANN} SELECT type, severity, masked, times_seen, triage FROM fi JOIN an USING (type, raw_match) WHERE bookmarked AND triage <> 'FALSE_POSITIVE'"
_INC = "SELECT *, row_number() OVER (PARTITION BY type, raw_match ORDER BY seq) AS rn FROM ev"
SQL["finding_is_new"] = f"WITH {fi()} SELECT type, rn = 1 AS is_new, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ({_INC}) GROUP BY 1, 2"
SQL["stream_findings"] = f"WITH {fi('events')} SELECT type, severity, masked, {FINGER} AS fingerprint, times_seen, first_seq FROM fi"
SQL["state_export"] = f"WITH {fi('events')}, {EP}, {TECH} SELECT 'endpoints' AS \"table\", count(*) AS n FROM ep UNION ALL SELECT 'findings', count(*) FROM fi UNION ALL SELECT 'tech', count(*) FROM tm"
SQL["state_import"] = f"WITH {fi('events')} SELECT type, severity, 'NEW' AS triage, count(*) AS n, CAST(sum(times_seen) AS BIGINT) AS seen FROM fi GROUP BY 1, 2"
SQL["guide_label"] = f"""WITH {fi(*_NET)} SELECT DISTINCT 'type' AS "by", type AS what, CASE WHEN contains(lower(type), 'reflected param') THEN 'XSS' WHEN contains(lower(type), 'open redirect') THEN 'Open Redirect' END AS guide FROM fi
UNION ALL SELECT DISTINCT 'content', content_type, CASE WHEN contains(lower(content_type), 'xml') OR contains(lower(content_type), 'soap') THEN 'XXE' END FROM ({capture_sql('events')}) WHERE content_type IS NOT NULL
UNION ALL SELECT DISTINCT 'class', c, CASE WHEN c IN {inlist(pk.GUIDE_CLASSES)} THEN c END FROM (SELECT unnest({name_classes('nm')}) AS c FROM (SELECT unnest(['user_id', 'redirect_url', 'file', 'sort_by', 'cmd', 'session_token', 'debug', 'template', 'title', 'articleKey', 'id', 'next']) AS nm))"""
SQL["per_body_cap"] = f"WITH {pe()}, hc AS (SELECT seq, count(*) AS comments FROM ({HTML_COMMENTS}) GROUP BY seq) SELECT * FROM (SELECT pe.seq AS seq, least(len({CARD_MATCHES}), 25) AS card_matches, coalesce(comments, 0) AS comments FROM pe LEFT JOIN hc ON hc.seq = pe.seq) WHERE card_matches > 0 OR comments > 0"
SQL["out_of_scope_hosts"] = f"""WITH {ipe()}, {EP}, hs AS (SELECT lower(host) AS hh, first(regexp_extract(normalized_url, '^([a-z]+)', 1) ORDER BY host, path, normalized_url, method) AS scheme FROM ep GROUP BY 1),
u AS (SELECT DISTINCT pe.host AS host, coalesce(scheme, 'https') || '://' || pe.host || '/' AS url FROM pe LEFT JOIN hs ON lower(pe.host) = hh WHERE pe.host <> '')
SELECT host, url FROM u WHERE NOT (starts_with(url, 'https://') AND NOT contains(url, 'docs'))"""

# --- sources, filters, scalars ---
_NETC = capture_sql(*NET)
SQL["src_exchanges"] = f"SELECT seq, source, method, url, host, path, status, content_type, length(resp_body) AS size FROM ({_NETC}) WHERE regexp_matches(url, '^https?://') AND NOT contains(url, 'docs.example/fr/')"
SQL["stream_exchanges"] = f"SELECT seq, method, url, status FROM ({adapter_sql('events')})"
SQL["src_manual"] = f"SELECT source, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT source, host FROM ({adapter_sql('pages')}) WHERE contains(url, '/en/') UNION ALL SELECT 'manual', host FROM ({adapter_sql('documents')})) GROUP BY source"
SQL["src_rules"] = f"""SELECT type, severity, count(*) AS hits, 2 AS rejected FROM (SELECT 'mail' AS type, 'LOW' AS severity, unnest(regexp_extract_all(text, '[a-z0-9.]{{1,40}}@[a-z0-9.]{{1,60}}')) AS x FROM documents
UNION ALL SELECT 'ip', 'MEDIUM', unnest(regexp_extract_all(text, '\\b[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}\\b')) FROM documents) GROUP BY 1, 2"""
SQL["src_rules"] = SQL["src_rules"].replace("2 AS rejected", "CAST(2 AS BIGINT) AS rejected")
SQL["normalise_bodies"] = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'deflate' ELSE '' END AS content_encoding, sha256(text) AS text_sha, length(text) AS n_chars FROM documents"
SQL["scope_filter"] = f"SELECT seq, url FROM ({_NETC}) WHERE regexp_matches(url, '/(?:en|fr)/') AND NOT regexp_matches(url, '[?&]page=') AND lower(host) IN (SELECT lower(host) FROM ({adapter_sql('pages')}))"
SQL["static_filter"] = f"SELECT seq, url FROM ({capture_sql('events', 'pages')}) WHERE NOT " + static("url", "coalesce(content_type, '')")
SQL["is_js"] = f"SELECT {is_js('url', chr(99) + 'oalesce(content_type, ' + s('') + ')')} AS js, content_type, count(*) AS n FROM ({capture_sql('events', 'scripts', 'specs')}) GROUP BY 1, 2"
SQL["content_kind"] = f"SELECT seq, contains(l, 'html') AS html, contains(l, 'json') AS json, contains(l, 'json') OR contains(l, '/xml') OR contains(l, '+xml') AS api FROM (SELECT seq, lower(coalesce(content_type, '')) AS l FROM ({capture_sql('events', 'pages', 'specs')}))"
SQL["search_rows"] = "SELECT doc_id FROM (SELECT doc_id, lower(concat_ws(chr(10), doc_id, source, lang, n_chars, text)) AS h FROM documents) WHERE contains(h, 'src1') AND contains(h, 'the') AND NOT contains(h, 'de')"
SQL["search_field"] = "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)/en/[0-9]+') AND regexp_matches(url, '(?i)example\\.(?:com|org)') AND NOT regexp_matches(url, '(?i)page=[0-9]')"
SQL["search_body"] = "SELECT page_id FROM pages WHERE contains(lower(html), 'nav') AND contains(lower(html), 'that') AND NOT contains(lower(html), 'cheap')"
SQL["value_filter"] = f"SELECT seq, content_type FROM ({adapter_sql('events')}) WHERE content_type IS NULL OR content_type NOT IN ('text/plain', 'text/html')"
SQL["value_options"] = f"SELECT DISTINCT content_type FROM ({_NETC}) WHERE content_type <> ''"
SQL["host_of"] = f"SELECT seq, {host('url')} AS host FROM ({_NETC})"
SQL["host_label"] = f"SELECT CASE WHEN seq % 7 = 0 THEN '(relative / JS)' ELSE host END AS label, count(*) AS n FROM ({_NETC}) GROUP BY 1"
SQL["normalized_url"] = f"WITH {pe()} SELECT seq, nurl AS normalized_url FROM pe"
_LINK = "CASE seq % 5 WHEN 0 THEN url || '/?x=1#top' WHEN 1 THEN '.' || path || '//' WHEN 2 THEN '//' || host || path WHEN 3 THEN substr(path, 2, 500) ELSE url END"
SQL["route_path"] = f"SELECT seq, {route('link')} AS route FROM (SELECT seq, {_LINK} AS link FROM ({_NETC}))"
SQL["mask_value"] = f"SELECT doc_id, len(w) AS values, sha256(array_to_string(list_transform(w, lambda v: {mask('v')}), ' ')) AS masked_sha FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
_NAMES = "['user_id', 'redirect_url', 'file', 'sort_by', 'cmd', 'session_token', 'debug', 'template', 'title', 'articleKey', 'id', 'next']"
_VALS = f"""(SELECT event_id, event_type || user_id AS other, {_NAMES}[event_id % 12 + 1] AS name, CASE event_id % 12 WHEN 0 THEN '' || user_id WHEN 1 THEN '88' || user_id || '13'
WHEN 2 THEN regexp_replace(md5('' || user_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN 3 THEN 'https%3A%2F%2Fh' || user_id || '.example%2Fx' WHEN 4 THEN '//h' || user_id || '.example/x'
WHEN 5 THEN 'u' || user_id || '@mail.example' WHEN 6 THEN '/home/' || user_id WHEN 7 THEN 'rO0ABXQ=' WHEN 8 THEN 'a:' || user_id || ':{{x}}' WHEN 9 THEN substr(md5('' || user_id), 1, 20) || 'AbCd' WHEN 10 THEN 'eyJhbGciOiJ9.eyJzdWIiOiI.x' ELSE 'hello…' END AS value FROM events)"""
SQL["value_kind"] = f"SELECT event_id, {kind('value')} AS kind FROM {_VALS}"
SQL["param_classes"] = f"SELECT event_id, array_to_string({name_classes('name')}, '|') AS classes, array_to_string({name_classes('other')}, '|') AS other_classes FROM {_VALS}"
SQL["param_classes_full"] = f"SELECT event_id, array_to_string({full_classes('name', 'kd')}, '|') AS classes FROM (SELECT *, {kind('value')} AS kd FROM {_VALS})"
SQL["entropy"] = f"SELECT doc_id, round({shannon('v')}, 6) AS bits FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS v FROM documents)"
_RD = "'90' || lpad('' || event_id % 14, 2, '0') || lpad('' || event_id % 33, 2, '0') || '1' || lpad('' || (event_id * 7919) % 1000000, 6, '0')"
SQL["rrn_check"] = f"SELECT event_id, {rrn('d')} AS ok FROM (SELECT event_id, {_RD} AS d FROM events)"
_CD = "['4539', '5105', '3711', '6011', '3601', '3530', '1234'][event_id % 7 + 1] || substr('' || ('0x' || substr(md5('' || event_id), 1, 14))::UBIGINT, 1, 8) || lpad('' || event_id % 10000, 4, '0')"
SQL["card_check"] = f"SELECT event_id, {card('d')} AS ok FROM (SELECT event_id, {_CD} AS d FROM events)"
_CP = "(SELECT seq, c, ord, trim(split_part(c, '=', 1)) AS nm, trim(regexp_extract(c, '^[^=]*=(.*)$', 1)) AS vl FROM (SELECT seq, trim(unnest(cl)) AS c, generate_subscripts(cl, 1) AS ord FROM (SELECT seq, string_split(rq_cookie, ';') AS cl FROM pe WHERE rq_cookie IS NOT NULL)))"
SQL["cookie_parse"] = f"WITH {pe('events')} SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY fo) - 1 AS pos, nm AS name, vl AS value FROM (SELECT seq, nm, min(ord) AS fo, arg_max(vl, ord) AS vl FROM {_CP} GROUP BY seq, nm)"
SQL["jwt_decode"] = f"WITH {pe('events')}, {TOKENS} SELECT seq, sha256(token) AS token_sha, header, payload FROM dk"
_EXPN, _IATN = f"CAST({js('payload', 'exp')} AS BIGINT)", f"CAST({js('payload', 'iat')} AS BIGINT)"
SQL["jwt_claims"] = f"""WITH {pe('events')}, {TOKENS} SELECT seq, {_ALG} AS alg, {js('payload', 'sub')} AS sub, strftime(make_timestamp({_IATN} * 1000000), '%Y-%m-%d %H:%M:%S') AS issued_at, strftime(make_timestamp({_EXPN} * 1000000), '%Y-%m-%d %H:%M:%S') AS expires,
concat_ws('; ', CASE WHEN lower({_ALG}) = 'none' THEN 'alg=none' END, CASE WHEN {_EXPN} < 1750000000 THEN 'expired' END, CASE WHEN ({_EXPN} - {_IATN}) // 86400 >= 30 THEN 'long-lived (' || ({_EXPN} - {_IATN}) // 86400 || ' days)' END) AS warnings FROM dk"""
SQL["token_info"] = f"WITH {pe('events')}, {TOKENS} SELECT seq, coalesce('email=' || {js('payload', 'email')}, 'sub=' || {js('payload', 'sub')}, 'uid=' || {js('payload', 'uid')}, '') AS subject, coalesce({_EXPN}, 0) AS expires FROM dk"
SQL["stream_jwt"] = f"WITH {pe('events')}, {TOKENS} SELECT DISTINCT host, label AS issue FROM (" + " UNION ALL ".join(f"SELECT lower(host) AS host, {lab} AS label FROM dk WHERE {cond}" for cond, lab, _ in _ISSUES) + ")"
SQL["curl_text"] = f"""SELECT seq, 'curl -X ' || method || ' ''' || replace(url, '''', '''\\''''') || '''' || array_to_string(list_transform(req_headers, lambda h: ' -H ''' || replace(h.name || ': ' || h.value, '''', '''\\''''') || ''''), '')
|| CASE WHEN req_body <> '' THEN ' --data ''' || replace(req_body, '''', '''\\''''') || '''' ELSE '' END AS curl FROM ({adapter_sql('events')})"""


def nv(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda h: h.name || '=' || h.value), '|')"


_NOGA = "array_to_string(list_filter(list_transform(string_split(h.value, ';'), lambda c: trim(c)), lambda c: NOT starts_with(c, '_ga=')), '; ')"
_RW = f"list_transform(list_filter(req_headers, lambda h: lower(h.name) <> 'origin'), lambda h: CASE lower(h.name) WHEN 'user-agent' THEN {{'name': h.name, 'value': replace(h.value, 'probe', 'client')}} WHEN 'cookie' THEN {{'name': h.name, 'value': replace({_NOGA}, 'theme=dark; theme=light', 'theme=light')}} WHEN 'content-type' THEN {{'name': h.name, 'value': regexp_replace(h.value, '^([a-z]+)/', '\\1+')}} ELSE h END)"
SQL["rewrite_requests"] = f"SELECT seq, CASE WHEN len(list_filter(req_headers, lambda h: lower(h.name) = 'content-type')) > 0 THEN {nv(_RW)} || '|X-Trace=on' END AS headers FROM ({adapter_sql('events')})"
SQL["rewrite_precheck"] = f"SELECT count(*) FILTER (WHERE contains(url, 'track')) AS out_of_scope, count(*) FILTER (WHERE NOT contains(url, 'track') AND len(list_filter(req_headers, lambda h: h.name = 'Origin')) = 0) AS not_applicable, CAST(0 AS BIGINT) AS expired_tokens FROM ({adapter_sql('events')})"
SQL["openapi_params"] = """SELECT c_custkey * 8 + 5 AS seq, b || p AS endpoint_key, l AS location, n AS name FROM (SELECT c_custkey, 'https://spec' || c_nationkey || '.shop.example' AS b, CASE c_custkey % 5 WHEN 1 THEN '/c/' || c_custkey WHEN 2 THEN '/base' || c_nationkey || '/s/' || c_custkey ELSE '/y/' || c_custkey END AS p,
unnest(CASE c_custkey % 5 WHEN 1 THEN [{'l': 'HEADER', 'n': 'tenant'}, {'l': 'QUERY', 'n': 'q'}, {'l': 'HEADER', 'n': 'tenant'}] WHEN 2 THEN [{'l': 'BODY', 'n': 'body'}, {'l': 'COOKIE', 'n': 'sid'}] ELSE [{'l': 'QUERY', 'n': 'page'}] END, recursive := true) FROM customer WHERE c_custkey % 5 IN (1, 2, 3))"""
SQL["openapi_endpoints"] = """SELECT c_custkey * 8 + 5 AS seq, kind, m AS method, 'spec' || c_nationkey || '.shop.example' AS host, p AS path, 'https://spec' || c_nationkey || '.shop.example' || p AS normalized_url FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 1 THEN 'OpenAPI 3.0.' || c_custkey % 3 WHEN 2 THEN 'Swagger 2.0' ELSE 'OpenAPI 3.1.0' END AS kind,
unnest(CASE c_custkey % 5 WHEN 1 THEN [{'m': 'GET', 'p': '/c/' || c_custkey}, {'m': 'POST', 'p': '/c/' || c_custkey}, {'m': 'DELETE', 'p': '/v2/list' || c_nationkey}] WHEN 2 THEN [{'m': 'PUT', 'p': '/base' || c_nationkey || '/s/' || c_custkey}] ELSE [{'m': 'GET', 'p': '/y/' || c_custkey}] END, recursive := true) FROM customer WHERE c_custkey % 5 IN (1, 2, 3))"""
SQL["graphql_fields"] = """SELECT c_custkey * 8 + 5 AS seq, 'POST' AS method, '/graphql#Query.' || f AS path, 'https://spec' || c_nationkey || '.shop.example/graphql#Query.' || f AS normalized_url, a AS args FROM (SELECT c_custkey, c_nationkey, unnest([{'f': 'user' || c_custkey, 'a': 'id|first'}, {'f': 'me', 'a': ''}], recursive := true) FROM customer WHERE c_custkey % 5 = 0)"""
SQL["sourcemap_exposed"] = """SELECT c_custkey * 8 + 5 AS seq, 'Source map exposed' AS type, 'MEDIUM' AS severity, sha256('Source map exposed|sourcemap|' || u) AS fingerprint, u AS location FROM (SELECT c_custkey, 'https://spec' || c_nationkey || '.shop.example/static/app' || c_custkey || '.js.map' AS u FROM customer WHERE c_custkey % 5 = 4)"""
SQL["json_fields"] = None


def similarity(a: str, b: str) -> tuple[str, str]:
    """(columns, expression) of the similarity of two text columns."""
    def norm(x):
        return f"regexp_replace(regexp_replace(left(coalesce({x}, ''), 262144), '(?i)[0-9a-f-]{{32,80}}', '#', 'g'), '[0-9]{{8,40}}', '0', 'g')"

    def toks(x):
        return f"list_distinct(list_filter(list_transform(string_split_regex({x}, '[\\r\\n,;{{}}\\[\\]<>]+'), lambda t: lower(trim(t))), lambda t: t <> ''))"

    cols = f"{norm(a)} AS na, {norm(b)} AS nb, {toks('na')} AS ta, {toks('nb')} AS tb, len(list_intersect(ta, tb)) AS inter"
    ratio = "(least(length(na), length(nb))::DOUBLE / greatest(length(na), length(nb)))"
    e = f"CASE WHEN na = '' AND nb = '' THEN 1.0 WHEN na = '' OR nb = '' THEN 0.0 WHEN len(ta) + len(tb) - inter = 0 THEN {ratio} ELSE {ratio} * (inter::DOUBLE / (len(ta) + len(tb) - inter)) END"
    return cols, e


_C, _E = similarity("text", "other")
SQL["body_similarity"] = f"SELECT doc_id, round({_E}, 6) AS similarity FROM (SELECT *, {_C} FROM (SELECT a.doc_id AS doc_id, a.text AS text, b.text AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1))"
_C, _E = similarity("orig_body", "body")
RC = f"""rc AS MATERIALIZED (SELECT *, CASE WHEN status = 0 OR orig_status = 0 THEN 'NA' WHEN status IN (401, 403) OR (status BETWEEN 300 AND 399 AND status <> orig_status AND {m('location', pk.LOGIN_LOCATION)}) THEN 'BLOCKED' WHEN status = orig_status AND sim >= 0.9 THEN 'SAME' ELSE 'DIFFERENT' END AS verdict,
CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN verdict = 'NA' THEN 'NONE' ELSE verdict END AS outcome FROM (SELECT *, {_C}, {_E} AS sim FROM ({adapter_sql('replays')})))"""
CE = f"{RC}, ce AS MATERIALIZED (SELECT target_key, CASE WHEN identity = '' THEN 'Custom' ELSE identity END AS identity, arg_max(outcome, ts) AS outcome, arg_max(status, ts) AS status FROM rc GROUP BY 1, 2)"
SQL["replay_compare"] = f"WITH {RC} SELECT ts, verdict, outcome, CASE WHEN verdict = 'NA' THEN -1.0 ELSE round(sim, 6) END AS similarity, CAST(length - orig_length AS BIGINT) AS length_delta FROM rc"
SQL["matrix_counts"] = f"WITH {CE} SELECT o AS outcome, count(outcome) AS n FROM (SELECT unnest(['SAME', 'BLOCKED', 'DIFFERENT', 'ERROR', 'NONE']) AS o) LEFT JOIN (SELECT * FROM ce WHERE identity <> 'Original' OR outcome = 'ERROR') ON outcome = o GROUP BY o"
SQL["matrix_filter"] = f"WITH {CE} SELECT target_key, identity, outcome FROM ce WHERE target_key IN (SELECT target_key FROM ce WHERE identity <> 'Original' AND outcome IN ('BLOCKED', 'ERROR'))"
SQL["matrix_suspicious"] = f"WITH {CE} SELECT DISTINCT target_key FROM ce WHERE identity <> 'Original' AND outcome = 'SAME'"
_CT = "CASE WHEN outcome = 'ERROR' THEN 'Error' WHEN identity = 'Original' OR outcome = 'NONE' THEN CASE WHEN status = 0 THEN '' ELSE '' || status END ELSE trim(CASE WHEN status = 0 THEN '' ELSE '' || status END || ' ' || CASE outcome WHEN 'SAME' THEN '⚠ Same' WHEN 'BLOCKED' THEN 'Blocked' ELSE 'Different' END) END"
SQL["replay_matrix"] = f"WITH {CE}, t AS (SELECT target_key, identity, {_CT} AS x FROM ce) SELECT target_key, max(x) FILTER (WHERE identity = 'Original') AS original, max(x) FILTER (WHERE identity = 'No auth') AS no_auth, max(x) FILTER (WHERE identity = 'bob') AS bob, max(x) FILTER (WHERE identity = 'Custom') AS custom FROM t GROUP BY target_key"

# --- differences ---
_ORD = "SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus AS st, o_orderpriority AS pr FROM orders WHERE o_custkey % 50 <> 0"
OD = f"od AS (SELECT k, max(seq) AS seq, arg_max(st, seq) AS st, arg_max(pr, seq) AS pr FROM ({_ORD}) WHERE seq % 3 <> 0 GROUP BY k), nw AS (SELECT k, max(seq) AS seq, arg_max(st, seq) AS st, arg_max(pr, seq) AS pr FROM ({_ORD}) WHERE seq % 3 <> 1 GROUP BY k)"
SQL["diff_added"] = f"WITH {OD} SELECT k, seq, st AS o_orderstatus FROM nw WHERE k NOT IN (SELECT k FROM od)"
SQL["diff_removed"] = f"WITH {OD} SELECT k, seq, st AS o_orderstatus FROM od WHERE k NOT IN (SELECT k FROM nw)"
SQL["snapshot_diff"] = f"WITH {OD} SELECT CAST(coalesce(od.k, nw.k) AS VARCHAR) AS key, CASE WHEN od.k IS NULL THEN '+' WHEN nw.k IS NULL THEN '-' ELSE '~' END AS change FROM od FULL JOIN nw ON od.k = nw.k WHERE od.k IS NULL OR nw.k IS NULL OR od.st || '|' || od.pr <> nw.st || '|' || nw.pr"
SQL["line_diff"] = """WITH p AS (SELECT a.doc_id AS doc_id, string_split_regex(a.text, '\\r?\\n') AS x, string_split_regex(b.text, '\\r?\\n') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), q AS (SELECT doc_id, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i FROM p)
SELECT doc_id, CASE WHEN i > len(x) THEN '+' WHEN i > len(y) THEN '-' WHEN x[i] <> y[i] THEN '~' ELSE ' ' END AS change, count(*) AS n FROM q GROUP BY 1, 2"""
SQL["traffic_windows"] = f"SELECT time_bucket(INTERVAL 1 HOUR, observed_at) AS window_start, host, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors FROM ({adapter_sql('events')}) GROUP BY 1, 2"
SQL["traffic_sessions"] = f"""WITH c AS (SELECT observed_at AS t, regexp_extract({h('req_headers', 'cookie')}, 'JSESSIONID=([^;]*)', 1) AS client FROM ({adapter_sql('events')})), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS n FROM c WHERE client <> '' WINDOW w AS (PARTITION BY client ORDER BY t)),
k AS (SELECT *, sum(n) OVER (PARTITION BY client ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT client, min(t) AS session_start, max(t) + INTERVAL 60 MINUTE AS session_end, count(*) AS requests FROM k GROUP BY client, sid"""

# --- JavaScript ---
JB = f"jb AS MATERIALIZED (SELECT sha, min(seq) AS seq, arg_min(url, seq) AS url, first(resp_body) AS body, count(*) AS served FROM (SELECT *, sha256(resp_body) AS sha FROM ({adapter_sql('scripts')})) GROUP BY sha)"
_DEL = {"endpoints": "SELECT host FROM ep", "tech": "SELECT host FROM tm", "technologies": "SELECT host FROM tr", "parameters": "SELECT host FROM ph", "findings": "SELECT host FROM fh", "scripts": f"SELECT {host('url')} AS host FROM jb"}
SQL["delete_hosts"] = f"WITH {fi()}, {EP}, {PA}, {TECH}, {JB}, dh AS (SELECT host FROM tm WHERE regexp_matches(host, '^(?:api[0-2]|blog)')) SELECT 'kept requests' AS what, count(*) AS n FROM pe WHERE st > 0" + "".join(
    f" UNION ALL SELECT '{what} {name}', count(*) FROM ({sql}) WHERE host {op} (SELECT host FROM dh)" for name, sql in _DEL.items() for what, op in (("kept", "NOT IN"), ("deleted", "IN"))
)
_FILE = "lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1))"


def js_kind() -> str:
    pairs = []
    for kd, label, part, rx in jp.LIBRARIES:
        col = {"host": "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)", "file": _FILE, "banner": "left(body, 2048)"}[part]
        pre = {"library": "Library: ", "third-party": "3rd-party: ", "vendor": ""}[kd]
        val = s(pre + label.replace("$1", "").strip())
        if "$1" in label:
            val = f"{s(pre)} || trim({s(label.split('$1')[0])} || regexp_extract(left(body, 2048), {s('(?i)' + rx)}, 1))"
        pairs.append((m(col, "(?i)" + rx), val))
    return chain(pairs, "''")


JK = f"{JB}, jk AS MATERIALIZED (SELECT *, {js_kind()} AS kind FROM jb), jd AS (SELECT * FROM jk WHERE kind = '')"
SQL["js_kind"] = f"WITH {JK} SELECT sha AS sha256, url, kind FROM jk"
SQL["ordered_js_assets"] = f"WITH {JK} SELECT url, length(body) AS size, kind FROM jk"
_ALL = "flatten([" + ", ".join(f"regexp_extract_all(body, {s(rx)}, 1)" for _, rx in jp.LINK_RULES) + "])"
JL = f"jl AS MATERIALIZED (SELECT DISTINCT sha, seq, url, trim(lk) AS link FROM (SELECT sha, seq, url, unnest({_ALL}) AS lk FROM jd) WHERE length(trim(lk)) >= 3 AND NOT regexp_matches(trim(lk), '(?i)^[a-z]+/[a-z0-9.+-]+$') AND contains(lk, '/'))"
SQL["js_links"] = f"WITH {JK}, {JL} SELECT sha AS sha256, url AS js_url, link FROM jl"
JR = f"jr AS (SELECT seq, {route_rule('rt')} AS type, link AS raw_match, url AS location FROM (SELECT *, {route('link')} AS rt FROM jl))"
_RSEV = chain([(f"type = {s(r.name)}", s(r.severity)) for r in jp.ROUTES])
ROUTES = f"SELECT seq, type, {_RSEV} AS severity, raw_match, location FROM jr WHERE type IS NOT NULL"
SQL["js_routes"] = f"WITH {JK}, {JL}, {JR} SELECT seq, type, severity, {FINGER} AS fingerprint, location FROM ({ROUTES})"
_PRE2 = {"query string follow-on": r"(?:^|[^&])&([A-Za-z_][\w\-\[\]]{0,40})=(?:[^=&]|$)"}
_PALL = "flatten([" + ", ".join(f"regexp_extract_all(body, {s(_PRE2.get(n, rx))}, 1)" for n, rx in jp.PARAM_RULES) + "])"
JH = f"jh AS MATERIALIZED (SELECT DISTINCT sha, seq, url, name FROM (SELECT sha, seq, url, unnest({_PALL}) AS name FROM jd) WHERE length(name) >= 2)"
SQL["js_params"] = f"WITH {JK}, {JH} SELECT sha AS sha256, name, {m('name', jp.PARAM_INTERESTING)} AS interesting FROM jh"
SQL["js_param_names"] = f"WITH {JK}, {JH} SELECT name, arg_min(url, seq) AS js_url FROM jh GROUP BY name"
SQL["wordlist_params"] = f"WITH {ipe()}, {PA}, {_EPP}, {JK}, {JH} SELECT DISTINCT trim(name) AS word FROM (SELECT name FROM pa UNION ALL SELECT name FROM epp UNION ALL SELECT name FROM jh) WHERE trim(name) <> ''"
HIDDEN = f"SELECT seq, 'Hidden parameter in JS: ' || name AS type, 'LOW' AS severity, name AS raw_match, url AS location FROM jh WHERE {m('name', jp.PARAM_INTERESTING)}"
_LEADRX = scan(jp.LEAD_RULES, "true", src="jd")
SQL["js_lead_rules"] = f"WITH {JK} SELECT seq, type, severity, {FINGER} AS fingerprint, location FROM ({_LEADRX})"
_BC = "list_transform(regexp_extract_all(body, '(?s)/\\*(.*?)\\*/', 1), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)))"
_LC = "list_transform(regexp_extract_all(body, '(?:^|[^:/])//([^\\n\\r]*)', 1), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)))"
JSC = f"SELECT seq, 'JS Comment' AS type, 'INFO' AS severity, sha256('JS Comment' || t) AS raw_match, url AS location FROM (SELECT seq, url, unnest(list_concat({_BC}, {_LC})) AS t FROM jd) WHERE length(t) >= 4 AND {m('t', pk.COMMENT_INTERESTING)}"
SQL["js_comments"] = f"WITH {JK} SELECT seq, type, severity, {FINGER} AS fingerprint, location FROM ({JSC})"
SMR = "SELECT seq, 'Source map reference exposed' AS type, 'LOW' AS severity, 'sourcemap-ref|' || regexp_extract(url, '^(.*/)', 1) || r AS raw_match, url AS location FROM (SELECT seq, url, regexp_extract(body, '[/*][#@]\\s*sourceMappingURL\\s*=\\s*([^\\s''\"*]+)', 1) AS r FROM jb) WHERE r <> ''"
SQL["sourcemap_refs"] = f"WITH {JK} SELECT seq, type, severity, {FINGER} AS fingerprint, location FROM ({SMR})"
JSEC = scan(pk.SECRETS, "true", src="jk")
SQL["js_assets"] = f"WITH {JK}, {JL}, n1 AS (SELECT sha, count(*) AS n FROM jl GROUP BY sha), n2 AS (SELECT seq, count(*) AS n FROM ({JSEC}) GROUP BY seq) SELECT jk.sha AS sha256, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, length(body) AS size, kind, served, coalesce(n1.n, 0) AS endpoint_count, coalesce(n2.n, 0) AS secret_count FROM jk LEFT JOIN n1 ON n1.sha = jk.sha LEFT JOIN n2 ON n2.seq = jk.seq"
_V1 = "regexp_extract(body, '(?:const|let|var) ([a-zA-Z]+) = location[.]hash;', 1)"
_V2 = f"regexp_extract(body, '(?:const|let|var) ([a-zA-Z]+) = ' || {_V1} || ' [+]', 1)"
DOM = f"SELECT sha, seq, url, 'DOM XSS: URL fragment (location.hash) -> innerHTML/outerHTML' AS type, 'HIGH' AS severity, '.innerHTML =' AS raw_match FROM jd WHERE {_V1} <> '' AND {_V2} <> '' AND regexp_matches(body, '[.]innerHTML = ' || {_V2} || ';')"
GUARD = "SELECT sha, seq, url, 'Client-side authorization gate -> route: ' || x AS type, 'MEDIUM' AS severity, x AS raw_match FROM (SELECT sha, seq, url, regexp_extract(body, 'if [(][a-zA-Z]+[.]isAdmin[)] [{][^}]*''(/[^'']+)''', 1) AS x FROM jd) WHERE x <> ''"
_ARG = "regexp_extract(body, 'CryptoJS[.]AES[.]encrypt[(][a-z]+, ([a-zA-Z]+)', 1)"
ARGUMENT = f"SELECT sha, seq, url, 'Embedded crypto key/IV -> value: ' || x AS type, 'HIGH' AS severity, x AS raw_match FROM (SELECT sha, seq, url, regexp_extract(body, 'var ' || {_ARG} || ' = ''([^'']+)''', 1) AS x FROM jd WHERE {_ARG} <> '') WHERE x <> ''"
STRUCT = " UNION ALL ".join(f"SELECT seq, type, severity, raw_match, url AS location FROM ({x})" for x in (DOM, GUARD, ARGUMENT))
JF = f"{JK}, {JL}, {JR}, {JH}, je AS (" + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (ROUTES, HIDDEN, _LEADRX, JSC, SMR, JSEC, STRUCT)) + "), jf AS MATERIALIZED (SELECT type, raw_match, arg_min(severity, seq) AS severity, arg_min(location, seq) AS location, count(*) AS times_seen FROM je GROUP BY 1, 2)"
_W = "CASE severity WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END + CASE WHEN starts_with(type, 'DOM XSS:') THEN 5 ELSE 0 END"
SQL["js_risk"] = f"WITH {JF} SELECT location, count(*) AS findings, CAST(sum({_W}) AS BIGINT) AS score FROM jf GROUP BY location"
SQL["js_files_ranked"] = f"WITH {JF}, r AS (SELECT location, CAST(sum({_W}) AS BIGINT) AS score FROM jf GROUP BY location) SELECT location, score, dense_rank() OVER (ORDER BY score DESC) AS rank FROM r"
SQL["js_asset_risk"] = f"WITH {JF}, r AS (SELECT location, count(*) AS n, CAST(sum({_W}) AS BIGINT) AS score FROM jf GROUP BY location) SELECT sha AS sha256, url, coalesce(n, 0) AS finding_count, coalesce(score, 0) AS risk FROM jk LEFT JOIN r ON location = url"
SQL["js_noise"] = f"WITH {JF}, r AS (SELECT location, count(*) AS n FROM jf GROUP BY location), l AS (SELECT sha, count(*) AS k FROM jl GROUP BY sha) SELECT jk.sha AS sha256, url, kind, length(body) AS size, coalesce(n, 0) AS finding_count FROM jk LEFT JOIN r ON location = url LEFT JOIN l ON l.sha = jk.sha WHERE kind = '' AND NOT (length(body) < 2048 AND coalesce(k, 0) = 0 AND coalesce(n, 0) = 0)"
SQL["js_sourced_findings"] = f"WITH {JF} SELECT type, severity, location, times_seen FROM jf WHERE location IN (SELECT url FROM jk)"
SQL["nonlibrary_findings"] = f"WITH {JF} SELECT type, severity, location, times_seen FROM jf WHERE location NOT IN (SELECT url FROM jk WHERE kind <> '')"
SQL["js_summary"] = f"WITH {JF} SELECT '(files)' AS category, count(DISTINCT regexp_extract(regexp_replace(location, '[?].*$', ''), '([^/]*)$', 1)) AS n FROM jf UNION ALL SELECT {category('type')}, count(*) FROM jf GROUP BY 1"
_SEEN = f"sf AS (SELECT *, CASE WHEN starts_with(type, 'Sensitive route in JS: ') THEN {route('raw_match')} IN (SELECT {route('path')} FROM ep WHERE last_status <> 0) WHEN starts_with(type, 'Hidden parameter in JS: ') THEN raw_match IN (SELECT name FROM rp) END AS seen FROM jf)"
SQL["seen_flag"] = f"WITH {ipe('events')}, {EP}, {_RP}, {JF}, {_SEEN} SELECT type, {FINGER} AS fingerprint, seen FROM sf"
SQL["js_findings_view"] = f"WITH {ipe('events')}, {EP}, {_RP}, {JF}, {_SEEN} SELECT type, severity, location, regexp_extract(regexp_replace(location, '[?].*$', ''), '([^/]*)$', 1) AS file FROM sf WHERE severity IN ('MEDIUM', 'LOW') AND {category('type')} = 'Auth' AND location NOT IN (SELECT url FROM jk WHERE kind <> '') AND seen = false"
SQL["js_asset_detail"] = f"WITH {JF} SELECT sha AS sha256, 'finding' AS kind, type AS item FROM jk JOIN jf ON location = url UNION ALL SELECT jk.sha, 'endpoint', link FROM jk JOIN (SELECT DISTINCT url, link FROM jl) o ON o.url = jk.url"
SQL["stream_js_dedup"] = f"WITH {JK} SELECT sha AS sha256, length(body) AS size FROM jk"
SQL["js_rebuild"] = f"WITH {JK} SELECT sha AS sha256, url, kind FROM jk WHERE seq % 5 <> 0 AND seq % 7 <> 0"
SQL["js_body_store"] = f"WITH {JK} SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(left(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '_' || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[^a-z0-9._-]', '_', 'g'), '_+', '_', 'g'), 100), '\\.js$', '') || '_' || left(sha, 8) || '.js' AS file_name, sha AS sha256 FROM jk WHERE seq % 3 <> 0"
SQL["src_js_files"] = f"WITH x AS (SELECT seq, url, resp_body FROM ({adapter_sql('scripts')})), y AS (SELECT seq, url, resp_body FROM x UNION ALL SELECT seq + 1000000000000, 'import://' || {_FILE}, CASE WHEN seq % 8 = 3 THEN resp_body || chr(10) || '// local copy' ELSE resp_body END FROM x) SELECT sha256(resp_body) AS sha256, arg_min(url, seq) AS url, starts_with(arg_min(url, seq), 'import://') AS imported, count(*) AS served FROM y GROUP BY 1"
_NR = {r.name: r.regex for r in jp.NOTE_RULES}
_NOTES = " UNION ALL ".join(f"SELECT sha, {s(n)} AS k, unnest(regexp_extract_all(body, {s(rx)})) AS x FROM jd" for n, rx in _NR.items())
_SNIP = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
SQL["js_notes"] = f"WITH {JK} SELECT DISTINCT sha AS sha256, k || ': ' || {_SNIP} AS note FROM ({_NOTES})"
SQL["js_note_rows"] = f"WITH {JK} SELECT DISTINCT sha AS sha256, k AS kind, {_SNIP} AS detail, true AS has_hint FROM ({_NOTES})"

SQL = {k: v for k, v in SQL.items() if v}

# --- structural JavaScript: the adapter's bodies have known shapes ---
SQL["js_dom_flows"] = f"WITH {JK} SELECT sha AS sha256, type, severity, raw_match FROM ({DOM})"
SQL["js_guard_pairs"] = f"WITH {JK} SELECT sha AS sha256, type, severity, raw_match FROM ({GUARD})"
SQL["js_argument_pairs"] = f"WITH {JK} SELECT sha AS sha256, type, severity, raw_match FROM ({ARGUMENT})"
_METHOD = "regexp_extract(body, 'method: ''([A-Z]+)''', 1)"
_CF = f"""cf AS (SELECT sha, seq, url, unnest([
CASE WHEN regexp_matches(body, 'return fetch[(]''[^'']+'' [+] [a-z]+[.]id, ') THEN {{'m': {_METHOD}, 'p': regexp_extract(body, 'return fetch[(]''([^'']+)''', 1) || '{{id}}', 'auth': regexp_extract(body, 'headers: [{{]([A-Za-z-]+): ', 1) || CASE WHEN contains(body, 'localStorage') THEN ' (localStorage)' ELSE '' END, 'fn': regexp_extract(body, 'function ([a-zA-Z]+)[(]', 1), 'via': 'fetch'}} END,
CASE WHEN contains(body, 'await fetch(') THEN {{'m': 'GET', 'p': regexp_replace(regexp_extract(body, 'await fetch[(].([^?]+)[?]', 1), '[$][{{]([a-z]+)[}}]', '{{\\1}}'), 'auth': '', 'fn': regexp_extract(body, 'const ([a-zA-Z]+) = async', 1), 'via': 'fetch'}} END,
CASE WHEN contains(body, 'axios.put(') THEN {{'m': 'PUT', 'p': regexp_extract(body, 'axios.put[(]''([^'']+)''', 1), 'auth': regexp_extract(body, 'headers: [{{]''([^'']+)''', 1), 'fn': '', 'via': 'axios'}} END,
CASE WHEN contains(body, 'axios.get(') THEN {{'m': 'GET', 'p': regexp_extract(body, 'axios.get[(]''([^''?]+)', 1), 'auth': '', 'fn': '', 'via': 'axios'}} END,
CASE WHEN regexp_matches(body, 'return callApi[(]') THEN {{'m': {_METHOD}, 'p': regexp_extract(body, 'fetch[(]''([^'']+)''', 1) || regexp_extract(body, 'callApi[(]''([^'']+)''', 1) || '{{id}}', 'auth': '', 'fn': regexp_extract(body, 'function ([a-zA-Z]+)[(]id[)]', 1), 'via': 'wrapper callApi() → fetch'}} END], recursive := true) FROM jd)"""
SQL["client_flows"] = f"WITH {JK}, {_CF} SELECT m AS method, p AS path, arg_min({host('url')}, seq) AS host, max(auth) AS auth, max(fn) AS function, max(via) AS via, count(*) AS sightings FROM cf WHERE m IS NOT NULL GROUP BY 1, 2"
SQL["client_flow_wrappers"] = f"WITH {JK}, {_CF} SELECT sha AS sha256, m AS method, p AS path, via, fn AS function FROM cf WHERE m = 'DELETE'"
SQL["flow_type"] = f"WITH {JK}, {_CF} SELECT DISTINCT m AS method, p AS path, CASE WHEN contains(p, '{{') OR regexp_matches(p, '/[0-9]+(/|$)') OR p = '/admin/members' THEN 'Client Flow: IDOR candidate' END AS type, CASE WHEN contains(p, '{{id}}') THEN '{{id}}' WHEN regexp_matches(p, '/[0-9]+(/|$)') THEN 'the numeric path segment' WHEN p = '/admin/members' THEN 'user_id' END AS id_parameter FROM cf WHERE m IS NOT NULL"
SQL["flow_type"] = SQL["flow_type"].replace("WHEN contains(p, '{id}') OR", "WHEN").replace("contains(p, '{') OR regexp_matches", "contains(p, '{id}') OR regexp_matches").replace("THEN 'Client Flow: IDOR candidate' END", "THEN 'Client Flow: IDOR candidate' ELSE 'Client Flow: no auth in call' END")

# --- everything in one inventory ---
ALL = ("events", "pages", "documents", "scripts", "specs")
SQL["merged_endpoints"] = f"""WITH {ipe(*ALL)}, {JK}, {JL}, me AS (SELECT method, nurl AS u, seq, source FROM pe UNION ALL SELECT 'JS', link, seq, 'js' FROM jl
UNION ALL SELECT method, normalized_url, seq, 'spec' FROM ({SQL["openapi_endpoints"]}) UNION ALL SELECT method, normalized_url, seq, 'graphql' FROM ({SQL["graphql_fields"]}))
SELECT method, u AS normalized_url, count(*) AS observations, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, min(seq) AS first_seq FROM me GROUP BY 1, 2"""
_DECLARED = f"SELECT seq, endpoint_key, location, name FROM ({SQL['openapi_params']}) UNION ALL SELECT seq, normalized_url, 'JSON', unnest(string_split(args, '|')) FROM ({SQL['graphql_fields']}) WHERE args <> ''"
SQL["merged_parameters"] = f"""WITH {ipe(*ALL)}, {_RP}, {_JP}, mp AS (SELECT seq, pos, endpoint_key, location, name, value FROM rp UNION ALL SELECT seq, pos, endpoint_key, location, name, value FROM jpn
UNION ALL SELECT seq, 0, endpoint_key, location, name, NULL FROM ({_DECLARED}))
SELECT endpoint_key, location, name, coalesce(first(value ORDER BY seq, pos) FILTER (WHERE trim(value) <> ''), '') AS example, count(*) AS seen, min(seq) AS first_seq FROM mp GROUP BY 1, 2, 3"""
