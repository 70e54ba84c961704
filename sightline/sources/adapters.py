"""Test-table adapters: project the driver's tables onto the input schemas.

Each adapter is a list of stages of ``(column, SQL expression)``.  The expressions use
the vocabulary Spark SQL and other engines share, apart from four constructors
(arrays, header pairs, parameters, base64) that a dialect object spells out, so the same
projection can feed a Spark job and a check in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SparkDialect:
    @staticmethod
    def arr(*items: str) -> str:
        """Array of the non-null items."""
        return f"array_compact(array({', '.join(items)}))"

    @staticmethod
    def hdr(name: str, value: str) -> str:
        return f"named_struct('name', {name}, 'value', {value})"

    @staticmethod
    def par(loc: str, name: str, value: str) -> str:
        return f"named_struct('location', '{loc}', 'name', {name}, 'value', {value})"

    @staticmethod
    def b64url(x: str) -> str:
        """What ``translate`` has no counterpart for goes: padding and line breaks."""
        return f"translate(base64(CAST({x} AS BINARY)), '+/=\\r\\n', '-_')"

    @staticmethod
    def lazily(cond: str, x: str) -> str:
        """A costly column that is read in rows of one condition only."""
        return f"CASE WHEN {cond} THEN {x} END"

    @staticmethod
    def query_params(url: str) -> str:
        pairs = f"split(regexp_extract({url}, '[?]([^#]*)', 1), '&')"
        return (
            f"transform(filter({pairs}, p -> p <> ''), p -> named_struct('location', 'QUERY', "
            f"'name', split_part(p, '=', 1), 'value', split_part(p, '=', 2)))"
        )

    null_hdr = "CAST(NULL AS STRUCT<name: STRING, value: STRING>)"
    null_par = "CAST(NULL AS STRUCT<location: STRING, name: STRING, value: STRING>)"


def _when(d, cond: str, item: str, null: str | None = None) -> str:
    return f"CASE WHEN {cond} THEN {item} ELSE {null or d.null_hdr} END"


def events_stages(d) -> list[list[tuple[str, str]]]:
    """API-shaped traffic from ``events``; a third of it goes to one host."""
    e, u, k, t = "e", "u", "k", "t"
    jwt = (
        d.b64url("jh") + " || '.' || " + d.b64url("jp") + " || '.c2lnbmF0dXJl' || CAST(u AS STRING)"
    )
    base = [
        ("e", "event_id"),
        ("u", "user_id"),
        ("t", "event_type"),
        ("ts", "ts"),
        ("v", "value"),
        ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"),
        ("props", "props"),
    ]
    shape = [
        (c, c) for c in ("e", "u", "t", "ts", "v", "k", "props")
    ] + [
        ("host", f"CASE WHEN {e} % 3 = 0 THEN 'api.shop.example' ELSE 'api' || CAST({u} % 5 AS STRING) || '.shop.example' END"),
        ("scheme", f"CASE WHEN {u} % 4 = 0 THEN 'http' ELSE 'https' END"),
        ("port", f"CASE WHEN {u} % 6 = 0 THEN ':8443' WHEN {u} % 6 = 1 AND {u} % 4 <> 0 THEN ':443' ELSE '' END"),
        ("method", f"CASE WHEN {t} = 'view' THEN 'GET' WHEN {t} = 'click' THEN 'POST' WHEN {t} = 'signup' THEN 'POST' WHEN {t} = 'purchase' THEN CASE WHEN {e} % 2 = 0 THEN 'PUT' ELSE 'POST' END WHEN {e} % 11 = 0 THEN 'OPTIONS' ELSE 'GET' END"),
        ("path", f"CASE WHEN {t} = 'view' THEN '/api/items/' || CAST({u} AS STRING)"
                 f" WHEN {t} = 'click' THEN '/track/click'"
                 f" WHEN {t} = 'purchase' THEN '/api/orders/' || CAST({e} % 50 AS STRING)"
                 f" WHEN {t} = 'signup' THEN CASE {e} % 4 WHEN 0 THEN '/portal/login.aspx' WHEN 1 THEN '/api/v1/auth/signin' WHEN 2 THEN '/account/register' ELSE '/member/profile' END"
                 f" ELSE CASE {e} % 7 WHEN 0 THEN '/.env' WHEN 1 THEN '/backup/db.sql' WHEN 2 THEN '/admin/users' WHEN 3 THEN '/graphql' WHEN 4 THEN '/static/app.png' WHEN 5 THEN '/api/internal/debug' ELSE '/search' END END"),
        ("status", f"CAST(CASE WHEN {e} % 29 = 0 THEN NULL WHEN {e} % 13 = 0 THEN 401 WHEN {e} % 13 = 1 THEN 403 WHEN {e} % 13 = 2 THEN 302 WHEN {e} % 13 = 3 THEN 404 WHEN {e} % 13 = 4 THEN 500 WHEN {e} % 13 = 5 THEN 204 ELSE 200 END AS INT)"),
        ("ct", f"CASE WHEN {t} = 'view' THEN 'application/json; charset=utf-8' WHEN {t} = 'click' THEN 'text/plain' WHEN {t} = 'purchase' THEN 'application/json' WHEN {t} = 'signup' THEN 'text/html; charset=utf-8' WHEN {e} % 7 = 4 THEN 'image/png' ELSE 'text/html' END"),
        ("redir", f"CASE WHEN {e} % 10 = 0 THEN 'https://partner' || CAST({u} % 3 AS STRING) || '.example/home' WHEN {e} % 5 = 0 THEN '//out' || CAST({u} % 3 AS STRING) || '.example/' ELSE '' END"),
        ("tok", f"CASE WHEN {e} % 7 = 0 THEN md5(CAST({u} AS STRING)) ELSE '' END"),
        ("comment", f"CASE WHEN {e} % 4 = 0 THEN 'abc<i>' || CAST({k} AS STRING) WHEN {e} % 4 = 1 THEN 'plainword' ELSE 'item number ' || CAST({k} AS STRING) END"),
        ("jh", f"CASE WHEN {u} % 4 = 0 THEN '{{\"alg\":\"none\"}}' WHEN {u} % 4 = 1 THEN '{{\"alg\":\"HS256\",\"kid\":\"k' || CAST({u} % 3 AS STRING) || '\"}}' WHEN {u} % 4 = 2 THEN '{{\"alg\":\"RS256\",\"jku\":\"https://keys.example/jwks\"}}' ELSE '{{\"alg\":\"RS256\",\"typ\":\"JWT\"}}' END"),
        ("jp", f"CASE WHEN {u} % 3 = 0 THEN '{{\"sub\":\"user' || CAST({u} AS STRING) || '\"}}' WHEN {u} % 3 = 1 THEN '{{\"email\":\"u' || CAST({u} AS STRING) || '@mail.example\",\"iat\":1700000000,\"exp\":1800000000,\"role\":\"admin\"}}' ELSE '{{\"uid\":' || CAST({u} AS STRING) || ',\"iat\":1700000000,\"exp\":1700003600,\"password\":\"x\"}}' END"),
    ]
    names = [c for c, _ in shape]
    query = [(c, c) for c in names] + [
        ("jwt", jwt if not hasattr(d, "lazily") else d.lazily("e % 4 = 0 OR e % 6 = 0", jwt)),
        ("qs", "CASE WHEN t = 'view' THEN '?k=' || CAST(k AS STRING) || '&page=' || CAST(e % 3 AS STRING) "
               "|| CASE WHEN redir <> '' THEN '&redirect=' || redir ELSE '' END || CASE WHEN tok <> '' THEN '&token=' || tok ELSE '' END "
               "WHEN t = 'error' AND e % 7 = 6 THEN '?q=' || replace(comment, ' ', '+') || CASE WHEN redir <> '' THEN '&next=' || redir ELSE '' END ELSE '' END"),
        ("rct", "CASE WHEN t = 'purchase' THEN 'application/json' WHEN t = 'signup' THEN CASE WHEN e % 9 = 0 THEN 'multipart/form-data; boundary=x' ELSE 'application/x-www-form-urlencoded' END WHEN t = 'click' THEN CASE WHEN e % 8 = 0 THEN 'application/xml' WHEN e % 8 = 1 THEN 'application/json; charset=utf-8' ELSE 'text/plain' END ELSE '' END"),
        ("has_cookie", "e % 3 <> 1"),
        ("has_auth", "e % 4 = 0"),
    ]
    out = [
        ("seq", "e * 8"),
        ("observed_at", "ts"),
        ("source", "CASE WHEN e % 10 = 0 THEN 'sitemap' ELSE 'proxy' END"),
        ("method", "method"),
        ("url", "scheme || '://' || host || port || path || qs"),
        ("host", "host"),
        ("path", "path"),
        ("req_headers", d.arr(
            d.hdr("'Host'", "host"),
            d.hdr("'User-Agent'", "'probe/1.0 (build 20240101123456789)'"),
            _when(d, "has_cookie", d.hdr("'Cookie'", "'JSESSIONID=S' || CAST(u AS STRING) || '; _ga=GA1.2.' || CAST(u AS STRING) || '; theme=dark' || CASE WHEN e % 6 = 0 THEN '; app_k=' || jwt ELSE '' END || CASE WHEN e % 12 = 2 THEN '; theme=light; csrftoken=c' || CAST(e AS STRING) ELSE '' END")),
            _when(d, "has_auth", d.hdr("'Authorization'", "'Bearer ' || jwt")),
            _when(d, "e % 6 = 0", d.hdr("'Origin'", "'https://web' || CAST(u % 3 AS STRING) || '.shop.example'")),
            _when(d, "rct <> ''", d.hdr("'content-type'", "rct")),
            _when(d, "e % 10 = 0", d.hdr("'X-CSRF-Token'", "'t' || CAST(e AS STRING)")),
            _when(d, "e % 15 = 0", d.hdr("'X-Api-Key'", "'key' || CAST(u AS STRING)")),
        )),
        ("params", d.arr(
            _when(d, "t = 'view'", d.par("QUERY", "'k'", "CAST(k AS STRING)"), d.null_par),
            _when(d, "t = 'view'", d.par("QUERY", "'page'", "CAST(e % 3 AS STRING)"), d.null_par),
            _when(d, "t = 'view' AND redir <> ''", d.par("QUERY", "'redirect'", "redir"), d.null_par),
            _when(d, "t = 'view' AND tok <> ''", d.par("QUERY", "'token'", "tok"), d.null_par),
            _when(d, "t = 'error' AND e % 7 = 6", d.par("QUERY", "'q'", "comment"), d.null_par),
            _when(d, "t = 'error' AND e % 7 = 6 AND redir <> ''", d.par("QUERY", "'next'", "redir"), d.null_par),
            _when(d, "t = 'signup'", d.par("BODY", "'user_id'", "CAST(u AS STRING)"), d.null_par),
            _when(d, "t = 'signup'", d.par("BODY", "'comment'", "comment"), d.null_par),
            _when(d, "t = 'signup' AND e % 5 = 0", d.par("BODY", "'_csrf'", "'t' || CAST(e AS STRING)"), d.null_par),
            _when(d, "has_cookie", d.par("COOKIE", "'JSESSIONID'", "'S' || CAST(u AS STRING)"), d.null_par),
            _when(d, "e % 21 = 0", d.par("XML", "'x'", "'1'"), d.null_par),
        )),
        ("req_body", "CASE WHEN t = 'purchase' THEN '{\"qty\":' || CAST(k AS STRING) || ',\"ship\":{\"city\":\"town' || CAST(u % 9 AS STRING) || '\",\"lines\":[{\"sku\":\"sku-' || CAST(k AS STRING) || '\",\"n\":1},{\"other\":2}]},\"tags\":[\"a\",\"b\"],\"gift\":true}' "
                     "WHEN t = 'signup' AND e % 9 = 0 THEN '--x' || chr(13) || chr(10) || 'Content-Disposition: form-data; name=\"f\"; filename=\"cv' || CAST(u AS STRING) || '.pdf\"' || chr(13) || chr(10) || chr(13) || chr(10) || 'data' "
                     "WHEN t = 'signup' THEN 'user_id=' || CAST(u AS STRING) || '&comment=' || replace(comment, ' ', '+') ELSE '' END"),
        ("status", "status"),
        ("resp_headers", "CASE WHEN status IS NULL THEN NULL ELSE " + d.arr(
            d.hdr("'Content-Type'", "ct"),
            _when(d, "e % 8 = 0", d.hdr("'Access-Control-Allow-Origin'", "'*'")),
            _when(d, "e % 8 = 4", d.hdr("'Access-Control-Allow-Origin'", "'https://web' || CAST(u % 3 AS STRING) || '.shop.example'")),
            _when(d, "e % 16 < 5", d.hdr("'Access-Control-Allow-Credentials'", "'true'")),
            _when(d, "e % 40 = 0", d.hdr("'Access-Control-Allow-Methods'", "'*'")),
            _when(d, "e % 56 = 0", d.hdr("'Access-Control-Allow-Headers'", "'*'")),
            _when(d, "e % 20 = 4", d.hdr("'Vary'", "'Accept, Origin'")),
            _when(d, "e % 5 = 0", d.hdr("'Cache-Control'", "'no-store'")),
            _when(d, "e % 5 = 1", d.hdr("'Cache-Control'", "'max-age=60'")),
            _when(d, "e % 9 = 0", d.hdr("'Set-Cookie'", "'sid=' || md5(CAST(u AS STRING)) || '; Path=/'")),
            _when(d, "e % 9 < 2", d.hdr("'set-cookie'", "'PHPSESSID=p' || CAST(u AS STRING) || '; HttpOnly; Secure; SameSite=Lax'")),
            _when(d, "e % 7 = 0", d.hdr("'Content-Security-Policy'", "'default-src * ' || chr(39) || 'unsafe-inline' || chr(39) || '; img-src a.example'")),
            _when(d, "e % 7 = 1", d.hdr("'Content-Security-Policy'", "'script-src ' || chr(39) || 'unsafe-eval' || chr(39) || ' b.example; frame-ancestors ' || chr(39) || 'none' || chr(39)")),
            _when(d, "e % 7 = 2", d.hdr("'Content-Security-Policy'", "'img-src *; object-src c.example'")),
            _when(d, "status = 302", d.hdr("'Location'", "CASE WHEN redir <> '' THEN redir ELSE '/portal/login.aspx?next=/' END")),
            _when(d, "e % 4 < 2", d.hdr("'Server'", "CASE WHEN u % 2 = 0 THEN 'nginx/1.25' ELSE 'Apache/2.4' END")),
            _when(d, "e % 10 = 3", d.hdr("'X-Powered-By'", "'PHP/8.2'")),
            _when(d, "e % 6 = 1", d.hdr("'X-Frame-Options'", "'DENY'")),
            _when(d, "e % 18 = 0", d.hdr("'X-RateLimit-Limit'", "'100'")),
        ) + " END"),
        ("content_type", "CASE WHEN status IS NULL THEN NULL ELSE ct END"),
        ("resp_body", "CASE WHEN status IS NULL THEN NULL "
            "WHEN t = 'view' THEN '{\"id\":' || CAST(u AS STRING) || ',\"owner\":{\"name\":\"n' || CAST(k AS STRING) || '\",\"password\":' || CASE WHEN e % 3 = 0 THEN '\"****\"' WHEN e % 3 = 1 THEN '\"hash' || CAST(u AS STRING) || '\"' ELSE 'null' END || '},\"otp\":' || CAST(k AS STRING) || ',\"access_level\":\"' || CASE WHEN u % 2 = 0 THEN 'gold' ELSE 'basic' END || '\"' || CASE WHEN e % 17 = 0 THEN '' ELSE '}' END "
            "WHEN t = 'purchase' THEN '{\"qty\":' || CAST(k AS STRING) || ',\"data\":{\"isAdmin\":false,\"role\":\"USER\",\"deep\":{\"tier\":1}},\"items\":[{\"price\":9}],\"sku\":\"sku-' || CAST(k AS STRING) || '\"}' "
            "WHEN t = 'click' THEN 'call 010-' || lpad(CAST(1000 + e % 9000 AS STRING), 4, '0') || '-' || lpad(CAST(u % 10000 AS STRING), 4, '0') || ' id 9' || CAST(e % 10 AS STRING) || '0' || CAST(1 + e % 9 AS STRING) || '1' || CAST(e % 9 AS STRING) || '-1' || lpad(CAST((e * 7919) % 1000000 AS STRING), 6, '0') || ' card 4539 ' || lpad(CAST(e % 10000 AS STRING), 4, '0') || ' 5787 ' || lpad(CAST((e * 31) % 10000 AS STRING), 4, '0') || ' end, host 10.0.' || CAST(u % 200 AS STRING) || '.7 mail m' || CAST(u AS STRING) || '@corp.example' "
            "WHEN t = 'signup' THEN '<html><head><meta name=\"generator\" content=\"Kit ' || CAST(u % 4 AS STRING) || '\"></head><body><p>' || comment || '</p><!-- TODO remove debug user ' || CAST(u % 6 AS STRING) || ' --><script src=\"http://cdn.example/jquery-3.6.' || CAST(u % 3 AS STRING) || '.min.js\"></script></body></html>' "
            "WHEN e % 7 = 2 THEN '<title>Index of /backup</title> role: \"admin\", roles: [1] token = \"abcd' || md5(CAST(u AS STRING)) || '\"' "
            "WHEN e % 7 = 5 THEN 'java.lang.IllegalStateException: boom ' || CAST(u % 8 AS STRING) || chr(10) || chr(9) || 'at a.b.C.run(C.java:10)' || chr(10) || chr(9) || 'at a.b.Main.main(Main.java:3)' || chr(10) || 'in /var/www/app' || CAST(u % 4 AS STRING) || '/index.php' "
            "WHEN e % 7 = 6 THEN '<html><b>' || comment || '</b></html>' "
            "WHEN e % 7 = 3 THEN '{\"data\":1}' "
            "ELSE 'You have an error in your SQL syntax; check the manual for MySQL ' || CAST(u % 5 AS STRING) END"),
    ]
    return [base, shape, query, out]


def pages_stages(d) -> list[list[tuple[str, str]]]:
    host = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
    return [[
        ("seq", "page_id * 8 + 1"),
        ("observed_at", "CAST('2024-02-01 00:00:00' AS TIMESTAMP)"),
        ("source", "'sitemap'"),
        ("method", "'GET'"),
        ("url", "url"),
        ("host", host),
        ("path", "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"),
        ("req_headers", d.arr(d.hdr("'Host'", host))),
        ("params", d.query_params("url")),
        ("req_body", "''"),
        ("status", "CAST(200 AS INT)"),
        ("resp_headers", d.arr(
            d.hdr("'Content-Type'", "'text/html; charset=utf-8'"),
            _when(d, "page_id % 3 = 0", d.hdr("'X-Frame-Options'", "'DENY'")),
            _when(d, "page_id % 4 = 0", d.hdr("'Server'", "'nginx'")),
        )),
        ("content_type", "'text/html; charset=utf-8'"),
        ("resp_body", "html"),
    ]]


def documents_stages(d) -> list[list[tuple[str, str]]]:
    url = "'https://' || source || '.docs.example/' || lang || '/' || CAST(doc_id AS STRING)"
    return [[
        ("seq", "doc_id * 8 + 2"),
        ("observed_at", "CAST('2024-03-01 00:00:00' AS TIMESTAMP)"),
        ("source", "'sitemap'"),
        ("method", "'GET'"),
        ("url", url),
        ("host", "source || '.docs.example'"),
        ("path", "'/' || lang || '/' || CAST(doc_id AS STRING)"),
        ("req_headers", d.arr(d.hdr("'Host'", "source || '.docs.example'"))),
        ("params", d.arr(d.null_par)),
        ("req_body", "''"),
        ("status", "CAST(200 AS INT)"),
        ("resp_headers", d.arr(d.hdr("'Content-Type'", "'text/plain; charset=utf-8'"))),
        ("content_type", "'text/plain; charset=utf-8'"),
        ("resp_body", "text"),
    ]]


def scripts_stages(d) -> list[list[tuple[str, str]]]:
    """JavaScript responses from ``events``: a few bundles per user, served many times."""
    q = "chr(39)"
    file = (
        "CASE u % 8 WHEN 6 THEN 'jquery-3.6.' || CAST(u % 10 AS STRING) || '.min.js' WHEN 7 THEN 'vendors~main.' || CAST(u AS STRING) || '.chunk.js' "
        "ELSE 'app-' || CAST(u AS STRING) || '.js' END"
    )
    body = (
        "'/* build ' || CAST(k % 2 AS STRING) || ' user ' || CAST(u AS STRING) || ' */' || chr(10) || CASE u % 8 "
        # 0: DOM flow through two variables
        f"WHEN 0 THEN 'function paintCrumb' || CAST(u AS STRING) || '(){{ const frag = location.hash; const label = frag + 1; crumbBox.innerHTML = label; }} var shelf = ' || {q} || '/shelf/' || CAST(u AS STRING) || {q} || ';' "
        # 1: fetch with options, and a template literal
        f"WHEN 1 THEN 'function storeParcel(parcel){{ return fetch(' || {q} || '/api/parcels/' || {q} || ' + parcel.id, {{method: ' || {q} || 'PATCH' || {q} || ', headers: {{Authorization: ' || {q} || 'Token ' || {q} || ' + localStorage.getItem(' || {q} || 'pass' || {q} || ')}}, body: JSON.stringify({{weight: kg, zone: z' || CAST(u AS STRING) || '}})}}); }} const listStops = async (lane) => {{ const answer = await fetch(`/api/v' || CAST(u % 4 AS STRING) || '/lanes/$' || '{{lane}}/stops?from=$' || '{{first}}&limit=50`); }};' "
        # 2: axios and routes
        f"WHEN 2 THEN 'axios.put(' || {q} || '/api/notes/' || CAST(u AS STRING) || {q} || ', {{headline: h, pinned: p}}, {{headers: {{' || {q} || 'X-Api-Key' || {q} || ': key}}}}); axios.get(' || {q} || '/admin/members?debug=1&user_id=' || {q} || ' + picked); var more = \"/api/orders/' || CAST(k % 2 AS STRING) || '\"; // TODO drop admin token' || chr(10) "
        # 3: guard pair
        f"WHEN 3 THEN 'if (viewer.isAdmin) {{ openPage(' || {q} || '/admin/ledger' || CAST(u AS STRING) || {q} || '); }} later(' || {q} || '/start' || {q} || '); var s = \"https://stage' || CAST(u % 9 AS STRING) || '.corp.internal/x\";' "
        # 4: argument pair
        f"WHEN 4 THEN 'function sealNote(plain){{ var short = ' || {q} || '0123456789abcdefXY' || lpad(CAST(u AS STRING), 4, ' ') || {q} || '; var seal = ' || {q} || 'qrstuvwxyzabcdefghij' || CAST(u AS STRING) || {q} || '; return CryptoJS.AES.encrypt(plain, seal, {{iv: start}}); }} aesKey = \"A1b2C3d4E5f6' || CAST(u AS STRING) || '\";' "
        # 5: parameters, comments, source map, wrapper
        f"WHEN 5 THEN 'function callApi(tail, opts) {{ return fetch(' || {q} || '/api' || {q} || ' + tail, opts); }} function dropParcel(id){{ return callApi(' || {q} || '/parcels/' || {q} || ' + id, {{method: ' || {q} || 'DELETE' || {q} || '}}); }} var asked = new URLSearchParams(location.search); var v = params.get(' || {q} || 'role' || {q} || '); params: {{ tier: 1 }}; eval(v); //# sourceMappingURL=app.' || CAST(u AS STRING) || '.js.map' || chr(10) "
        f"WHEN 6 THEN '/*! jQuery v3.6.' || CAST(u % 10 AS STRING) || ' */ var z = ' || {q} || '/lib/' || CAST(u AS STRING) || {q} || ';' "
        f"ELSE 'var vendor = ' || {q} || '/vendor/' || CAST(u AS STRING) || {q} || '; fetch(' || {q} || '/api/vendor' || {q} || ');' END"
    ).replace("{{", "{").replace("}}", "}")
    base = [
        ("e", "event_id"), ("u", "user_id"), ("ts", "ts"),
        ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"),
    ]
    shape = [(c, c) for c in ("e", "u", "ts", "k")] + [
        ("host", "CASE WHEN e % 3 = 0 THEN 'cdn.shop.example' ELSE 'web' || CAST(u % 3 AS STRING) || '.shop.example' END"),
        ("file", file),
        ("body", body),
    ]
    out = [
        ("seq", "e * 8 + 3"),
        ("observed_at", "ts"),
        ("source", "'proxy'"),
        ("method", "'GET'"),
        ("url", "'https://' || host || '/static/' || file || CASE WHEN e % 2 = 0 THEN '?v=' || CAST(k AS STRING) ELSE '' END"),
        ("host", "host"),
        ("path", "'/static/' || file"),
        ("req_headers", d.arr(d.hdr("'Host'", "host"))),
        ("params", d.arr(_when(d, "e % 2 = 0", d.par("QUERY", "'v'", "CAST(k AS STRING)"), d.null_par))),
        ("req_body", "''"),
        ("status", "CAST(200 AS INT)"),
        ("resp_headers", d.arr(d.hdr("'Content-Type'", "'application/javascript'"))),
        ("content_type", "'application/javascript'"),
        ("resp_body", "body"),
    ]
    return [base, shape, out]


def specs_stages(d) -> list[list[tuple[str, str]]]:
    """API descriptions from ``customer``: OpenAPI as JSON or YAML, and GraphQL schemas."""
    nl = "chr(10)"
    key = "CAST(c AS STRING)"
    openapi = (
        f"'{{\"openapi\":\"3.0.' || CAST(c % 3 AS STRING) || '\",\"paths\":{{\"/c/' || {key} || '\":{{\"parameters\":[{{\"name\":\"tenant\",\"in\":\"header\"}}],"
        f"\"get\":{{\"parameters\":[{{\"name\":\"q\",\"in\":\"query\"}},{{\"name\":\"id\",\"in\":\"path\"}}]}},\"post\":{{\"x\":1}},\"summary\":\"s\"}},\"v2/list' || CAST(n AS STRING) || '\":{{\"delete\":{{}}}}}}}}'"
    )
    swagger = (
        f"'{{\"swagger\":\"2.0\",\"basePath\":\"/base' || CAST(n AS STRING) || '\",\"paths\":{{\"/s/' || {key} || '\":{{\"put\":{{\"parameters\":[{{\"name\":\"body\",\"in\":\"body\"}},{{\"name\":\"sid\",\"in\":\"cookie\"}}]}}}}}}}}'"
    )
    yaml = (
        f"'openapi: 3.1.0' || {nl} || 'paths:' || {nl} || '  /y/' || {key} || ':' || {nl} || '    get:' || {nl} || '      parameters:' || {nl}"
        f" || '        - name: page' || {nl} || '          in: query' || {nl}"
    )
    graphql = (
        f"'{{\"data\":{{\"__schema\":{{\"types\":[{{\"kind\":\"OBJECT\",\"name\":\"Query\",\"fields\":[{{\"name\":\"user' || {key} || '\",\"args\":[{{\"name\":\"id\"}},{{\"name\":\"first\"}}]}},{{\"name\":\"me\",\"args\":[]}}]}},"
        f"{{\"kind\":\"OBJECT\",\"name\":\"__Type\",\"fields\":[{{\"name\":\"kind\"}}]}},{{\"kind\":\"ENUM\",\"name\":\"E\"}}]}}}}}}'"
    )
    smap = f"'{{\"version\":3,\"sources\":[\"src/a' || {key} || '.ts\",\"src/b.ts\",\"c.ts\",\"d.ts\"],\"mappings\":\"AAAA\"}}'"
    base = [("c", "c_custkey"), ("n", "c_nationkey")]
    kind = [(c, c) for c in ("c", "n")] + [
        ("kind", "CASE WHEN c % 5 = 0 THEN 'graphql' WHEN c % 5 = 1 THEN 'openapi' WHEN c % 5 = 2 THEN 'swagger' WHEN c % 5 = 3 THEN 'yaml' ELSE 'map' END"),
        ("host", "'spec' || CAST(n AS STRING) || '.shop.example'"),
    ]
    out = [
        ("seq", "c * 8 + 5"),
        ("observed_at", "CAST('2024-04-01 00:00:00' AS TIMESTAMP)"),
        ("source", "'sitemap'"),
        ("method", "CASE WHEN kind = 'graphql' THEN 'POST' ELSE 'GET' END"),
        ("url", "'https://' || host || CASE WHEN kind = 'graphql' THEN '/graphql' WHEN kind = 'map' THEN '/static/app' || CAST(c AS STRING) || '.js.map' ELSE '/docs/' || kind || CAST(c AS STRING) END"),
        ("host", "host"),
        ("path", "CASE WHEN kind = 'graphql' THEN '/graphql' ELSE '/docs/' || kind || CAST(c AS STRING) END"),
        ("req_headers", d.arr(d.hdr("'Host'", "host"))),
        ("params", d.arr(d.null_par)),
        ("req_body", "''"),
        ("status", "CAST(200 AS INT)"),
        ("resp_headers", d.arr(d.hdr("'Content-Type'", "CASE WHEN kind = 'yaml' THEN 'application/yaml' ELSE 'application/json' END"))),
        ("content_type", "CASE WHEN kind = 'yaml' THEN 'application/yaml' ELSE 'application/json' END"),
        ("resp_body", f"CASE kind WHEN 'graphql' THEN {graphql} WHEN 'openapi' THEN {openapi} WHEN 'swagger' THEN {swagger} WHEN 'map' THEN {smap} ELSE {yaml} END"),
    ]
    return [base, kind, out]


def replays_stages(d) -> list[list[tuple[str, str]]]:
    """Stored replays from ``events``: cells of (target, identity), several runs each."""
    base = [
        ("e", "event_id"), ("u", "user_id"), ("t", "event_type"), ("ts", "ts"), ("v", "value"),
        ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"),
    ]
    body = "'{\"type\":\"' || t || '\",\"user\":' || CAST({u} AS STRING) || ',\"at\":' || CAST(1700000000000 + e AS STRING) || ',\"token\":\"' || md5(CAST(e AS STRING)) || '\",\"rows\":[' || CAST({k} AS STRING) || ',2,3]}}'"
    orig = body.replace("{u}", "u").replace("{k}", "k").replace("}}", "}")
    new = body.replace("{u}", "CASE WHEN e % 4 = 0 THEN u + 1 ELSE u END").replace("{k}", "CASE WHEN e % 5 = 0 THEN k + 1 ELSE k END").replace("md5(CAST(e AS STRING))", "md5(CAST(e + 1 AS STRING))").replace("}}", "}")
    out = [
        ("method", "'GET'"),
        ("host", "'api.shop.example'"),
        ("path", "'/api/' || t || '/' || CAST(u AS STRING)"),
        ("target_key", "'GET api.shop.example/api/' || t || '/' || CAST(u AS STRING)"),
        ("identity", "CASE e % 4 WHEN 0 THEN 'Original' WHEN 1 THEN 'No auth' WHEN 2 THEN 'bob' ELSE '' END"),
        ("run_id", "CAST(e % 3 AS INT)"),
        ("ts", "e"),
        ("error", "CASE WHEN e % 19 = 0 THEN 'timeout' ELSE NULL END"),
        ("status", "CAST(CASE WHEN e % 19 = 0 THEN 0 WHEN e % 7 = 0 THEN 403 WHEN e % 7 = 1 THEN 302 ELSE 200 END AS INT)"),
        ("body", new),
        ("length", f"CAST(length({new}) AS INT)"),
        ("location", "CASE WHEN e % 7 = 1 AND e % 2 = 0 THEN '/portal/login.aspx' WHEN e % 7 = 1 THEN '/home' ELSE NULL END"),
        ("orig_status", "CAST(CASE WHEN e % 23 = 0 THEN 0 WHEN e % 14 = 1 THEN 302 ELSE 200 END AS INT)"),
        ("orig_body", orig),
        ("orig_length", f"CAST(length({orig}) AS INT)"),
    ]
    return [base, out]


STAGES = {
    "events": ("events", events_stages),
    "pages": ("pages", pages_stages),
    "documents": ("documents", documents_stages),
    "scripts": ("events", scripts_stages),
    "specs": ("customer", specs_stages),
    "replays": ("events", replays_stages),
}


#: A table of more bytes than this is never dealt anew, however few its splits are.
SMALL_TABLE = 256 << 20


#: Bytes of a small table that one task gets at most, as far as whole rounds of tasks allow.
DEALT = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table evenly over the cores; leave any other alone.

    The number of its splits says nothing: a split that holds the start of no row group is empty, and
    a file of a few long row groups keeps as many cores busy.
    """
    parts = dealt(df)
    return df.repartition(parts) if parts else df


def dealt(df: DataFrame) -> int:
    """The number of partitions that a small table is dealt to; 0 for any other."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return cores * max(1, -(-size // (cores * DEALT))) if size <= SMALL_TABLE else 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, stages: list[list[tuple[str, str]]]) -> DataFrame:
    """Each column is built once a row, after the rows are dealt.

    Spark moves a deterministic condition on these columns below the projections and the deal, where
    the few tasks that read the file build every column again for each time the condition names it.
    It moves none past a condition on the partition, which always holds.
    """
    df = spread(df)
    for stage in stages:
        df = df.selectExpr(*[f"{expr} AS {name}" for name, expr in stage])
    return df.where(F.spark_partition_id() >= 0)


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, stages = STAGES[name]
    return project(read_table(spark, sf_dir, table), stages(SparkDialect))


def capture(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Union of exchange adapters; by default everything a capture would hold."""
    out = None
    for p in parts or ("events", "pages", "documents", "scripts"):
        df = adapt(spark, sf_dir, p)
        out = df if out is None else out.unionByName(df)
    return out
