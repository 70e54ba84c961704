"""Literal cases of the network detectors, positive and negative."""

import pytest
from conftest import row
from pyspark.sql import functions as F

from sightline.operators import detect, jwt
from sightline.rules import packs

COOKIE = {"Cookie": "JSESSIONID=1"}
JSON = {"Content-Type": "application/json"}


def types(df):
    return sorted((r["seq"], r["type"], r["severity"]) for r in df.collect())


def run(ex, *fns):
    return types(detect.explode_findings(detect.prepare(ex), *[f() for f in fns]))


def test_access(exchanges):
    j = "application/json"
    ex = exchanges(
        row(1, url="https://h.example/api/orders", ct=j), row(2, url="https://h.example/admin/users"), row(3, url="https://h.example/api/orders", ct=j, req=COOKIE),
        row(4, url="https://h.example/api/orders", ct=j, status=401), row(5, url="https://h.example/api/orders", ct=j, status=204),
        row(6, url="https://h.example/api/orders", ct=j, method="OPTIONS"), row(7, url="https://h.example/admin/app.js"), row(8, url="https://h.example/about"),
    )
    assert run(ex, detect.unauth_access) == [(1, "Unauthenticated access: API", "LOW"), (2, "Unauthenticated access: admin", "MEDIUM")]


def test_csrf(exchanges):
    def post(seq, **k):
        return row(seq, method="POST", url=k.pop("url", "https://h.example/profile"), req={**COOKIE, **k.pop("req", {})}, **k)

    form = {"Content-Type": "application/x-www-form-urlencoded"}
    ex = exchanges(
        post(1, req=form, params=[("BODY", "nickname", "a")]), post(2, req=JSON), post(3, req=form, params=[("BODY", "_csrf", "a")]), post(4, req={**form, "X-XSRF-TOKEN": "1"}),
        post(5, req={**form, "Authorization": "Bearer x"}), post(6, req={"Content-Type": "application/xml"}), post(7, req=form, url="https://h.example/portal/login.aspx"),
        row(8, method="POST", url="https://h.example/profile", req=form), row(9, url="https://h.example/profile", req=COOKIE),
    )
    assert run(ex, detect.csrf) == [(1, "CSRF candidate", "LOW"), (2, "CSRF candidate", "INFO")]


def test_upload_and_auth_flow(exchanges):
    mp = {"Content-Type": "multipart/form-data; boundary=b"}
    ex = exchanges(
        row(1, method="POST", url="https://h.example/u", req=mp, req_body='--b\r\nContent-Disposition: form-data; name="f"; filename="cv.pdf"\r\n'),
        row(2, method="POST", url="https://h.example/u", req=mp, req_body='--b\r\nContent-Disposition: form-data; name="title"\r\n'),
        row(3, method="POST", url="https://h.example/portal/login.aspx"), row(4, method="POST", url="https://h.example/api/v1/auth/signin"),
    )
    assert run(ex, detect.upload) == [(1, "File upload endpoint", "INFO")]
    assert run(ex, detect.auth_flow) == [(3, "Auth flow endpoint: login", "INFO"), (4, "Auth flow endpoint: login", "INFO")]


def test_json_bodies(exchanges):
    j = "application/json"
    put = dict(method="PUT", url="https://h.example/me", req=JSON, ct=j)
    ex = exchanges(
        row(1, req_body='{"nickname":"a"}', body='{"data":{"id":7,"nickname":"a","role":"USER","isAdmin":false}}', **put),
        row(2, req_body='{"user_role":"a"}', body='{"userRole":"a"}', **put), row(3, url="https://h.example/me", ct=j, body='{"role":"x"}'),
        row(4, req_body='{"a":1}', body='{"rows":[{"role":"x"}]}', **put),
        row(5, url="https://h.example/x", ct=j, body='{"id":1,"password":"abcd","pin":""}'), row(6, url="https://h.example/x", ct=j, body='{"password":"****","otp":null,"pin":true}'),
        row(7, url="https://h.example/x", ct=j, body='{"password":"abc"'), row(8, url="https://h.example/x", ct=j, body="[" * 200_000),
        row(9, url="https://h.example/x", ct=j, body='{"note":"\\"password\\":\\"x\\""}'),
    )
    assert [t[:2] for t in run(ex, detect.mass_assignment)] == [(1, "Mass assignment candidate: isAdmin"), (1, "Mass assignment candidate: role")]
    got = detect.explode_findings(detect.prepare(ex), detect.sensitive_fields()).collect()
    assert sorted((r["seq"], r["type"]) for r in got) == [(5, "Sensitive field in response: password"), (7, "Sensitive field in response: password")]
    assert not any("abcd" in r["evidence"] for r in got)


def test_headers(exchanges):
    ex = exchanges(
        row(1, resp={"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Credentials": "true"}),
        row(2, req={"Origin": "https://a.example"}, resp={"Access-Control-Allow-Origin": "https://a.example", "Vary": "Origin"}),
        row(3, resp=[("Set-Cookie", "a=1; HttpOnly"), ("Set-Cookie", "b=2; Secure; SameSite=Lax; httponly")]),
        row(4, resp={"Content-Security-Policy": "script-src 'unsafe-inline' *; frame-ancestors 'none'"}),
    )
    assert [t[1] for t in run(ex, detect.cors)] == ["CORS wildcard +creds", "CORS reflected"]
    assert [t[1] for t in run(ex, detect.cookie_flags)] == ["Cookie no SameSite", "Cookie no Secure"]
    assert sorted(t[1] for t in run(ex, detect.csp)) == ["CSP no object-src", "CSP unsafe-inline", "CSP wildcard src"]


def test_pii(exchanges):
    ex = exchanges(row(1, body="card 4111 1111 1111 1111, 1111-1111-1111-1111; rrn 900101-1234568 010-1234-5678 x"))
    got = [t[1] for t in run(ex, detect.pii_card, detect.pii_phone)]
    assert got == ["Korean phone number", "Payment card number"]


def test_jwt_once_per_host_and_issue(spark, exchanges):
    import base64

    def tok(h, p):
        e = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
        return f"{e(h)}.{e(p)}.c2lnbmF0"

    a, b = tok('{"alg":"HS256"}', '{"sub":"a","exp":10,"iat":1}'), tok('{"alg":"HS256"}', '{"sub":"b","exp":10,"iat":1}')
    n = tok('{"alg":"none"}', '{"password":"x","role":"y"}')
    ex = exchanges(row(1, req={"Authorization": f"Bearer {a}"}), row(2, req={"Authorization": f"Bearer {b}"}), row(3, url="https://o.example/", body=f"t {n} t"))
    got = types(jwt.weaknesses(jwt.tokens(detect.prepare(ex))))
    assert got == [
        (1, "JWT weakness: symmetric HS256", "LOW"), (3, "JWT weakness: alg=none", "HIGH"), (3, "JWT weakness: no expiry (exp)", "MEDIUM"),
        (3, "JWT weakness: privilege claim", "INFO"), (3, "JWT weakness: sensitive claim", "MEDIUM"),
    ]


def test_comments_and_source_maps(exchanges):
    ex = exchanges(row(1, body="<!-- TODO fix --><!-- ok --><!-- nothing here -->"), row(2, url="https://h.example/a.js.map", ct="application/json", body='{"version":3,"sources":["a.ts"],"mappings":"A"}'))
    assert [t[1] for t in run(ex, detect.html_comments)] == ["HTML Comment"]
    assert [t[1] for t in run(ex, detect.sourcemap_exposed)] == ["Source map exposed"]


def test_nothing_is_cut_off(spark, exchanges):
    """Bodies and counts past every former limit."""
    from sightline.operators import js, replay, rollup, sessions

    cards = " ".join(f"x{k}y 4539 5787 6362 1486" for k in range(40))
    comments = "".join(f"<!-- todo {k} -->" for k in range(80)) + "<!-- " + "y" * 30_000 + " password -->"
    upload = "p" * 70_000 + '\r\nContent-Disposition: form-data; name="f"; filename="late.bin"\r\n'
    fields = "{" + ",".join(f'"k{k}":"{"v" * 60}"' for k in range(9_000)) + ',"ssn":"123-45-6789","password":"hunter22"}'
    df = detect.prepare(exchanges(
        row(seq=1, body=cards), row(seq=2, body=comments),
        row(seq=3, method="POST", req={"Content-Type": "multipart/form-data; boundary=b"}, req_body=upload),
        row(seq=4, ct="application/json", body=fields),
        row(seq=5, params=[("QUERY", "t", "z" * 500)]),
    ))
    count = lambda seq, col: df.where(F.col("seq") == seq).select(F.size(col)).first()[0]
    assert count(1, detect.pii_card()) == 40
    assert count(2, detect.html_comments()) == 81
    assert count(3, detect.upload()) == 1
    assert len(fields) > 600_000 and count(4, detect.sensitive_fields()) >= 1
    example = rollup.parameters(rollup.parameter_events(df)).where("name = 't'").first()["example"]
    assert example == "z" * 500
    same = "line,\n" * 60_000
    a, b = same + "one", same + "\n".join(f"other {k}" for k in range(60_000))
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    assert replay.similarity_columns(pair, "a", "b").first()["similarity"] < 0.9
    links = spark.createDataFrame([("".join(f'"/p/{k}";' for k in range(900)) + '"/long/' + "q" * 400 + '"',)], "body string")
    assert links.select(F.size(js.link_array(F.col("body")))).first()[0] >= 900
    many = [row(seq=k, req={"Authorization": "Bearer sess-abcdef0123456789"} if k == 0 else {}) for k in range(6_000)]
    assert sessions.discover(exchanges(*many)).count() == 1


MET = {
    "GitHub Token": "x ghr_" + "a1B2" * 9, "Generic secret assignment": "API_KEY = 'abcdefgh1'", "Private IPv4": "at 172.16.3.4 or 192.168.0.1 or 10.1.2.3",
    "ASP.NET Error Page": "<b>Description:</b> AN UNHANDLED exception", "PHP Error": "PARSE ERROR : bad token in C:\\w\\a.php ON LINE 12",
    "Ruby/Rails Error": "NOMETHODERROR for nil\n  Lib/x.rb", "Node.js Stack Trace": "Error\n   at run (C:\\app\\a.js:1:2)\n\tat go (/srv/a.js:3:4)",
    "SQL Error": "Warning: near MYSQLI_query; Sql Syntax in MySQL; ora-00933; SqlState[42]; Postgresql: error", "Directory Listing": "<TITLE> INDEX OF /a",
    "Debug Mode Enabled": "DEBUG = true; WHOOPS!; <title>a dEbug</title>", "Internal Path Disclosure": "/srv/www/a and C:\\xampp\\b and /home/me/c",
    "Privileged role": "User_Type = 'SuperUser', level: Operator", "Admin flag on": "IS_STAFF: Yes, isRoot=1", "Roles/permissions": "Acl: [", "Access level": "CLEARANCE = top", "Role value": '"ROLE": "Guest"',
}


@pytest.mark.parametrize("rule", packs.SECRETS + packs.SIGNATURES + packs.AUTHZ, ids=lambda r: r.name)
def test_literals_before_an_expression_lose_no_match(spark, rule):
    assert rule.guard or rule.folded
    if rule.name in MET:
        t = MET[rule.name]
        texts = [t, t.lower(), t.upper(), t + " İK é", "nothing here"]
        df = spark.createDataFrame([(k, "u", x) for k, x in enumerate(texts)], "seq int, url string, body string")
        plain = detect.scan_rules("body", [rule._replace(guard=(), folded=())])
        rows = df.select(detect.scan_rules("body", [rule]).alias("a"), plain.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["b"] and not rows[-1]["b"]
