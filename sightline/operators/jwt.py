"""JSON web tokens: where they are, what they say, what is weak about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import checks
from sightline.functions.text import nz, whole
from sightline.operators.detect import EVENT_COLS, _set_cookies, finding, gate
from sightline.rules import packs

LONG_LIVED_DAYS = 30


def found_tokens() -> Column:
    """The distinct tokens of one exchange, in the order of the places they are looked for."""
    texts = F.concat(F.array("rq_auth", "rq_cookie"), _set_cookies(), F.array("body"))
    found = F.flatten(
        F.transform(
            F.filter(texts, lambda t: t.contains("eyJ")),
            lambda t: F.regexp_extract_all(t, F.lit(packs.JWT_TOKEN), F.lit(0)),
        )
    )
    return F.array_distinct(found)


def _bearing() -> Column:
    return F.col("has_resp") & F.col("host").isNotNull()


def tokens(prepared: DataFrame) -> DataFrame:
    """Distinct tokens of every exchange: seq, host, url, pos, token."""
    return prepared.where(_bearing()).select("seq", "observed_at", "host", "url", F.posexplode(found_tokens()).alias("pos", "token"))


def token_events() -> Column:
    """The tokens of an exchange as findings without a type, their place as evidence: they are written with its findings."""
    return gate(_bearing(), F.transform(found_tokens(), lambda t, i: finding(F.lit(None).cast("string"), F.lit(None).cast("string"), t, F.col("url"), i.cast("string"), True)))


def tokens_of(seen: DataFrame) -> DataFrame:
    """What ``tokens`` gives, from the rows that hold ``token_events``."""
    return seen.where("type IS NULL").select(
        "seq", "observed_at", "host", F.col("location").alias("url"), F.col("evidence").cast("int").alias("pos"), F.col("raw_match").alias("token")
    )


def decoded(toks: DataFrame) -> DataFrame:
    """Adds ``header`` and ``payload`` as JSON text (NULL unless an object) and their members."""
    df = toks.select("*", checks.jwt_part(F.col("token"), 1).alias("header"), checks.jwt_part(F.col("token"), 2).alias("payload"))
    return df.select("*", checks.json_map(F.col("header")).alias("h"), checks.json_map(F.col("payload")).alias("p"))


def claims(dec: DataFrame, now: Column | None = None) -> DataFrame:
    """Notable claims as columns, and the decoder's warnings."""
    now = F.unix_timestamp(F.current_timestamp()) if now is None else now
    p = F.col("payload")
    exp, iat, nbf = (checks.number(p, k) for k in ("exp", "iat", "nbf"))
    days = F.floor((exp - iat) / 86400)
    warn = F.array_compact(
        F.array(
            F.when(F.lower(nz(checks.scalar(F.col("header"), "alg"))) == "none", F.lit("alg=none")),
            F.when(checks.has_key(F.col("p"), "exp") & (exp > 0) & (exp < now), F.lit("expired")),
            F.when(
                checks.has_key(F.col("p"), "exp") & checks.has_key(F.col("p"), "iat") & (iat > 0) & (exp > iat) & (days >= LONG_LIVED_DAYS),
                F.concat(F.lit("long-lived ("), days.cast("string"), F.lit(" days)")),
            ),
        )
    )
    as_time = lambda c: F.when(c > 0, F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss"))
    return dec.select(
        "seq", "token",
        checks.scalar(F.col("header"), "alg").alias("alg"),
        *[checks.scalar(p, k).alias(k) for k in ("iss", "sub", "aud")],
        as_time(iat).alias("issued_at"), as_time(nbf).alias("not_before"), as_time(exp).alias("expires"),
        F.array_join(warn, "; ").alias("warnings"),
    )


def issues(toks: DataFrame) -> DataFrame:
    """A row for every issue of every token: host, label, and in ``m`` where it was seen and what to say."""
    dec = decoded(toks).where(F.col("header").isNotNull())
    h, p = F.col("h"), F.col("p")
    alg = nz(checks.scalar(F.col("header"), "alg"))
    exp = checks.number(F.col("payload"), "exp")
    iat = F.when(checks.has_key(p, "iat"), checks.number(F.col("payload"), "iat")).otherwise(F.unix_timestamp("observed_at"))
    days = F.floor((exp - iat) / 86400)
    keys = F.coalesce(F.map_keys(p), F.array().cast("array<string>"))
    sensitive = F.filter(keys, lambda k: whole(k, packs.SENSITIVE_FIELDS))
    privileged = F.filter(keys, lambda k: whole(k, packs.PRIVILEGED_FIELDS) & ~whole(k, packs.SENSITIVE_FIELDS))

    def issue(cond, label, sev, hint):
        label = label if isinstance(label, Column) else F.lit(label)
        return F.when(cond, F.struct(label.alias("label"), F.lit(sev).alias("severity"), F.lit(hint).alias("hint")))

    has_payload = F.col("payload").isNotNull()
    found = F.array_compact(
        F.array(
            issue(F.lower(alg) == "none", "alg=none", "HIGH", "confirm that unsigned tokens are refused"),
            issue(F.upper(alg).startswith("HS"), F.concat(F.lit("symmetric "), F.upper(alg)), "LOW", "confirm that the secret is strong and private"),
            issue(checks.has_key(h, "kid"), "kid header", "LOW", "confirm that kid only selects known keys"),
            issue(checks.has_key(h, "jku") | checks.has_key(h, "x5u") | checks.has_key(h, "jwk"), "embedded key / key URL (jku, x5u, jwk)", "LOW", "confirm that keys named in the token are not trusted"),
            issue(has_payload & ~checks.has_key(p, "exp"), "no expiry (exp)", "MEDIUM", "set an expiry"),
            issue(has_payload & checks.has_key(p, "exp") & (exp > 0) & (iat > 0) & (exp > iat) & (days >= LONG_LIVED_DAYS), "long-lived token", "LOW", "shorten the lifetime"),
            issue(has_payload & (F.size(sensitive) > 0), "sensitive claim", "MEDIUM", "the payload is readable: move the value out of the token"),
            issue(has_payload & (F.size(privileged) > 0), "privilege claim", "INFO", "confirm that the signature is checked before the claim is used"),
        )
    )
    parts = F.array_compact(F.array(*[F.when(checks.has_key(h, k), F.lit(k)) for k in ("kid", "jku", "x5u", "jwk")]))
    summary = F.concat(
        F.lit("alg="), F.when(checks.has_key(h, "alg"), alg).otherwise(F.lit("?")),
        F.when(F.size(parts) > 0, F.concat(F.lit(", "), F.array_join(parts, ", "))).otherwise(F.lit("")),
        F.when(
            has_payload,
            F.concat(F.lit("; claims: "), F.array_join(F.array_sort(keys), ", ")),
        ).otherwise(F.lit("")),
    )
    rows = dec.select("seq", "host", "url", "pos", "token", summary.alias("summary"), F.posexplode(found).alias("ipos", "i"))
    m = F.struct("seq", "pos", "ipos", "token", "url", "summary", F.col("i.severity").alias("severity"), F.col("i.hint").alias("hint"))
    return rows.select(F.lower("host").alias("host"), F.col("i.label").alias("label"), m.alias("m"))


def first_issues(rows: DataFrame) -> DataFrame:
    """One row per (host, issue): the first exchange that shows it. An aggregate, which combines on the
    map side, so a host that sends most of the traffic does not end up in one task."""
    return rows.groupBy("host", "label").agg(F.min("m").alias("m"))


def weaknesses(toks: DataFrame) -> DataFrame:
    """One finding event per (host, issue)."""
    return issue_events(first_issues(issues(toks)))


def issue_events(first: DataFrame) -> DataFrame:
    return first.select(
        F.col("m.seq").alias("seq"),
        (F.lit(1_000_000) + F.col("m.pos") * 100 + F.col("m.ipos")).alias("ord"),
        finding(
            F.concat(F.lit("JWT weakness: "), F.col("label")), F.col("m.severity"), F.col("m.token"), F.col("m.url"),
            F.concat(F.col("m.summary"), F.lit("  |  Try: "), F.col("m.hint")), True,
        ).alias("f"),
    ).select("seq", "ord", "f.*").select(*EVENT_COLS)
