"""Personal data in documents, and the terms that give it away. DataFrame expressions only.

Method. The base finds e-mail addresses, IP addresses, card and phone numbers by fixed
expressions. Each value found is a protected entity. The corpus then tells how strongly
a term discloses an entity: with ``c(e)`` and ``c(t)`` the documents that hold them,
``c(e, t)`` those where ``t`` stands within ``REACH`` words of ``e``, and ``N`` all
documents, the pointwise mutual information is ``ln(N c(e, t) / (c(e) c(t)))`` and the
information of the entity ``ln(N / c(e))``. A term whose share of that information
reaches ``DISCLOSURE``, in at least ``SUPPORT`` different texts, is a span of kind
``term`` wherever it stands in a document that holds the entity, however far from it;
``sanitise`` generalises it. A term is a word of at least three letters, with hyphens
and apostrophes between them.

Defined results: null text is empty text and has no spans. A context reaches
``CONTEXT`` characters at most, so that a word cut there is never counted. Rows are told
apart by their place in the table, so repeated rows and repeated or null ``doc_id`` are
fine; each row has its own result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import shared, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions. Possessive forms and the guards in front keep them linear without changing a match:
#: a match can only begin where a run of its first characters begins, or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARK = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
REACH, CONTEXT = 6, 160
DISCLOSURE, SUPPORT = 0.8, 3
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_CHUNK = 256
#: Characters of the blocks that a text is cut into where many places of it are read.
_BLOCK = 4096
_TERM = r"\p{L}++(?:['\u2019-]\p{L}++)*+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _within(items: Column, size, first: Column, add) -> Column:
    """``running`` from ``first``; ``items`` is short."""
    start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(items, start, lambda a, x: F.struct(add(a["at"], size(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def running(items: Column, size, add=operator.add) -> Column:
    """Running sums (or what ``add`` makes) of ``size(item)``, each without its own. Chunks keep the appends short, so long arrays stay cheap."""

    def body(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int")), lambda c: F.slice(xs, c * _CHUNK + 1, _CHUNK))
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: add(a, size(x)))

        def join(cs: Column) -> Column:
            return F.flatten(F.zip_with(cs, _within(cs, total, F.lit(0).cast("bigint"), add), lambda c, first: _within(c, size, first, add)))

        return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, join))

    return let(items, body)


def _luhn(digits: Column) -> Column:
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(F.coalesce(c.cast("int"), F.lit(0)), i))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(hit, " -", "")
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.translate(hit, "+ ().-", "")).between(10, 15)
    return F.lit(True)


_FOUND = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string,cut_left:boolean,cut_right:boolean>>"


def _found(kind: str, text: Column) -> Column:
    """Valid matches of one kind with their places and what stands beside them."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def place(found: Column) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)

        def spans(gaps: Column) -> Column:
            pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), F.slice(gaps, 2, F.size(found)).alias("next"))
            size = lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint")
            placed = lambda p, at: F.struct(
                (at + F.length(p["gap"])).alias("start"),
                (at + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                p["hit"].alias("value"),
                F.right(p["gap"], F.lit(CONTEXT)).alias("left"),
                F.left(p["next"], F.lit(CONTEXT)).alias("right"),
                (F.length(p["gap"]) > CONTEXT).alias("cut_left"),
                (F.length(p["next"]) > CONTEXT).alias("cut_right"),
            )
            return let(pairs, lambda ps: F.zip_with(ps, running(ps, size), placed))

        return F.when(F.exists(found, lambda h: _valid(kind, h)), F.filter(let(gaps, spans), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_FOUND))

    there = F.lit(True) if kind not in _MARK else F.contains(text, F.lit(_MARK[kind]))
    return F.when(there, let(hits, place)).otherwise(F.array().cast(_FOUND)).cast(_FOUND)


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``place`` (of the row), the base spans per kind as columns, and a hash of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # one projection a kind, so that no expression is spelled out twice
    out = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text.alias("body"))
    for kind in KINDS:
        out = out.withColumn(f"f_{kind}", _found(kind, F.col("body")))
    return out.withColumn("content", F.xxhash64("body")).withColumn("place", F.monotonically_increasing_id())


def _spans(kind: str) -> Column:
    return F.transform(F.col(f"f_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans() -> Column:
    return F.array_sort(F.concat(*[_spans(k) for k in KINDS])).cast(SPAN)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def beside(found: DataFrame) -> DataFrame:
    """place, content, entity, term, start, end: the terms within reach of every base span."""
    per = [F.transform(F.col(f"f_{k}"), lambda s, k=k: F.struct(F.xxhash64(F.lit(k), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), *[s[c].alias(c) for c in ("left", "right", "cut_left", "cut_right")])) for k in KINDS]
    hits = found.select("place", "content", F.explode(F.concat(*per)).alias("h")).select("place", "content", "h.*")

    def side(text: Column, origin: Column, tail: bool) -> Column:
        # a word cut at the far end of the context is left out
        far = F.when(F.col("cut_left" if tail else "cut_right"), 1).otherwise(0)
        whole = lambda f: F.slice(f, 1 + far if tail else F.lit(1), F.greatest(F.size(f) - far, F.lit(0)))
        last = lambda f: F.slice(f, F.greatest(F.size(f) - REACH + 1, F.lit(1)), REACH)
        return let(let(_placed_words(text, origin), whole), last if tail else (lambda f: F.slice(f, 1, REACH)))

    near = F.concat(side(F.col("left"), F.col("start") - F.length("left"), True), side(F.col("right"), F.col("end"), False))
    return _terms(hits.select("place", "content", "entity", F.explode(near).alias("t")))


def _placed_words(text: Column, origin: Column) -> Column:
    """The words between white space with their places, counted from ``origin``."""
    size = lambda w: (F.length(w) + 1).cast("bigint")
    placed = lambda ws: F.zip_with(ws, running(ws, size), lambda w, at: F.struct(w.alias("w"), (origin + at).alias("at")))
    return F.filter(let(F.split(text, r"\s", -1), placed), lambda p: F.length(p["w"]) > 0)


def _terms(rows: DataFrame) -> DataFrame:
    """term, start, end in place of ``t`` (a placed word), where the word without the signs around it is a term."""
    others = [c for c in rows.columns if c != "t"]
    bare = F.regexp_replace(F.col("t.w"), r"^[^\p{L}]+", "")
    term = F.regexp_replace(F.col("bare"), r"[^\p{L}]++$", "")
    rows = rows.withColumn("bare", bare).withColumn("term", term).where((F.length("term") >= 3) & F.col("term").rlike(f"^{_TERM}$"))
    start = F.col("t.at") + F.length("t.w") - F.length("bare")
    return rows.select(*others, F.lower("term").alias("term"), start.alias("start"), (start + F.length("term")).alias("end"))


def held(found: DataFrame) -> DataFrame:
    """place, entity: the entities of every row."""
    per = [F.transform(F.col(f"f_{k}"), lambda s, k=k: F.xxhash64(F.lit(k), F.lower(s["value"]))) for k in KINDS]
    return found.select("place", F.explode(F.array_distinct(F.concat(*per))).alias("entity"))


def everywhere(found: DataFrame, text: Column, told: DataFrame) -> DataFrame:
    """place, start, end: all places of terms in documents that hold an entity which the term discloses.

    Rows come from the words of the documents, never from an entity's documents times its terms.
    """
    words = _terms(found.select("place", F.explode(_placed_words(text, F.lit(0).cast("bigint"))).alias("t")))
    words = shared(words.join(told.select("term").distinct(), "term"), "pii-words")
    meant = words.select("place", "term").distinct().join(told, "term").join(held(found), ["place", "entity"]).select("place", "term").distinct()
    return words.join(meant, ["place", "term"]).select("place", "start", "end")


def disclosing(near: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term: what the corpus shows to disclose an entity. Counts cover all documents."""
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("place").alias("c_et"), F.count_distinct("content").alias("texts"))
    pairs = shared(pairs.where(F.col("texts") >= SUPPORT), "pii-pairs")
    entities = near.groupBy("entity").agg(F.count_distinct("place").alias("c_e"))
    text = F.lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    # an inner join, since a semi join would be pushed below the count and meet every word of the corpus
    terms = terms.join(pairs.select("term").distinct(), "term")
    total = float(docs.count())
    known = pairs.join(entities, "entity").join(terms, "term")
    shown = F.log(total * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    info = F.log(total / F.col("c_e"))
    return known.where((info > 0) & (shown >= DISCLOSURE * info)).select("entity", "term")


def find(docs: DataFrame, keep: list[str], text: str = "body") -> DataFrame:
    """``keep`` columns, counts per kind, ``base`` and ``spans`` (base and terms) of every row.

    ``text`` is where the kept columns hold the text, as a field of ``row``; otherwise it is kept beside them.
    """
    found = base(docs, keep)
    any_span = " OR ".join(f"size(f_{k}) > 0" for k in KINDS)
    body = found.withColumn("body", F.when(F.expr(any_span), F.col("body"))) if text == "body" else found.drop("body")
    found = shared(body, "pii-base")
    some = found.where(any_span)
    near = shared(beside(some), "pii-near")
    told = shared(disclosing(near, docs), "pii-told")
    # the words beside an entity are told apart by where its match ends, those of the whole text by white space alone
    places = near.join(told, ["entity", "term"]).select("place", "start", "end").unionByName(everywhere(some, F.col(text), told))
    terms = places.select("place", F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), "end").alias("s"))
    terms = terms.groupBy("place").agg(F.collect_set("s").alias("terms"))  # places in one text
    own = some.select(F.col("row"), "place", *[F.size(f"f_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base_spans().alias("base"))
    with_terms = own.join(terms, "place", "left").withColumn("spans", F.coalesce(F.array_sort(F.concat("base", F.col("terms").cast(SPAN))), F.col("base"))).drop("terms", "place")
    none = found.where(f"NOT ({any_span})")
    empty = F.array().cast(SPAN)
    without = none.select("row", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], empty.alias("base"), empty.alias("spans"))
    return with_terms.unionByName(without).select("row.*", *[f"n_{k}" for k in KINDS], "base", "spans")


def generalised(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first names the place.

    The text is cut in blocks once, so that a place costs the same wherever it lies.
    """

    def replaced(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            i, j = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
            at, rest = (a % _BLOCK + 1).cast("int"), (b % _BLOCK).cast("int")
            first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
            between = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            return F.when(i == j, first.substr(at, (b - a).cast("int"))).otherwise(F.concat(first.substr(at, F.lit(_BLOCK)), between, last.substr(F.lit(1), rest)))

        def piece(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

        pieces = F.zip_with(spans, running(spans, lambda s: s["end"], F.greatest), piece)
        end = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(end, F.greatest(end, F.length(text).cast("bigint"))))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), replaced)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms generalised in ``text``, and ``n_chars``, where there is one, made right."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"])
    out = find(whole, ["doc"], "row.doc.text")
    text = F.when(F.size("spans") > 0, generalised(F.col("doc.text").cast("string"), F.col("spans"))).otherwise(F.col("doc.text"))
    out = out.withColumn("text", text)
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.size("spans") > 0, n).otherwise(F.col("doc.n_chars"))
    return out.select([made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
