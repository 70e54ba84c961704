"""Calls that JavaScript makes to its server, from the token table.

A call site is an opening bracket; its arguments are the tokens whose parent it is.  Paths are
put together per call from the tokens of one argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.text import nz
from sightline.operators.js_structure import GLOBAL, assignments, functions, var_ref
from sightline.operators.nesting import nearest, next_after
from sightline.rules import js_packs as jp
from sightline.session import persist_table, shuffled

c = F.col
SEP = "\u0001"


def unquote(t: Column) -> Column:
    return F.regexp_replace(t, r"""\A["'`]|["'`]\z""", "")


def template_text(t: Column) -> Column:
    """Template literal with its expressions as {last name}."""
    named = F.regexp_replace(
        unquote(t), r"\$\{(?:[^{}]*[^\p{L}\p{Nd}_${}])?([A-Za-z_$][A-Za-z0-9_$]*)(?![A-Za-z0-9_$]|\s*\()[^A-Za-z_${}]*\}", "{$1}"
    )
    return F.regexp_replace(named, r"\$\{[^{}]*\}", "{param}")


def entries(tok: DataFrame) -> DataFrame:
    """Members of object literals: sha256, brace, key, vstart, vend, at."""
    start = nz(c("p1")).isin("{", ",")
    pair = start & c("kind").isin("ident", "string", "number") & (c("n1") == ":")
    short = start & (c("kind") == "ident") & nz(c("n1")).isin(",", "}")
    return tok.where((c("parent") >= 0) & (pair | short)).select(
        "sha256", c("parent").alias("brace"), F.when(c("kind") == "string", unquote(c("t"))).otherwise(c("t")).alias("key"),
        F.when(pair, c("i") + 2).otherwise(c("i")).alias("vstart"), F.when(pair, c("expr_end")).otherwise(c("i")).alias("vend"), c("i").alias("at"),
    )


class Program:
    """Token tables that the steps below look things up in."""

    def __init__(self, tok: DataFrame):
        self.tok = tok
        self.entries = persist_table(entries(tok), "js-entries")
        asg = assignments(tok)
        rhs = tok.select("sha256", c("i").alias("rhs_start"), c("t").alias("rt"), c("kind").alias("rk"))
        one = asg.groupBy("sha256", "scope", "name").agg(F.count("*").alias("n"), F.min("rhs_start").alias("rhs_start"), F.min("rhs_end").alias("rhs_end"))
        self.single = persist_table(one.where("n = 1").join(shuffled(rhs), ["sha256", "rhs_start"]), "js-single")

    def literals(self) -> DataFrame:
        """Entry values that are one string: sha256, brace, key, value."""
        t = self.tok.where(c("kind").isin("string", "template")).select("sha256", c("i").alias("vstart"), c("t").alias("lit"))
        return self.entries.where("vstart = vend").join(shuffled(t), ["sha256", "vstart"]).select("sha256", "brace", "key", unquote(c("lit")).alias("value"))

    def braces(self, df: DataFrame, at: str) -> DataFrame:
        """Adds ``brace``: the object literal at a token, or the one its variable was assigned."""
        t = self.tok.select("sha256", c("i").alias(at), c("t").alias("_t"), c("scope").alias("_s"), var_ref().alias("_v"), c("n1").alias("_n"))
        d = df.join(shuffled(t), ["sha256", at], "left")
        s = self.single.where("rt = '{'").select("sha256", c("scope").alias("_s"), c("name").alias("_t"), c("rhs_start").alias("_r"))
        d = d.join(shuffled(s), ["sha256", "_s", "_t"], "left")
        var = c("_v") & nz(c("_n")).isin(",", ")", "}")
        return d.withColumn("brace", F.when(c("_t") == "{", c(at)).when(var, c("_r"))).drop("_t", "_s", "_v", "_n", "_r")

    def keys_at(self, df: DataFrame, at: str) -> DataFrame:
        """(call, keys): members of the object at a token or of the first call's first argument there."""
        here = df.select("sha256", "call", c(at).alias("i")).join(shuffled(self.tok.select("sha256", "i", "parent", "expr_end")), ["sha256", "i"])
        opened = next_after(here, self.tok.where("t = '(' AND kind = 'punct'"), "i", c("i"), "_open", ["sha256", "parent"])
        par = opened.where(c("_open") <= c("expr_end")).select("sha256", "call", (c("_open") + 1).alias("v"))
        direct = self.braces(df.select("sha256", "call", c(at).alias("v")), "v").where(c("brace").isNotNull())
        inner = self.braces(par.join(shuffled(direct.select("sha256", "call")), ["sha256", "call"], "left_anti"), "v").where(c("brace").isNotNull())
        b = direct.select("sha256", "call", "brace").unionByName(inner.select("sha256", "call", "brace"))
        k = b.join(shuffled(self.entries.select("sha256", "brace", "key", "at")), ["sha256", "brace"])
        # Members of one object literal of one body.
        return k.groupBy("sha256", "call").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"])).alias("keys"))

    def args(self, calls: DataFrame) -> DataFrame:
        """First and last token of every argument: sha256, call, arg, a_from, a_to."""
        ch = self.tok.select("sha256", c("parent").alias("open"), "arg", "i", "t", "kind").where(~((c("t") == ",") & (c("kind") == "punct")))
        j = calls.select("sha256", "call", "open").join(shuffled(ch), ["sha256", "open"])
        return j.groupBy("sha256", "call", "open", "arg").agg(F.min("i").alias("a_from"), F.max("i").alias("a_to"))

    def paths(self, ranges: DataFrame) -> DataFrame:
        """Adds ``tpl`` to (sha256, call, holder, from_, to_): the path as a template, NULL where
        the tokens are no concatenation."""
        ch = self.tok.select("sha256", c("parent").alias("holder"), "i", "t", "kind", "scope")
        j = ranges.join(shuffled(ch), ["sha256", "holder"]).where(c("i").between(c("from_"), c("to_")))
        g = j.groupBy("sha256", "call").agg(F.array_sort(F.collect_list(F.struct("i", "t", "kind"))).alias("ts"), F.min("scope").alias("scope"))
        line = F.array_join(F.transform("ts", lambda x: F.when((x["kind"] == "punct") & (x["t"] == "+"), F.lit("\u0002")).otherwise(x["t"])), SEP)
        seg = g.select("sha256", "call", "scope", F.posexplode(F.split(line, f"{SEP}?\u0002{SEP}?")).alias("pos", "s"))
        const = self.single.where(c("rk").isin("string", "template") & (c("rhs_end") == c("rhs_start"))).select("sha256", "scope", "name", c("rt").alias("cv"))
        seg = seg.join(shuffled(const.select("sha256", "scope", c("name").alias("s"), c("cv").alias("c1"))), ["sha256", "scope", "s"], "left")
        seg = seg.join(shuffled(const.where(c("scope") == GLOBAL).select("sha256", c("name").alias("s"), c("cv").alias("c2"))), ["sha256", "s"], "left")
        s = F.coalesce("c1", "c2", "s")
        multi = s.contains(SEP)
        odd = s.rlike(f"(?:^|{SEP})[?:|&](?:{SEP}|$)")
        last = F.regexp_extract(s, rf"([\p{{L}}_$][\p{{L}}\p{{Nd}}_$]*)(?:{SEP}[^\p{{L}}_$]*)*$", 1)
        text = (
            F.when(~multi & s.rlike("""^["']"""), unquote(s)).when(~multi & s.startswith("`"), template_text(s)).when(~multi & s.rlike("^[0-9]"), s)
            .when(~odd & s.rlike(r"^[\p{L}_$(]"), F.concat(F.lit("{"), F.coalesce(F.nullif(last, F.lit("")), F.lit("param")), F.lit("}")))
        )
        t = seg.groupBy("sha256", "call").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("x")))).alias("xs"))
        ok = ~F.exists("xs", lambda v: v["x"].isNull())
        tpl = F.when(ok, F.array_join(F.transform("xs", lambda v: v["x"]), ""))
        return ranges.join(shuffled(t.select("sha256", "call", tpl.alias("tpl"))), ["sha256", "call"]).where(c("tpl").isNotNull())


def has_literal_path(tpl: Column) -> Column:
    lit = F.regexp_replace(tpl, r"\{[^}]{0,60}\}", "")
    return tpl.startswith("/") | tpl.rlike("^https?://") | lit.contains("/")


def call_sites(p: Program) -> DataFrame:
    """sha256, call, open, style, verb, via, name."""
    tok = p.tok
    member = nz(c("p1")) == "."
    word = c("kind") == "ident"
    fetch = tok.where(word & (c("t") == "fetch") & (c("n1") == "(") & (~member | c("p2").isin("window", "self", "globalThis"))).select(
        "sha256", c("i").alias("call"), (c("i") + 1).alias("open"), F.lit("fetch").alias("style"), F.lit(None).cast("string").alias("verb"), F.lit("fetch").alias("via"), c("t").alias("name")
    )
    made = p.tok.where(word & (c("n1") == "=") & (c("n2") == "axios") & (c("n3") == ".")).select("sha256", c("t").alias("t")).distinct()
    ax = tok.where(word & ~member)
    named = ax.where(c("t") == "axios").unionByName(ax.join(shuffled(made), ["sha256", "t"], "left_semi").select(*ax.columns))
    via = F.when(c("t") == "axios", "axios").otherwise(F.concat(F.lit("axios instance "), c("t")))
    low = c("n2")
    verbs = named.where((c("n1") == ".") & (c("n3") == "(") & low.isin("get", "delete", "head", "options", "post", "put", "patch"))
    a1 = verbs.select("sha256", c("i").alias("call"), (c("i") + 3).alias("open"), F.when(low.isin("post", "put", "patch"), "axios-data").otherwise("axios").alias("style"), F.upper(low).alias("verb"), via.alias("via"), c("t").alias("name"))
    a2 = named.where((c("n1") == ".") & (c("n2") == "request") & (c("n3") == "(")).select("sha256", c("i").alias("call"), (c("i") + 3).alias("open"), F.lit("config").alias("style"), F.lit(None).cast("string").alias("verb"), via.alias("via"), c("t").alias("name"))
    a3 = named.where(c("n1") == "(").select("sha256", c("i").alias("call"), (c("i") + 1).alias("open"), F.lit("config").alias("style"), F.lit(None).cast("string").alias("verb"), via.alias("via"), c("t").alias("name"))
    jq = tok.where(word & c("t").isin("$", "jQuery") & ~member & (c("n1") == ".") & (c("n3") == "(") & c("n2").isin("ajax", "get", "post", "getJSON")).select(
        "sha256", c("i").alias("call"), (c("i") + 3).alias("open"), F.when(c("n2") == "ajax", "config").otherwise("jquery").alias("style"),
        F.when(c("n2") == "post", "POST").when(c("n2") == "ajax", F.lit(None)).otherwise("GET").alias("verb"), F.concat(F.lit("jQuery."), c("n2")).alias("via"), c("t").alias("name"),
    )
    xhr = tok.where(word & (c("t") == "open") & member & (c("n1") == "(") & F.upper(unquote(nz(c("n2")))).isin(jp.HTTP_VERBS) & nz(c("n2")).rlike("""^["'`]""")).select(
        "sha256", c("i").alias("call"), (c("i") + 1).alias("open"), F.lit("xhr").alias("style"), F.upper(unquote(c("n2"))).alias("verb"), F.lit("XMLHttpRequest").alias("via"), c("p2").alias("name")
    )
    out = reduce(lambda a, b: a.unionByName(b), [fetch, a1, a2, a3, jq, xhr])
    here = tok.select("sha256", c("i").alias("call"), "scope", c("off").alias("at_off"))
    return out.join(shuffled(here), ["sha256", "call"])


def _auth_text(p: Program, holders: DataFrame) -> DataFrame:
    """(call, auth) of header objects: the first credential header and where its value is kept."""
    h = p.braces(holders, "v").where(c("brace").isNotNull()).select("sha256", "call", "brace")
    e = h.join(shuffled(p.entries), ["sha256", "brace"]).where(c("key").rlike(jp.FLOW_AUTH_HEADER)).groupBy("sha256", "call").agg(F.min(F.struct("at", "key", "vstart", "vend")).alias("e"))
    return e.select("sha256", "call", c("e.key").alias("header"), c("e.vstart").alias("vstart"), c("e.vend").alias("vend"))


def _with_storage(p: Program, auth: DataFrame) -> DataFrame:
    kept = p.tok.where(c("t").isin("localStorage", "sessionStorage", "cookie"))
    g = next_after(auth, kept, "vstart", F.struct("i", "t"), "s", ["sha256"]).withColumn("s", F.when(c("s.i") <= c("vend"), c("s")))
    return g.select("sha256", "call", F.concat(c("header"), F.when(c("s").isNotNull(), F.concat(F.lit(" ("), c("s.t"), F.lit(")"))).otherwise("")).alias("auth"))


def client_calls(bodies: DataFrame, tok: DataFrame) -> DataFrame:
    """Call sightings: sha256, call, method, path, body_keys, query_keys, auth, function, via, trigger, call_site."""
    p = Program(tok)
    calls = persist_table(call_sites(p), "js-calls")
    args = persist_table(p.args(calls), "js-args")
    style = calls.select("sha256", "call", "style")
    a = args.join(shuffled(style), ["sha256", "call"])
    # Configuration object: which argument, per style.
    cfg_arg = F.when(c("style") == "axios-data", 2).when(c("style").isin("fetch", "axios"), 1)
    first_obj = p.braces(a.where("style = 'config' AND arg = 0").select("sha256", "call", c("a_from").alias("v")), "v").where(c("brace").isNotNull()).select("sha256", "call", "brace")
    rest = a.where((c("arg") == cfg_arg) | ((c("style") == "config") & (c("arg") == 1))).select("sha256", "call", c("a_from").alias("v"))
    other = p.braces(rest.join(shuffled(first_obj.select("sha256", "call")), ["sha256", "call"], "left_anti"), "v").where(c("brace").isNotNull()).select("sha256", "call", "brace")
    cfg = persist_table(first_obj.withColumn("own_url", F.lit(True)).unionByName(other.withColumn("own_url", F.lit(False))), "js-cfg")
    lit = p.literals()
    cl = cfg.join(shuffled(lit), ["sha256", "brace"])
    method = cl.where(c("key").isin("method", "type")).groupBy("sha256", "call").agg(F.upper(F.min_by("value", F.when(c("key") == "method", 0).otherwise(1))).alias("m"))
    creds = cl.where("key = 'credentials' AND value = 'include'").select("sha256", "call", F.lit(True).alias("cookies")).distinct()
    ce = cfg.join(shuffled(p.entries), ["sha256", "brace"])
    has_method = ce.where("key = 'method'").select("sha256", "call", F.lit(True).alias("any_method")).distinct()
    two = args.where("arg = 1").select("sha256", "call", F.lit(True).alias("two")).distinct()
    # Path range.
    path_arg = F.when(c("style") == "xhr", 1).otherwise(0)
    by_arg = a.where(c("arg") == path_arg).join(shuffled(cfg.where("own_url").select("sha256", "call")), ["sha256", "call"], "left_anti").select("sha256", "call", c("open").alias("holder"), c("a_from").alias("from_"), c("a_to").alias("to_"))
    by_key = ce.where("own_url AND key = 'url'").select("sha256", "call", c("brace").alias("holder"), c("vstart").alias("from_"), c("vend").alias("to_"))
    ranges = persist_table(by_arg.unionByName(by_key), "js-ranges")
    tpl = p.paths(ranges)
    # Keys and credentials.
    data_arg = a.where((c("style").isin("axios-data", "jquery")) & (c("arg") == 1)).select("sha256", "call", c("a_from").alias("v"))
    data_key = ce.where(c("key").isin("body", "data")).groupBy("sha256", "call").agg(F.min("vstart").alias("v"))
    sent = calls.where("style = 'xhr'").select("sha256", "call", "scope", c("name").alias("recv"))
    dots = tok.where((c("t") == ".") & (c("n2") == "(")).select("sha256", "scope", c("p1").alias("recv"), c("n1").alias("fn"), (c("i") + 2).alias("o"))
    on = sent.join(shuffled(dots), ["sha256", "scope", "recv"]).where(c("o") > c("call"))
    xsend = on.where("fn = 'send'").groupBy("sha256", "call").agg((F.min("o") + 1).alias("v"))
    body = p.keys_at(data_arg.unionByName(data_key).unionByName(xsend).groupBy("sha256", "call").agg(F.min("v").alias("v")), "v").withColumnRenamed("keys", "body_keys")
    query = p.keys_at(ce.where("key = 'params'").groupBy("sha256", "call").agg(F.min("vstart").alias("v")), "v").withColumnRenamed("keys", "extra")
    hdr = _with_storage(p, _auth_text(p, ce.where("key = 'headers'").groupBy("sha256", "call").agg(F.min("vstart").alias("v"))))
    xh = on.where("fn = 'setRequestHeader'").select("sha256", "call", c("o").alias("i"))
    xa = xh.join(shuffled(tok.select("sha256", "i", c("n1").alias("h"), c("match").alias("m"))), ["sha256", "i"]).where(unquote(c("h")).rlike(jp.FLOW_AUTH_HEADER)).select(
        "sha256", "call", unquote(c("h")).alias("header"), (c("i") + 2).alias("vstart"), c("m").alias("vend")
    )
    xhdr = _with_storage(p, xa)
    auth = hdr.unionByName(xhdr).groupBy("sha256", "call").agg(F.min("auth").alias("auth"))
    # Defaults end with their expression, an interceptor with the call that registers it.
    inst = tok.where(c("t").isin("interceptors", "defaults") & (nz(c("p1")) == ".")).select("sha256", "parent", c("p2").alias("name"), c("i").alias("k"), c("t").alias("what"), "expr_end")
    inst = next_after(inst, tok.where("t = '(' AND kind = 'punct'"), "k", F.struct("i", "match"), "_call", ["sha256", "parent"])
    inst = inst.withColumn("end", F.when(c("what") == "defaults", c("expr_end")).when(c("_call.i") <= c("expr_end"), c("_call.match")))
    near = next_after(inst, tok.where(F.lower(c("t")).contains("authorization")), "k", c("i"), "_auth", ["sha256"]).where(c("_auth") <= c("end"))
    iauth = near.groupBy("sha256", "name").agg(F.max(F.when(c("what") == "interceptors", "Authorization (interceptor)").otherwise("Authorization (defaults)")).alias("iauth"))
    d = calls.join(shuffled(tpl.select("sha256", "call", "tpl")), ["sha256", "call"])
    for part in (method, creds, has_method, two, body, query, auth):
        d = d.join(shuffled(part), ["sha256", "call"], "left")
    d = d.join(shuffled(cfg.select("sha256", "call", F.lit(True).alias("has_cfg")).distinct()), ["sha256", "call"], "left")
    d = d.join(shuffled(iauth), ["sha256", "name"], "left")
    open_method = c("m").isNull() & c("verb").isNull() & (c("any_method").isNotNull() | ((c("style") == "fetch") & c("two").isNotNull() & c("has_cfg").isNull()))
    none = F.array().cast("array<string>")
    auth_col = F.coalesce("auth", F.when(c("style").isin("axios", "axios-data", "config"), c("iauth")), F.when(c("cookies"), F.lit("cookies (credentials: include)")), F.lit(""))
    d = persist_table(d.select(
        "sha256", "call", "open", "scope", "via", "tpl", F.when(~open_method, F.coalesce("verb", "m", F.lit("GET"))).alias("method"),
        F.coalesce("body_keys", none).alias("body_keys"), F.coalesce("extra", none).alias("extra"), auth_col.alias("auth"), "at_off",
    ), "js-direct")
    # Wrappers: the path mentions a parameter of the named function around the call.
    fn = persist_table(functions(tok), "js-functions")
    par = fn.where("name <> ''").select("sha256", "head", "name", "open", "body_end").join(
        shuffled(tok.where((c("kind") == "ident") & (nz(c("n1")) != ":") & ~nz(c("p1")).isin("=", ".") & ~c("t").isin(jp.JS_KEYWORDS)).select("sha256", c("parent").alias("open"), "i", c("t").alias("param"))),
        ["sha256", "open"],
    )
    par = par.withColumn("pos", F.row_number().over(W.partitionBy("sha256", "head").orderBy("i")) - 1)
    refs = ranges.join(shuffled(tok.where(var_ref()).select("sha256", c("parent").alias("holder"), "i", c("t").alias("param"))), ["sha256", "holder"]).where(c("i").between(c("from_"), c("to_"))).select("sha256", "call", "param", "i")
    w = d.join(shuffled(refs), ["sha256", "call"]).join(shuffled(par.select("sha256", c("head").alias("scope"), c("name").alias("wname"), "param", "pos", "body_end")), ["sha256", "scope", "param"])
    w = w.groupBy("sha256", "call").agg(F.min(F.struct("i", "param", "pos", "wname", "scope", "body_end")).alias("w")).select("sha256", "call", "w.*")
    inner = persist_table(d.join(shuffled(w.drop("i")), ["sha256", "call", "scope"], "left"), "js-inner")
    base = F.concat(F.lit("{"), c("param"), F.lit("}"))
    at = F.expr("locate(concat('{', param, '}'), tpl)")
    is_base = c("param").isNotNull() & (at > 0) & ((at == 1) | (F.expr("substring(tpl, locate(concat('{', param, '}'), tpl) - 1, 1)") != "/"))
    direct = inner.where(has_literal_path(c("tpl")) & ~F.coalesce(is_base, F.lit(False))).select("sha256", "call", "scope", "method", "tpl", "body_keys", "extra", "auth", "via", "at_off")
    wrappers = persist_table(inner.where(c("wname").isNotNull()).groupBy("sha256", "wname").agg(F.min(F.struct("call", "param", "pos", "tpl", "method", "auth", "via", "scope", "body_end")).alias("w")).select("sha256", "wname", "w.*"), "js-wrappers")
    uses = tok.where((c("kind") == "ident") & (c("n1") == "(") & (nz(c("p1")) != "function")).select("sha256", c("t").alias("wname"), c("i").alias("use"), (c("i") + 1).alias("uopen"), c("scope").alias("uscope"), c("off").alias("uoff"))
    u = uses.join(shuffled(wrappers), ["sha256", "wname"]).where(~c("use").between(c("scope"), c("body_end")))
    u = persist_table(u.select("sha256", c("use").alias("call"), c("uopen").alias("open"), c("uscope").alias("scope"), c("uoff").alias("at_off"), "wname", "param", "pos", c("tpl").alias("wtpl"), "method", "auth", "via"), "js-uses")
    ua = persist_table(p.args(u).join(shuffled(u.select("sha256", "call", "pos")), ["sha256", "call"]), "js-uargs")
    upath = p.paths(ua.where(c("arg") == c("pos")).select("sha256", "call", c("open").alias("holder"), c("a_from").alias("from_"), c("a_to").alias("to_")))
    uobj = p.braces(ua.where(c("arg") != c("pos")).select("sha256", "call", c("a_from").alias("v")), "v").where(c("brace").isNotNull())
    uent = uobj.join(shuffled(p.entries), ["sha256", "brace"])
    optlike = uent.where(c("key").isin("method", "headers", "body", "data")).select("sha256", "call", "brace").distinct()
    um = uobj.join(shuffled(lit.where("key = 'method'").select("sha256", "brace", "value")), ["sha256", "brace"]).groupBy("sha256", "call").agg(F.upper(F.min("value")).alias("um"))
    ubody = p.keys_at(uent.where(c("key").isin("body", "data")).groupBy("sha256", "call").agg(F.min("vstart").alias("v")), "v").withColumnRenamed("keys", "b1")
    plain = uent.join(shuffled(optlike), ["sha256", "call", "brace"], "left_anti").groupBy("sha256", "call").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"])).alias("b2"))
    low = F.lower("wname")
    by_name = reduce(lambda x, y: x.when(low.startswith(y[0]) | low.endswith(y[1]), y[2]), [("put", "put", "PUT"), ("patch", "patch", "PATCH"), ("del", "delete", "DELETE"), ("remove", "remove", "DELETE")], F.when(low.startswith("post") | low.endswith("post"), "POST")).otherwise("GET")
    x = u.join(shuffled(upath.select("sha256", "call", "tpl")), ["sha256", "call"]).where(has_literal_path(c("tpl")))
    for part in (um, ubody, plain):
        x = x.join(shuffled(part), ["sha256", "call"], "left")
    through = x.select(
        "sha256", "call", "scope", F.coalesce("method", "um", by_name).alias("method"), F.replace(c("wtpl"), F.concat(F.lit("{"), c("param"), F.lit("}")), c("tpl")).alias("tpl"),
        F.concat(F.coalesce("b1", none), F.coalesce("b2", none)).alias("body_keys"), none.alias("extra"), "auth",
        F.concat(F.lit("wrapper "), c("wname"), F.lit("() → "), c("via")).alias("via"), "at_off",
    )
    out = persist_table(direct.unionByName(through), "js-flows")
    return _finish(out, p, bodies, fn)


def _finish(calls: DataFrame, p: Program, bodies: DataFrame, fn: DataFrame) -> DataFrame:
    raw_query = F.regexp_extract("tpl", r"\?(.*)$", 1)
    names = F.transform(F.split(raw_query, "&"), lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))))
    query = F.array_distinct(F.concat(c("extra"), F.filter(names, lambda n: (n != "") & ~n.startswith("{"))))
    path = F.regexp_replace(F.regexp_replace(c("tpl"), r"\?.*$", ""), r"#.*$", "")
    path = F.regexp_replace(path, r"(?<!:)/{2,}", "/")
    d = calls.withColumn("query_keys", query).withColumn("path", path).where(c("path") != "")
    d = d.withColumn("rn", F.row_number().over(W.partitionBy("sha256", "method", "path").orderBy("call"))).where("rn = 1")
    # Enclosing functions, through the bracket around each head.
    heads = fn.select("sha256", c("head").alias("scope"), c("name").alias("fname"))
    outer = p.tok.select("sha256", c("i").alias("scope"), c("parent").alias("pb")).join(shuffled(p.tok.select("sha256", c("i").alias("pb"), c("scope").alias("up"))), ["sha256", "pb"], "left")
    outer = heads.join(shuffled(outer), ["sha256", "scope"], "left").select("sha256", "scope", "fname", F.when(c("up") != c("scope"), c("up")).alias("up"))
    routes = p.literals().where("key = 'path'").where(c("value").startswith("/")).select("sha256", "brace", c("value").alias("route"))
    comp = p.entries.where(c("key").isin(jp.ROUTE_COMPONENT_KEYS)).join(shuffled(routes), ["sha256", "brace"])
    comp = comp.where("vstart = vend").join(shuffled(p.tok.where("kind = 'ident'").select("sha256", c("i").alias("vstart"), c("t").alias("fname"))), ["sha256", "vstart"]).groupBy("sha256", "fname").agg(F.min("route").alias("croute"))
    handler = p.entries.where(c("key").rlike(jp.HANDLER_KEY) & (c("vstart") == c("vend"))).join(shuffled(p.tok.where("kind = 'ident'").select("sha256", c("i").alias("vstart"), c("t").alias("fname"))), ["sha256", "vstart"]).select("sha256", "fname", c("key").alias("hname"))
    listen = p.tok.where((c("t") == "addEventListener") & (c("n1") == "(") & nz(c("n2")).rlike("""^["']""") & (c("n3") == ",")).select("sha256", (c("i") + 4).alias("i"), F.concat(unquote(c("n2")), F.lit(" listener")).alias("hname"))
    by_ident = listen.join(shuffled(p.tok.where("kind = 'ident' AND t <> 'function'").select("sha256", "i", c("t").alias("fname"))), ["sha256", "i"]).select("sha256", "fname", "hname")
    handler = handler.unionByName(by_ident).groupBy("sha256", "fname").agg(F.min("hname").alias("hname"))
    inline = listen.select("sha256", c("i").alias("scope"), c("hname").alias("iname"))
    near = outer.join(shuffled(comp), ["sha256", "fname"], "left").join(shuffled(handler), ["sha256", "fname"], "left").join(shuffled(inline), ["sha256", "scope"], "left")
    own = F.when(c("fname").rlike(jp.HANDLER_KEY), c("fname"))
    tree = near.select("sha256", "scope", "up", F.nullif(c("fname"), F.lit("")).alias("function"), "croute", F.coalesce("hname", own, "iname").alias("handler"))
    tree = tree.groupBy("sha256", "scope", "up").agg(*[F.min(m).alias(m) for m in ("function", "croute", "handler")])
    around = nearest(tree, ["function", "croute", "handler"], node="scope")
    # Route object around the call itself: up the brackets.
    brackets = p.tok.where("open").join(shuffled(d.select("sha256").distinct()), "sha256", "left_semi").select("sha256", c("i").alias("brace"), c("parent").alias("up"))
    under = brackets.join(shuffled(routes.groupBy("sha256", "brace").agg(F.min("route").alias("oroute"))), ["sha256", "brace"], "left")
    under = nearest(under, ["oroute"], node="brace").where(c("oroute").isNotNull())
    inside = d.select("sha256", "call").join(shuffled(p.tok.select("sha256", c("i").alias("call"), c("parent").alias("brace"))), ["sha256", "call"]).join(shuffled(under), ["sha256", "brace"]).select("sha256", "call", "oroute")
    out = d.join(shuffled(around), ["sha256", "scope"], "left").join(shuffled(inside), ["sha256", "call"], "left").join(shuffled(bodies.select("sha256", "body")), "sha256")
    route = F.coalesce("oroute", "croute")
    trigger = F.concat_ws(" · ", F.when(route.isNotNull(), F.concat(F.lit("route "), route)), c("handler"))
    site = F.regexp_replace(F.substr("body", c("at_off") + 1, F.lit(160)), r"\s+", " ")
    return out.select("sha256", "call", "method", "path", "body_keys", "query_keys", "auth", nz(c("function")).alias("function"), "via", trigger.alias("trigger"), site.alias("call_site"))
