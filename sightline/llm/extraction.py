"""Main text of web pages with a style tree per site.

Method. Pages of one host are merged in a tree: a node is an element's path of tags and
classes, and it keeps the *presentation styles* (sequences of children) and the content
lines that different pages show there. A node seen on ``m`` pages has the presentation
importance ``H(styles) / ln m`` and the content importance ``1 - mean(ln c) / ln m``,
with ``c`` the pages that show a line there: what every page repeats in one style weighs
nothing. Both are mixed with the decay ``DECAY``. Branches below ``LEAST_IMPORTANCE`` on
at least ``LEAST_PAGES`` different pages are removed from each page. Elements whose tag says
what they are (navigation, footer, form and the like) go in any case. Names are evidence
only: a part named like something beside the article goes if the page's marked article,
or at least ``ELSEWHERE`` of its text, stands outside it; otherwise the part is the page's
body, and the same is asked of the parts in it. Where a page marks its article or main
part, the text is taken from there, unless the marks hold the smaller part of the text.

The merged nodes to remove are a small table next to the pages. Up to ``SMALL`` rows it
is sent to the tasks; beyond, nodes and pages meet by host, hot hosts in several parts.

Defined results: null or empty html gives an empty text; a page without a url belongs to
the host ''; equal pages count once in a tree; markup that never ends reaches to the end
of the page. A removed branch never holds half of a page's remaining text: such a branch
is the content itself. Extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, shared, table

DECAY, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.3, 10
#: Share of a page's text that has to stand outside the parts named as beside the article.
ELSEWHERE = 0.1
SMALL, HOST_PART = 50_000, 2_000
#: Containers nested deeper belong to their ancestor at this depth.
DEEPEST = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option datalist textarea iframe object svg math canvas audio video dialog menu map noembed noframes".split())
#: Elements whose content is not parsed.
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a style tree keeps as nodes; text blocks are their content.
CONTAINER = BLOCK - HEADING - frozenset("p li dt dd td th tr tbody thead tfoot blockquote pre figcaption caption summary legend option hr html body article main".split())
#: What an open element of the key is ended by.
ENDED_BY = {
    "p": BLOCK - frozenset("body html legend option caption td th tr tbody thead tfoot summary figcaption".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
}
#: Where the search for an element to end stops.
SCOPE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tbody": frozenset(["table"]), "thead": frozenset(["table"])}
#: Words in classes, ids and roles that name a part beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs "
    "sidebar sidenav rail complementary footer contentinfo cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay dialog newsletter subscribe subscription signup login "
    "social share sharing sharebar related recommended recommendations comment comments commentlist respond disqus reply replies discussion widget widgets toolbar pagination pager masthead topbar skip search form paywall".split()
)
HEADERS = frozenset(["header", "masthead", "banner"])
#: Names that a section inside an article may well have as its subject.
OWN_PARTS = frozenset("discussion notice notification alert reply replies respond search form widget widgets rail complementary promotion signup login".split())
#: Names of parts that readers write; an article marked in one is a comment.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Tags of open elements that end where a tag begins, by that tag; and where the search for them stops.
ENDS = {tag: tuple(name for name, by in ENDED_BY.items() if tag in by) for tag in frozenset().union(*ENDED_BY.values())}
BOUNDS = ("article", "main", "body", "table", "div", "section")

_TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Page:
    """Text blocks of one page and the containers they stand in."""

    def __init__(self, html: str) -> None:
        # text, container, dropped by its tag, in an article, in the main part, innermost part named as beside the article (-1: none)
        self.blocks: list[tuple[str, int, bool, bool, bool, int]] = []
        self.parent, self.path, self.depth, self.children = [-1], [0], [0], [[]]
        self.named: list[tuple[int, bool]] = []  # of each named part the one around it, and whether readers write it
        # open elements: tag, container, dropped, in article, in main, named part; and their places by tag
        self.open: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, -1)]
        self.at: dict[str, list[int]] = {}
        self.text: list[str] = []
        self._read(html)

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                self.blocks.append((text, *self.open[-1][1:]))

    def _pop(self, to: int) -> None:
        if any(o[0] in BLOCK for o in self.open[to:]):
            self._flush()
        for o in self.open[to:]:
            self.at[o[0]].pop()
        del self.open[to:]

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if (ends := ENDS.get(tag)) and (ended := self._last(ends)) > self._last((*SCOPE.get(tag, ()), *BOUNDS)):
            self._pop(ended)
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\t\r\n") else {}
        _, container, dropped, article, main, part = self.open[-1]
        role = given.get("role", "").lower()
        inside = article or main
        if tag not in ("html", "body"):
            words = {w.lower() for c in ("class", "id", "role") for w in _WORD.findall(given.get(c, "").replace("_", " "))}
            joined = {w.lower() for c in ("class", "id") for w in re.split(r"[\s_-]+", given.get(c, ""))}
            names = (words | joined) & (BESIDE | HEADERS)
            if inside or tag in HEADING:
                names -= HEADERS
            if inside and tag == "section":
                names -= OWN_PARTS
            if tag == "main" or role == "main":
                names = set()
            if names and tag not in HEADING and not dropped:
                self.named.append((part, bool(names & READERS)))
                part = len(self.named) - 1
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I)
            dropped = dropped or tag in DROPPED or bool(hidden) or (tag == "header" and not inside)
        if tag == "article" and not dropped:
            article = True
        if (tag == "main" or role == "main" or given.get("itemprop", "").lower() == "articlebody") and not dropped:
            main = True
        self.children[container].append(tag)
        if tag in CONTAINER and self.depth[container] < DEEPEST:
            label = tag + "".join(f".{c}" for c in sorted(given.get("class", "").lower().split())) + (f"#{given['id']}" if given.get("id") else "")
            self.parent.append(container)
            self.path.append(_signed(f"{self.path[container]}>{label}"))
            self.depth.append(self.depth[container] + 1)
            self.children.append([])
            container = len(self.path) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, container, dropped, article, main, part))

    def _end(self, tag: str) -> None:
        if places := self.at.get(tag):
            self._pop(places[-1])
            return
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.text.append(" ")

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if not m:
                self.text.append(unescape(html[at:]))
                break
            if m.start() > at:
                self.text.append(unescape(html[at : m.start()]))
            at = m.end()
            if m[0] == "<!--":
                end = html.find("-->", m.start() + 2)
                at = n if end < 0 else end + 3
            elif m[0] == "<![CDATA[":
                end = html.find("]]>", at)
                self.text.append(html[at : n if end < 0 else end])
                at = n if end < 0 else end + 3
            elif m[2] or m[5]:
                tag = (m[2] or m[5]).lower()
                if m[1] or m[4]:
                    self._end(tag)
                    continue
                rest = m[3] if m[2] else m[6]
                self._start(tag, rest)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = n if not end else end.start()
        self._flush()

    def containers_of(self, k: int) -> Iterator[int]:
        while k > 0:
            yield k
            k = self.parent[k]

    def _body(self, blocks: list[tuple]) -> list[tuple]:
        """The blocks outside named parts, and those of the named parts that turn out to be the page's body."""
        n = len(self.named)
        text, marked = [0] * (n + 1), [0] * (n + 1)  # the last is for what no named part holds
        direct = [0] * (n + 1)
        for b in blocks:
            text[b[5]] += len(b[0])
            direct[b[5]] += len(b[0]) if b[3] or b[4] else 0
        marked[:] = direct
        inner: dict[int, list[int]] = {}
        outside = text[-1]
        for k in range(n - 1, -1, -1):  # a part begins after the one around it
            around, readers = self.named[k]
            inner.setdefault(around, []).append(k)
            marked[k] = 0 if readers else marked[k]
            if around >= 0:
                text[around] += text[k]
                marked[around] += marked[k]
        total = outside + sum(text[k] for k in inner.get(-1, ()))
        allowed, at = {-1}, -1
        while not direct[at] and inner.get(at):
            best = max(inner[at], key=lambda k: (marked[k], text[k]))
            if not marked[best] and outside >= ELSEWHERE * total:
                break
            allowed.add(best)
            outside += text[best] - sum(text[k] for k in inner.get(best, ()))
            at = best
        return [b for b in blocks if b[5] in allowed]

    def kept(self, removed: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text; ``removed`` are the paths (hashed) that the host's tree gives up."""
        own = self._body([b for b in self.blocks if not b[2]])
        size = lambda bs: sum(len(b[0]) for b in bs)
        article, main = [b for b in own if b[3]], [b for b in own if b[4]]
        if main:
            inner = [b for b in main if b[3]]
            own = inner if 2 * size(inner) >= size(main) else main
        elif article:
            own = article if 2 * size(article) >= size(own) else [b for b in own if not b[3]]
        if removed:
            held: dict[int, int] = {}
            for text, container, *_ in own:
                for k in self.containers_of(container):
                    held[k] = held.get(k, 0) + len(text)
            total = size(own)
            gone = {k for k, s in held.items() if 2 * s < total and self.path[k] in removed}
            if gone:
                own = [b for b in own if not any(k in gone for k in self.containers_of(b[1]))]
        return "\n".join(b[0] for b in own)

    def nodes(self) -> Iterator[tuple[int, int, int | None]]:
        """Path, style and, one by one, lines of every container; None once for the container itself."""
        lines: dict[int, set[int]] = {}
        for text, container, *_ in self.blocks:
            line = _signed(text)
            for k in self.containers_of(container):
                lines.setdefault(k, set()).add(line)
        for k in range(1, len(self.path)):
            path, style = self.path[k], _signed(" ".join(self.children[k]))
            yield path, style, None
            for line in lines.get(k, ()):
                yield path, style, line


def host_column(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(host, path, style, _signed(html), line) for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) if html for path, style, line in Page(html).nodes()}
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(),) + (pa.int64(),) * 4, strict=True)], ["host", "path", "style", "page", "line"])


def style_trees(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance: the merged nodes of every host."""
    arrow_batches(pages.sparkSession)
    rows = pages.select(host_column(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_tree_rows, "host string, path long, style long, page long, line long")
    rows = shared(rows.distinct(), "sst-rows")
    styles = rows.where("line IS NULL").groupBy("host", "path", "style").agg(F.count_distinct("page").alias("c"))
    styles = styles.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    lines = rows.where("line IS NOT NULL").groupBy("host", "path", "line").agg(F.count_distinct("page").alias("c"))
    lines = lines.groupBy("host", "path").agg(F.avg(F.log("c")).alias("common"))
    both = styles.join(lines, ["host", "path"], "left")
    whole = F.log("m")
    shape = F.when(F.col("m") <= 1, 1.0).otherwise((whole - F.col("s") / F.col("m")) / whole)
    content = F.when(F.col("m") <= 1, 1.0).otherwise(1 - F.coalesce("common", F.lit(0.0)) / whole)
    return both.select("host", "path", F.col("m").alias("pages"), ((1 - DECAY) * shape + DECAY * content).alias("importance"))


def _text_batch(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    spark = pages.sparkSession
    gone = shared(style_trees(pages).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)).select("host", "path"), "sst-removed")
    arrow_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_column(F.col("url")).alias("host"))
    schema = "page_id long, url string, text string"
    if gone.count() <= SMALL:
        by_host: dict[str, set[int]] = {}
        for r in gone.collect():  # SMALL rows at most
            by_host.setdefault(r["host"], set()).add(r["path"])

        def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _text_batch(batch, [Page(html or "").kept(by_host.get(host, frozenset())) for html, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)])

        return rows.mapInArrow(with_table, schema)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (host, part), the paths of the host before its pages."""
        at, paths = None, set()
        for batch in batches:
            texts, own = [], []
            for k, (host, part, path, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "part", "path", "html")), strict=True)):
                if at != (host, part):
                    at, paths = (host, part), set()
                if path is not None:
                    paths.add(path)
                else:
                    own.append(k)
                    texts.append(Page(html or "").kept(paths))
            yield _text_batch(batch.take(pa.array(own, pa.int64())), texts)

    parts = rows.groupBy("host").agg(F.ceil(F.count("*") / HOST_PART).cast("long").alias("parts"))
    dealt = rows.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))).withColumn("path", F.lit(None).cast("long"))
    paths = gone.join(parts, "host").select("host", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.select("page_id", "url", "html", "host", "part", "path").unionByName(paths, allowMissingColumns=True)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return both.repartition(n, "host", "part").sortWithinPartitions("host", "part", F.col("path").asc_nulls_last()).mapInArrow(by_part, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
