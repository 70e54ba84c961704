"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

Method. Texts are lower-cased and their white space collapsed. An item of ``m``
characters may be met with ``k`` edits; by the q-gram lemma an occurrence then shares
at least ``m - Q + 1 - k * Q`` q-grams with it, all on ``k + 1`` neighbouring
diagonals. The shared q-grams are counted, once per place in the item, in diagonal
bands that overlap by ``k``; bands that reach the bound are verified by an alignment
confined to the band. Whole texts and all items are used.

Items go to the tasks in slices of ``SLICE_CHARS`` characters, one pass over the
documents per slice, so what a task holds does not grow with the benchmark.

Items shorter than ``LEAST_FUZZY`` normalised characters leave the lemma no count to
go by; they are met exactly, as whole words. ``least_item`` leaves out items that a user
takes for no evidence: by default those, while the query and the pipeline use all items.

Defined results: null or empty texts and items match nothing; repeated items each match; of regions of one item that overlap the one with fewest edits (then the
first) is returned. Extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, table

Q = 8
#: Edits allowed per character of an item, and the shared q-grams that a budget must leave to count.
EDIT_RATE, LEAST_SHARED = 0.1, 4
LEAST_FUZZY = 24
SLICE_CHARS = 2_000_000
_BITS = 22


def lowered(text: str) -> str:
    """Lower case without changing the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalised(text: str | None) -> str:
    return " ".join(lowered(text or "").split())


def budget(m: int) -> int:
    """Edits allowed for an item of ``m`` characters."""
    return max(0, min(int(EDIT_RATE * m), (m - Q + 1 - LEAST_SHARED) // Q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams; the i-th starts at i."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:]
        four = two[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]
        return (four[:-4] * np.uint64(0x165667B19E3779F9) + four[4:])[:n] * np.uint64(0x9FB21C651E98DF25)


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits that turn ``item`` into a region of ``text`` on the diagonals ``low`` to ``high``
    (text position less item position), with the region's start and end."""
    width = high - low + 1
    far = len(item) + len(text) + 1
    offs = np.arange(width)
    cost = np.where((offs + low >= 0) & (offs + low <= len(text)), 0, far)
    begin = offs + low
    for i in range(1, len(item) + 1):
        at = offs + low + i  # text position after the step
        ok = (at >= 1) & (at <= len(text))
        same = np.zeros(width, np.int64)
        same[ok] = text[at[ok] - 1] != item[i - 1]
        step = np.where(ok, cost + same, far)
        drop = np.append(cost[1:], far) + 1
        best = np.where(step <= drop, step, drop)
        first = np.where(step <= drop, begin, np.append(begin[1:], 0))
        best = np.where((at >= 0) & (at <= len(text)), best, far)
        run = best - offs  # insertions: the best of the places to the left plus the distance to it
        low_to_now = np.minimum.accumulate(run)
        came = np.maximum.accumulate(np.where(run == low_to_now, offs, 0))
        cost, begin = low_to_now + offs, first[came]
        cost = np.where((at >= 0) & (at <= len(text)), cost, far)
    k = int(np.argmin(cost))
    return int(cost[k]), int(begin[k]), int(k + low + len(item))


class Index:
    """q-grams of a slice of items: sorted hashes with their (item, place), and a bit table in front."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = sorted(items, key=lambda x: len(x[1]) < LEAST_FUZZY)  # those that are met exactly stand last
        self.ids = [i for i, _ in items]
        self.text = [t for _, t in items]
        self.codes = [_codes(t) for t in self.text if len(t) >= LEAST_FUZZY]
        self.words = ahocorasick.Automaton()
        for i in range(len(self.codes), len(items)):
            if self.text[i]:
                self.words.add_word(self.text[i], [*self.words.get(self.text[i], []), i])
        self.words.make_automaton()
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget(m) for m in self.m], np.int64)
        self.least = self.m - Q + 1 - self.k * Q
        self.band = np.maximum(self.k + 1, 16)
        grams = [_qgrams(c) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, number of the item, start, end, edits) of every region met, in normalised characters."""
        if not len(self.hashes):
            return
        codes = [_codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + Q)])[:-1]
        gap = np.zeros(Q, np.uint32)
        hashes = _qgrams(np.concatenate([x for c in codes for x in (c, gap)]))
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, hashes[at])
        real = self.hashes[np.minimum(lo, len(self.hashes) - 1)] == hashes[at]
        at, lo = at[real], lo[real]
        doc = np.searchsorted(starts, at, side="right") - 1
        enough = np.bincount(doc, minlength=len(texts)) >= self.least.min()
        keep = enough[doc]
        at, lo, doc = at[keep], lo[keep], doc[keep]
        n = np.searchsorted(self.hashes, hashes[at], side="right") - lo
        rows = np.repeat(np.arange(len(at)), n)
        post = np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        item, place = self.item[post], self.place[post]
        diagonal = at[rows] - starts[doc[rows]] - place
        band, inside = np.divmod(diagonal, self.band[item])
        again = inside <= self.k[item]
        cols = [np.concatenate([x, x[again]]) for x in (doc[rows], item, place)] + [np.concatenate([band, band[again] - 1])]
        if not len(cols[0]):
            return
        order = np.lexsort((cols[2], cols[3], cols[1], cols[0]))
        doc, item, place, band = (c[order] for c in cols)
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= np.diff(place) != 0
        shared = np.bincount(group, weights=fresh)
        head = np.flatnonzero(new)
        for g in np.flatnonzero(shared >= self.least[item[head]]):
            d, i, b = int(doc[head[g]]), int(item[head[g]]), int(band[head[g]])
            low, high = b * int(self.band[i]), (b + 1) * int(self.band[i]) + int(self.k[i])
            low, high = max(low, -int(self.k[i])), min(high, len(codes[d]))
            exact = texts[d].find(self.text[i], max(0, low), max(0, high) + int(self.m[i]))
            if exact >= 0:
                yield d, i, exact, exact + int(self.m[i]), 0
                continue
            if low <= high:
                edits, start, end = banded_distance(self.codes[i], codes[d], low, high)
                if edits <= self.k[i]:
                    yield d, i, max(0, start), end, edits

    def exact(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """As ``regions``, of the short items: whole words, from left to right without overlaps."""
        if not len(self.words):
            return
        for d, text in enumerate(texts):
            done: dict[int, int] = {}
            for last, found in self.words.iter(text):
                for i in found:
                    start, end = last + 1 - len(self.text[i]), last + 1
                    alone = not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()
                    if alone and start >= done.get(i, 0):
                        done[i] = end
                        yield d, i, start, end, 0

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """The regions without those that overlap a better one of the same item."""
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for d, i, start, end, edits in self.regions(texts):
            best.setdefault((d, i), []).append((edits, start, end))
        out = list(self.exact(texts))
        for (d, i), found in best.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(found)):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    out.append((d, i, start, end, edits))
        return out


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text itself."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    begin = np.concatenate([[0], np.cumsum([e - s + 1 for s, e in words])])[:-1] if words else np.zeros(1, np.int64)
    out = []
    for start, end in spans:
        a = int(np.searchsorted(begin, start, side="right")) - 1
        b = int(np.searchsorted(begin, max(start, end - 1), side="right")) - 1
        out.append((words[a][0] + start - int(begin[a]), min(words[b][1], words[b][0] + end - int(begin[b]))))
    return out


def slices(benchmark: DataFrame, least_item: int = LEAST_FUZZY) -> Iterator[list[tuple[int, str]]]:
    """The items in slices of bounded size, fetched one at a time by a hash of the item."""
    usable = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // SLICE_CHARS) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        items = [(r["item_id"], normalised(r["text"])) for r in usable.where(part == k).collect()]  # about SLICE_CHARS characters
        yield sorted(((i, t) for i, t in items if len(t) >= least_item), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_FUZZY) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text itself), edits, similarity; a row per region."""
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long, similarity double"

    def finder(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                ids, raw = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = []
                for d, i, start, end, edits in index.matches([normalised(t) for t in raw]):
                    a, b = _original(raw[d], [(start, end)])[0]
                    rows.append((ids[d], index.ids[i], a, b, edits, 1 - edits / len(index.text[i])))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(),) * 5 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "similarity"])

        return run

    out = None
    for items in slices(benchmark, least_item):
        found = docs.mapInArrow(finder(items), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_FUZZY) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns; no shuffle."""
    arrow_batches(docs.sparkSession)

    def sieve(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                hit = {d for d, *_ in index.matches([normalised(t) for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        return run

    for items in slices(benchmark, least_item):
        docs = docs.mapInArrow(sieve(items), docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_item=0)
