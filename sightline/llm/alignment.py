"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked ids.

Method (external spill counting). A task encodes its texts with both vocabularies and
collects records (pair of ids, document, uses). When ``RUN_LINKS`` links are held, they are
sorted side-major (B id, then A id), cut by the low part of the B id into ``RADIX``
partitions and spilled as zstd-compressed runs to the shared folder: one part holds the
pairs with their totals in the run, the other the documents of each pair. The runs of a
partition meet in a k-way heap merge of at most ``FAN`` at a time, over as many levels as
the runs need, which adds up each pair. As the order is side-major, all pairs of a B id
follow one another, so its highest count is known when it ends. The records then pass
by the merged counts in the same order, in blocks of runs, and what each document gains
streams back to the run that it came from.

A hot pair is one entry per run, whatever number of documents holds it, and its documents
stay with their run, so no key gathers rows. What a task holds is bounded by the run size,
by one batch more, by ``FAN`` chunks of ``CHUNK`` pairs, and by the pairs of one partition (the vocabularies
bound those: 50,257 x 32,000 / ``RADIX``, of which a corpus uses a small part).

Both encoders see texts in segments: neither joins a token across a space that follows
something other than white space, so what a segment gives is remembered, and groups never
cross one.

Defined results: a null or empty text, and one whose joined token bytes differ from a
space plus the text (the piece vocabulary can't tell U+2581 from a space), has no tokens:
zeros and an empty digest. Repeated rows and repeated or null ids are documents like any
other: each row counts its links and gets its own result. Extra columns are left alone. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, shared, table, vocabulary

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links (or documents) that a task holds before it spills a run; partitions of a run.
RUN_LINKS, RUN_DOCS, RADIX = 1_000_000, 16_384, 32
#: Runs that one merge reads; pairs in a chunk of a merged run; runs that meet a partition's counts in one task.
FAN, CHUNK, BLOCK_RUNS = 64, 65_536, 128
#: Segments, and characters of them, after which a task forgets what it has learnt.
REMEMBERED, REMEMBERED_CHARACTERS = 300_000, 8_000_000

#: A space, then all up to the next space that doesn't follow white space.
_SEGMENT = re.compile(r" (?:[^ ]+|(?<=\s) )*")
_LEVEL = 3


# ----------------------------------------------------------------- one text


def byte_letters() -> dict[str, int]:
    """Letters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class _Growing:
    """A numpy column that grows by doubling."""

    def __init__(self, dtype: type) -> None:
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(self.n, len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Pair:
    """Both encoders, the bytes of every id, and what known segments give, a slot each."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # decimal ids with what stands before them: the first of a segment, of a group, of a side, or another
        written = lambda before, n: np.array([f"{before}{i}" for i in range(n)], object)
        self.a_text = [written(before, len(self.a_bytes)) for before in ("\n", ";", ",")]
        self.b_text = [written(before, len(self.b_bytes)) for before in ("|", ",")]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[str] = []
        self.ok, self.held = _Growing(bool), 0
        #: n_a, n_b, n_groups, where the links begin
        self.counts = [_Growing(np.int64) for _ in range(4)]
        self.links = _Growing(np.uint64)

    def _learn(self, segments: list[str]) -> None:
        """Give a slot to every one of these new segments."""
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)  # this encoder adds the space
        ok = np.ones(len(segments), bool)
        if b"".join(map(self.a_bytes.__getitem__, chain.from_iterable(a))) != (whole := b"".join(raw)) or b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))) != whole:
            same = lambda side, ids, r: b"".join(map(side.__getitem__, ids)) == r
            ok = np.array([same(self.a_bytes, x, r) and same(self.b_bytes, y, r) for x, y, r in zip(a, b, raw, strict=True)])
            a, b, raw = ([x for x, keep in zip(side, ok, strict=True) if keep] for side in (a, b, raw))
        counts, groups, links = self._aligned(a, b, np.array([len(r) for r in raw], np.int64))
        texts = iter(groups)
        self.groups += [next(texts) if keep else "" for keep in ok]
        starts = np.zeros(len(ok), np.int64)
        for column, values in zip(self.counts, (*counts, np.cumsum(counts[2]) - counts[2] + self.links.n), strict=True):
            starts[:] = 0
            starts[ok] = values
            column.extend(starts)
        self.ok.extend(ok)
        self.links.extend(links)
        first = len(self.slots)
        self.slots |= {s: first + k for k, s in enumerate(segments)}
        self.held += sum(map(len, segments))

    def _aligned(self, a: list[list[int]], b: list[list[int]], sizes: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[str], np.ndarray]:
        """Of segments whose bytes agree: tokens on both sides and groups of each, groups as text, and all linked pairs (B id << 24 | A id)."""
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        # no token is empty, so just one of each side ends at a common offset
        common, a_last, b_last = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        links = b_ids[b_last].astype(np.uint64) << np.uint64(24) | a_ids[a_last].astype(np.uint64)
        ends = np.cumsum(sizes)
        n_groups = np.diff(np.searchsorted(common, ends, side="right"), prepend=0)
        # place of every token among all: groups in order, in each the A side before the B side
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        out = np.empty(len(a_ids) + len(b_ids), object)
        a_first = np.r_[True, a_group[1:] != a_group[:-1]] if len(a_ids) else np.empty(0, bool)
        b_first = np.r_[True, b_group[1:] != b_group[:-1]] if len(b_ids) else np.empty(0, bool)
        a_start = np.zeros(len(a_ids), bool)
        a_start[np.cumsum(n_a) - n_a] = True
        before = np.where(a_start, 0, np.where(a_first, 1, 2))
        place = np.arange(len(a_ids)) + np.r_[0, b_last + 1][a_group]
        for k, text in enumerate(self.a_text):
            out[place[before == k]] = text[a_ids[before == k]]
        place = np.arange(len(b_ids)) + (a_last + 1)[b_group]
        for text, own in zip(self.b_text, (b_first, ~b_first), strict=True):
            out[place[own]] = text[b_ids[own]]
        return (n_a, n_b, n_groups), "".join(out).split("\n")[1:], links

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, int, str | None]], np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links and its groups (None without tokens), and the linked pairs of all texts in a row."""
        split = [_segments(t) if t else [] for t in texts]
        if len(self.slots) > REMEMBERED or self.held > REMEMBERED_CHARACTERS:
            self._forget()
        fresh = list({s for own in split for s in own}.difference(self.slots))
        if fresh:
            self._learn(fresh)
        out, pairs = [], []
        n_a, n_b, n_groups, start = (c.data for c in self.counts)
        for own in split:
            at = np.fromiter(map(self.slots.__getitem__, own), np.int64, len(own))
            if not len(at) or not self.ok.data[at].all():
                out.append((0, 0, 0, 0, None))
                continue
            many = n_groups[at]
            total = int(many.sum())
            steps = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(self.links.data[np.repeat(start[at], many) + steps])
            out.append((int(n_a[at].sum()), int(n_b[at].sum()), total, total, ";".join(map(self.groups.__getitem__, at.tolist()))))
        return out, np.concatenate(pairs) if pairs else np.empty(0, np.uint64)


def _segments(text: str) -> list[str]:
    own = _SEGMENT.findall(" " + text)
    if len(own) > 1 and own[-1] == " ":
        own[-2:] = [own[-2] + " "]  # the piece encoder gives nothing for an empty rest
    return own


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """The encoders of this process; tasks that follow one another share what they remember."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


# ----------------------------------------------------------------- runs


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers in one zstd frame, the bytes of equal rank together."""
    size = np.array([[len(c), c.dtype.itemsize] for c in columns], "<u4").tobytes()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=_LEVEL).compress(bytes([len(columns)]) + size + b"".join(planes))


def _spread(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = raw[0]
    out, at = [], 1 + 8 * n
    for count, width in np.frombuffer(raw, "<u4", 2 * n, 1).reshape(n, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += count * width
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8")


def _head(rows: list[tuple]) -> bytes:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.large_string()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


RUNS = "run long, radix int, head binary, pairs binary, records binary"


def _run(run: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of one run: its documents (radix -1), and for every radix the pairs with their totals and the records."""
    out = [(run, -1, _head(rows), None, None)]
    keys = np.concatenate(links)
    docs = np.repeat(np.arange(len(rows), dtype=np.uint32), [r[4] for r in rows])
    keys = ((keys >> np.uint64(24)) % np.uint64(RADIX)) << np.uint64(48) | keys
    order = np.argsort(keys, kind="stable")  # documents stay in order within a pair
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    uses = np.diff(at, append=len(keys)).astype("<u4")
    keys, docs = keys[at], docs[at].astype("<u4")
    radix = (keys >> np.uint64(48)).astype(np.int64)
    cuts = np.searchsorted(radix, np.arange(RADIX + 1))
    for r in range(RADIX):
        own = slice(cuts[r], cuts[r + 1])
        if cuts[r] == cuts[r + 1]:
            continue
        pair, first, n = np.unique(keys[own], return_index=True, return_counts=True)
        total = np.add.reduceat(uses[own].astype("<u8"), first)
        out.append((run, r, None, _squeeze(_steps(pair), total), _squeeze(_steps(pair), n.astype("<u4"), docs[own], uses[own])))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["run", "radix", "head", "pairs", "records"])


def spill(docs: DataFrame, folder: str | None = None, a_name: str = BYTE_VOCABULARY, b_name: str = PIECE_VOCABULARY, keep_groups: bool = False) -> DataFrame:
    """Encode ``docs`` and spill the runs to the shared folder."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(vocabulary(a_name, folder), vocabulary(b_name, folder))
        part, k = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        held = 0
        for batch in batches:
            found, pairs = pair.align(batch.column("text").to_pylist())
            for doc_id, (*counts, groups) in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                rows.append((doc_id, *counts, "" if groups is None else hashlib.sha256(groups.encode()).hexdigest(), groups if keep_groups else None))
            links.append(pairs)
            held += len(pairs)
            if held >= RUN_LINKS or len(rows) >= RUN_DOCS:
                yield _run(part << 32 | k, rows, links)
                k, rows, links, held = k + 1, [], [], 0
        if rows:
            yield _run(part << 32 | k, rows, links)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared(texts.mapInArrow(run, RUNS), "align-runs")


# ----------------------------------------------------------------- merging


def _chunks(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs and totals of one run, a chunk at a time."""
    for blob in blobs:
        steps, total = _spread(blob)
        yield from zip(np.cumsum(steps, dtype=np.uint64).tolist(), total.tolist(), strict=True)


def _added(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """K-way heap merge of sorted runs: each pair once, with the sum of its totals."""
    at, total = -1, 0
    for key, n in heapq.merge(*map(_chunks, runs)):
        if key != at:
            if at >= 0:
                yield at, total
            at, total = key, 0
        total += n
    if at >= 0:
        yield at, total


def _with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Side-major order: the pairs of a B id come together, so its highest count is known at its end."""
    held: list[tuple[int, int]] = []

    def close() -> Iterator[tuple[int, int, int]]:
        top = max((n for _, n in held), default=0)
        return ((key, n, int(n == top)) for key, n in held)

    for key, n in pairs:
        if held and held[0][0] >> 24 != key >> 24:
            yield from close()
            held = []
        held.append((key, n))
    yield from close()


def _merge(last: bool):
    """Rows come sorted by (radix, bundle, run, chunk); emits chunks of the merged run."""

    def chunked(radix: int, bundle: int, runs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        rows = _with_best(_added(runs)) if last else ((k, n, 0) for k, n in _added(runs))
        held: list[tuple[int, int, int]] = []
        chunk = 0

        def batch() -> pa.RecordBatch:
            keys, total, best = (np.array(c, np.uint64) for c in zip(*held, strict=True))
            blob = _squeeze(_steps(keys), total, best.astype("<u1")) if last else _squeeze(_steps(keys), total)
            return pa.RecordBatch.from_pydict({"radix": pa.array([radix], pa.int32()), "run": pa.array([bundle], pa.int64()), "chunk": pa.array([chunk], pa.int32()), "pairs": pa.array([blob], pa.binary())})

        for row in rows:
            held.append(row)
            if len(held) == CHUNK:
                yield batch()
                held, chunk = [], chunk + 1
        if held:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs, own = None, [], None
        for b in batches:
            for radix, bundle, name, blob in zip(*(b.column(c).to_pylist() for c in ("radix", "bundle", "run", "pairs")), strict=True):
                if at != (radix, bundle):
                    if runs:
                        yield from chunked(*at, runs)
                    at, runs, own = (radix, bundle), [], None
                if name != own:
                    runs.append([])
                    own = name
                runs[-1].append(blob)
        if runs:
            yield from chunked(*at, runs)

    return run


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.repartition(parts, *keys)


def count_pairs(runs: DataFrame) -> DataFrame:
    """radix, run, chunk, pairs: the corpus-wide count of every pair and whether it is its B id's highest, packed in chunks."""
    level = runs.where("radix >= 0").select("radix", "run", F.lit(0).alias("chunk"), "pairs")
    left = runs.where("radix = -1").count()
    while True:
        bundles = -(-left // FAN)
        place = F.pmod(F.xxhash64("run"), F.lit(max(bundles, 1)))
        rows = _dealt(level.withColumn("bundle", place), "radix", "bundle").sortWithinPartitions("radix", "bundle", "run", "chunk")
        level = shared(rows.mapInArrow(_merge(bundles <= 1), "radix int, run long, chunk int, pairs binary"), "align-merged")
        if bundles <= 1:
            return level
        left = bundles


def pair_table(counts: DataFrame) -> DataFrame:
    """a_id, b_id, count, best: a row per linked pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("pairs").to_pylist():
                steps, total, best = _spread(blob)
                key = np.cumsum(steps, dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"a_id": pa.array(key & 0xFFFFFF), "b_id": pa.array(key >> 24 & 0xFFFFFF), "count": pa.array(total.astype(np.int64)), "best": pa.array(best.astype(bool))})

    return counts.select("pairs").mapInArrow(run, "a_id long, b_id long, count long, best boolean")


# ----------------------------------------------------------------- back to the documents


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (radix, block, side, chunk): the counts of a radix, then records of runs; emits per run what its documents gain."""
    at, counts, table_ = None, [], None
    for b in batches:
        out: list[tuple] = []
        for radix, block, side, run, pairs, records in zip(*(b.column(c).to_pylist() for c in ("radix", "block", "side", "run", "pairs", "records")), strict=True):
            if at != (radix, block):
                at, counts, table_ = (radix, block), [], None
            if side == 0:
                steps, total, best = _spread(pairs)
                counts.append((np.cumsum(steps, dtype=np.uint64), total, best))
                continue
            if table_ is None:
                table_ = [np.concatenate(c) for c in zip(*counts, strict=True)]
            steps, n, docs, uses = _spread(records)
            place = np.repeat(np.searchsorted(table_[0], np.cumsum(steps, dtype=np.uint64)), n)
            who, own = np.unique(docs, return_inverse=True)
            gain, best = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
            np.add.at(gain, own, table_[1][place] * uses)
            np.add.at(best, own, table_[2][place].astype(np.uint64) * uses)
            out.append((run, radix, _squeeze(who, best, gain)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["run", "radix", "gains"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (run, radix): the documents of a run, then their gains."""
    at, head, best, total = None, None, None, None

    def close() -> pa.RecordBatch:
        names = [c for c in head.schema.names if c != "groups"]
        return pa.RecordBatch.from_arrays([*(head.column(c) for c in names), pa.array(best.astype(np.int64)), pa.array(total.astype(np.int64)), head.column("groups").cast(pa.string())], [*names, "n_best", "count_sum", "groups"])

    for b in batches:
        for run, data, gains in zip(*(b.column(c).to_pylist() for c in ("run", "head", "gains")), strict=True):
            if run != at:
                if head is not None:
                    yield close()
                at, head = run, pa.ipc.open_stream(data).read_next_batch()
                best, total = np.zeros(head.num_rows, np.uint64), np.zeros(head.num_rows, np.uint64)
            else:
                who, n, s = _spread(gains)
                best[who] += n
                total[who] += s
    if head is not None:
        yield close()


def align(docs: DataFrame, folder: str | None = None, a_name: str = BYTE_VOCABULARY, b_name: str = PIECE_VOCABULARY, keep_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups
    (``a1,a2|b1;a3|b2,b3``; null without tokens)."""
    runs = spill(docs, folder, a_name, b_name, keep_groups)
    counts = count_pairs(runs)
    blocks = -(-runs.where("radix = -1").count() // BLOCK_RUNS) or 1
    block = F.pmod(F.xxhash64("run"), F.lit(blocks))
    records = runs.where("radix >= 0").select("radix", block.alias("block"), F.lit(1).alias("side"), "run", F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("pairs"), "records")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    known = counts.select("radix", every, F.lit(0).alias("side"), "run", "chunk", "pairs", F.lit(None).cast("binary").alias("records"))
    met = _dealt(records.unionByName(known), "radix", "block").sortWithinPartitions("radix", "block", "side", "chunk")
    gains = shared(met.mapInArrow(_gains, "run long, radix int, gains binary"), "align-gains")
    heads = runs.where("radix = -1").select("run", "radix", "head", F.lit(None).cast("binary").alias("gains"))
    back = heads.unionByName(gains.select("run", "radix", F.lit(None).cast("binary").alias("head"), "gains"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, groups string"
    out = _dealt(back, "run").sortWithinPartitions("run", "radix").mapInArrow(_finish, schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*columns, *(["groups"] if keep_groups else []))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
