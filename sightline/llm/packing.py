"""Packing of token sequences by a configuration linear program over their lengths.

Method. A configuration says how many pieces of each length one sequence holds. The
program asks for the fewest configurations that cover the length histogram. It is
solved by multiplicative weights: each length carries a weight, a knapsack by dynamic
programming finds the configurations of most weight (the pricing), the lengths they cover
lose weight, and the average of the rounds is the fractional solution. Its full
configurations are rounded to whole uses, the remaining histogram is solved again, and so
on; only the last pieces are filled into sequences one by one. Everything up to here works
on the histogram, whose size is the sequence length and not the input. Spark then numbers
the pieces of each length with counts per partition and deals them to the places of the
configurations.

Defined results: null text is empty text, which is one token (the closing id 0). Only
documents longer than a sequence are cut. Repeated rows and repeated or null ids are
packed like any other row. An empty table gives no rows.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sightline.llm.common import arrow_batches, shared, table, vocabulary

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
CLOSING = 0
#: Rounds of multiplicative weights, their step, and how much a weight may add to a length of a whole sequence.
ROUNDS, STEP, PREFERENCE = 6, 2.0, 0.45
#: Share of the pieces that a solution's configurations aren't built around: the shorter ones.
SHORTER = 0.6
#: Share of the pieces that a solution has to place for another to follow, and that the program has to place in the end.
LITTLE, CARRIED = 0.02, 0.9
#: Points of the hand-over to the last filling that are tried, and the share of sequences that the program may need beyond filling alone.
HAND_OVER, SPARE = 8, 1e-4
#: Words whose ids a task remembers.
REMEMBERED = 800_000
#: Words that are encoded as one text, with a mark between them.
JOINED = 500
#: Where Python splits and the vocabulary doesn't, or lower-cases by the neighbours: such texts are encoded whole.
_ODD = [*map(chr, range(0x1C, 0x20)), "\u03a3"]


# ----------------------------------------------------------------- tokens


class Encoder:
    """Ids of whole texts. The vocabulary never joins across white space, so the ids of each
    distinct word are found once and remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Strings that the vocabulary takes for one token wherever they stand.
        self.marks = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        #: A mark that parts words without a trace in their ids, and its id; none where the vocabulary has no such mark.
        self.parting = next(((t.content, k) for k, t in self.model.get_added_tokens_decoder().items() if self._parts(t.content, k)), None)

    def _parts(self, mark: str, number: int) -> bool:
        ids = [self.model.encode(t, add_special_tokens=False).ids for t in ("it's", "9th", f"it's{mark}9th{mark}it's")]
        return ids[2] == [*ids[0], number, *ids[1], number, *ids[0]]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold no mark; many words make one text, as a call costs more than a word."""
        if self.parting is None:
            return self._ids(words)
        mark, number = self.parting
        parts = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for part, e in zip(parts, self.model.encode_batch_fast([mark.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            marks = np.flatnonzero(ids == number)
            if len(marks) != len(part) - 1:
                out += self._ids(part)
                continue
            whole = ids.tobytes()
            out += [whole[a:b] for a, b in zip([0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(whole)], strict=True)]
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        plain = [(t or "").encode("utf-8", "replace").decode() for t in texts]
        lower = [t.lower() for t in plain]
        odd = [any(c in t for c in _ODD) or any(m in low for m in self.marks) for t, low in zip(plain, lower, strict=True)]
        split = [[] if o else low.split() for o, low in zip(odd, lower, strict=True)]
        known = self.known
        words = {w for own in split for w in own}
        fresh = [w for w in words if w not in known]
        here = dict(zip(fresh, self._word_ids(fresh), strict=True))
        for w in words.difference(here):
            here[w] = known[w]
        if len(known) < REMEMBERED:
            known.update((w, here[w]) for w in fresh)
        get = here.__getitem__
        return [self._ids([t])[0] if o else b"".join(map(get, own)) for o, t, own in zip(odd, plain, split, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process; tasks that follow one another share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, keep_ids: bool = False, folder: str | None = None, name: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: the documents' ids with the closing id, cut at ``length``."""
    arrow_batches(docs.sparkSession)
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary(name, folder))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ()))
            cols = list(zip(*rows, strict=True)) or [()] * (5 + keep_ids)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# ----------------------------------------------------------------- the program


#: How many pieces of each length one sequence holds: (length, pieces) in rising order.
Configuration = tuple[tuple[int, int], ...]


def price(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack by dynamic programming: for every room the most weight that fits, and the length placed last in it (0: none)."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    gain = weights[sizes]
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := fitting[room]:
            total = gain[:n] + value[room - sizes[:n]]
            k = int(total.argmax())
            if total[k] > value[room]:
                value[room], last[room] = total[k], sizes[k]
    return value, last


def fractional(counts: np.ndarray, capacity: int) -> dict[Configuration, float]:
    """Configurations with fractional uses, by multiplicative weights.

    The dual of a packing without waste is the length itself. On top of it every length has a
    weight that falls with the share of it already covered, so a round prefers what the rounds
    before left out; it is too small to let a sequence with more room in it win. One pricing
    tells for every length the best configuration around it, which is used as often as its
    scarcest length allows, a round's share of that.
    """
    sizes = np.flatnonzero(counts)
    place = np.arange(len(counts))
    log_weight, covered = np.zeros(len(counts)), np.zeros(len(counts))
    found: dict[Configuration, float] = {}
    for k in range(ROUNDS):
        weight = np.exp(log_weight - log_weight[sizes].max())
        _, last = price(place * (1 + PREFERENCE * weight / capacity), sizes, capacity)
        for size in sizes[::-1].tolist():
            uses, room = Counter({size: 1}), capacity - size
            while room > 0:
                if last[room]:
                    uses[int(last[room])] += 1
                    room -= int(last[room])
                else:
                    room -= 1
            key = tuple(sorted(uses.items()))
            often = min(counts[x] / n for x, n in key) / ROUNDS
            found[key] = found.get(key, 0.0) + often
            for x, n in key:
                covered[x] += n * often
        log_weight[sizes] -= STEP * np.minimum(covered[sizes] / counts[sizes], 50) / (k + 1)
    return found


def fill(left: np.ndarray, capacity: int) -> np.ndarray:
    """One sequence filled from ``left``: the longest length first, then the fullest sum of the rest."""
    sizes = np.flatnonzero(left)
    uses = np.zeros(len(left), np.int64)
    top = int(sizes[-1])
    uses[top] = 1
    room = capacity - top
    rest = left.copy()
    rest[top] -= 1
    # longest first, but the last two places are chosen to fill exactly where that can be done
    while room > 0:
        fits = np.flatnonzero(rest[: room + 1])
        if not len(fits):
            break
        if rest[room]:
            pick = [room]
        else:
            other = room - fits
            pair = fits[(other > 0) & (rest[other] > 0) & ((other != fits) | (rest[fits] > 1))]
            pick = [int(pair[-1]), room - int(pair[-1])] if len(pair) else [int(fits[-1])]
        for p in pick:
            uses[p] += 1
            rest[p] -= 1
            room -= p
    return uses


def _filled(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Sequences filled one by one, each filling used as often as there are pieces for it."""
    left, plan = left.copy(), []
    while left.any():
        uses = fill(left, capacity)
        n = int((left[uses > 0] // uses[uses > 0]).min())
        left -= uses * n
        plan.append((tuple((int(x), int(uses[x])) for x in np.flatnonzero(uses)), n))
    return plan


def solve(counts: np.ndarray, capacity: int = LENGTH) -> tuple[list[tuple[Configuration, int]], int]:
    """Configurations and whole numbers of their uses that hold every piece exactly once, and how many pieces the program placed.

    The full configurations of the fractional solution are rounded down to whole uses, but to one at
    least, as long as there are pieces for them; those around the longest lengths come first. What
    remains is a histogram again and solved in the same way, until a solution places little. The
    last pieces are filled sequence by sequence: of the points at which the program has placed the share
    ``CARRIED``, the first ``HAND_OVER`` are tried and the best is taken. Where all need over ``SPARE``
    more sequences than filling alone, filling alone is taken: lengths that don't add up to full
    sequences are no case for full configurations.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[Configuration, int]] = []

    def use(key: Configuration, most: int) -> None:
        n = min(most, *(int(left[size]) // k for size, k in key))
        if n > 0:
            plan.append((key, n))
            for size, k in key:
                left[size] -= k * n

    use(((capacity, 1),), sys.maxsize)
    total = int(left.sum())
    points = [(0.0, len(plan), left.copy())]
    while left.any():
        before = int(left.sum())
        # those around the longer pieces: the short ones are what fills them
        middle = int(np.searchsorted(np.cumsum(left), before * SHORTER))
        full = {key: often for key, often in fractional(left, capacity).items() if key[-1][0] >= middle and sum(size * k for size, k in key) == capacity}
        for key, often in sorted(full.items(), key=lambda x: (-x[0][-1][0], -x[1], x[0])):
            use(key, max(1, int(often)))
        points.append((1 - int(left.sum()) / total, len(plan), left.copy()))
        if before - left.sum() < LITTLE * before:
            break
    ends = []
    for share, n, rest in [points[0], *[p for p in points if p[0] >= CARRIED][:HAND_OVER]]:
        last = _filled(rest, capacity)
        ends.append((share, sum(k for _, k in plan[:n]) + sum(k for _, k in last), plan[:n] + last))
    carried = [e for e in ends if e[0] >= CARRIED and e[1] <= ends[0][1] * (1 + SPARE)]
    share, _, best = min(carried or ends, key=lambda e: (e[1], -e[0]))
    return best, int(counts[capacity]) + round(share * total)


def places(plan: list[tuple[Configuration, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where the ranks of its pieces begin per configuration, the pieces of it in one
    sequence, the first sequence number, and the first offset in a sequence."""
    out: dict[int, list] = {}
    first = 0
    for key, n in plan:
        at = 0
        for size, k in key:
            rows = out.setdefault(size, [])
            begin = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((begin, k, first, at, k * n))
            at += k * size
        first += n
    return {s: tuple(np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4]) for s, rows in out.items()}


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rows`` (with a ``length`` from 1 to ``length``) plus sequence_id and offset. ``rows`` should be a table: it is read twice."""
    columns = rows.columns
    dealt = shared(rows.withColumn("_part", F.spark_partition_id()), "pack-rows")
    tally = shared(dealt.groupBy("_part", "length").agg(F.count("*").alias("n")), "pack-tally")
    counts = np.zeros(length + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, at most ``length``
        counts[r["length"]] = r["n"]
    where = places(solve(counts, length)[0])
    # rank of a piece among those of its length: pieces in the partitions before, plus its rank in its own
    before = tally.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    dealt = dealt.join(before.select("_part", "length", F.coalesce("_before", F.lit(0)).alias("_before")), ["_part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}  # partition and length: how many came
        for batch in batches:
            size = batch.column("length").to_numpy()
            part = batch.column("_part").to_numpy()
            before = batch.column("_before").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for key in set(zip(part.tolist(), size.tolist(), strict=True)):
                own = np.flatnonzero((part == key[0]) & (size == key[1]))
                rank = before[own] + seen.get(key, 0) + np.arange(len(own))
                seen[key] = seen.get(key, 0) + len(own)
                begin, each, first, at = where[key[1]]
                k = np.searchsorted(begin, rank, side="right") - 1
                copy, slot = np.divmod(rank - begin[k], each[k])
                sequence[own] = first[k] + copy
                offset[own] = at[k] + slot * key[1]
            keep = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = StructType([*rows.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return dealt.repartition("_part").mapInArrow(run, schema)


def packed_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece."""
    return pack(pieces(docs, keep_ids))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
