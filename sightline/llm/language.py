"""Language of whole texts by compression with per-language dictionaries.

Method. Each learned language has a raw-content zstandard dictionary: running text of that
language. A text is compressed with every dictionary, in blocks of ``BLOCK`` bytes that each
start from the dictionary alone (so that a long text doesn't become its own dictionary),
and the language of the smallest total wins. Ties go to the language with more documents.
Where the runner-up is within ``NARROW`` of the size, or ``LEAST`` bytes, the margin is too
narrow and the answer is marked as rejected; it still names the best guess.

Texts are compared in lower case with ASCII non-letters, digits and punctuation taken for
one space, so that shouting, markup and numbers count for no language.

The dictionaries are a bounded sample: segments of ``SEGMENT`` characters of all texts to
learn from, those with the smallest hashes, up to ``DICTIONARY`` bytes a language, for the
``LANGUAGES`` languages of most text. The share of the hashes that can be needed is known from
the bytes of each language, so a task passes on few segments, and copies meet as one.

Defined results: null texts and texts without a letter are ``und``, score 0, rejected. Without
any text to learn from all are. Rows of null text or null language teach nothing; a null
doc_id isn't held out. Repeated rows and extra columns change nothing. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, table
from sightline.llm.shingles import mix

#: Bytes of a dictionary, characters of a segment, most languages; how many times the bytes are drawn before duplicates go.
DICTIONARY, SEGMENT, LANGUAGES, DRAWN = 65_536, 256, 256, 4
#: Bytes compressed at a time, level and shortest match of the compressor.
BLOCK, LEVEL, SHORTEST = 16_384, 6, 3
#: Margins, in shares of the smallest size and in bytes, under which an answer is rejected.
NARROW, LEAST = 0.01, 2
UNKNOWN = "und"

_OTHER = re.compile("[\x00-@\\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf -⁯　-〿]+")


def plain(text: str) -> bytes:
    """The form in which texts are compared."""
    return f" {_OTHER.sub(' ', text).strip().lower()} ".encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _segments(text: str, share: float) -> list[tuple[int, bytes]]:
    """Segments of a text whose hash is in the lowest ``share``, with that hash; equal texts give equal ones."""
    n = -(-len(text) // SEGMENT)
    seed = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    with np.errstate(over="ignore"):
        rank = mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(1)
    return [(int(rank[k]), plain(text[k * SEGMENT : (k + 1) * SEGMENT])) for k in np.flatnonzero(rank <= share * (2.0**63 - 1024))]


@dataclass
class Languages:
    """Names in falling order of documents, and the dictionary of each."""

    names: list[str]
    texts: list[bytes]
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"names": self.names, "texts": self.texts, "_made": []}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not self._made:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST, write_checksum=False, write_content_size=False, write_dict_id=False)
            for text in self.texts:
                own = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                self._made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
        return self._made

    def sizes(self, text: str) -> list[int]:
        """Compressed size of the text with the dictionary of every language."""
        data = plain(text)
        return [sum(len(c.compress(data[k : k + BLOCK])) for k in range(0, len(data), BLOCK)) for c in self._compressors()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        size = np.array(self.sizes(text))
        best = int(np.argmin(size))  # the first of equal ones: most documents
        gap = np.delete(size, best) - size[best]
        score = 1 / (1 + float((2.0 ** -np.minimum(gap, 1000)).sum()))
        return self.names[best], score, bool(len(gap)) and bool(gap.min() < max(LEAST, NARROW * size[best]))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; such documents are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Languages:
    """Dictionaries from the texts of ``docs`` with a language that aren't held out."""
    arrow_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", "text")
    totals = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).where("bytes > 0")
    rows = totals.orderBy(F.desc("bytes"), "lang").limit(LANGUAGES).collect()  # a row per language, LANGUAGES at most
    share = {r["lang"]: min(1.0, DRAWN * DICTIONARY / r["bytes"]) for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, *s) for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True) if lang in share for s in _segments(text, share[lang]) if s[1].strip()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "rank", "segment"])

    drawn = known.mapInArrow(run, "lang string, rank long, segment binary").groupBy("lang", "segment").agg(F.min("rank").alias("rank"))
    text: dict[str, bytearray] = {r["lang"]: bytearray() for r in rows}
    for r in drawn.orderBy("rank", "segment").collect():  # about DRAWN dictionaries a language
        if len(text[r["lang"]]) < DICTIONARY:
            text[r["lang"]] += r["segment"]
    names = [r["lang"] for r in sorted(rows, key=lambda r: (-r["n"], r["lang"])) if text[r["lang"]]]
    return Languages(names, [bytes(text[n][:DICTIONARY]) for n in names])


def _predictor(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [languages.predict(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, languages: Languages | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; one row per row of ``docs``."""
    languages = languages or learn(docs)
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predictor(languages), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
