"""Sources: history, manual additions, JavaScript files, rules, bodies, saved state."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import schemas
from sightline.functions.text import nz
from sightline.rules.packs import Rule


def read_exchanges(spark: SparkSession, path: str, fmt: str = "parquet", source: str = "sitemap") -> DataFrame:
    df = spark.read.schema(schemas.EXCHANGES).format(fmt).load(path)
    return df.withColumn("source", F.coalesce("source", F.lit(source)))


def stream_exchanges(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Live capture: files that appear in a folder."""
    df = spark.readStream.schema(schemas.EXCHANGES).format(fmt).options(**options).load(path)
    return df.withColumn("source", F.coalesce("source", F.lit("proxy")))


def with_manual(in_scope: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual additions bypass the scope filter."""
    return in_scope.unionByName(manual.withColumn("source", F.lit("manual")))


#: Sequence numbers of imported files begin here; those of a capture stay below.
IMPORTED = 1 << 62


def read_js_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files under a synthetic URL; ``seq`` is a hash of the file, above ``IMPORTED``, so a captured row comes first."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    return df.select((F.lit(IMPORTED) + F.pmod(F.xxhash64("file"), F.lit(IMPORTED))).alias("seq"), F.concat(F.lit("import://"), name).alias("url"), "body")


NESTED_QUANTIFIER = re.compile(r"\([^()]*[+*]\)[+*]|\(\?:[^()]*[+*]\)[+*]")


def load_rules(spark: SparkSession, text: str) -> tuple[list[Rule], list[str]]:
    """A JSON rule pack; a bad rule is reported and the others load.

    Expressions with a repeated group that itself repeats are refused, since a task has no
    time limit per row.
    """
    from sightline.operators.filters import java_regex_ok

    rules, errors = [], []
    for raw in json.loads(text).get("patterns", []):
        name, regex = raw.get("name"), raw.get("regex")
        if not name or not regex:
            errors.append(f"{name}: name and regex are required")
        elif NESTED_QUANTIFIER.search(regex):
            errors.append(f"{name}: nested unbounded repetition")
        elif not java_regex_ok(spark, regex):
            errors.append(f"{name}: invalid expression")
        else:
            sev = str(raw.get("severity", "MEDIUM")).upper()
            rules.append(Rule(name, sev if sev in schemas.SEVERITIES else "MEDIUM", regex, raw.get("note") or "", bool(raw.get("lead"))))
    return rules, errors


# --- bodies ------------------------------------------------------------------------------------


@F.pandas_udf(T.StructType().add("raw", T.BinaryType()).add("error", T.StringType()))
def inflate(body: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """``raw`` and ``error`` of compressed bodies. What does not inflate is kept as it is with the
    reason; without a decoder for its encoding a body has no text, only the reason."""
    import gzip
    import zlib

    def inflated(b, enc):
        if b is not None:
            if enc in ("gzip", "x-gzip"):
                return gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
            if enc == "deflate":
                try:
                    return zlib.decompress(b)
                except zlib.error:
                    return zlib.decompress(b, -15)
            if enc in ("br", "brotli"):
                import brotli

                return brotli.decompress(b)
        return b

    def one(b, enc):
        try:
            return inflated(b, enc), None
        except ImportError as e:
            return None, f"{enc}: {e}"
        except Exception as e:  # each decoder has errors of its own; the row names it
            return b, f"{enc}: {e}"

    return pd.DataFrame([one(b, e) for b, e in zip(body, encoding)], columns=["raw", "error"])


# Charset names Spark decodes; everything else is read as UTF-8.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1",
            "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


def decode_text(raw: Column, content_type: Column) -> Column:
    """Text of a body under the charset of its content type.  Malformed input becomes the
    replacement character, as a lenient reader would do."""
    name = F.lower(F.trim(F.regexp_extract(nz(content_type), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1)))
    out = F.when(name.isin("iso-8859-1", "latin1"), F.decode(raw, "ISO-8859-1"))
    for enc in ("UTF-16", "UTF-16LE", "UTF-16BE"):
        out = out.when(name == enc.lower(), F.decode(raw, enc))
    return out.otherwise(F.call_function("make_valid_utf8", raw.cast("string")))


ENCODED = ["gzip", "x-gzip", "deflate", "br", "brotli"]


def normalise_bodies(df: DataFrame, body: str = "raw_body", encoding: str = "content_encoding", content_type: str = "content_type") -> DataFrame:
    """Adds ``text`` and ``body_error``.  Only rows with a compressed body pass through Python."""
    df = df.withColumn("_enc", F.lower(F.trim(nz(F.col(encoding)))))
    packed = F.col("_enc").isin(ENCODED)
    plain = df.where(~packed).withColumns({"_raw": F.col(body), "body_error": F.lit(None).cast("string")})
    zipped = df.where(packed).withColumn("_z", inflate(F.col(body), F.col("_enc")))
    zipped = zipped.withColumns({"_raw": F.col("_z.raw"), "body_error": F.col("_z.error")}).drop("_z")
    both = plain.unionByName(zipped)
    return both.withColumn("text", decode_text(F.col("_raw"), F.col(content_type))).drop("_raw", "_enc")
