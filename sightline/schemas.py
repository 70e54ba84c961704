"""Input schemas."""

from __future__ import annotations

from pyspark.sql import types as T

NAME_VALUE = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
PARAM = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

EXCHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("req_headers", T.ArrayType(NAME_VALUE)),
        T.StructField("params", T.ArrayType(PARAM)),
        T.StructField("req_body", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("resp_headers", T.ArrayType(NAME_VALUE)),
        T.StructField("content_type", T.StringType()),
        T.StructField("resp_body", T.StringType()),
    ]
)

JS_FILES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

REPLAYS = T.StructType(
    [
        T.StructField("target_key", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("identity", T.StringType()),
        T.StructField("run_id", T.IntegerType()),
        T.StructField("ts", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("orig_status", T.IntegerType()),
        T.StructField("orig_body", T.StringType()),
        T.StructField("orig_length", T.IntegerType()),
    ]
)

ANNOTATIONS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("bookmarked", T.BooleanType()),
        T.StructField("note", T.StringType()),
        T.StructField("triage", T.StringType()),
    ]
)

FINDING_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("raw_match", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("sensitive", T.BooleanType()),
    ]
)
FINDING_DDL = "struct<type:string,severity:string,raw_match:string,location:string,evidence:string,sensitive:boolean>"

# Order matters, it is the ordinal.
SEVERITIES = ["HIGH", "MEDIUM", "LOW", "INFO"]
TRIAGE = ["NEW", "REVIEWED", "CONFIRMED", "FALSE_POSITIVE"]
CATEGORIES = [
    "Secret", "PII", "Auth", "Misconfig", "Info leak", "API", "Injection", "Crypto", "Comment", "Other",
]
