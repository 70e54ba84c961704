"""Chat formatting of typed content parts. DataFrame expressions only.

Method. A turn's content is a list of typed parts. A visitor goes over it in order: a
text part becomes its escaped text, an image, audio or document part a placeholder, and
its reference is recorded with the character it stands at and the tokens it expands to.
Turns are put between control strings; what looks like one inside a text is escaped so
that it can be read back. The loss mask covers the text of assistant turns.

    <|turn|>role<|body|>content<|end|>

Escaping: a backslash is doubled, and one is put behind the first character of every
control string, of this template or another. Reading back drops the backslash.

Turns are formatted row by row before they meet; a conversation is one row of output, so
its text is assembled in one task, as it must be for a digest of the whole.

Defined results: null text or role is the empty string; rows without a ``conv_id`` make
one conversation without an id; turns of equal number are ordered by role, then content;
unknown part types are kept as documents; a part without tokens expands to the tokens
its type has by default. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Tokens a part expands to where it names none.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}
#: Control strings of common templates that must not stand in a text as they are.
_CONTROL = r"(?:<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|<(?=/?(?:start|end)_of_turn>)|\[(?=/?INST\]))"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(text, f"({_CONTROL})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The content of a plain turn: one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def visited(content: Column) -> Column:
    """Flatten typed parts: struct of ``flat`` text and ``attachments`` (type, ref, at, tokens)."""
    kind = lambda p: F.when(p["type"].isin(*EXPANDED, "text"), p["type"]).otherwise(F.lit("document"))
    default = F.create_map(*[F.lit(x) for pair in EXPANDED.items() for x in pair])
    entry = "array<struct<type:string,ref:string,at:bigint,tokens:bigint>>"

    def visit(seen: Column, part: Column) -> Column:
        text = kind(part) == "text"
        piece = F.when(text, escaped(part["text"])).otherwise(F.concat(F.lit("<|"), kind(part), F.lit("|>")))
        record = F.struct(kind(part).alias("type"), part["ref"].alias("ref"), F.length(seen["flat"]).cast("bigint").alias("at"), F.coalesce(part["tokens"], default[kind(part)].cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"))
        more = F.when(text, F.array().cast(entry)).otherwise(F.array(record).cast(entry))
        return F.struct(F.concat(seen["flat"], piece).alias("flat"), F.concat(seen["attachments"], more).alias("attachments"))

    start = F.struct(F.lit("").alias("flat"), F.array().cast(entry).alias("attachments"))
    return F.aggregate(F.coalesce(F.filter(content, lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>")), start, visit)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end; characters of ``formatted``) and attachments per conversation.

    ``turns``: conv_id, turn, role, content (array of parts).
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), visited(F.col("content")).alias("v"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.select("conv_id", "turn", "role", "v.flat", "v.attachments", head.alias("head"))
    rows = rows.withColumn("formatted", F.concat("head", "flat", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "flat")
    rows = rows.withColumn("nr", F.row_number().over(order))
    rows = rows.withColumn("at", F.sum(F.length("formatted")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("formatted"))
    begin = F.col("at") + F.length("head")
    span = F.struct(begin.alias("start"), (begin + F.length("flat")).alias("end"))
    moved = F.transform("attachments", lambda a: F.struct(a["type"].alias("type"), a["ref"].alias("ref"), (begin + a["at"]).alias("at"), a["tokens"].alias("tokens")))
    each = F.struct("nr", "formatted", F.when(F.col("role") == "assistant", span).alias("span"), moved.alias("attachments"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: role, text (unescaped), and the raw text's length."""
    raw = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(raw, 1, F.size(raw) - 1)

    def turn(t: Column) -> Column:
        return F.transform(F.array(F.split(F.substr(t, F.lit(len(TURN) + 1)), r"<\|body\|>", 2)), lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text"), F.length(t).cast("bigint").alias("chars"), F.length(p[1]).cast("bigint").alias("body")))[0]

    return F.transform(turns, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, start, end; characters), loss_text: what the output itself says.

    The places of the turns are explode positions and a running sum; a turn is under the
    loss where one of ``loss_spans`` has its place.
    """
    turns = formatted.select("conv_id", F.posexplode(parsed(F.col("formatted"))).alias("nr", "t")).select("conv_id", "nr", "t.*")
    order = Window.partitionBy("conv_id").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("end", F.sum(F.col("chars") + len(END)).over(order) - len(END))
    turns = turns.withColumn("start", F.col("end") - F.col("body"))
    masked = formatted.select("conv_id", F.explode("loss_spans").alias("s")).select("conv_id", "s.start", "s.end").withColumn("loss", F.lit(True))
    same = (turns["start"] == masked["start"]) & (turns["end"] == masked["end"]) & turns["conv_id"].eqNullSafe(masked["conv_id"])
    out = turns.join(masked, same, "left").select(turns["conv_id"], "nr", "role", "text", turns["start"], turns["end"], F.coalesce("loss", F.lit(False)).alias("loss"))
    return out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nr", "role", "text", "start", "end", "loss"))).alias("turns"))


#: The conversation that the contract adds: control strings of another template as texts.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = rows.unionByName(probe).withColumn("content", text_part(F.col("text")))
    output = format_conversations(turns)
    joined = lambda xs: F.array_join(xs, "")
    said = joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = joined(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    back = read_back(output).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))
    length = output.select(F.col("conv_id").alias("c"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.join(length, back["conv_id"].eqNullSafe(length["c"])).drop("c")


#: DuckDB: the same digests from the table itself. Escaping is stated again by string functions.
OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(role || chr(1) || text, '\', '\\'), '(<\||</?s>|<</?SYS>>|</?(start|end)_of_turn>|\[/?INST\])', '_\1', 'g')) - 1 AS escaped FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(8 + 8 + escaped + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
