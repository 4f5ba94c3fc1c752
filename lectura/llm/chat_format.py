"""Chat formatting: logs of events folded into messages, rendered with a loss mask, and read back.

DataFrame functions only. One shuffle by conversation serves every step, since the later keys extend that key. A conversation
ends as one string, so it has to fit a row; nothing else is gathered.

Events have conv_id, seq, role, text and, optionally, kind and target:
  message (or null): a message of the number seq; delta: text added to the message of the number target;
  edit: new text for that message; regenerate: messages and their deltas from the number target on, as far as they came
  before it, are void.
Events of one conversation apply by seq, then role, then text, so repeated rows and ties are messages of their own in a fixed
order. A delta or edit without a message opens it. A null role or text is empty, a null seq comes first, rows without conv_id
form one conversation, an empty table gives none, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates give a meaning; a backslash behind their first character takes it away.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, number, nth (among messages of that number), role, text: the messages that stand at the end of the log."""
    has = {c.lower() for c in events.columns}
    kind = F.coalesce(F.lower("kind"), F.lit("message")) if "kind" in has else F.lit("message")
    target = F.col("target").cast("long") if "target" in has else F.lit(None).cast("long")
    log = events.select("conv_id", F.col("seq").cast("long").alias("seq"), kind.alias("kind"), target.alias("target"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.withColumn("number", F.when(F.col("kind") == "message", F.col("seq")).otherwise(F.col("target")))

    in_time = [F.asc_nulls_first("seq"), F.asc("role"), F.asc("text")]
    later = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("seq"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    void_from = F.min(F.when(F.col("kind") == "regenerate", F.col("target"))).over(later)
    stands = log.withColumn("void_from", void_from).filter((F.col("kind") != "regenerate") & (F.col("void_from").isNull() | F.col("number").isNull() | (F.col("number") < F.col("void_from"))))

    of_number = Window.partitionBy("conv_id", "number").orderBy(*in_time)
    opens = (F.col("kind") == "message") | (F.row_number().over(of_number) == 1)
    stands = stands.withColumn("opens", opens).withColumn("nth", F.sum(F.col("opens").cast("long")).over(of_number.rowsBetween(Window.unboundedPreceding, 0)))
    of_message = Window.partitionBy("conv_id", "number", "nth").orderBy(*in_time)
    stands = stands.withColumn("at", F.row_number().over(of_message))
    stands = stands.withColumn("reset", F.max(F.when(F.col("opens") | (F.col("kind") == "edit"), F.col("at"))).over(Window.partitionBy("conv_id", "number", "nth")))
    parts = F.array_sort(F.collect_list(F.when(F.col("at") >= F.col("reset"), F.struct("at", "text"))))
    return stands.groupBy("conv_id", "number", "nth").agg(F.min_by("role", "at").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the conversation as one string, and (start, length) in code points of what is learnt."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "number", "nth", "role", head.alias("head"), body.alias("body"), F.length(head).alias("n_head"), F.length(body).alias("n_body"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("number"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_head") + F.col("n_body") + len(END)).over(before), F.lit(0))
    turns = turns.withColumn("start", start)
    in_order = F.array_sort(F.collect_list(F.struct("start", "head", "body", "n_head", "n_body", (F.col("role") == learn_from).alias("learn"))))
    return turns.groupBy("conv_id").agg(in_order.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct((t["start"] + t["n_head"]).alias("start"), t["n_body"].cast("long").alias("length"))).alias("loss_spans"),
    )


def format_chats(events: DataFrame, learn_from: str = "assistant") -> DataFrame:
    return render(fold(events), learn_from)


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescape(F.substring(p, F.locate(SEP, p) + len(SEP), F.lit(1 << 30))).alias("text"),
    )
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
