"""Chat formatting with a grammar round trip. DataFrame functions only.

A conversation is rendered, reparsed by a deterministic parser and compared with its source; where they differ, its
conflicting content is escaped, and it is reparsed and compared again.

Grammar: a turn is `<s>` role ` [INST] ` text ` [/INST] </s>`. A control string with a backslash before it is content: escaping
puts one more backslash before each control string (after those that stand there), unescaping takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import running

CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\])"
TURN = r"(?s)^<s>(.*?) \[INST\] (.*) \[/INST\] $"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


def render(turns: Column, how) -> Column:
    """An array of the turns' strings."""
    return F.transform(turns, lambda t: F.concat(F.lit("<s>"), how(t["role"]), F.lit(" [INST] "), how(t["text"]), F.lit(" [/INST] </s>")))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null if the grammar doesn't derive it."""
    pieces = F.split(formatted, r"(?<!\\)</s>", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    whole = (F.element_at(pieces, -1) == "") & F.forall(turns, lambda p: p.rlike(TURN))
    part = lambda p, i: unescape(F.regexp_extract(p, TURN, i))
    return F.when(whole, F.transform(turns, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text"))))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, escaped, identical, parsed, loss_spans, loss_text) for each conversation.

    Turns stand by turn, then role and text (nulls first, repeated rows stay); null roles and texts are empty; null is an id like any other.
    parsed and loss_text are read back from formatted: loss_spans are (start, length) of the assistant's texts in it, code points
    from 0; loss_text is what stands under them, unescaped.
    """
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), col(role).alias("role"), col(text).alias("text"))
    talks = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one"), _order).alias("turns"))
    talks = talks.withColumn("source", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    talks = talks.withColumn("plain", render(F.col("turns"), lambda x: x))
    talks = talks.withColumn("escaped", ~parse(F.array_join("plain", "")).eqNullSafe(F.col("source")))
    talks = talks.withColumn("strings", F.when(F.col("escaped"), render(F.col("turns"), escape)).otherwise(F.col("plain")))
    talks = talks.withColumn("formatted", F.array_join("strings", ""))
    talks = talks.withColumn("parsed", parse(F.col("formatted")))
    lengths = F.transform("strings", lambda s: F.length(s).cast("long"))
    marks = F.zip_with(running(lengths), F.col("strings"), lambda at, s: F.struct(at.alias("at"), F.length(F.regexp_extract(s, r"(?s)^(<s>.*? \[INST\] )", 1)).alias("head"), F.length(s).alias("n"), s.startswith(f"<s>{ASSISTANT} [INST] ").alias("own")))
    spans = F.transform(F.filter(marks, lambda m: m["own"]), lambda m: F.struct((m["at"] + m["head"]).cast("int").alias("start"), (m["n"] - m["head"] - len(" [/INST] </s>")).cast("int").alias("length")))
    talks = talks.withColumn("loss_spans", spans)
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "escaped", F.col("parsed").eqNullSafe(F.col("source")).alias("identical"), "parsed", "loss_spans", under.alias("loss_text"))


def _order(a: Column, b: Column) -> Column:
    """By turn (nulls first), then role, then text."""
    by = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(nulls, by(a["turn"], b["turn"]), by(a["role"], b["role"]), by(a["text"], b["text"]), F.lit(0))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(tricky).alias("text"))
    made = format_conversations(rows.unionByName(more))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("conv_id", "n_turns", digest(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "identical")
