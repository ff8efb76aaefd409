"""Chat formatting with prefix-target expansion.

Template: a turn is `<s>[INST] role [/INST]text</s>`; a conversation is its turns in order. Control strings inside
roles and texts get a backslash after their first character, backslashes are doubled: no escaped text holds a control
string, and dropping each backslash before the character it protects gives the text back.

Expansion: every assistant turn is an example of its own. Its context is the conversation from the start up to the
turn, its loss mask the reply alone (with the end mark outside). Examples refer to the conversation's one formatted
stream by offsets, so that a long conversation isn't stored once per reply; materialise() writes the texts out.

Turns are rows throughout: offsets come from a running sum within the conversation, which spills; nothing gathers a
conversation but digests() and materialise(), whose results are one value for it. digests() reads the trained text
through the exploded examples. DataFrame functions only.

Defined results: null roles and texts are empty; rows of equal turn number are ordered by role, then text; repeated
rows are turns of their own; a null conversation id is one conversation; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]")
OPEN, BODY, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, position, piece (formatted), start and end in the stream; for targets, the example:
    context_end, loss_start, loss_end (else null). Offsets count code points, ends are exclusive."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("piece").cast("long")
    turns = turns.withColumn("end", F.sum(size).over(upto)).withColumn("position", F.row_number().over(upto) - 1).withColumn("start", F.col("end") - size)
    target = F.col("role") == target_role
    return turns.select(
        "conv_id", "position", "piece", "start", "end",
        F.when(target, F.col("start")).alias("context_end"),
        F.when(target, F.col("start") + F.char_length("head")).alias("loss_start"),
        F.when(target, F.col("end") - len(CLOSE)).alias("loss_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """The expansion: one row per target turn, conv_id, example, context_end, loss_start, loss_end, by reference."""
    return turns.filter("loss_start IS NOT NULL").select("conv_id", F.col("position").alias("example"), "context_end", "loss_start", "loss_end")


def streams(turns: DataFrame) -> DataFrame:
    """conv_id, stream: each conversation's formatted text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda t: t["piece"]), "")
    return turns.groupBy("conv_id").agg(joined.alias("stream"))


def materialise(turns: DataFrame) -> DataFrame:
    """Examples with their own text, context and reply; offsets stay valid in it."""
    own = examples(turns).withColumnRenamed("conv_id", "id")
    all_text = streams(turns)
    joined = own.join(all_text, own["id"].eqNullSafe(all_text["conv_id"]))
    return joined.select("conv_id", "example", "context_end", "loss_start", "loss_end", F.substr("stream", F.lit(1), F.col("loss_end").cast("int") + len(CLOSE)).alias("text"))


def read_back(turns: DataFrame) -> DataFrame:
    """From the formatted streams and the expanded examples alone: conv_id, stream, turns (array of role, text), examples
    (array of loss_start, loss_end, context_end), loss (unescaped text under all examples' masks, in order)."""
    piece = F.struct("position", "piece")
    rows = turns.select("conv_id", piece.alias("piece"), F.lit(None).cast("struct<loss_start:long,loss_end:long,context_end:long>").alias("example"))
    rows = rows.unionByName(examples(turns).select("conv_id", F.lit(None).cast("struct<position:int,piece:string>").alias("piece"), F.struct("loss_start", "loss_end", "context_end").alias("example")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda t: t["piece"]), "")
    whole = rows.groupBy("conv_id").agg(joined.alias("stream"), F.array_sort(F.collect_list("example")).alias("examples"))
    parts = F.slice(F.split("stream", CLOSE), 1, F.size(F.split("stream", CLOSE)) - 1)
    one = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), BODY, 1)).alias("role"), unescape(F.substr(p, F.instr(p, BODY) + len(BODY))).alias("text"))
    loss = F.array_join(F.transform("examples", lambda m: unescape(F.substr(F.col("stream"), (m["loss_start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")))), "")
    return whole.select("conv_id", "stream", F.transform(parts, one).alias("turns"), "examples", loss.alias("loss"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what read_back() gives; n_examples and
    context_chars, the code points of all examples' contexts together."""
    back = read_back(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    contexts = F.aggregate("examples", F.lit(0).cast("long"), lambda a, m: a + m["context_end"])
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("stream").cast("long").alias("formatted_chars"), F.size("examples").cast("long").alias("n_examples"), contexts.alias("context_chars"))
