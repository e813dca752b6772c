"""Chat formatting with a grammar round trip, in column functions alone.

    turn := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A conversation is rendered as it is and parsed back by that grammar. Turns that do not come
back identical are escaped: "\\\\" becomes "\\\\b", "<|" becomes "<\\\\p" and, in a role, a
line break becomes "\\\\n". The parser always undoes these codes, so a text that holds one by
chance also fails the first round and is escaped. If the conversation as a whole still
differs, all its turns are escaped; if it differs even then, the job fails.

A conversation is one document of the output, so its turns meet in one row.

Nulls: a null role or text counts as empty; a null turn sorts first, and rows of a null
conv_id are one conversation. Equal turn numbers are ordered by role and text; repeated rows
are repeated turns. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def lit(text: str) -> Column:
    return F.lit(text)


def escape(text: Column, line: bool) -> Column:
    out = F.replace(F.replace(text, lit("\\"), lit("\\b")), lit("<|"), lit("<\\p"))
    return F.replace(out, lit("\n"), lit("\\n")) if line else out


def unescape(text: Column, line: bool) -> Column:
    # every backslash of an escaped text starts a code, so plain replacement is exact; "\b" comes last
    out = F.replace(text, lit("\\n"), lit("\n")) if line else text
    return F.replace(F.replace(out, lit("\\p"), lit("|")), lit("\\b"), lit("\\"))


def render_turn(turn: Column) -> Column:
    return F.concat(lit(START), turn.role, lit("\n"), turn.text, lit(END + "\n"))


def escape_turn(turn: Column) -> Column:
    return F.struct(escape(turn.role, True).alias("role"), escape(turn.text, False).alias("text"))


def parse_turn(piece: Column) -> Column:
    """Role and text of what follows a start mark; null where the grammar does not hold."""
    line = F.locate("\n", piece)
    body = F.substring(piece, line + 1, F.length(piece))
    stop = F.locate(END, body)
    rest = F.substring(body, stop + len(END), F.length(body))
    role, text = F.substring(piece, 1, line - 1), F.substring(body, 1, stop - 1)
    sound = (line > 0) & (stop > 0) & (rest == lit("\n"))
    return F.when(sound, F.struct(unescape(role, True).alias("role"), unescape(text, False).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation. What stands before the first mark must be nothing."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), parse_turn)
    return F.when(F.element_at(pieces, 1) == lit(""), turns)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def loss_spans(turns: Column, rendered: Column) -> Column:
    """(start, length), in code points of the formatted text, of every trained text."""

    def step(state: Column, pair: Column) -> Column:
        head = len(START) + 1 + F.length(pair.rendered.role)
        size = F.length(pair.rendered.text)
        span = F.array(F.struct((state.at + head).alias("start"), size.alias("length")))
        return F.struct(
            (state.at + head + size + len(END) + 1).alias("at"),
            F.when(pair.turn.role == TRAINED_ROLE, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"),
        )

    pairs = F.arrays_zip(turns.alias("turn"), rendered.alias("rendered"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(pairs, first, step, lambda s: s.spans)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans, turns): the text, its loss mask, and the turns read back from it."""
    turn = F.struct("turn", F.coalesce("role", lit("")).alias("role"), F.coalesce("text", lit("")).alias("text"))
    kept = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    found = rows.groupBy("conv_id").agg(kept.alias("source"))
    found = found.withColumn("plain", render(F.col("source")))
    found = found.withColumn("identical", parse(F.col("plain")).eqNullSafe(F.col("source")))
    alone = F.transform("source", lambda t: F.when(same_alone(t), t).otherwise(escape_turn(t)))
    found = found.withColumn("some", F.when(F.col("identical"), F.col("source")).otherwise(alone))
    found = found.withColumn("identical", F.col("identical") | parse(render(F.col("some"))).eqNullSafe(F.col("source")))
    every = F.transform("source", escape_turn)
    found = found.withColumn("rendered", F.when(F.col("identical"), F.col("some")).otherwise(every))
    found = found.withColumn("formatted", render(F.col("rendered"))).withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(
        F.raise_error(F.concat(lit("conversation does not survive formatting: "), F.coalesce(F.col("conv_id").cast("string"), lit("null")))).cast(
            "array<struct<role:string,text:string>>"
        )
    )
    return found.select("conv_id", "formatted", loss_spans(F.col("source"), F.col("rendered")).alias("spans"), checked.alias("turns"))


def same_alone(turn: Column) -> Column:
    """Whether a turn by itself comes back identical."""
    back = parse(render_turn(turn))
    return (F.size(back) == 1) & F.element_at(back, 1).eqNullSafe(F.struct(turn.role.alias("role"), turn.text.alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from the text."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, lit("\n"), t.text, lit("\n"))), "")
    loss = F.array_join(
        F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length), False)), ""
    )
    return formatted.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
