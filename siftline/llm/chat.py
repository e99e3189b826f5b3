"""Chat formatting as relational work, in SQL functions only.

Turns are escaped row by row, collected as structs, sorted, and merged and joined by array functions. A block of adjacent
turns of one role reads

    <s>[ROLE]role[/ROLE]text[NEXT]text</s>

Control strings inside roles and texts, those of this template and of common others, get a backslash after their first
character, and one more where backslashes stand there already; so reading a conversation back gives its turns exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
OPEN, ROLE_END, NEXT, CLOSE = "<s>[ROLE]", "[/ROLE]", "[NEXT]", "</s>"
# What follows the first character of a control string, the backslashes taken off.
_TAILS = r"/?s>|/?ROLE\]|NEXT\]|/?INST\]|<?/?SYS>>|\|[A-Za-z_]+\|>|(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>"
CONTROL = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"
ANSWERS = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  answers: str = ANSWERS) -> DataFrame:
    """(id, formatted, loss_spans): one row of each conversation.

    Turns go by number (null first), ties by role and text as escaped. Null texts and roles count as empty; repeated rows are
    turns of their own, and rows without an id make up one conversation. ``loss_spans`` has start and
    length, in code points of ``formatted``, of the text of every turn whose role is ``answers``. A conversation
    is one row of the result, and so must fit in one.
    """
    safe = lambda c: escaped(F.coalesce(F.col(c), F.lit("")))
    rows = turns.select(F.col(id_col).alias("_id"), F.struct(F.col(turn_col).alias("turn"), safe(role_col).alias("role"), safe(text_col).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        turn_at = lambda k: F.get(F.col("turns"), k)
        goes_on = F.coalesce(turn_at(i - 1)["role"] == t["role"], F.lit(False))
        last = ~F.coalesce(turn_at(i + 1)["role"] == t["role"], F.lit(False))
        before = F.when(goes_on, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), t["role"], F.lit(ROLE_END)))
        return F.struct(
            before.alias("before"), t["text"].alias("text"), F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
            (t["role"] == escaped(F.lit(answers))).alias("counts"),
        )

    pieces = sorted_turns.select("_id", F.transform("turns", piece).alias("pieces"))
    size = lambda p: F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def add(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + F.length(p["before"])).alias("start"), F.length(p["text"]).alias("length"))
        spans = F.when(p["counts"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size(p)).alias("at"), spans.alias("spans"))

    return pieces.select(
        F.col("_id").alias(id_col),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"].alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds."""
    quoted = lambda mark: "".join("\\" + c if c in "[]" else c for c in mark)
    blocks = F.transform(
        F.filter(F.split(formatted, quoted(OPEN), -1), lambda b: b != ""), lambda b: F.substr(b, F.lit(1), F.length(b) - len(CLOSE))
    )

    def of_block(block: Column) -> Column:
        halves = F.split(block, quoted(ROLE_END), 2)
        role = unescaped(F.element_at(halves, 1))
        return F.transform(
            F.split(F.element_at(halves, 2), quoted(NEXT), -1), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text"))
        )

    return F.flatten(F.transform(blocks, of_block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"])))
    return F.array_join(texts, "")
