"""Chat formatting with a grammar round trip, in Spark expressions only.

A conversation is its turns in order (ties by role and text). Each turn is rendered between the marks of its role;
other roles than system, user and assistant carry their name. A deterministic parser reads the rendered text back, and
what it recovers is compared with the source: a turn whose text does not come back gets its control strings escaped
(a backslash after the first character, one more where there are some), and then all of its brackets, until the round
trip is identical; `exact` says that it is.

Null text and role are empty texts, and null turns come first. Rows without a conversation id form one conversation.
Repeated rows are repeated turns. Other columns are not read. The turns of one conversation meet in one row, as its
rendered text must; the only shuffle is by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, opening mark, closing mark.
MARKS = (
    ("system", "<<SYS>>\n", "\n<</SYS>>"),
    ("user", "[INST] ", " [/INST]"),
    ("assistant", "<s>", "</s>"),
)
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")  # before the name, after it, after the text

#: Strings that mean something to the parser, the first character apart.
CONTROL = r"(<|\[)(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|<ROLE |</ROLE>>)"
ESCAPED = r"(<|\[)\\(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|<ROLE |</ROLE>>)"
TURN = (
    r"(?s)<<SYS>>\n.*?\n<</SYS>>|\[INST\] .*? \[/INST\]|<s>.*?</s>|<<ROLE .*?<</ROLE>>"
)


def escape(text: Column) -> Column:
    """One backslash more in every control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, start, end in MARKS:
        out = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
    return out


def read_turn(piece: Column) -> Column:
    """struct(role, text, start, length) of one rendered turn: start and length of the text inside it."""

    def part(role: Column, start: Column | int, end: int) -> Column:
        start = F.lit(start) if isinstance(start, int) else start
        inner = F.length(piece) - start - end
        return F.struct(
            role.alias("role"),
            piece.substr(start + 1, inner).alias("text"),
            start.cast("int").alias("start"),
            inner.cast("int").alias("length"),
        )

    # an encoded name has no bracket, so it ends at the first pair
    name_end = F.locate(OTHER[1], piece, len(OTHER[0]) + 1)
    name = piece.substr(F.lit(len(OTHER[0]) + 1), name_end - len(OTHER[0]) - 1)
    out = part(F.url_decode(name), name_end + len(OTHER[1]) - 1, len(OTHER[2]))
    for role, start, end in MARKS:
        out = F.when(piece.startswith(start), part(F.lit(role), len(start), len(end))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Turns of a rendered text: array of struct(role, text, size, start, length).

    `text` is unescaped; `size` is the length of the rendered turn, `start` and `length` are the place of its (escaped)
    text inside it, in code points.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def turn(piece: Column) -> Column:
        return F.transform(
            F.array(F.struct(F.length(piece).alias("size"), read_turn(piece).alias("turn"))),
            lambda x: F.struct(
                x["turn"]["role"].alias("role"),
                unescape(x["turn"]["text"]).alias("text"),
                x["size"].alias("size"),
                x["turn"]["start"].alias("start"),
                x["turn"]["length"].alias("length"),
            ),
        )

    return F.flatten(F.transform(pieces, turn))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its id and `source`, an array of struct(role, text)."""
    part = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = rows.select(F.col(conv).alias("conv_id"), part.alias("part"))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("source"))
    return out.withColumn("source", F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def format_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """conv_id, source, formatted, turns (read back from formatted), exact.

    A turn's text is rendered as it is if the parser gives it back from its own turn; otherwise it is escaped, after
    which no control string is left in it.
    """

    def back(role: Column, text: Column) -> Column:
        same = F.transform(parse(render_turn(role, text)), lambda x: (x["role"] == role) & (x["text"] == text))
        return same == F.array(F.lit(True))

    df = conversations(rows, **names)
    pieces = F.transform(
        "source",
        lambda x: render_turn(x["role"], F.when(back(x["role"], x["text"]), x["text"]).otherwise(escape(x["text"]))),
    )
    df = df.withColumn("formatted", F.array_join(pieces, "")).withColumn("turns", parse(F.col("formatted")))
    plain = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return df.withColumn("exact", plain == F.col("source"))


def masked_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask, as read back from the rendered text."""
    under = F.filter(turns, lambda x: x["role"] == role)
    return F.array_join(F.transform(under, lambda x: x["text"]), "")


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
