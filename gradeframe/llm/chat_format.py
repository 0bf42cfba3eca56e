r"""Conversations as training text, and back, in column expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one
role are merged into a block, and blocks are concatenated:

    ### User: text</turn>
    ### Assistant: text<next>text</turn>

``<next>`` parts the turns of a block. A backslash in a text is doubled, and a
backslash is put into what a text shares with the template (``#\##``, ``<\/turn>``,
``<\next>``), so no text can end a turn or begin one, and a backslash followed by
a character always stands for that character. The roles system, user and assistant
are shown with a capital; other roles are shown as they are, escaped the same way
(also ``: ``, and with a backslash in front if they look like a shown role).

The loss mask is an array of spans over the UTF-8 bytes of the text: the escaped text of
each turn of the trained roles, without anything of the template. Bytes make reading a
span independent of how long the text before it is.

Cases: a NULL text or role is empty. NULL turn numbers come first; turns of equal number go by role,
then text; repeated rows are turns of their own. Rows with a NULL conversation id are
one conversation. Empty texts keep their turn, and their span is empty. A table
without rows gives no rows. A conversation is one value, so it has to fit in one (2 GB);
work per conversation grows in proportion to its length. Only the four columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
TRAINED = ("assistant",)
BEGIN, AFTER_ROLE, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
# Elements of a running sum that are added up at a time.
_STRIDE = 256


def escaped(text: Column) -> Column:
    """A text in which no control string occurs."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=##)", r"#\\")
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("<next>"), F.lit("<\\next>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def shown_role(role: Column) -> Column:
    """The role as it stands in the header."""
    other = F.replace(escaped(role), F.lit(": "), F.lit(":\\ "))
    other = F.when(other.isin(*ROLES.values()), F.concat(F.lit("\\"), other)).otherwise(other)
    for name, shown in ROLES.items():
        other = F.when(role == name, shown).otherwise(other)
    return other


def read_role(shown: Column) -> Column:
    role = unescaped(shown)
    for name, as_shown in ROLES.items():
        role = F.when(shown == as_shown, name).otherwise(role)
    return role


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it.

    Strides are summed on their own, then the strides' totals: an array that
    grows by one element at a time is never longer than a stride or than there are strides.
    """
    def running(part: Column) -> Column:
        return F.aggregate(
            part, F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before")),
            lambda acc, v: F.struct((acc["total"] + v).alias("total"),
                                    F.concat(acc["before"], F.array(acc["total"])).alias("before")))

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(_STRIDE))).otherwise(F.array().cast("array<int>"))
    strides = F.transform(starts, lambda s: running(F.slice(values, s, F.lit(_STRIDE))))
    offsets = running(F.transform(strides, lambda s: s["total"]))["before"]
    return F.flatten(F.zip_with(strides, offsets, lambda s, o: F.transform(s["before"], lambda b: b + o)))


def _blocks(turns: Column) -> Column:
    """Sorted turns with neighbours of one role merged: array of (role, texts)."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    firsts = F.filter(places, lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(turns)))
    return F.zip_with(firsts, ends, lambda first, end: F.struct(
        turns[first]["role"].alias("role"),
        F.transform(F.slice(turns, first + 1, end - first), lambda t: t["text"]).alias("texts")))


def _pieces(block: Column, trained: Sequence[str]) -> Column:
    """A block as neighbouring stretches of text, with a flag for those that are trained on."""
    header = F.concat(F.lit(BEGIN), shown_role(block["role"]), F.lit(AFTER_ROLE))
    learn = block["role"].isin(*trained)
    last = F.size(block["texts"]) - 1

    def stretches(text: Column, i: Column) -> Column:
        after = F.when(i < last, NEXT).otherwise(END)
        return F.array(F.struct(escaped(text).alias("text"), learn.alias("learn")),
                       F.struct(after.alias("text"), F.lit(False).alias("learn")))

    return F.concat(F.array(F.struct(header.alias("text"), F.lit(False).alias("learn"))),
                    F.flatten(F.transform(block["texts"], stretches)))


def formatted(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained: Sequence[str] = TRAINED,
) -> DataFrame:
    """id, formatted text and loss_spans (start, end), one row per conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias("id"), turn.alias("turn")) \
        .groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Each step is a projection of its own, so that none is worked out twice.
    merged = turns.select("id", _blocks(F.col("turns")).alias("blocks"))
    pieces = merged.select("id", F.flatten(F.transform("blocks", lambda b: _pieces(b, trained))).alias("pieces"))
    placed = pieces.select(
        "id", "pieces", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.octet_length(p["text"]).cast("long")).alias("sizes"))
    spans = F.arrays_zip("pieces", sums_before(F.col("sizes")).alias("start"), "sizes")
    learned = placed.select("id", "formatted", spans.alias("spans")).select(
        "id", "formatted", F.transform(
            F.filter("spans", lambda s: s["pieces"]["learn"]),
            lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["sizes"]).alias("end"))).alias("loss_spans"))
    return learned.withColumnRenamed("id", id_col)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.split(text, END)
    # What follows the last end is empty.
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        shown = F.substring_index(F.substr(block, F.lit(len(BEGIN) + 1)), AFTER_ROLE, 1)
        body = F.substr(block, F.length(shown) + len(BEGIN) + len(AFTER_ROLE) + 1)
        role = read_role(shown)
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    raw = F.encode(text, "UTF-8")
    parts = F.transform(spans, lambda s: unescaped(
        F.substr(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))
    return F.array_join(parts, "")


def format_report(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained: Sequence[str] = TRAINED,
) -> DataFrame:
    """What can be read back from the formatted conversations, as counts and digests."""
    out = formatted(rows, id_col, turn_col, role_col, text_col, trained).withColumnRenamed(id_col, "id")
    back = out.select("id", read_turns(F.col("formatted")).alias("turns"),
                      read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                      F.char_length("formatted").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias(id_col), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"))
