"""Chat formatting from an event log, with built-in functions only.

An event has a conversation, a sequence number, a message (its place in the
conversation), a role, a kind and a text:

* ``delta`` appends its text to the message,
* ``edit`` replaces the message's text,
* ``regenerate`` empties the message, so that later deltas write it anew.

An edit or a regeneration also takes back what was said after that message
until then: events of later messages with a smaller sequence number.

``fold`` partitions the log by conversation and orders it by sequence without
ever holding a conversation in a list: resets are first reduced to one number
per message, a running maximum over the messages tells each event whether it
still counts, and the surviving pieces are grouped per message. ``render``
writes each message as one piece of the template, places it by a running sum of
piece lengths and joins the pieces, in blocks of ``block`` messages first, so
that a long conversation is not joined in one step.

Template of a message: ``### role: text</turn>`` and a line feed. In texts
``\\``, ``<`` and ``#`` are written ``\\b``, ``\\l`` and ``\\h`` (in roles also
``:`` as ``\\c``), so neither mark occurs inside a text, and the form reads back
to exactly what went in.

Null texts and roles count as empty. Events without a conversation are one
conversation of their own; those without a message are left out. A null or
unknown kind is a delta. Events without a sequence number come before all
others, so any reset of their message or an earlier one takes them back. Events
of equal sequence number are ordered by kind, then text; repeated deltas append
twice. An empty log gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, TAIL = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, _ESCAPES)


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: every backslash there is followed by its letter,
    and the one for the backslash itself is resolved last."""
    return _replaced(text, [(new, old) for old, new in reversed(_ESCAPES)])


def unescape_role(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(_ROLE_ESCAPES)])


def fold(events: DataFrame) -> DataFrame:
    """conversation, message, role, text: the messages that stand at the end.

    The role is that of the message's last event."""
    known = events.where("message IS NOT NULL").select(
        "conversation", "message", "sequence", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    is_reset = F.col("kind").isin("edit", "regenerate")
    resets = known.groupBy("conversation", "message").agg(F.max(F.when(is_reset, F.col("sequence"))).alias("reset"))
    earlier = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    border = resets.select(F.col("conversation").alias("c_"), F.col("message").alias("m_"), F.max("reset").over(earlier).alias("border"))
    # The message's own reset event counts; what it or an earlier one took back does not.
    same = known["conversation"].eqNullSafe(border["c_"]) & (known["message"] == border["m_"])
    alive = known.join(border, same).where("border IS NULL OR sequence >= border")
    written = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    pieces = F.array_sort(F.collect_list(F.struct("sequence", "kind", written.alias("text"))))
    return alive.groupBy("conversation", "message").agg(
        F.max_by("role", F.struct("sequence", "kind", "role")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant", block: int = 256) -> DataFrame:
    """conversation, formatted, loss: one row per conversation; ``loss`` lists
    start and end (code points of ``formatted``, end exclusive) of the texts of
    the role that bears loss."""
    role, text = _replaced(F.coalesce("role", F.lit("")), _ROLE_ESCAPES), escape(F.coalesce("text", F.lit("")))
    opening = F.concat(F.lit(HEAD), role, F.lit(": "))
    order = Window.partitionBy("conversation").orderBy("message", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("piece").cast("bigint")
    placed = (
        messages.withColumn("opening", opening)
        .withColumn("body", text)
        .withColumn("piece", F.concat("opening", "body", F.lit(TAIL)))
        .select(
            "conversation",
            "piece",
            (F.row_number().over(order) - 1).alias("place"),
            F.coalesce(F.sum(length).over(before), F.lit(0)).alias("start"),
            F.char_length("opening").cast("bigint").alias("lead"),
            F.char_length("body").cast("bigint").alias("size"),
            (F.col("role") == loss_role).alias("bears"),
        )
    )
    span = F.when(F.col("bears"), F.struct((F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("lead") + F.col("size")).alias("end")))
    listed = F.array_sort(F.collect_list(F.struct("place", "piece")))
    blocks = placed.groupBy("conversation", F.floor(F.col("place") / block).alias("part")).agg(
        F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("joined"), F.array_sort(F.collect_list(span)).alias("loss")
    )
    parts = F.array_sort(F.collect_list(F.struct("part", "joined", "loss")))
    return (
        blocks.groupBy("conversation")
        .agg(parts.alias("parts"))
        .select(
            "conversation",
            F.array_join(F.transform("parts", lambda x: x["joined"]), "").alias("formatted"),
            F.flatten(F.transform("parts", lambda x: x["loss"])).alias("loss"),
        )
    )


def read_back(formatted: Column) -> Column:
    """Messages (role, text) of a formatted conversation."""
    pieces = F.split(formatted, "</turn>\n")
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def message(piece: Column) -> Column:
        at = F.locate(": ", piece)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(piece, at + 2, F.char_length(piece))).alias("text"),
        )

    return F.transform(whole, message)


def under_mask(formatted: Column, loss: Column) -> Column:
    """Unescaped text under each span of the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
