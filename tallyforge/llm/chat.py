"""Chat formatting of typed content parts, with a loss mask and a way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that begin or end a control string, and what stands for them inside texts.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
TURN_OPEN, TURN_CLOSE = "[TURN ", "[/TURN]"
#: Placeholder word of each kind of attachment, and the tokens it expands to where a part gives no number.
ATTACHMENTS = {"image": ("IMAGE", 576), "audio": ("AUDIO", 750), "document": ("DOCUMENT", 1024)}
OTHER = ("FILE", 256)

PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A message's parts where all it has is a text; null counts as empty."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), none.alias("tokens"))
    return F.array(part).cast(PARTS)


def _by_kind(kind: Column, text: Column, others: dict[str, Column], other: Column) -> Column:
    """The visitor's case for one part; a part without a kind is a text."""
    result = F.when(F.coalesce(kind, F.lit("text")) == "text", text)
    for name, value in others.items():
        result = result.when(kind == name, value)
    return result.otherwise(other)


def format_conversations(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id as ``conv_id``, ``formatted``, ``segments``, ``attachments``, ``n_turns``.

    ``parts_col`` holds typed parts (``PARTS``). A visitor walks them in
    order of turn and place: a text is escaped, so that no control string
    appears in it; an image, audio, document or other part becomes a
    placeholder with its number in the conversation, and its reference and
    expanded token count go to ``attachments``. ``segments`` (text, loss) are
    the pieces of ``formatted`` in order; the loss mask covers the contents of
    ``loss_roles`` and no marker.

    Null texts and roles count as empty, null or empty parts as an empty turn,
    null turns come first, ties are ordered by role and content, rows that
    repeat a turn stay. A null id is a conversation of its own; an empty table
    gives no rows. Other columns are ignored. Rows move once, by conversation.
    One conversation is one row of the result, so it has to fit in a task.
    """
    conv = F.col(conv_col).alias("conv_id")
    rows = messages.select(
        conv,
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.when(F.coalesce(F.size(parts_col), F.lit(0)) > 0, F.col(parts_col).cast(PARTS)).alias("parts"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    numbered = rows.withColumn("place", F.row_number().over(by_turn))
    parts = numbered.select(
        "conv_id", "place", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("at", "part")
    ).withColumn("at", F.coalesce("at", F.lit(0)))
    kind, text = F.col("part.kind"), F.coalesce(F.col("part.text"), F.lit(""))
    attached = F.coalesce(kind, F.lit("text")) != "text"
    before = Window.partitionBy("conv_id").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("number", F.coalesce(F.sum(attached.cast("long")).over(before), F.lit(0)))

    def placeholder(word: str) -> Column:
        return F.concat(F.lit(f"[{word} "), F.col("number").cast("string"), F.lit("]"))

    shown = _by_kind(kind, escape(text), {k: placeholder(w) for k, (w, _) in ATTACHMENTS.items()}, placeholder(OTHER[0]))
    tokens = F.coalesce(
        F.col("part.tokens"),
        _by_kind(kind, F.lit(0), {k: F.lit(n) for k, (_, n) in ATTACHMENTS.items()}, F.lit(OTHER[1])).cast("long"),
    )
    record = F.struct(
        F.col("number"), (F.col("place") - 1).alias("turn"), F.col("at").alias("part"), kind.alias("kind"),
        F.col("part.ref").alias("ref"), tokens.alias("tokens"),
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    opening = segment(F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit("]")), F.lit(False))
    closing = segment(F.lit(TURN_CLOSE), F.lit(False))
    none = F.array().cast("array<struct<text:string,loss:boolean>>")
    pieces = F.concat(
        F.when(F.col("at") == 0, F.array(opening)).otherwise(none),
        F.array(segment(shown, F.col("role").isin(*loss_roles))),
        F.when(F.col("at") >= F.coalesce(F.col("n"), F.lit(1)) - 1, F.array(closing)).otherwise(none),
    )
    entry = F.struct("place", "at", pieces.alias("pieces"), F.when(attached, record).alias("record"))
    gathered = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("place").cast("long").alias("n_turns")
    )
    return gathered.select(
        "conv_id", F.flatten("entries.pieces").alias("segments"),
        F.filter("entries.record", lambda r: r.isNotNull()).alias("attachments"), "n_turns",
    ).select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "attachments", "n_turns")


def read_turns(formatted: Column) -> Column:
    """``role`` and ``text`` of each turn, read back from a formatted conversation; placeholders stay as they are."""
    pieces = F.split(formatted, TURN_CLOSE.replace("[", "\\[").replace("]", "\\]"), -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    opened = len(TURN_OPEN)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "]", 1)
        return F.struct(
            unescape(F.substring(role, opened + 1, F.length(role))).alias("role"),
            unescape(F.substring(piece, F.length(role) + 2, F.length(piece))).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a conversation's output gives back: turns and loss text as counts and SHA-256 digests."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.select(
        "conv_id", "formatted", "attachments", turns.alias("turns"), loss_text(F.col("segments")).alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )
