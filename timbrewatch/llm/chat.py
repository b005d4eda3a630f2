"""Chat formatting: fold an event log into final messages, render them with a template, read them back.

The template writes a turn as ``<s>`` head, text, tail ``</s>``:

* user: ``[INST] text [/INST]``
* system: ``<<SYS>>\\n text \\n<</SYS>>``
* assistant: the text alone, which is what the loss mask covers
* any other role: ``<<ROLE>>role<</ROLE>>text``

Control strings inside texts get one backslash more after their first character
(``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``); reading takes one away.
So any text survives, and backslashes elsewhere stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the template.
ASSISTANT = "assistant"
OPEN, CLOSE = "<s>", "</s>"
USER_HEAD, USER_TAIL = "[INST] ", " [/INST]"
SYSTEM_HEAD, SYSTEM_TAIL = "<<SYS>>\n", "\n<</SYS>>"
ROLE_HEAD, ROLE_TAIL = "<<ROLE>>", "<</ROLE>>"
AFTER_ANGLE = r"\\*(?:/?s>|</?(?:SYS|ROLE)>>)"
AFTER_SQUARE = r"\\*/?INST\]"

EVENT = ["conv_id", "seq", "kind", "message", "role", "text"]
RESETS = ("edit", "regenerate")
#: Events of one message in `events_of` are numbered within this width.
WIDTH = 1 << 31
NO_SEQ = -(1 << 63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(?={AFTER_ANGLE})|\[(?={AFTER_SQUARE})", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=<)\\(?={AFTER_ANGLE})|(?<=\[)\\(?={AFTER_SQUARE})", "")


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations as the event log that would have produced them.

    A user or system row is one ``open`` event; an assistant row is opened and then
    streamed line by line. Rows go by turn (nulls first), then role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "message", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.concat(F.array(event("open", F.lit(""))), F.transform(
        F.split("text", "(?<=\n)", -1), lambda part: event("delta", part)))
    parts = F.when(F.col("role") == ASSISTANT, streamed).otherwise(F.array(event("open", F.col("text"))))
    return rows.select("conv_id", "message", "role", F.posexplode_outer(parts).alias("at", "e")).select(
        "conv_id", (F.col("message") * WIDTH + F.col("at")).alias("seq"), "e.kind", "message", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, opened, role, text.

    ``events`` has conv_id, seq, kind, message, role and text; other columns are
    ignored. ``open`` starts a message, ``delta`` appends to it, ``edit`` puts a new
    text in place of all before, ``regenerate`` does so with the first part of
    another answer. Both also withdraw the messages opened between their own
    message and themselves: the conversation goes on from there. A withdrawn
    message stays so.

    Partitioned by conversation once and sorted by sequence; all windows run in
    that partitioning and spill. A sequence number stands for one event: of several
    events with it, as after a redelivery, the first by message, kind and text
    counts. A missing number is the smallest. An event of a message that was never
    opened opens it; its role is that of the first event with one. Null text is
    empty, and an unknown kind appends.
    """
    rows = events.select(*EVENT).withColumns({
        "seq": F.coalesce("seq", F.lit(NO_SEQ)), "text": F.coalesce("text", F.lit(""))})
    by_seq = Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "text")
    once = rows.withColumn("_last", F.lag("seq").over(by_seq)).filter("_last IS NULL OR _last < seq")
    resets = F.col("kind").isin(*RESETS)
    message = Window.partitionBy("conv_id", "message")
    placed = once.withColumns({
        "_opened": F.min("seq").over(message),
        "_reset": F.max(F.when(resets | (F.col("kind") == "open"), F.col("seq"))).over(message)})
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_rewound", F.min(F.when(resets, F.col("_opened"))).over(later))
    live = F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))
    first = F.col("seq") == F.col("_opened")
    parts = F.array_sort(F.collect_list(F.when(live, F.struct("seq", "text"))))
    return (
        placed.groupBy("conv_id", "message")
        .agg(F.min("_opened").alias("opened"), F.min(F.when(first, F.col("_rewound"))).alias("_rewound"),
             F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"), parts.alias("_parts"))
        .filter("_rewound IS NULL OR _rewound >= opened")
        .select("conv_id", "opened", "role", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    ``loss`` lists the assistant texts inside ``formatted``: turn number, ``at`` (where
    the turn starts), ``start`` and ``end``, in code points from 0, end exclusive. A
    null role is written like an empty one. A conversation is one value, so
    its text must stay below 2 GB; rows without a conv_id form one conversation.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.when(role == "user", USER_HEAD).when(role == "system", SYSTEM_HEAD).when(role == ASSISTANT, "").otherwise(
        F.concat(F.lit(ROLE_HEAD), escape(role), F.lit(ROLE_TAIL)))
    tail = F.when(role == "user", USER_TAIL).when(role == "system", SYSTEM_TAIL).otherwise("")
    rows = messages.select("conv_id", "opened", role.alias("role"), F.concat(F.lit(OPEN), head).alias("_head"),
                           escape(F.col("text")).alias("_body"), tail.alias("_tail"))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", "_tail", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("opened")
    size = F.length("_piece").cast("long")
    rows = rows.withColumns({"_turn": F.row_number().over(order) - 1, "_at": F.sum(size).over(order) - size})
    start = F.col("_at") + F.length("_head")
    span = F.struct(F.col("_turn").alias("turn"), F.col("_at").alias("at"), start.alias("start"),
                    (start + F.length("_body")).alias("end"))
    pieces = F.array_sort(F.collect_list(F.struct("_turn", "_piece")))
    return rows.groupBy("conv_id").agg(
        pieces.alias("_pieces"), F.array_sort(F.collect_list(F.when(F.col("role") == ASSISTANT, span))).alias("loss")).select(
        "conv_id", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"), "loss")


def _inside(piece: Column, head: str, tail: str = "") -> Column:
    return F.substring(piece, F.lit(len(head) + 1), F.length(piece) - (len(head) + len(tail)))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role,text>>."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        named = _inside(piece, OPEN + ROLE_HEAD)
        role = F.substring_index(named, ROLE_TAIL, 1)
        user, system = piece.startswith(OPEN + USER_HEAD), piece.startswith(OPEN + SYSTEM_HEAD)
        other = piece.startswith(OPEN + ROLE_HEAD)
        body = F.when(user, _inside(piece, OPEN + USER_HEAD, USER_TAIL)).when(
            system, _inside(piece, OPEN + SYSTEM_HEAD, SYSTEM_TAIL)).when(
            other, F.substring(named, F.length(role) + len(ROLE_TAIL) + 1, F.length(named))).otherwise(_inside(piece, OPEN))
        name = F.when(user, "user").when(system, "system").when(other, unescape(role)).otherwise(ASSISTANT)
        return F.struct(name.alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(loss, lambda s: unescape(F.substring(
        F.get(pieces, s["turn"]), (s["start"] - s["at"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def format_chats(events: DataFrame) -> DataFrame:
    """Formatted conversations with their loss masks, from an event log."""
    return render(fold_events(events))
