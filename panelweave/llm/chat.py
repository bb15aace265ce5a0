"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of parts.  A visitor turns every part into template
text: text is escaped, an image, audio clip or document becomes a placeholder,
and its reference and expanded token count are recorded.  Turns are joined in
order to one string per conversation, with the character spans that carry loss.

Control strings all begin with ``<`` or ``[``.  In texts and roles each of these
two characters gets a ``~`` behind it, so no control string can appear there;
taking the ``~`` away restores the text exactly.

Defined cases: a null text, role or part list is empty; null turns come first;
rows with one turn number are ordered by role and text, repeats are all kept; a
null conv_id is a conversation of its own; unknown part types are read as text;
a null size counts as one unit.  Turns are joined in chunks of turn numbers
before a conversation is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted

# Fixed values of the template.
TURN = "<|turn|>"
BODY = "<|body|>"
END = "<|end|>"
LOSS_ROLE = "assistant"
PATCH = 28  # image pixels a token, each way
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 256  # a document page
CHUNK_TURNS = 64

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit("<~")), F.lit("["), F.lit("[~"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[~"), F.lit("[")), F.lit("<~"), F.lit("<"))


def text_part(text: Column) -> Column:
    """A one-part content of a plain text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    )


def _units(size: Column, unit: int) -> Column:
    return F.greatest(F.ceil(F.coalesce(size, F.lit(1)) / unit), F.lit(1)).cast("long")


def _expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for."""
    seconds = F.greatest(F.ceil(F.coalesce(part.seconds, F.lit(1.0)) * AUDIO_TOKENS), F.lit(1)).cast("long")
    return (
        F.when(part.type == "image", _units(part.width, PATCH) * _units(part.height, PATCH))
        .when(part.type == "audio", seconds)
        .when(part.type == "document", F.greatest(F.coalesce(part.pages, F.lit(1)), F.lit(1)).cast("long") * PAGE_TOKENS)
    )


def _visited(part: Column) -> Column:
    attached = F.coalesce(part.type.isin(*KINDS), F.lit(False))
    return F.struct(
        F.when(attached, F.concat(F.lit("<|"), part.type, F.lit("|>"))).otherwise(escaped(part.text)).alias("out"),
        F.when(attached, F.struct(part.type.alias("kind"), part.ref.alias("ref"), _expanded(part).alias("tokens"))).alias("attachment"),
    )


def format_chat(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans, attachments: a row a conversation.

    ``loss_spans`` holds (start from 1, length) of each assistant body in
    ``formatted``; ``attachments`` lists kind, reference and expanded tokens in
    the order of the placeholders.
    """
    visited = F.transform(F.coalesce(quoted(parts), F.array().cast(f"array<{PART}>")), _visited)
    spoken = messages.select(
        quoted(conv_id).alias("conv_id"), quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), visited.alias("visited")
    ).select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("visited", lambda v: v.out), "").alias("body"),
        F.filter(F.transform("visited", lambda v: v.attachment), lambda a: a.isNotNull()).alias("attachments"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    piece = F.struct(
        "turn", "role", "body", F.concat(head, "body", F.lit(END)).alias("piece"), F.length(head).alias("head"),
        (F.col("role") == LOSS_ROLE).alias("loss"), "attachments",
    )
    order = F.struct("turn", "role", "body")
    by_chunk = (
        spoken.select("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"), order.alias("at"), piece.alias("p"))
        .groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .select(
            "conv_id", "chunk",
            F.array_join(F.transform("ps", lambda p: p.piece), "").alias("text"),
            F.size("ps").cast("long").alias("n"),
            F.transform("ps", lambda p: F.struct(F.length(p.piece).alias("all"), p.head.alias("head"), p.loss.alias("loss"))).alias("sizes"),
            F.flatten(F.transform("ps", lambda p: p.attachments)).alias("attachments"),
        )
    )
    joined = (
        by_chunk.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "n", "sizes", "attachments"))).alias("cs"))
        .select(
            "conv_id",
            F.array_join(F.transform("cs", lambda c: c.text), "").alias("formatted"),
            F.aggregate("cs", F.lit(0).cast("long"), lambda n, c: n + c.n).alias("n_turns"),
            F.flatten(F.transform("cs", lambda c: c.sizes)).alias("sizes"),
            F.flatten(F.transform("cs", lambda c: c.attachments)).alias("attachments"),
        )
    )
    zero = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state, s):
        body = (s.all - s.head - len(END)).cast("long")
        span = F.struct((state.at + s.head).cast("long").alias("start"), body.alias("length"))
        spans = F.when(s.loss, F.concat(state.spans, F.array(span))).otherwise(state.spans)
        return F.struct((state.at + s.all).cast("long").alias("at"), spans.alias("spans"))

    return joined.select(
        "conv_id", "formatted", "n_turns",
        F.aggregate("sizes", zero, step, lambda state: state.spans).alias("loss_spans"),
        "attachments",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation of text parts."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(p, BODY, 1)).alias("role"),
            unescaped(F.regexp_replace(F.substring_index(p, BODY, -1), r"<\|end\|>$", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s.start.cast("int"), s.length.cast("int")))), "")
