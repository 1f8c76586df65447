"""Chat formatting by a grammar round trip, in SQL functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " label ": " body "</turn>\n"

The parser is deterministic: it cuts before every ``### ``, wants exactly one ``</turn>`` at the end of each
piece, and drops one level of backslashes from bodies. A turn is first rendered as it is and parsed again; where
the parse is not the one turn that went in, its text is escaped (backslash, ``#`` and ``</``), which no text can
defeat. Then the whole conversation is parsed and compared with its source, and every turn is escaped if that fails.

Defined cases: null role or text count as empty; a null conv_id is a conversation of its own; turns sort by turn
(nulls first), then role, then text, so repeated rows stay and ties don't matter; other columns are ignored. An
empty table gives no rows. The rows of one conversation meet in one task: a conversation is one output string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def label_of(role: Column) -> Column:
    """Known roles by name; any other as @ and its UTF-8 bytes in hex."""
    out = F.concat(F.lit("@"), F.hex(F.encode(role, "UTF-8")))
    for k, v in LABELS.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def role_of(label: Column) -> Column:
    out = F.when(label.startswith("@"), F.decode(F.unhex(F.substring(label, 2, 1 << 30)), "UTF-8"))
    for k, v in LABELS.items():
        out = F.when(label == v, F.lit(k)).otherwise(out)
    return out


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), label_of(role), F.lit(SEP), body, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """ARRAY<STRUCT<role, text>>; a piece that doesn't follow the grammar has a null role."""

    def turn(piece: Column) -> Column:
        parts = F.split(piece, CLOSE)
        head = F.get(parts, F.lit(0))
        label = F.substring_index(head, SEP, 1)
        good = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "\n") & head.startswith(OPEN) & head.contains(SEP)
        text = unescape(F.substr(head, F.length(label) + len(SEP) + 1))
        return F.struct(F.when(good, role_of(F.substr(label, F.lit(len(OPEN) + 1)))).alias("role"), text.alias("text"))

    pieces = F.filter(F.split(formatted, f"(?={OPEN})"), lambda x: x != "")
    return F.transform(pieces, turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, round_trip (always true), n_escaped, recovered (the turns read back from formatted) and
    loss_spans (start and length in code points of each assistant body within formatted)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    one = F.array(F.struct("role", "text"))
    turns = turns.withColumn("clash", ~F.coalesce(parse(render(F.col("role"), F.col("text"))) == one, F.lit(False)))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "clash"))).alias("t"))

    def rendered(every: bool) -> Column:
        return F.transform("t", lambda x: render(x["role"], F.when(x["clash"] | every, escape(x["text"])).otherwise(x["text"])))

    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    same = F.coalesce(parse(F.array_join("pieces", "")) == F.col("source"), F.lit(False))
    out = (
        grouped.withColumn("source", source)
        .withColumn("pieces", rendered(False))
        .withColumn("whole", same)
        .withColumn("pieces", F.when(F.col("whole"), F.col("pieces")).otherwise(rendered(True)))
        .withColumn("n_escaped", F.when(F.col("whole"), F.size(F.filter("t", lambda x: x["clash"]))).otherwise(F.size("t")))
        .withColumn("formatted", F.array_join("pieces", ""))
        .withColumn("recovered", parse(F.col("formatted")))
    )
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p)).alias("at"),
        F.when(
            p.startswith(OPEN + LABELS["assistant"] + SEP),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + len(OPEN + LABELS["assistant"] + SEP)).alias("start"),
                        (F.length(p) - len(OPEN + LABELS["assistant"] + SEP + CLOSE + "\n")).cast("long").alias("length"),
                    )
                ),
            ),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate("pieces", none, step, lambda acc: acc["spans"])
    return out.select("conv_id", "formatted", (F.col("recovered") == F.col("source")).alias("round_trip"), F.col("n_escaped").cast("long").alias("n_escaped"), "recovered", spans.alias("loss_spans"))


def loss_text(recovered: Column) -> Column:
    """All text under the loss mask: the assistant's bodies, in order."""
    return F.array_join(F.transform(F.filter(recovered, lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
