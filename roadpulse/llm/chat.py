"""Chat formatting with Spark expressions only.

A turn becomes `<turn ROLE>TEXT`, closed by `</turn>` and a line break; a turn of the same role as the one before goes on
in the same mark as `<also ROLE>TEXT`. `&`, `<` and `>` inside roles and texts become entities, so every `<` of the output is
a mark and the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
LEARNED = "assistant"
#: Turns of a conversation that are formatted together before its parts meet.
BLOCK = 256


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _mark(before: Column, role: Column) -> Column:
    """What stands between the turn of role `before` (null: there is none) and one of `role`."""
    opened = F.concat(F.lit("<turn "), escape(role), F.lit(">"))
    return (
        F.when(before.isNull(), opened)
        .when(before == role, F.concat(F.lit("<also "), escape(role), F.lit(">")))
        .otherwise(F.concat(F.lit(END), opened))
    )


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("piece"), loss.alias("loss"))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: `(<conversation>, formatted, segments)`.

    `segments` cuts `formatted` into `(piece, loss)`; the pieces of assistant texts are the ones to learn. Turns go by
    `turn`, then role, then text, so ties and repeated rows have one order; a null turn comes first. Null role or text is an
    empty one; rows whose conversation is null form one conversation. Other columns are not read; no rows give no rows.
    A conversation is formatted in blocks of consecutive turn numbers, so that only finished text meets in its last row.
    """
    nothing = F.lit("")
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), nothing).alias("role"),
        F.coalesce(F.col(text).cast("string"), nothing).alias("text"),
    )
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    blocks = rows.groupBy("conv", block).agg(sorted_turns)

    def pieces(t: Column, i: Column) -> Column:
        own = _piece(escape(t["text"]), t["role"] == LEARNED)
        before = F.element_at("turns", F.when(i > 0, i).otherwise(F.lit(1)))["role"]
        return F.when(i == 0, F.array(own)).otherwise(F.array(_piece(_mark(before, t["role"]), F.lit(False)), own))

    parts = blocks.select(
        "conv",
        F.struct(
            "block",
            F.col("turns")[0]["role"].alias("first"),
            F.element_at("turns", -1)["role"].alias("last"),
            F.flatten(F.transform("turns", pieces)).alias("pieces"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list("part"), _by_block).alias("parts"))

    def stitched(part: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("parts", F.when(i > 0, i).otherwise(F.lit(1)))["last"])
        return F.concat(F.array(_piece(_mark(before, part["first"]), F.lit(False))), part["pieces"])

    closing = F.array(_piece(F.lit(END), F.lit(False)))
    segments = F.concat(F.flatten(F.transform("parts", stitched)), closing)
    return whole.select("conv", segments.alias("segments")).select(
        F.col("conv").alias(conversation),
        F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"),
        "segments",
    )


def _by_block(a: Column, b: Column) -> Column:
    """Order of parts; the block of null turn numbers comes first, and there is one part per block."""
    x, y = a["block"], b["block"]
    return (
        F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    )


def read_turns(formatted: Column) -> Column:
    """The turns behind a formatted conversation: an array of `(role, text)`."""
    marks = F.filter(F.split(formatted, "<", -1), lambda p: p.startswith("turn ") | p.startswith("also "))

    def turn(p: Column) -> Column:
        at = F.locate(">", p)
        return F.struct(
            unescape(F.substr(p, F.lit(6), at - 6)).alias("role"), unescape(F.substr(p, at + 1)).alias("text")
        )

    return F.transform(marks, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
s AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN before IS NOT NULL AND before <> role THEN 8 ELSE 0 END
           + length(replace(replace(replace('<turn ' || role || '>' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) - 6 AS n
  FROM o),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) + 8 AS n
  FROM s GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM g
"""
