"""Chat transcripts as training text, with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text)
and rendered. Adjacent turns of one role share a block:

    <turn>### role: text<next>text</turn>

and a line feed. Inside roles and texts a backslash is written \\b, < is \\l,
# is \\h, and in roles a colon is \\c, so control strings can't occur in them and
every text is read back as it was. `segments` holds the same text in pieces,
each with a flag that says if it counts for the loss (assistants' texts).

Defined cases: null role or text is empty; equal turn numbers are ordered by
role and text; repeated rows are turns each; a null conv_id is a conversation
of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MARK, COLON, NEXT, CLOSE = "<turn>", "### ", ": ", "<next>", "</turn>\n"
#: What is replaced inside texts, in this order, and read back in the opposite one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES if role else ESCAPES[:3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, segments (array of text and loss) and formatted (their concatenation) of each conversation."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def pieces(x: Column, i: Column) -> Column:
        fresh = (i == 0) | (F.get("t", i - 1)["role"] != x["role"])
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN + MARK), escaped(x["role"], True), F.lit(COLON))
        return F.array(
            F.struct(F.when(fresh, head).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"]).alias("text"), (x["role"] == learn_role).alias("loss")),
        )

    end = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    rows = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform("t", pieces)), end).alias("segments"))
    return rows.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def parsed_turns(formatted: str = "formatted") -> Column:
    """The turns (array of role and text in order) read back from a formatted text."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(OPEN + MARK) + 1), F.length(block))
        role = F.substring_index(body, COLON, 1)
        texts = F.split(F.substring(body, F.length(role) + len(COLON) + 1, F.length(body)), NEXT, -1)
        return F.transform(texts, lambda x: F.struct(unescaped(role, True).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from `format_chats`' output."""
    turns = chats.select("conv_id", "formatted", parsed_turns().alias("turns"), F.filter("segments", lambda x: x["loss"]).alias("learned"))
    shown = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("learned", lambda x: unescaped(x["text"])), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS etext,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS erole,
    row_number() OVER w AS i,
    lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS fresh
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN fresh THEN length(erole) + 6 + 4 + 2 + CASE WHEN i > 1 THEN 8 ELSE 0 END ELSE 6 END) + 8 AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
