"""Chat formatting: conversations to marked training text with a loss mask, by Spark expressions only.

The template, with adjacent turns of one role merged into one block:

    <s>[INST]role[/INST]text[SEP]text ...</s>

Inside roles and texts a control string, or what looks like an escaped one, gets
one more backslash after its first character, so it can't be read as control
and comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MID, SEP, CLOSE = "<s>[INST]", "[/INST]", "[SEP]", "</s>"
_CONTROL = r"([\[<])(\\*)(/?INST\]|SEP\]|/?s>)"
_ESCAPED = r"([\[<])\\(\\*)(/?INST\]|SEP\]|/?s>)"
#: Turns of a conversation that one group collects before the groups are put together.
SEGMENT = 256
#: Texts of a block whose places are summed up together: an array grows by copies, so a long block is cut.
GROUP = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted, and loss, the mask.

    loss holds, for each block in turn, the spans (start, length in code
    points, within the block) of the texts that bear loss.

    Turns are sorted by number, then role and text, so ties and repeated rows
    have one order; a null turn comes first.  Null texts and roles count as
    empty, a null conversation is one of its own.  An empty table gives an
    empty table.  Other columns are ignored, whatever their names.

    Conversations are collected in segments of SEGMENT turn numbers first, so
    a very long one is sorted in many tasks and meets only as sorted arrays.
    The result is a row a conversation, so a task holds its longest conversation
    whole, a few times over; time is in proportion to the turns for all but the
    running sum over groups of GROUP texts, which at a million turns of one role
    is still some ten million steps.
    """
    rows = turns.select(
        F.col(conv).alias("c"),
        F.floor(F.col(turn) / SEGMENT).alias("segment"),
        F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    segments = rows.groupBy("c", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = segments.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("segment", "ts"))).alias("s"))
    whole = whole.select("c", F.flatten("s.ts").alias("ts"))

    # Where a block begins, and the block: its role and its texts.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"])
    )
    whole = whole.select("c", "ts", starts.alias("starts"))
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.transform(F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    whole = whole.select("c", blocks.alias("blocks"))

    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(MID), F.array_join(b["texts"], SEP), F.lit(CLOSE))), ""
    )
    spans = F.zip_with("blocks", F.transform("blocks", _group_starts), lambda b, at: F.when(b["role"] == loss_role, _spans(b, at)).otherwise(F.expr("array()").cast("array<struct<start:int,length:int>>")))
    return whole.select(F.col("c").alias(conv), formatted.alias("formatted"), spans.alias("loss"))


def _groups(block: Column) -> Column:
    """A block's texts in groups of GROUP."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(block["texts"]) - 1) / GROUP).cast("int")), lambda g: F.slice(block["texts"], g * GROUP + 1, GROUP))


def _group_starts(block: Column) -> Column:
    """Where each group of a block's texts begins in the block: a running sum over groups."""
    first = F.length(F.lit(OPEN + MID)) + F.length(escape(block["role"]))
    sizes = F.transform(_groups(block), lambda ts: F.aggregate(ts, F.lit(0), lambda n, t: n + F.length(t) + len(SEP)))
    return F.aggregate(sizes, F.array(first), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))


def _spans(block: Column, starts: Column) -> Column:
    """Where a block's texts are in it: running sums within each group, which hold few copies of few places."""
    return F.flatten(
        F.transform(
            _groups(block),
            lambda ts, g: F.aggregate(
                ts,
                F.struct(F.get(starts, g).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans")),
                lambda acc, t: F.struct(
                    (acc["at"] + F.length(t) + len(SEP)).alias("at"),
                    F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(t).alias("length")))).alias("spans"),
                ),
                lambda acc: acc["spans"],
            ),
        )
    )


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What format_chats wrote: conv, turns (role, text) in order, and loss_text, all text under the mask."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    rows = formatted.select(F.col(conv).alias("c"), "loss", pieces.alias("pieces"))

    def turns_of(piece: Column) -> Column:
        at = F.instr(piece, MID)
        role = unescape(F.substring(piece, len(OPEN) + 1, at - len(OPEN) - 1))
        body = F.substring(piece, at + len(MID), F.length(piece))
        return F.transform(F.split(body, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    under = F.transform(
        F.arrays_zip("pieces", "loss"),
        lambda z: F.array_join(F.transform(z["loss"], lambda s: unescape(F.substring(z["pieces"], s["start"] + 1, s["length"]))), ""),
    )
    return rows.select(F.col("c").alias(conv), F.flatten(F.transform("pieces", turns_of)).alias("turns"), F.array_join(under, "").alias("loss_text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = format_chats(chats.unionByName(trap))
    back = read_chats(done.select("conv_id", "loss", "formatted", ).withColumn("conv_id", F.struct("conv_id", F.length("formatted").alias("n"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.col("conv_id.n").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|SEP\]|/?s>)', '\1\\\2\3', 'g') AS written,
         regexp_replace(role, '([\[<])(\\*)(/?INST\]|SEP\]|/?s>)', '\1\\\2\3', 'g') AS speaker,
         lag(role) OVER w IS DISTINCT FROM role AS first
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(written) + CASE WHEN first THEN length('<s>[INST][/INST]</s>') + length(speaker) ELSE length('[SEP]') END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
