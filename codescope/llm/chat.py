"""Chat formatting: event-sourced reconstruction of conversations, folded, rendered and read back.

The input is an event log ``(conv_id, msg, seq, kind, role, text)``:

* ``message``    starts (or restarts) message ``msg`` with ``text``;
* ``delta``      appends streamed ``text`` to the message;
* ``edit``       replaces everything written to the message before it;
* ``regenerate`` replaces the message's text and voids what later messages
  (higher ``msg``) had written before it.

Messages are folded by a keyed aggregate, never a whole conversation at once: a
message's events meet in one row, then runs of ``BLOCK`` consecutive messages are
rendered together. A conversation holding a third of all rows is therefore many
blocks; only :func:`assemble` joins the blocks, because one output row per
conversation has to hold its whole text.

Defined results: null ``text``, ``role`` and ``kind`` count as empty (an unknown kind
appends); null ``msg`` and ``seq`` sort first; a null ``conv_id`` is a conversation of
its own; events with equal ``seq`` are applied in the order of kind, then of message,
role and text; a message has its last role that is not empty, so deltas and edits need
not repeat it; an empty log gives an empty frame. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import table

BLOCK = 64
OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"
RESETS = ("message", "edit", "regenerate")


def escape(c: Column) -> Column:
    r"""Reversible escape: ``\`` becomes ``\b`` and ``<`` becomes ``\l``, so no control string survives."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    r"""A role also hides ``>``, which ends the opening mark: it becomes ``\g``."""
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Fold the log into final messages ``(conv_id, msg, role, text)``, one row per surviving message."""
    e = events.select(
        "conv_id", "msg", F.coalesce(F.col("seq"), F.lit(-(1 << 62))).alias("seq"),
        *(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("kind", "role", "text")),
        F.floor(F.col("msg") / BLOCK).alias("block"))
    regen = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regen")
    # the latest regeneration of each block, and of all blocks before it: (conversation, block) rows only
    void = (e.groupBy("conv_id", "block").agg(regen)
            .withColumn("void", F.max("regen").over(
                W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
            .where(F.col("void").isNotNull())
            .select(F.col("conv_id").alias("v_conv"), F.col("block").alias("v_block"), "void"))
    per_msg = e.groupBy("conv_id", "block", "msg").agg(
        regen, F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    # within a block the running maximum covers at most BLOCK rows of one conversation
    running = W.partitionBy("conv_id", "block").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)
    per_msg = per_msg.withColumn("void_in", F.max("regen").over(running))
    joined = per_msg.join(void, F.col("conv_id").eqNullSafe(F.col("v_conv"))
                          & F.col("block").eqNullSafe(F.col("v_block")), "left")
    # an event stands unless it came before the regeneration, in the order of seq and kind
    stands = F.filter("log", lambda x: F.col("cut").isNull() | (x["seq"] > F.col("cut"))
                      | ((x["seq"] == F.col("cut")) & (x["kind"] == "regenerate")))
    # what is written since the last reset, found by its place in the order, not by its seq
    since = F.array_position(F.reverse(F.transform("log", lambda x: x["kind"].isin(*RESETS))), F.lit(True))
    live = F.filter("log", lambda x, i: (F.col("since") == 0) | (i >= F.size("log") - F.col("since")))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != "")
    return (joined.withColumn("cut", F.greatest("void", "void_in")).withColumn("log", stands)
            .where(F.size("log") > 0).withColumn("since", since)
            .select("conv_id", "block", "msg", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
                    F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text")))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Render blocks: ``(conv_id, block, formatted, loss_spans)``.

    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``; they
    cover the escaped text of every message of ``trained_role`` and nothing else.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MID))
    rows = messages.select(
        "conv_id", "block", "msg", F.col("role") == trained_role, head, escape(F.col("text"))
    ).toDF("conv_id", "block", "msg", "trained", "head", "body")
    rows = rows.withColumn("n_head", F.char_length("head")).withColumn("n_body", F.char_length("body"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(
        F.struct("msg", "head", "body", "trained", "n_head", "n_body"))).alias("m"))
    start = F.transform("m", lambda x, i: F.aggregate(
        F.slice("m", F.lit(1), i), F.lit(0).cast("long"),
        lambda a, y: a + y["n_head"] + y["n_body"] + F.lit(len(CLOSE))) + x["n_head"])
    spans = F.filter(F.zip_with("m", start, lambda x, s: F.struct(
        x["trained"].alias("trained"), s.alias("start"), x["n_body"].cast("long").alias("length"))),
        lambda s: s["trained"])
    return blocks.select(
        "conv_id", "block",
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
                    ).alias("loss_spans"))


def assemble(blocks: DataFrame) -> DataFrame:
    """One row per conversation: ``(conv_id, formatted)``, blocks in order."""
    g = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted"))).alias("b"))
    return g.select("conv_id", F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"))


def read_back(blocks: DataFrame) -> DataFrame:
    """Parse rendered blocks: turns (role, newline, text, newline each) and the text under the loss mask."""
    turns = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    parsed = F.transform(turns, lambda t: F.concat(
        unescape(F.substring_index(F.substring(t, len(OPEN) + 1, 1 << 30), MID, 1)), F.lit("\n"),
        unescape_text(F.substring(t, F.instr(t, MID) + F.lit(len(MID)), F.lit(1 << 30))), F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape_text(
        F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return blocks.select("conv_id", "block", F.size(turns).alias("turns_n"), F.array_join(parsed, "").alias("turns"),
                         F.array_join(masked, "").alias("loss"), F.char_length("formatted").alias("chars"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as an event log; rows that share a turn stay turns of their own, in order of role and text."""
    c = conversations.select("conv_id", F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("turn"),
                             *(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "text")))
    n = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    # several rows of one turn: the fold's key gets the rank as its fraction
    return c.withColumn("n", n - 1).select(
        "conv_id", (F.col("turn").cast("decimal(20,0)") + F.col("n").cast("decimal(18,0)") / F.lit(10 ** 12)
                    .cast("decimal(13,0)")).cast("decimal(34,12)").alias("msg"),
        F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation plus the fixed probe conversation -7, formatted and read back."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(render(fold(as_events(rows))))
    g = back.groupBy("conv_id").agg(F.sum("turns_n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                    F.sort_array(F.collect_list(F.struct("block", "turns", "loss"))).alias("b"))
    turns = F.array_join(F.transform("b", lambda x: x["turns"]), "")
    loss = F.array_join(F.transform("b", lambda x: x["loss"]), "")
    return g.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op1_sql() -> str:
    return r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(text)
      + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', '')))
      + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '<', '')))
      + (length(role) - length(replace(role, '>', ''))))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
