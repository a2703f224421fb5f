"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The longest common prefix of the turns of the chosen and the rejected conversation is
rendered once, as the prompt. What follows on either side is a completion. Of a
completion only the assistant's words and their closing mark are trained on; headers
and other roles are masked, and so is the prompt.

Everything stays in rows of one turn: the first position at which the sides differ is
an aggregate, and offsets are sums over blocks of turns and then inside a block. So a
conversation of any length is spread over tasks, and only DataFrame functions run.

Defined results: a null role or text counts as the empty string. Turns are ordered by
position, equal positions by role and text; a repeated row counts once. A
side that ends is a difference: the longer side has the rest as its completion. Equal sides
have a prompt and no completions. Rows with a null pair, position or side take no part. A
pair with one side has an empty prompt. Columns with other names are not read, an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, BREAK, CLOSE = "<|", "|>\n", "<|end|>\n"
BLOCK_TURNS = 256


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(BREAK), text, F.lit(CLOSE))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Rendered turns of pairs, from columns pair_id, side, position, role, text.

    ``side`` is 'chosen' or 'rejected'. Result: pair_id, part ('prompt', 'chosen' or
    'rejected'), position, role, rendered, start (offset in the part, in characters),
    trained (whether the turn is learnt), trained_from (offset in ``rendered`` from
    which on).
    """
    clean = turns.where(F.col("pair_id").isNotNull() & F.col("position").isNotNull()
                        & F.col("side").isin("chosen", "rejected")) \
        .select("pair_id", "side", F.col("position").cast("bigint").alias("position"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    at = Window.partitionBy("pair_id", "position")
    # Both sides of a position meet here; it has two rows unless positions repeat.
    both = clean.withColumn("turn", F.struct("role", "text")) \
        .withColumn("a", F.array_sort(F.collect_list(
            F.when(F.col("side") == "chosen", F.col("turn"))).over(at))) \
        .withColumn("b", F.array_sort(F.collect_list(
            F.when(F.col("side") == "rejected", F.col("turn"))).over(at))) \
        .withColumn("differ", F.col("a") != F.col("b")).drop("a", "b", "turn")
    split = both.groupBy(F.col("pair_id").alias("p")).agg(
        F.min(F.when(F.col("differ"), F.col("position"))).alias("split"))
    placed = both.join(split, F.col("pair_id") == F.col("p")).withColumn(
        "shared", F.col("split").isNull() | (F.col("position") < F.col("split"))) \
        .where(~F.col("shared") | (F.col("side") == "chosen")) \
        .withColumn("part", F.when(F.col("shared"), "prompt").otherwise(F.col("side"))) \
        .withColumn("rendered", rendered(F.col("role"), F.col("text"))) \
        .withColumn("block", F.floor(F.col("position") / BLOCK_TURNS))
    order = Window.partitionBy("pair_id", "part", "block").orderBy("position", "role", "text")
    inside = F.sum(F.length("rendered")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("rendered")
    blocks = placed.groupBy("pair_id", "part", "block").agg(
        F.sum(F.length("rendered")).alias("size")).select(
        F.col("pair_id").alias("p2"), F.col("part").alias("t2"), F.col("block").alias("b2"),
        (F.sum("size").over(Window.partitionBy("pair_id", "part").orderBy("block"))
         - F.col("size")).alias("base"))
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return placed.withColumn("inside", inside).join(
        blocks, (F.col("pair_id") == F.col("p2")) & (F.col("part") == F.col("t2"))
        & (F.col("block") == F.col("b2"))).select(
        "pair_id", "part", "position", "role", "rendered",
        (F.col("base") + F.col("inside")).alias("start"), trained.alias("trained"),
        F.when(trained, F.length(F.concat(F.lit(HEAD), "role", F.lit(BREAK)))).cast("bigint")
        .alias("trained_from"))


def assembled(parts: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, spans of trained characters of either completion).

    For pairs whose conversations fit in a row; the rows of ``parts`` have no such limit.
    """
    def text(part: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(
            F.col("part") == part, F.struct("start", "position", "rendered"))))
        return F.array_join(F.transform(mine, lambda x: x["rendered"]), "").alias(part)

    def spans(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when(
            (F.col("part") == part) & F.col("trained"),
            F.struct((F.col("start") + F.col("trained_from")).alias("first"),
                     (F.col("start") + F.length("rendered")).alias("end"))))) \
            .alias(f"{part}_trained")

    return parts.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"),
                                        spans("chosen"), spans("rejected"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, for ``format_preferences``.

    Chosen is the conversation itself. Rejected is the same one with its last reply
    of the assistant exchanged for its first, or without the reply if there is but one.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("position"),
                                 "role", "text")
    replies = turns.where("role = 'assistant'").groupBy(F.col("pair_id").alias("p")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"))
    first = turns.where("role = 'assistant'").join(
        replies, (F.col("pair_id") == F.col("p")) & (F.col("position") == F.col("first"))) \
        .groupBy("p").agg(F.min("text").alias("stale"))
    known = turns.join(replies.join(first, "p"), F.col("pair_id") == F.col("p"), "left")
    last = F.coalesce((F.col("position") == F.col("last")) & (F.col("role") == "assistant"),
                      F.lit(False))
    rejected = known.where(~last | (F.col("first") != F.col("last"))).select(
        "pair_id", F.lit("rejected").alias("side"), "position", "role",
        F.when(last, F.col("stale")).otherwise(F.col("text")).alias("text"))
    return turns.select("pair_id", F.lit("chosen").alias("side"), "position", "role", "text") \
        .unionByName(rejected)
