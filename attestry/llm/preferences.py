"""Preference formatting: chosen and rejected conversations become a shared prompt and two masked completions.

Both sides are compared turn by turn. The longest common prefix of turns is rendered once, as the prompt; what follows on
either side is that side's completion. A completion comes with a loss mask: spans, in characters of the completion, of what
an assistant says (its text and end mark, not its header). Where the sides are equal throughout, the completions are empty.

Every turn is rendered alone, as ``<|role|>\\n text <|end|>\\n``. The first turn that differs is a minimum per pair, which is
pre-aggregated. Then turns are put together by pair, one output row a pair. Only a pair of over ``block_turns`` turns has a row for each block of so many
turn numbers: no row, task or sort holds more of a conversation, however long it is. Blocks of a pair, in order, concatenate to the whole; spans count
from the start of their block. What is known of a pair is broadcast to its turns where these are over a thousandth of all.

Defined results: of repeated rows, one counts. Different rows with one turn number are taken in the order of role and text. A null
turn number comes first, as -1; a null role is empty, a null text is empty. Rows without a pair id are no part of any pair. A pair that
has one side only has an empty prompt and an empty other completion. Empty tables: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import common

ASSISTANT = "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit("<|end|>\n"))


def _turns(said: DataFrame) -> DataFrame:
    """said: pair_id, turn, role, text, side (c or r). pair_id, turn, and the sorted distinct messages of either side at that turn, in one grouping."""
    clean = said.where(F.col("pair_id").isNotNull()).select("pair_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"), "side")
    of = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("m")))).alias(side)
    return clean.groupBy("pair_id", "turn").agg(of("c"), of("r"))


def _joined(turns: Column) -> Column:
    """The rendering of (turn, messages), sorted by turn."""
    return F.array_join(F.transform(F.flatten(F.transform(turns, lambda t: t["said"])), lambda m: render(m["role"], m["text"])), "")


def _spans(turns: Column) -> Column:
    """Start and end, in the rendering, of what assistants say."""
    said = F.flatten(F.transform(turns, lambda t: t["said"]))
    none = F.array().cast("array<struct<start:long,end:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(done: Column, m: Column) -> Column:
        end = done["at"] + F.length(render(m["role"], m["text"]))
        mark = F.struct((done["at"] + F.length(header(m["role"]))).cast("long").alias("start"), (end - 1).cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(m["role"] == ASSISTANT, F.concat(done["spans"], F.array(mark))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(said, start, step, lambda done: done["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, block_turns: int = 512) -> DataFrame:
    """chosen, rejected: pair_id, turn, role, text. Returns pair_id, block, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns."""
    side = lambda df, name: df.select("pair_id", "turn", "role", "text", F.lit(name).alias("side"))
    return format_sides(side(chosen, "c").unionByName(side(rejected, "r")), block_turns)


def format_sides(said: DataFrame, block_turns: int = 512) -> DataFrame:
    """said: pair_id, turn, role, text, side (c or r): both sides of all pairs in one table. Returns as format_pairs."""
    both = common.stage(_turns(said).withColumn("differs", F.col("c") != F.col("r")))
    split = both.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("split"), F.count("*").alias("n"))
    marked = common.attach(both, common.stage(split), "pair_id", "n", both.count()).withColumn("shared", F.coalesce(F.col("turn") < F.col("split"), F.lit(True)))
    block = F.when(F.col("n") <= block_turns, 0).otherwise(F.floor(F.greatest("turn", F.lit(0)) / block_turns)).cast("long")
    each = lambda when, side: F.sort_array(F.collect_list(F.when(when & (F.size(side) > 0), F.struct("turn", F.col(side).alias("said")))))
    parts = marked.withColumn("block", block).groupBy("pair_id", "block").agg(each(F.col("shared"), "c").alias("p"), each(~F.col("shared"), "c").alias("c"), each(~F.col("shared"), "r").alias("r"))
    return parts.select(
        "pair_id",
        "block",
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"),
        _joined(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_mask"),
        _spans(F.col("r")).alias("rejected_mask"),
        F.size("p").cast("long").alias("prompt_turns"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations (conv_id, turn, role, text), as format_sides takes them: chosen is a conversation as it is; rejected is the
    same with its last assistant turn answered as the partner conversation (conv_id with the lowest bit flipped) ends. Without a partner that has
    an assistant turn, or without one of its own, a conversation makes no pair."""
    talk = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("pair_id"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    answer_at = F.when(F.col("role") == ASSISTANT, F.struct("turn", "text"))
    answers = common.stage(talk.groupBy("pair_id").agg(F.max(answer_at).alias("a"), F.count("*").alias("n")).where("a IS NOT NULL"))
    partner = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("a.text").alias("other"))
    last = common.stage(answers.join(partner, "pair_id").select("pair_id", "n", F.col("a.turn").alias("last"), "other"))
    paired = common.attach(talk, last, "pair_id", "n", talk.count()).where("last IS NOT NULL")
    answer = (F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT)
    sides = F.array(F.struct(F.lit("c").alias("side"), F.col("text").alias("text")), F.struct(F.lit("r").alias("side"), F.when(answer, F.col("other")).otherwise(F.col("text")).alias("text")))
    return paired.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "turn", "role", "s.text", "s.side")
