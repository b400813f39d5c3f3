"""Preference formatting of chosen and rejected conversations (any style; here DataFrame functions).

Turns are gathered by pair and block of BLOCK_TURNS turn numbers, so that many tasks share a long pair, and then by pair, which gives
both conversations in order. The longest common prefix of turns ends at the first turn number at which
their (turn number, role, text) differ. Its turns are rendered once as the prompt, later ones as
the two completions. A completion's mask lists its turns as ``length:flag`` in code
points, flag 1 where the turn is to be learnt (role assistant) and 0 where it is masked.

Rows: one for each pair, however long; its texts together must fit one Spark row (under 2 GB). Null texts render as empty, null roles
as ``unknown``; null turn numbers come first. A pair with one side missing has an empty prompt and one empty
completion; equal sides have empty completions. Turns that repeat a number are ordered by role
and text, and belong to the prompt only if all of that number agree; repeated rows are rendered as often as they occur. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 256
LEARNT = "assistant"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``turns`` has pair_id, chosen (boolean), turn, role and text. Returns pair_id, prompt, n_prompt_turns, chosen, chosen_mask, rejected, rejected_mask."""
    turn = F.coalesce("turn", F.lit(-1)).cast("bigint")
    own = turns.select(
        "pair_id", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.floor(turn / block_turns).alias("block"),
        F.struct(turn.alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"),
    )
    blocks = own.groupBy("pair_id", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), F.col("x")))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("x")))).alias("r")
    )
    whole = blocks.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("block", "c", "r"))).alias("b"))
    sides = whole.select("pair_id", F.flatten("b.c").alias("c"), F.flatten("b.r").alias("r"))
    apart = F.array_position(F.zip_with("c", "r", lambda x, y: ~x.eqNullSafe(y)), True)
    ends = F.when(apart > 0, F.least(F.get("c", (apart - 1).cast("int"))["turn"], F.get("r", (apart - 1).cast("int"))["turn"]))
    cut = sides.select("pair_id", "c", "r", ends.alias("ends"))

    def part(side: str, before: bool) -> Column:
        return F.filter(F.col(side), lambda e: F.coalesce(e["turn"] < F.col("ends"), F.lit(True)) == F.lit(before))

    def shown(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda e: render(e["role"], e["text"])), "")

    def mask(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda e: F.concat(F.length(render(e["role"], e["text"])).cast("string"), F.lit(":"), (e["role"] == LEARNT).cast("int").cast("string"))), ",")

    split = cut.select("pair_id", part("c", True).alias("p"), part("c", False).alias("c"), part("r", False).alias("r"))
    return split.select(
        "pair_id", shown(F.col("p")).alias("prompt"), F.size("p").cast("bigint").alias("n_prompt_turns"),
        shown(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), shown(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"),
    )


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    return conversations.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
