"""Chat formatting from every participant's perspective.

A conversation is rendered once for each of its participants: that one's turns become the assistant's
and are to be learnt, all others' turns those of users named after them, and are masked. A turn is

    <|im_start|>assistant\\n ... <|im_end|>\\n     or     <|im_start|>user name=NAME\\n ... <|im_end|>\\n

and what is to be learnt of an assistant's turn is its text with the closing mark.

The turns of a conversation are ranked by turn, role and the MD5 of their text, whatever their number,
and laid out in parts of ``PART`` ranks; a part is a row. Ranks come from a sort by ranges, so one
conversation, turn or repeated row may hold any share of all rows: no task holds more than its range.
A null role counts as ``unknown``, a null text as empty, a null turn comes first; rows
without a conversation are a conversation of their own, with a null id. Repeated rows are repeated
turns. Markers within a text have their bar doubled, so no text can end its turn; white space and
``>`` in a name become ``_``. An empty table gives no rows, other columns are no matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rideflow.session import stage
from rideflow.sources.ordered import sorted_rows

PART = 256
START, END = "<|im_start|>", "<|im_end|>\n"
# A generated row number holds the task above these bits, the row in the task in them.
ROW_BITS = 33


def turns(conversations: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The four columns, cleaned, with ``tie``, which orders turns of one number and role."""
    plain = conversations.select(*(F.col(old).alias(new) for new, old in columns.items()))
    clean = plain.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("who"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||")).alias("text"),
    )
    return clean.withColumn("tie", F.md5("text"))


def ranked(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their ``rank`` in the conversation and their ``part``; and turns by conversation.

    The rows are sorted by ranges and written; a range knows where in it a conversation begins and how
    many of its turns lie in earlier ranges.
    """
    row = F.monotonically_increasing_id()
    placed = sorted_rows(plain, ["conv_id", "turn", "who", "tie"]).select(
        "conv_id",
        "who",
        "text",
        F.shiftright(row, ROW_BITS).alias("range"),
        row.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"),
    )
    placed = stage(placed, "chat-turns")
    runs = placed.groupBy("conv_id", "range").agg(
        F.min("place").alias("first"), F.count("*").alias("n")
    )
    earlier = (
        Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = runs.select(
        F.col("conv_id").alias("__conv"),
        F.col("range").alias("__range"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("range") == F.col("__range"))
    rank = F.col("place") + F.col("shift")
    found = placed.join(starts, same).select("conv_id", "who", "text", rank.alias("rank"))
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    return found.withColumn("part", F.floor(F.col("rank") / PART)), sizes


def _rendered(perspective: Column) -> tuple[Column, Column]:
    """Opening of a turn and whether it is the assistant's."""
    mine = F.col("who") == perspective
    name = F.regexp_replace("who", r"[\s>]", "_")
    role = F.when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), role, F.lit("\n")), mine


def perspectives(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per conversation, participant and part: text, spans to be learnt, counts.

    ``text`` is the part's rendering, ``learn`` its character ranges that belong to the assistant;
    ``part`` counts the parts of a conversation from 0, and their texts in this order are the whole.
    """
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    plain = turns(conversations, names)
    placed, sizes = ranked(plain)
    people = plain.groupBy("conv_id", "who").agg(F.lit(1).alias("__one")).select(
        F.col("conv_id").alias("__conv"), F.col("who").alias("perspective")
    )
    # Every participant meets every part, a key of at most PART turns, not the whole conversation.
    last = F.floor((F.col("turns") - 1) / PART)
    wanted = sizes.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "__conv", "perspective", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__part")
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))
    opening, mine = _rendered(F.col("perspective"))
    lines = placed.join(wanted, same).select(
        "conv_id",
        "perspective",
        "part",
        F.struct("rank", "text", opening.alias("opening"), mine.alias("mine")).alias("line"),
    )
    key = ["conv_id", "perspective", "part"]
    parts = lines.groupBy(*key).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    size = lambda s: F.length(s["opening"]) + F.length(s["text"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["opening"])
        end = acc["at"] + size(s)
        span = F.array(F.struct(begin.alias("a"), end.alias("b")))
        return F.struct(
            end.alias("at"),
            F.when(s["mine"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    text = F.array_join(
        F.transform("lines", lambda s: F.concat(s["opening"], s["text"], F.lit(END))), ""
    )
    return parts.select(
        *key,
        text.alias("text"),
        F.aggregate("lines", start, step)["spans"].alias("learn"),
        F.size("lines").cast("bigint").alias("n_turns"),
        F.size(F.filter("lines", lambda s: s["mine"])).cast("bigint").alias("n_assistant"),
    )
