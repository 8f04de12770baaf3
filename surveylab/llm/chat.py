"""Chat formatting of logged conversations, in DataFrame operations only.

A log that saves a conversation after every turn holds each of its states. A
conversation whose turns are the first turns of a longer one is such a state
and is collapsed into it; of equal conversations the one with the least id
stays. Both are found by hashes: every turn gets the hash of all turns up to it
(a running exclusive or of hashes that include the position, twice with 64
bits), and conversations whose last hash is another one's earlier hash are
anti-joined away. Only then are the texts fetched and rendered.

Turns count in the order of ``turn`` (null first; ties by content); repeated
rows count once. Null roles and texts are values of their own in the
comparison, rendered as ``no_role`` and as empty text. Rows with a null
conversation id form one conversation. A conversation is one rendered row, and
has to fit into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveylab.llm.common import stored

#: Rendered form of a turn; the marker's beginning is broken up inside of texts.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
MARK, BROKEN = "<|", "< |"


def _hashed(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    said = [F.col(role).isNull(), F.coalesce(F.col(role).cast("string"), F.lit("")), F.col(text).isNull(),
            F.coalesce(F.col(text).cast("string"), F.lit(""))]
    return turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text"), F.xxhash64(F.lit(1), *said).alias("h1"),
                        F.xxhash64(F.lit(2), *said).alias("h2"))


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, pos, n_turns, p1, p2): for each turn its position and the hashes of all turns up to it."""
    own = _hashed(turns, conv_id, turn, role, text).select("conv_id", "turn", "h1", "h2").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    placed = own.withColumn("pos", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id", "pos", F.lead("pos").over(order).isNull().alias("last"),
        F.bit_xor(F.xxhash64("pos", "h1", "h2")).over(upto).alias("p1"),
        F.bit_xor(F.xxhash64("h2", "h1", "pos")).over(upto).alias("p2"))


def maximal(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no first part of another one."""
    states = stored(prefixes(turns, conv_id, turn, role, text), "states")
    whole = (states.where("last").groupBy(F.col("pos").alias("n_turns"), "p1", "p2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    # Distinct before the join: a first turn that a third of the conversations share is one row here.
    earlier = states.where("not last").select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(earlier, ["n_turns", "p1", "p2"], "left_anti").select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           begin: str = BEGIN, middle: str = MIDDLE, end: str = END, no_role: str = "unknown") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    kept = stored(maximal(turns, conv_id, turn, role, text), "maximal")
    said = _hashed(turns, conv_id, turn, role, text)
    named = kept.select(F.col("conv_id").alias("k"))
    own = said.join(named, said["conv_id"].eqNullSafe(named["k"]), "left_semi").distinct()
    piece = F.concat(F.lit(begin), F.coalesce(F.col("role").cast("string"), F.lit(no_role)), F.lit(middle),
                     F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(BROKEN)), F.lit(end))
    # Structs sort by their fields, null first, as the turns were placed.
    texts = own.groupBy(F.col("conv_id").alias("c")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", piece.alias("piece")))).alias("pieces"))
    return kept.join(texts, kept["conv_id"].eqNullSafe(texts["c"])).select(
        "conv_id", "n_turns", "n_copies", F.array_join("pieces.piece", "").alias("rendered"))
