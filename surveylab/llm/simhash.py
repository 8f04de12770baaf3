"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, one per bit of the shingles' XXH64 hashes: 1 if it
is set in over half of them. Fingerprints link when at most ``max_bits`` bits
differ; then at most that many of their eight bytes differ, so that a linked
pair shares at least ``8 - max_bits`` bytes at their positions. The index holds
the distinct fingerprints by the bytes at chosen positions: the positions form
``max_bits + 2`` groups, and a list for each two groups (a pair that shares
enough bytes shares two whole groups; lists of single bytes would hold every
256th fingerprint of the corpus). Pairs that meet in a list are tallied by the
number of positions with equal bytes, kept from the guaranteed number on, and
verified bit by bit.

Lists of over ``LONGEST_LIST`` fingerprints (near copies of one text) are not
paired up. Their members are put under every value at up to one changed bit:
two fingerprints differ in at most two bits exactly if they meet under such a
value, a value has 65 members at most, and the work is linear.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from surveylab.llm import common
from surveylab.llm.components import connected

SEED = 42
#: Longer posting lists take the linear way.
LONGEST_LIST = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no word."""
    tokens = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not tokens:
        return 0
    if len(tokens) <= words:
        grams, n = [b" ".join(tokens)], 1
    else:
        n = len(tokens) - words + 1
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", n)
    counts = np.zeros(64, "int64")
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at:at + _CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp", keep=None) -> DataFrame:
    """Append the fingerprint (signed 64-bit) of each whole text; null and empty texts have 0."""
    def task():
        return lambda col: [pa.array([fingerprint(t, shingle) for t in common.text_bytes(col)], pa.int64())]

    return common.map_columns(df, [text], [StructField(name, LongType())], task, keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """(part, key, fp): the index lists in which a fingerprint stands."""
    groups = np.array_split(np.arange(8), max_bits + 2)
    masks = [sum(255 << (8 * int(p)) for g in pair for p in g) for pair in combinations(groups, 2)]
    entries = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
               for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.part", "e.key", "fp")


def links(fps: DataFrame, max_bits: int = 2, longest_list: int = LONGEST_LIST) -> DataFrame:
    """(a, b) between distinct fingerprints: their components are those of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    index = postings(fps, max_bits)
    long = common.stored(index.groupBy("part", "key").count().where(F.col("count") > longest_list)
                         .select("part", "key"), "lists")
    lists = (index.join(long, ["part", "key"], "left_anti").groupBy("part", "key")
             .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    shared = " + ".join(f"int(((a ^ b) & {_signed(255 << 8 * p)}L) = 0)" for p in range(8))
    pairs = (lists.select(F.explode("fps").alias("a"), "fps")
             .select("a", F.explode(F.expr(
                 f"filter(fps, b -> b > a and {shared} >= {8 - max_bits} and bit_count(a ^ b) <= {max_bits})"
             )).alias("b")).distinct())
    crowded = index.join(long, ["part", "key"], "left_semi").select("fp").distinct()
    if max_bits < 2:
        # One bit apart: equal when that bit is cleared. A key has two members at most.
        values = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (1 << 64) - 1)))
                           .alias("value")) for i in range(64)] if max_bits else []
    else:
        values = [F.struct(F.lit(0).alias("bit"), F.col("fp").bitwiseXOR(F.lit(_signed(m))).alias("value"))
                  for m in [0, *(1 << i for i in range(64))]]
    if not values:
        return pairs
    near = (crowded.select("fp", F.explode(F.array(*values)).alias("e")).groupBy("e.bit", "e.value")
            .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b"))
    return pairs.unionByName(near)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row: component_id is the least id that links reach,
    root the least fingerprint of the component.

    Null and empty texts, and texts without a word, have fingerprint 0 and link
    like any other. Repeated rows stay and share a component. A null id is
    passed by when the least id is taken (null only if the component has no
    id). An empty table gives an empty result.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    docs = common.stored(fingerprints(texts, "text", shingle, keep=["doc_id", "text_hash"]), "fingerprints")
    fps = common.stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(fps.select("fp"), max_bits))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only fingerprints with links have another root, so that most groups here are single rows.
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.stored(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    return docs.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                max_bits: int = 2) -> DataFrame:
    """The rows of ``df`` with one document per component: the one with the least id (a null id comes last, and of
    texts with one id the least hash), and of repeated rows one."""
    classes = near_duplicates(df, doc_id, text, shingle, max_bits)
    first = (classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("k")))
    kept = common.stored(first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"),
                                      F.col("k.n").alias("__rows")), "kept")
    found = df.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")))
    once = found.where("__rows = 1").select(*[F.col(f"`{c}`") for c in df.columns])
    again = found.where("__rows > 1").dropDuplicates(["__id", "__hash"]).select(*[F.col(f"`{c}`") for c in df.columns])
    return once.unionByName(again)
