"""Positions of rows in a sorted order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.llm.common import stored

#: About so many rows are numbered by one task.
ROWS_A_PART = 1 << 17


def ranked(rows: DataFrame, group: str, order: list[Column], rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Add ``pos``, the 0-based position of each row in its group, and ``n``, the rows of the group.

    Rows are dealt by range of (group, order), so that a group of any size is
    cut into parts; each part is numbered by itself and shifted by the rows of
    the group in the parts before it. ``group`` must not be null. Rows that
    agree in group and order may be cut apart as well (by their place in the
    input) and stand next to each other in no certain order.
    """
    parts = max(1, -(-rows.count() // rows_a_part))
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    cut = stored(dealt.repartitionByRange(parts, F.col(group), *order, F.col("__row"))
                 .withColumn("__part", F.spark_partition_id()), "ranged")
    counts = cut.groupBy(group, "__part").agg(F.count("*").alias("__here"))  # groups and parts at most
    own = Window.partitionBy(group)
    shifts = counts.select(
        group, "__part", F.sum("__here").over(own).alias("n"),
        F.coalesce(F.sum("__here").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order, "__row"))
    return (cut.join(shifts, [group, "__part"]).withColumn("pos", F.col("__before") + number - 1)
            .drop("__part", "__row", "__before"))


#: Most parts into which rows are cut for finding their next rows; strides of the search among their borders.
MOST_PARTS = 1 << 18
_STRIDES = (1 << 12, 1 << 6, 1)
LEAST = -(1 << 63)


def borders(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The greatest key (id, hash) of each of about ``parts`` ranges of equally many keys, ascending."""
    dealt = keys.repartitionByRange(parts, "id", "hash")
    found = dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct("id", "hash")).alias("k")).select("k.*")
    return sorted((r[0], r[1]) for r in found.collect())  # a row for each part


def part_of(borders: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """SQL steps (column, expression) that find how many borders, the last one aside, are less than the key (id, hash):
    the last step is ``part``. A step looks at no more than 64 borders for a row."""
    ids, hashes = (f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)" for x in zip(*borders))
    last, below, steps = len(borders) - 2, "0", []
    for stride, wider in zip(_STRIDES, (MOST_PARTS, *_STRIDES)):
        name = "part" if stride == 1 else f"__below{stride}"
        first, end = f"{below} + {stride - 1}", f"least({below} + {wider - 2}, {last})"
        steps.append((name, f"""{below} + {stride} * if({first} > {end}, 0, size(filter(
            sequence({first}, greatest({end}, {first}), {stride}),
            j -> {ids}[j] < id or ({ids}[j] = id and {hashes}[j] < hash))))"""))
        below = name
    return steps


def beside_next(docs: DataFrame, doc_id: str, text: str, part_bytes: int) -> DataFrame:
    """(part, guest, id, hash, doc_id, text, n_rows): the documents dealt into parts of about ``part_bytes`` of text.

    Ascending ranges of (id, hash of the text) are the parts; every part also
    gets, as a guest, the greatest document of the part below, and the lowest
    part the greatest of all. Ordered by guest and then descending by (id,
    hash), each document that is no guest stands before the next one in
    descending order of ids, the last one before the first. The rows of a part
    are in one task. Null ids count as the least; rows that agree in id and text
    are one document with their number in ``n_rows``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("id"),
                       F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    keys = stored(rows.groupBy("id", "hash").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")),
                  "keys")
    size, repeated = keys.agg(F.sum("bytes"), F.max("n")).first()
    if repeated is not None and repeated > 1:
        # Counted before the shuffle: a document with many rows sends one a task.
        rows = rows.groupBy("id", "hash").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"),
                                              F.count("*").alias("n_rows"))
    else:
        rows = rows.withColumn("n_rows", F.lit(1).cast("long"))
    ends = borders(keys, min(MOST_PARTS, 1 + (size or 0) // part_bytes)) or [(LEAST, 0)]
    for name, step in part_of(ends):
        rows = rows.withColumn(name, F.expr(step))
    ids, hashes = (f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)" for x in zip(*ends))
    places = F.expr(f"""if(id = {ids}[part] and hash = {hashes}[part],
        array(struct(part, false as guest), struct((part + 1) % {len(ends)} as part, true as guest)),
        array(struct(part, false as guest)))""")
    dealt = rows.select("id", "hash", "doc_id", "text", "n_rows", F.explode(places).alias("at"))
    return dealt.select("at.part", "at.guest", "id", "hash", "doc_id", "text", "n_rows").repartition("part")
