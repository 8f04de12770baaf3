"""Document fingerprints by SpotSigs, in DataFrame operations only.

Common words (articles, prepositions and the like) are anchors: each one makes
a signature with the chain of the next content words after it. Navigation,
tables and lists have few common words, so that the signatures stand for the
running text. A document's fingerprint is its set of signatures (64-bit
hashes); a text with words but without a whole chain has one signature, that
of all its words. The likeness of two documents is the Jaccard measure of
their sets.

For near duplicates the distinct sets are partitioned by their length, in
ranges so wide that a pair of the wanted likeness stands in one range or two
neighbouring ones. Inside of these, a set stands in the lists of its rarest
signatures, as many as every like set must share one of. In each list all
members are compared with one of them; those found alike are in its class
already, and only the others are compared with all members of the list. A
comparison passes by pairs whose lengths alone rule the likeness out.

Null and empty texts have the empty set; two empty sets have likeness 1, an
empty set and another one 0. Repeated rows stay and share a class. Classes
have the least id of their members (a null id only if there is no other). Any
further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.llm import order
from surveylab.llm.common import stored
from surveylab.llm.components import connected

# Common words of four languages (English, German, French, Spanish) that serve as anchors.
ANCHORS = tuple("""
    a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no
    not of on one or she so that the their there they this to up was we were what when which who will with would you
    als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist man mit
    nach nicht noch nur oder sich sie sind um und von vor war wie wird zu zum zur über
    au aux avec ce ces dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que
    qui sa se ses son sont sur un une vous à
    al como con del el ella ellos entre era esta este fue ha hay la las lo los más me muy o para pero por porque ser si
    sin sobre su sus también una y ya
""".split())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CHAIN = 2
#: Bytes of text in a part of the documents that are compared with their next ones.
PART_BYTES = 2 << 20


def with_signatures(df: DataFrame, text: str, name: str = "spots", chain: int = CHAIN,
                    anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Add ``name``: the sorted distinct signatures (64-bit) of each whole text."""
    common = ", ".join("'" + w.replace("'", "\\'") + "'" for w in sorted({*anchors}))
    words = F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    df = df.withColumn("__words", words)
    df = df.withColumn("__at", F.expr(f"filter(transform(__words, (w, i) -> if(w in ({common}), i, -1)), i -> i >= 0)"))
    df = df.withColumn("__content", F.expr(f"filter(__words, w -> w not in ({common}))"))
    # All anchors are common words: before the k-th one, at place p, stand p - k content words.
    chained = ", ".join(f"__content[p - k + {c}]" for c in range(chain))
    df = df.withColumn("__spots", F.expr(f"""filter(transform(__at, (p, k) ->
        if(p - k + {chain} <= size(__content), xxhash64(__words[p], {chained}), null)), s -> s is not null)"""))
    whole = F.when(F.size("__words") > 0, F.array(F.xxhash64("__words"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.when(F.size("__spots") > 0, F.sort_array(F.array_distinct("__spots"))).otherwise(
        whole)).drop("__words", "__at", "__content", "__spots")


def fingerprint(spots: Column | str) -> Column:
    """32 hex digits that name a set of signatures."""
    spots = F.col(spots) if isinstance(spots, str) else spots
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(i), spots)), 16, "0")) for i in (1, 2)])


def likeness(a: Column | str, b: Column | str, at_least: float = 0.0) -> Column:
    """Jaccard measure of two sets (arrays of distinct values); 0 for pairs whose lengths keep it below ``at_least``."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    shared = F.size(F.array_intersect(a, b))
    measure = shared / (F.size(a) + F.size(b) - shared)
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (F.when(longer == 0, 1.0).when((shorter == 0) | (shorter < at_least * longer), 0.0).otherwise(measure)
            .cast("double"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document beside its edited text and the next document, in descending order of ids (after the last: the
    first): doc_id, text, edited, spots, edited_spots, next_spots.

    In the edited text the last half of the code points (rounded down) is
    replaced by the first as many, or all, of the next document's. Rows that
    agree in id and text are one document, and each has its result.
    """
    dealt = with_signatures(order.beside_next(docs, doc_id, text, part_bytes).withColumn(
        "text", F.coalesce("text", F.lit(""))), "text")
    along = Window.partitionBy("part").orderBy(F.col("guest"), F.col("id").desc(), F.col("hash").desc())
    pairs = dealt.withColumn("next", F.lead(F.struct("text", "spots")).over(along)).where("not guest")
    half = F.expr("length(text) div 2").cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                                                 F.substring("next.text", F.lit(1), half)))
    found = with_signatures(edited, "edited", "edited_spots").select(
        "doc_id", "text", "edited", "spots", "edited_spots", F.col("next.spots").alias("next_spots"), "n_rows")
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("__n", "n_rows")


def _length_borders(longest: int, at_least: float) -> list[int]:
    """First lengths of the ranges: a pair of the wanted likeness stands in one range or two neighbouring ones."""
    borders = [1]
    while borders[-1] <= longest:
        borders.append(int(borders[-1] / at_least) + 1)
    return borders


def links(sets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b) between distinct sets (fp, spots): their components are those of all pairs of that likeness."""
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be over 0 and at most 1")
    own = stored(sets.where(F.size("spots") > 0).select("fp", "spots", F.size("spots").alias("n")), "sets")
    spots = own.select("fp", "n", F.explode("spots").alias("spot"))
    rare = spots.groupBy("spot").agg(F.count("*").alias("held")).where("held > 1")  # alone, it meets no other set
    borders = ", ".join(map(str, _length_borders(own.agg(F.max("n")).first()[0] or 0, at_least)))
    # A like set shares one of the first n - ceil(at_least * n) + 1 signatures of every order that both keep; those
    # that no other set has can only come first, and take up places.
    place = F.row_number().over(Window.partitionBy("fp").orderBy(F.coalesce("held", F.lit(1)), "spot"))
    first = spots.join(rare, "spot", "left").withColumn("place", place).where(
        (F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least) - 1e-9) + 1) & F.col("held").isNotNull())
    parts = F.expr(f"size(filter(array({borders}), b -> b <= n))")
    index = stored(first.select("fp", "spot", F.explode(F.array(parts, parts + 1)).alias("part")), "lists")
    leaders = index.groupBy("part", "spot").agg(F.min("fp").alias("leader"), F.count("*").alias("members")).where("members > 1")
    led = index.join(leaders, ["part", "spot"])

    def alike(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) of the wanted likeness; lengths are compared before the sets are fetched."""
        short = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = own.select(F.col("fp").alias("a"), F.col("spots").alias("a_spots"))
        right = own.select(F.col("fp").alias("b"), F.col("spots").alias("b_spots"))
        return short.join(left, "a").join(right, "b").where(
            likeness("a_spots", "b_spots", at_least) >= at_least - 1e-12).select("a", "b")

    to_leader = stored(alike(led.select(F.col("leader").alias("a"), F.col("fp").alias("b"))), "led")
    others = led.join(to_leader, (F.col("leader") == F.col("a")) & (F.col("fp") == F.col("b")), "left_anti").where(
        "fp <> leader").select("part", "spot", F.col("fp").alias("a"))
    rest = alike(others.join(index.withColumnRenamed("fp", "b"), ["part", "spot"]))
    return to_leader.unionByName(rest)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: float = 0.8) -> DataFrame:
    """(doc_id, fp, n_spots, class_id) for every row: documents are linked if their sets have that likeness, and
    class_id is the least id that links reach."""
    docs = stored(with_signatures(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select(
        "doc_id", fingerprint("spots").alias("fp"), "spots"), "spots")
    sets = docs.groupBy("fp").agg(F.min("spots").alias("spots"))
    roots = connected(links(sets, at_least))
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    named = stored(rooted.join(classes, "root").select("fp", "class_id"), "classes")
    return docs.join(named, "fp").select("doc_id", "fp", F.size("spots").cast("long").alias("n_spots"), "class_id")
