"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
A window of ``size`` words holds the k-grams of its words (k: the greatest power
of two up to ``size``); its fingerprint is the least k-gram hash in it. Equal
windows have equal fingerprints, so that every span of ``size`` shared words is
found by joining the fingerprints of documents and items; the hit is then
extended to the whole window, which must agree as well. Items of fewer words
are one window of their own size, for which documents are fingerprinted too.

Hashes of k-grams are built by doubling (a 2-gram's from its words', a 4-gram's
from its 2-grams') and the least ones of a window alike, so that each word costs a few
steps at any size. A bit table of the items' fingerprints (bounded: at most
2^20 bits) passes by the windows that cannot match before rows are made; the
join itself is left to Spark, which broadcasts the items' table only if what
was written is small.

Null and empty texts have no words, and are neither contaminated nor do they
contaminate. Rows that agree in id and text are judged once and returned as
often as they stand in the table. Items with equal ids are one item; an item
without an id makes hits but is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveylab.llm.common import stored

# Fixed values of the word rule.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Most bits of the table that passes by windows without a match, and bits for each fingerprint below that.
MOST_BITS = 1 << 20
BITS_EACH = 32
#: Repeated rows are put out in runs of that many.
REPEATS = 1 << 16


def words(text: Column | str) -> Column:
    """The words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def _pairs(arr: str, step: int, both: str) -> Column:
    """``both`` of the elements x and y that stand ``step`` apart."""
    return F.expr(f"zip_with(slice({arr}, 1, greatest(size({arr}) - {step}, 0)), "
                  f"slice({arr}, {step + 1}, greatest(size({arr}) - {step}, 0)), (x, y) -> {both})")


def with_windows(df: DataFrame, sizes: list[int], text: str) -> DataFrame:
    """Add ``n_words`` and, for each size, the arrays ``fp_size`` and ``span_size`` by first word."""
    df = df.withColumn("h1", F.transform(words(text), lambda w: F.xxhash64(w))).withColumn(
        "n_words", F.size("h1").cast("long"))
    grams = 1
    for size in sorted(sizes):
        k = _power(size)
        while grams < k:
            df = df.withColumn(f"h{2 * grams}", _pairs(f"h{grams}", grams, "xxhash64(x, y)"))
            grams *= 2
        least, held = f"h{k}", 1  # of that many k-grams
        while 2 * held <= size - k + 1:
            df = df.withColumn(f"least{size}_{2 * held}", _pairs(least, held, "least(x, y)"))
            least, held = f"least{size}_{2 * held}", 2 * held
        rest = size - k + 1 - held
        df = df.withColumn(f"fp_{size}", _pairs(least, rest, "least(x, y)") if rest else F.col(least))
        df = df.withColumn(f"span_{size}", _pairs(f"h{k}", size - k, f"xxhash64({size}, x, y)"))
    return df


def item_windows(items: DataFrame, size: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(size, fp, span, item_id) of the windows of the items."""
    sized = stored(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"),
                                F.least(F.size(words(text)), F.lit(size)).alias("size")).where("size > 0"), "items")
    sizes = [r[0] for r in sized.select("size").distinct().collect()]  # at most ``size`` numbers
    parts = [with_windows(sized.where(F.col("size") == n), [n], "text").select(
        "size", "item_id", F.explode(F.arrays_zip(F.col(f"fp_{n}").alias("fp"), F.col(f"span_{n}").alias("span"))).alias("w"))
        .select("size", "w.fp", "w.span", "item_id") for n in sizes]
    if not parts:
        return sized.select("size", F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("span"), "item_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out.distinct(), "windows")


def _bit_table(fps: DataFrame) -> tuple[str, int]:
    """64-bit words, comma-joined, of a table with a bit for each fingerprint, and their number less one."""
    n = fps.distinct().count()
    bits = 1 << 10
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    last = bits // 64 - 1
    rows = fps.select(F.expr(f"int(shiftright(fp, 6) & {last})").alias("at"),
                      F.expr("shiftleft(1L, int(fp & 63))").alias("bit")).groupBy("at").agg(
        F.bit_or("bit")).collect()  # at most MOST_BITS / 64 rows
    table = [0] * (last + 1)
    for at, bit in rows:
        table[at] = bit
    return ",".join(map(str, table)), last


def hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, size, start, span, one): a row for every document, and one for each window of an
    item that occurs in it (size, start and span are null without one); ``one`` is 1 in one row of each document, else 0."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    table, last = _bit_table(windows.select("fp"))
    # The windows of documents whose fingerprint may be one of an item's.
    df = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    df = with_windows(df, sizes, "text") if sizes else df.withColumn("n_words", F.size(words("text")).cast("long"))
    bits = f"cast(split('{table}', ',') as array<bigint>)"
    found = []
    for n in sizes:
        may = (f"(shiftright(element_at({bits}, int(shiftright(fp_{n}[i], 6) & {last}) + 1), int(fp_{n}[i] & 63)) & 1)"
               " = 1")
        found.append(f"transform(filter(if(size(fp_{n}) > 0, sequence(0, size(fp_{n}) - 1), array()), i -> {may}), "
                     f"i -> named_struct('size', {n}, 'start', i, 'fp', fp_{n}[i], 'span', span_{n}[i]))")
    entry = "array<struct<size:int,start:int,fp:bigint,span:bigint>>"
    entries = F.expr(f"cast(concat({', '.join(found)}) as {entry})" if found else f"cast(array() as {entry})")
    rows = df.select("doc_id", "text_hash", "n_words", F.posexplode_outer(entries).alias("at", "e")).select(
        "doc_id", "text_hash", "n_words", "e.*", F.expr("if(coalesce(at, 0) = 0, 1, 0)").alias("one"))
    items = windows.select(F.col("size").alias("i_size"), F.col("fp").alias("i_fp"),
                           F.col("span").alias("i_span")).distinct()
    joined = rows.join(items, (F.col("fp") == F.col("i_fp")) & (F.col("span") == F.col("i_span"))
                       & (F.col("size") == F.col("i_size")), "left")
    hit = F.col("i_span").isNotNull()
    return joined.select("doc_id", "text_hash", "n_words", F.when(hit, F.col("size")).alias("size"),
                         F.when(hit, F.col("start")).alias("start"), F.when(hit, F.col("span")).alias("span"), "one")


_COVERED = """aggregate(array_sort(collect_set(if(start is null, null, struct(start, start + size as upto)))),
    struct(0L as n, 0L as upto),
    (a, x) -> struct(a.n + greatest(x.upto - greatest(x.start, a.upto), 0L) as n, greatest(a.upto, bigint(x.upto)) as upto),
    a -> a.n)"""


def judged(docs: DataFrame, items: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text",
           item_text: str = "text", item_id: str = "item_id", percent: int = 5) -> DataFrame:
    """Per distinct id and text: doc_id, text_hash, n_words, n_hit (words inside occurring windows), items (their ids as
    sorted strings), ``contaminated`` (hit, and at least ``percent`` of the words are) and n_copies (rows of it)."""
    windows = item_windows(items, size, item_text, item_id)
    found = stored(hits(docs, windows, doc_id, text), "hits")
    key = ["doc_id", "text_hash"]
    counts = found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.expr(_COVERED).alias("n_hit"),
                                     F.sum("one").alias("n_copies"))
    owners = windows.select("size", "span", F.col("item_id").cast("string").alias("item_id")).where(
        "item_id is not null")
    items_of = (found.where("span is not null").select(*key, "size", "span").distinct()
                .join(owners, ["size", "span"]).groupBy(*key)
                .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return (counts.alias("c").join(items_of.alias("o"), F.col("c.doc_id").eqNullSafe(F.col("o.doc_id"))
                                   & (F.col("c.text_hash") == F.col("o.text_hash")), "left")
            .select("c.doc_id", "c.text_hash", "n_words", "n_hit",
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
                    "n_copies"))


def contamination(docs: DataFrame, items: DataFrame, *args, **settings) -> DataFrame:
    """The columns of ``judged`` but n_copies, a row for each row of ``docs``."""
    rows = judged(docs, items, *args, **settings)
    runs = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (n_copies - 1) div {REPEATS})")))
    each = F.expr(f"array_repeat(0, int(least({REPEATS}, n_copies - {REPEATS} * run)))")
    return runs.withColumn("copy", F.explode(each)).drop("run", "copy", "n_copies")


def clean_rows(docs: DataFrame, items: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text",
               **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they are."""
    bad = stored(judged(docs, items, size, doc_id, text, **settings).where("contaminated")
                 .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "contaminated")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")),
                     "left_anti")
