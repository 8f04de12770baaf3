"""Token ids in a word-aligned binary format (Simple-8b): encode texts, write the ids in document order, read them.

A chunk holds the ids of some consecutive documents::

    magic  n_ids  block_size  n_blocks  offset[n_blocks + 1]  word[...]

Each 64-bit word has a selector in its upper 4 bits that tells how many ids of
which width the lower 60 bits hold. An id of more than 60 bits is an escape
word followed by the id itself. Ids are packed in blocks, whose word offsets
stand in the header, so that blocks can be decoded by themselves; decoding
handles all words of a selector at once.

Chunks are rows of Parquet files (so that writing survives lost executors and
any store that Spark writes to will do): ``shard`` and ``first`` tell a chunk's
place in the order of ascending document ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField, StructType)

from surveylab.llm import common, order

# Fixed values of the coding: ids in a word by selector, and bits of each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 512
CHUNK_IDS = 1 << 16
#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
_MAGIC = np.uint64(int.from_bytes(b"S8BLOCK1", "little"))
_LOW = np.uint64((1 << 60) - 1)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (1 for 0)."""
    top = np.frexp(ids.astype(np.float64))[1]  # rounding may only give one bit too many for ids over 2^53
    over = ids > np.uint64(1 << 53)
    if over.any():
        top[over] = [int(x).bit_length() for x in ids[over].tolist()]
    return np.maximum(top, 1)


def _reach(widths: np.ndarray) -> np.ndarray:
    """For each place, how many ids a word that begins there holds (0: escape), within its block."""
    n = len(widths)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    best = np.zeros(n, "int64")
    most: dict[int, np.ndarray] = {1: widths}

    def widest(k: int) -> np.ndarray:
        """Greatest width of the k ids from each place on."""
        if k not in most:
            half = k // 2
            a, b = widest(half), widest(k - half)
            out = a.copy()
            out[:max(n - half, 0)] = np.maximum(a[:max(n - half, 0)], b[half:])
            most[k] = out
        return most[k]

    for k in reversed(COUNTS):
        fits = (widest(k) <= 60 // k) & (left >= k)
        best[fits] = k
    return best


def encode(ids: np.ndarray) -> bytes:
    """The chunk of a list of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, "<u8")
    n = len(ids)
    blocks = -(-n // BLOCK)
    reach = _reach(_widths(ids)) if n else np.zeros(0, "int64")
    step, starts, at = np.maximum(reach, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    begin = np.array(starts, "int64")
    held = reach[begin] if n else begin
    place = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(held == 0)[:-1]]).astype("int64") if n else begin
    words = np.zeros(len(begin) + int((held == 0).sum()), "<u8")
    for selector, k in enumerate(COUNTS):
        mine = np.flatnonzero(held == k)
        if not len(mine):
            continue
        value = np.full(len(mine), np.uint64(selector) << np.uint64(60))
        for i in range(k):
            value |= ids[begin[mine] + i] << np.uint64(i * (60 // k))
        words[place[mine]] = value
    out = np.flatnonzero(held == 0)
    words[place[out]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[out] + 1] = ids[begin[out]]
    first = np.flatnonzero(begin % BLOCK == 0)
    offsets = np.concatenate([place[first], [len(words)]]).astype("<u8")
    return np.concatenate([np.array([_MAGIC, n, BLOCK, blocks], "<u8"), offsets, words]).tobytes()


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive words."""
    selector = (words >> np.uint64(60)).astype("int64")
    if (selector == ESCAPE).any():  # the word after an escape is an id, whatever its upper bits are
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
        selector[raw] = len(COUNTS)
        count = np.array([*COUNTS, 1, 0])[selector]
    else:
        raw, count = None, np.array([*COUNTS, 0, 0])[selector]
    start = np.cumsum(count) - count
    ids = np.zeros(n, "<u8")
    for s, k in enumerate(COUNTS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            part, mask = words[mine], np.uint64((1 << (60 // k)) - 1)
            for i in range(k):
                ids[start[mine] + i] = (part >> np.uint64(i * (60 // k))) & mask
    if raw is not None:
        ids[start[raw]] = words[raw]
    return ids


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk."""
    data = np.frombuffer(chunk, "<u8")
    if len(data) < 5 or data[0] != _MAGIC:
        raise ValueError("not a chunk of ids")
    n, blocks = int(data[1]), int(data[3])
    return _unpack(data[5 + blocks:], n)


def decode_block(chunk: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    data = np.frombuffer(chunk, "<u8")
    n, size, blocks = (int(x) for x in data[1:4])
    words = data[5 + blocks:]
    a, b = int(data[4 + block]), int(data[5 + block])
    return _unpack(words[a:b], min(size, n - block * size))


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printable, else the next
    free character from U+0100 on (the public rule of byte-level BPE)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Ends a pre-token for the ranked merges; texts that hold it are left to the library.
STOP = "\x01"


def word_ranks(data: bytes) -> tuple[dict[bytes, int], list[int]] | None:
    """(rank of each piece as bytes, id of each rank) of a vocabulary with end-of-word pieces, or None if merging by
    ranks could differ from merging by its list.

    The end of word is a byte of its own that joins its neighbour before any
    other merge. Ranks merge any two neighbours that make up a piece, the list
    only certain ones. The two are the same if the list's merges, run on each
    piece by itself, lead to that piece: two neighbours that span a piece have
    come about in that span alone, and the last two there are those of the list.
    """
    rules = json.loads(data)
    end, vocab = rules["model"].get("end_of_word_suffix"), rules["model"]["vocab"]
    chars = byte_of_char()
    if not end:
        return None

    def raw(piece: str) -> bytes:
        last = piece.endswith(end)
        return bytes(chars[c] for c in (piece[:-len(end)] if last else piece)) + STOP.encode() * last

    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in rules["model"]["merges"]]
    place = {m: k for k, m in enumerate(merges)}
    for a, b in merges:
        whole = a + b
        symbols = [*(whole[:-len(end)] if whole.endswith(end) else whole)]
        if whole.endswith(end):
            symbols[-1] += end
        while len(symbols) > 1:
            k, at = min((place.get(p, len(merges)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if k == len(merges):
                return None
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
    first = [c for c, _ in sorted(chars.items(), key=lambda x: x[1])]
    pieces = [*first, *(c + end for c in first), *(a + b for a, b in merges)]
    ranks = {raw(p): k for k, p in enumerate(pieces)}
    return (ranks, [vocab[p] for p in pieces]) if len(ranks) == len(pieces) else None


class Tokens:
    """Ids of texts as the tokenizers library gives them.

    Only for vocabularies whose pre-tokenizer drops white space (checked): ids
    of a text are then those of its pieces between ASCII white space, one after
    the other. If the vocabulary cuts lower-cased text by PATTERN, texts of
    plain Latin letters are cut here in the same way and their pre-tokens
    merged by ``ranks`` (:func:`word_ranks`); all other texts are cut at white
    space and left to the library, the ids of such pieces kept in a bounded table.
    """

    #: Bytes of kept pieces after which those not seen since the last time are forgotten.
    KEPT_BYTES = 24 << 20
    #: How the vocabulary's own rules cut normalised text, as its file states it.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # ASCII but for STOP, and the letters U+00C0 to U+017F: composed, and lower-cased one by one (but for U+0130).
    _OTHER = re.compile("[^\x00\x02-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
    # Runs of letters come first: no other alternative begins with a letter.
    _CUT = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|"
                      "[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u017f]+")

    def __init__(self, data: bytes, ranks: tuple[dict[bytes, int], list[int]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        probe = [self._ids([t])[0] for t in ("one two", "one  \n\ttwo", "one", "two")]
        if probe[0] != probe[1] or probe[0] != probe[2] + probe[3]:
            raise ValueError("this vocabulary keeps white space")
        self.special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(data)
        normal = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        cuts = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.ranked = None
        if ranks and normal == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [self.PATTERN]:
            self.ranked = tiktoken.Encoding("words", pat_str=rf"[^{STOP}]+{STOP}", mergeable_ranks=ranks[0], special_tokens={})
            self.id_of_rank = np.array(ranks[1], "<u4")
        self.known = _Kept(self.KEPT_BYTES)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list = [None] * len(texts)
        rest: dict[int, list[bytes]] = {}
        for i, raw in enumerate(texts):
            text = raw.decode()
            if self.ranked and not self._OTHER.search(text) and not any(s in text for s in self.special):
                parts = self._CUT.findall(text.lower())
                out[i] = (self.id_of_rank[self.ranked.encode_ordinary(STOP.join(parts) + STOP)].tobytes() if parts else b"")
            else:
                rest[i] = raw.split()
        new = self.known.missing(set().union(*rest.values()))
        for p, ids in zip(new, self._ids([p.decode() for p in new]) if new else ()):
            self.known.add(p, np.array(ids, "<u4").tobytes())
        known = self.known.young
        for i, parts in rest.items():
            out[i] = b"".join(map(known.__getitem__, parts))
        return out


class _Kept:
    """A table in two generations: when the young one has grown to ``most`` bytes it becomes the old one, and what is
    looked up from there on comes back into a new young one."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most, self.bytes = most, 0

    def add(self, key, value: bytes) -> None:
        self.young[key] = value
        self.bytes += 180 + len(key) + len(value)

    def missing(self, keys: set) -> list:
        """The keys that are not kept; the others are in ``young`` from now on."""
        if self.bytes > self.most:
            self.young, self.old, self.bytes = {}, self.young, 0
        new = keys.difference(self.young)
        again = new.intersection(self.old)
        for k in again:
            self.add(k, self.old[k])
        return [*(new - again)]


def token_ids(df: DataFrame, vocabulary_path: str, end_id: int | None = None, text: str = "text", ids: str = "ids",
              keep=None, width: int = 4) -> DataFrame:
    """Append the ids of each whole text as little-endian bytes, ``width`` (4 or 2) for each id, followed by ``end_id``
    if given. An id that does not fit raises."""
    data = common.vocabulary_bytes(vocabulary_path)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def narrow(raw: bytes) -> bytes:
        if width == 4:
            return raw
        flat = np.frombuffer(raw, "<u4")
        if len(flat) and flat.max() >= 1 << 16:
            raise ValueError("id too large for two bytes")
        return flat.astype("<u2").tobytes()

    ranks = word_ranks(data)

    def task():
        tokens = common.cached_in_task(("tokens", hash(data)), lambda: Tokens(data, ranks))
        return lambda col: [pa.array([narrow(x + end) for x in tokens.encode(common.text_bytes(col))], pa.binary())]

    return common.map_columns(df, [text], [StructField(ids, BinaryType())], task, keep)


_CHUNK = StructType([
    StructField("shard", IntegerType()), StructField("first", LongType()), StructField("n_ids", LongType()),
    StructField("doc_ids", ArrayType(LongType())), StructField("sizes", ArrayType(IntegerType())),
    StructField("payload", BinaryType())])


def _chunks(batches, width: int):
    """Chunks of the sorted rows (shard, doc_id, ids) of a partition."""
    shard, first, docs, held, total = None, 0, [], [], 0

    def flush():
        ids = np.frombuffer(b"".join(held), f"<u{width}").astype("<u8")
        row = {"shard": [shard], "first": [first], "n_ids": [total], "doc_ids": [docs],
               "sizes": [[len(h) // width for h in held]], "payload": [encode(ids)]}
        return pa.RecordBatch.from_arrays(
            [pa.array(row[f.name], t) for f, t in zip(_CHUNK.fields, (
                pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))],
            names=_CHUNK.names)

    for batch in batches:
        for s, d, x in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (s != shard or total + len(x) // width > CHUNK_IDS):
                yield flush()
                first, docs, held, total = first + total, [], [], 0
            if s != shard:
                shard, first = s, 0
            docs.append(d)
            held.append(x)
            total += len(x) // width
    if held:
        yield flush()


def with_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with the columns ``shard`` and ``place``, and the number of shards: ranges of ascending ids with about
    ``shard_bytes`` of text each.

    Taken before the texts are encoded: a sort by range would encode all texts
    a second time for its sample. Rows of an id are ordered by ``place`` (a hash
    of the text, with ten random bits), so that an id, and even a repeated row,
    that holds many rows is cut into several shards.
    """
    salted = F.xxhash64(text).bitwiseAND(F.lit(~1023)).bitwiseOR(F.floor(F.rand(7) * 1024).cast("long"))
    keyed = docs.withColumns({"id": F.coalesce(F.col(doc_id).cast("long"), F.lit(order.LEAST)), "hash": salted})
    keys = common.stored(keyed.select("id", "hash", F.octet_length(text).alias("bytes")), "keys")
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    ends = order.borders(keys, min(order.MOST_PARTS, 1 + size // shard_bytes)) or [(order.LEAST, 0)]
    for name, step in order.part_of(ends):
        keyed = keyed.withColumn(name, F.expr(step))
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "place", "id", "hash", "part")]
    return keyed.select(*kept, F.col("part").cast("int").alias("shard"), F.col("hash").alias("place")), len(ends)


def write(df: DataFrame, path: str, shards: int, doc_id: str = "doc_id", ids: str = "ids", width: int = 4) -> None:
    """Write rows (shard, place, doc_id, ids of ``width`` bytes each) in ascending order of doc_id; null ids come first.
    ``shard`` and ``place`` are those of :func:`with_shards`, of which there are ``shards``."""
    placed = df.select("shard", F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"), "place")
    (placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "place")
     .select("shard", "doc_id", "ids").mapInArrow(lambda batches: _chunks(batches, width), _CHUNK)
     .write.option("compression", "none").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: start counts the ids of all documents before it."""
    chunks = spark.read.schema(_CHUNK).parquet(path)
    totals = chunks.groupBy(F.col("shard").alias("s")).agg(F.sum("n_ids").alias("n"))  # a row for each shard
    bases = totals.select("s", (F.sum("n").over(Window.orderBy("s")) - F.col("n")).alias("base"))

    def rows(batches):
        for batch in batches:
            for first, base, docs, sizes, payload in zip(*(c.to_pylist() for c in batch.columns)):
                flat = decode(payload).astype("<u4")
                ends = np.cumsum([0, *sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ends[:-1] + (first + base), pa.int64()),
                     pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                    names=["doc_id", "start", "ids"])

    schema = StructType([StructField("doc_id", LongType()), StructField("start", LongType()),
                         StructField("ids", BinaryType())])
    # A row for each shard: small beside the chunks, whose payload would else be shuffled.
    return (chunks.join(F.broadcast(bases), F.col("shard") == F.col("s")).select("first", "base", "doc_ids", "sizes", "payload")
            .mapInArrow(rows, schema))
