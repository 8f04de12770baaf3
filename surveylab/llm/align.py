"""Alignment of two tokenizers' tokens over a corpus, with exact-text deduplication.

A text with a space before it is tokenised twice: by a byte-level BPE (A) and
by a SentencePiece model (B). Tokens are byte ranges; where both end, the text
is cut into groups, and every A and B token whose ranges overlap are linked.
A pair of ids counts as often as its links occur in the whole corpus.

Rows are shuffled by their full text and every distinct text is tokenised and
aligned once. Chunks of aligned texts are stored: for each text its measures
and the ids of its linked pairs with their numbers, for the chunk each pair
with its links weighted by the texts' multiplicity. Pair counts are sums over
chunks, the pairs of each chunk look their corpus counts up (one row for a
pair and chunk), and the measures go to all rows of a text by its SHA-256.

Within a task the tokens of some texts are aligned at once, by marks at the
bytes where tokens end.

Null and empty texts have no tokens. Nor has a text whose tokens, joined, give
other bytes than a space and the text (for example one with U+2581). Repeated
rows are rows of one text. Any further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from surveylab.llm import common
from surveylab.llm.simple8b import byte_of_char

MARK = "▁"
#: Distinct pairs of texts in one stored chunk (a single text may have more).
CHUNK_PAIRS = 1 << 19
# Fixed value: how byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_RUN = 4096
_LONG_RUN = re.compile(rf"[^ ]{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}")


class Aligner:
    """Tokenises texts by both vocabularies and aligns the tokens of a batch at once."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        chars = byte_of_char()
        names = {p: i for p, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = {i: bytes(chars[c] for c in p) for p, i in names.items()}
        self.n_a, self.n_b = max(a_bytes) + 1, self.b.get_piece_size()
        if self.n_a * self.n_b > 1 << 31:
            raise ValueError("pairs of these vocabularies do not fit into 31 bits")
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                   for i, p in enumerate(pieces)]
        self.a_bytes = pa.array([a_bytes.get(i, b"") for i in range(self.n_a)], pa.binary())
        self.b_bytes = pa.array(b_bytes, pa.binary())
        # Decimal ids with what follows them: within a group, and at the end of its A or B ids.
        self.a_text = pa.array([f"{i}{c}" for i in range(self.n_a) for c in ",|"])
        self.b_text = pa.array([f"{i}{c}" for i in range(self.n_b) for c in ",;"])
        self.texts = pa.concat_arrays([self.a_text, self.b_text])
        rules = json.loads(a)
        merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        ranks = {v: i for i, v in a_bytes.items()}
        # If merges come in the order of the ids they make, another library does the same work by ranks, faster.
        ranked = (rules["pre_tokenizer"].get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex", True)
                  and not rules["pre_tokenizer"].get("add_prefix_space") and rules.get("normalizer") is None
                  and len(ranks) == len(a_bytes) and [names.get(x + y) for x, y in merges] == sorted(
                      i for i, v in a_bytes.items() if len(v) > 1))
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of the texts with a space before them, and B's ids (B puts the space there itself)."""
        spaced = [" " + t for t in texts]
        a: list = [None] * len(texts)
        slow = []
        for k, t in enumerate(spaced):
            # A long run without a space would go beyond the stack of the faster library's pattern search.
            if self.fast is None or len(t) > LONGEST_RUN and _LONG_RUN.search(t):
                slow.append(k)
            else:
                a[k] = self.fast.encode_ordinary(t)
        for k, e in zip(slow, self.a.encode_batch_fast([spaced[k] for k in slow], add_special_tokens=False)):
            a[k] = e.ids
        return a, self.b.encode(texts, num_threads=1)

    @staticmethod
    def _joined(table: pa.Array, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(flat ids, number of each list, joined bytes of each list)."""
        sizes = np.fromiter(map(len, lists), "i8", len(lists))
        flat = np.fromiter(chain.from_iterable(lists), "i4", int(sizes.sum()))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        parts = pa.ListArray.from_arrays(offsets, table.take(pa.array(flat)))
        return flat, sizes, pc.binary_join(parts, b"").to_pylist()

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each text (n_a, n_b, n_groups, pair codes of all links in order, SHA-256 of the groups); None without tokens."""
        at = [k for k, t in enumerate(texts) if t]
        out: list[tuple | None] = [None] * len(texts)
        if not at:
            return out
        a, b = self._ids([texts[k] for k in at])
        raw = [b" " + texts[k].encode() for k in at]
        a_made, b_made = self._joined(self.a_bytes, a), self._joined(self.b_bytes, b)
        good = [x == y == z for x, y, z in zip(raw, a_made[2], b_made[2])]
        if not all(good):
            at, a, b, raw = ([x for x, g in zip(xs, good) if g] for xs in (at, a, b, raw))
            if not at:
                return out
            a_made, b_made = self._joined(self.a_bytes, a), self._joined(self.b_bytes, b)
        (a_ids, n_a, _), (b_ids, n_b, _) = a_made, b_made
        a_ends, b_ends = (np.cumsum(np.asarray(pc.binary_length(t.take(pa.array(i))), "i8")) - 1
                          for t, i in ((self.a_bytes, a_ids), (self.b_bytes, b_ids)))
        size = int(a_ends[-1]) + 1
        ends = np.cumsum([len(r) for r in raw]) - 1  # last byte of each text
        is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
        is_a[a_ends] = is_b[b_ends] = True
        # Every place where a token ends closes one link: that of the two tokens over this byte.
        either, both = np.flatnonzero(is_a | is_b), np.flatnonzero(is_a & is_b)
        codes = (a_ids[np.searchsorted(a_ends, either)] * np.int32(self.n_b) + b_ids[np.searchsorted(b_ends, either)])
        n_links = np.diff(np.searchsorted(either, ends, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        # The ids in the order of the groups, each group's A ids before its B ids.
        a_upto = np.searchsorted(a_ends, both, "right")
        b_before = np.concatenate([[0], np.searchsorted(b_ends, both, "right")[:-1]])
        order = np.empty(len(a_ids) + len(b_ids), "i4")
        order[np.arange(len(a_ids)) + b_before[np.searchsorted(both, a_ends)]] = 2 * a_ids + is_b[a_ends]
        order[np.arange(len(b_ids)) + a_upto[np.searchsorted(both, b_ends)]] = 2 * (self.n_a + b_ids) + is_a[b_ends]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_a + n_b)]), pa.int32())
        groups = pc.binary_join(pa.ListArray.from_arrays(offsets, self.texts.take(pa.array(order))), "").to_pylist()
        cuts = np.cumsum(n_links)
        for k, i in enumerate(at):
            out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), codes[cuts[k] - n_links[k]:cuts[k]],
                      hashlib.sha256(groups[k][:-1].encode()).hexdigest())
        return out


_CHUNK = StructType([
    StructField("keys", ArrayType(BinaryType())), StructField("n_a", ArrayType(LongType())),
    StructField("n_b", ArrayType(LongType())), StructField("n_groups", ArrayType(LongType())),
    StructField("groups", ArrayType(StringType())), StructField("ends", ArrayType(IntegerType())),
    StructField("codes", ArrayType(IntegerType())), StructField("links", ArrayType(IntegerType())),
    StructField("pairs", ArrayType(IntegerType())), StructField("weights", ArrayType(LongType()))])
_ARROW = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 4,
          pa.list_(pa.int64())]


def _chunks(batches, build, most: int):
    """Chunks of the aligned texts (text, n): texts without tokens are left out."""
    aligner = build()
    rows, sizes, held = [], [], 0

    def flush():
        codes = np.concatenate([r[5] for r in rows])
        links = np.concatenate([r[6] for r in rows])
        times = np.repeat([r[7] for r in rows], sizes).astype("i8")
        pairs, place = np.unique(codes, return_inverse=True)
        weights = np.zeros(len(pairs), "i8")
        np.add.at(weights, place, links * times)
        columns = [[r[k] for r in rows] for k in range(5)] + [np.cumsum(sizes), codes, links, pairs, weights]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _ARROW)], names=_CHUNK.names)

    for whole in batches:
        for batch in common.slices(whole, 0, 1 << 20):
            texts = batch.column(0).to_pylist()
            for text, n, made in zip(texts, batch.column(1).to_pylist(), aligner.align(texts)):
                if made is None:
                    continue
                codes, links = np.unique(made[3], return_counts=True)
                if rows and held + len(codes) > most:
                    yield flush()
                    rows, sizes, held = [], [], 0
                rows.append((hashlib.sha256(text.encode()).digest(), *made[:3], made[4], codes, links, n))
                sizes.append(len(codes))
                held += len(codes)
    if rows:
        yield flush()


def chunks(docs: DataFrame, a_path: str, b_path: str, text: str = "text", most: int = CHUNK_PAIRS) -> DataFrame:
    """The stored chunks of the distinct aligned texts, each with its number ``chunk``, of at most ``most`` distinct pairs
    of texts unless a single text has more."""
    a, b = common.vocabulary_bytes(a_path), common.vocabulary_bytes(b_path)

    def build():
        return common.cached_in_task(("aligner", hash(a), hash(b)), lambda: Aligner(a, b))

    # Copies are counted before the shuffle, so that a text with many rows sends one a task.
    distinct = docs.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    made = distinct.mapInArrow(lambda batches: _chunks(batches, build, most), _CHUNK)
    return common.stored(made.withColumn("chunk", F.monotonically_increasing_id()), "aligned")


def pair_counts(made: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count, best): the links of each pair of ids in the corpus, and if no pair of that B id has more."""
    counts = common.stored(
        made.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count"))
        .select("pair", F.expr(f"int(pair div {n_b})").alias("a"), F.expr(f"pair % {n_b}").alias("b"), "count"), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select(  # at most a row for each id of vocabulary B
        "pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


_MEASURES = StructType([
    StructField("key", BinaryType()), StructField("n_a", LongType()), StructField("n_b", LongType()),
    StructField("n_groups", LongType()), StructField("n_links", LongType()), StructField("n_best", LongType()),
    StructField("count_sum", LongType()), StructField("groups_sha256", StringType())])


def _measures(batches):
    """Measures of the texts of each chunk with the counts of its pairs (pair, count, best in three lists)."""
    for batch in batches:
        for at in range(batch.num_rows):
            n_a, n_b, n_groups = (batch.column(k)[at].values for k in (1, 2, 3))
            ends, codes, links, pairs, counts, best = (
                np.asarray(batch.column(k)[at].values.to_numpy(zero_copy_only=False)) for k in range(5, 11))
            order = np.argsort(pairs)
            place = order[np.searchsorted(pairs, codes, sorter=order)]
            links = links.astype("i8")
            begin = np.concatenate([[0], ends[:-1]]).astype("i8")  # every text here has a link
            out = [np.add.reduceat(x, begin) for x in (links, links * best[place], links * counts[place])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[at].values, n_a, n_b, n_groups, *[pa.array(x, pa.int64()) for x in out],
                 batch.column(4)[at].values], names=_MEASURES.names)


def measures(made: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each distinct text with tokens; key is
    the SHA-256 of the text."""
    looked_up = (made.select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair")
                 .groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("pair", "count", "best")).alias("found")))
    rows = made.join(looked_up, F.col("chunk") == F.col("c")).select(
        "keys", "n_a", "n_b", "n_groups", "groups", "ends", "codes", "links", F.col("found.pair").alias("pair"),
        F.col("found.count").alias("count"), F.col("found.best").alias("best"))
    return rows.mapInArrow(_measures, _MEASURES)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links of a pair that no other pair of
    its B id exceeds), count_sum (corpus counts, summed over the links) and groups_sha256 ('' without tokens)."""
    import sentencepiece

    made = chunks(docs, a_path, b_path, text)
    n_b = sentencepiece.SentencePieceProcessor(model_proto=common.vocabulary_bytes(b_path)).get_piece_size()
    found = common.stored(measures(made, pair_counts(made, n_b)), "measures")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.col(text), 256)).alias("k"))
    numbers = [f.name for f in _MEASURES.fields[1:-1]]
    return rows.join(found, F.col("k") == F.col("key"), "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
