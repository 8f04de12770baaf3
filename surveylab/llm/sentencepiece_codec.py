"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

The encoder never replays the merges of a whole text. An Aho-Corasick automaton
over the vocabulary gives the longest piece at every position; pieces are laid
out from left to right, and a piece may follow another one only if merging
their joined text again gives just these two pieces. Where no piece fits, the
position is marked in a bitfield and the piece before is shortened. A layout
whose neighbours are all compatible is the one that the merges give: the first
merge across a border would be a merge across it in the pair alone as well.

Texts are cut before white-space marks and around characters that occur in no
longer piece (no merge crosses these places; checked when the model is
loaded); the ids of such a word are kept between texts in a bounded table.

Null texts are encoded like empty ones (no ids); decoding null ids gives an
empty text. Repeated rows are encoded each by itself.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from surveylab.llm import common

MARK = "▁"  # stands for the space in the pieces
#: Words whose ids are kept per Python worker, and pairs whose compatibility is kept.
WORDS_KEPT = 1 << 18
PAIRS_KEPT = 1 << 18
LONGEST_KEPT = 64

# Fixed values of the model file format (field numbers and piece types of its public protocol-buffer schema).
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_MODEL_TYPE, _SUFFIX, _BYTE_FALLBACK, _UNK_SURFACE = 3, 24, 35, 44
_CHARSMAP, _DUMMY_PREFIX, _TRIM, _ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file; refuses models outside the operator's scope."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == _PIECES:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(_PIECE, b"").decode())
                self.types.append(piece.get(_TYPE, NORMAL))
                self.scores.append(float(np.frombuffer(piece.get(_SCORE, bytes(4)), "<f4")[0]))
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                normalizer = dict(_fields(value))
        self.dummy_prefix = bool(normalizer.get(_DUMMY_PREFIX, 1))
        self.unknown_surface = trainer.get(_UNK_SURFACE, " ⁇ ".encode()).decode()
        refused = {
            "not a merge-type model": trainer.get(_MODEL_TYPE, 1) != _BPE,
            "no byte fallback": not trainer.get(_BYTE_FALLBACK, 0),
            "a character map": bool(normalizer.get(_CHARSMAP)),
            "extra white space is removed": bool(normalizer.get(_TRIM, 1)),
            "spaces are not escaped": not normalizer.get(_ESCAPE, 1),
            "white space as suffix": bool(trainer.get(_SUFFIX, 0)),
            "user-defined or unused pieces": bool({USER_DEFINED, UNUSED} & {*self.types}),
        }
        if any(refused.values()):
            raise ValueError("model not supported: " + ", ".join(k for k, v in refused.items() if v))
        self.byte_ids = [0] * 256
        for i, kind in enumerate(self.types):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}

    def as_bytes(self, text: str) -> bytes:
        """The byte pieces of a character that has no piece, as little-endian ids."""
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in text.encode())


class Encoder:
    """ids of a text: ``encode_into(text)`` gives little-endian 32-bit ids as bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {p: model.scores[i] for p, i in model.ids.items()}
        self.id_bytes = {p: i.to_bytes(4, "little") for p, i in model.ids.items()}
        self.reach = max(map(len, model.ids), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        # Only pieces that their own merges give can be part of a result.
        self.usable = {p for p in model.ids if len(p) == 1 or self._merged(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.usable:
            self.automaton.add_word(p, p)
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.usable), None)
        self.automaton.make_automaton()
        # Where the automaton stops in its trie tells the longest piece that begins at a place.
        self.path: dict[str, str | None] = {"": None}
        for p in sorted(self.usable, key=len):
            for n in range(1, len(p) + 1):
                if p[:n] not in self.path or n == len(p):
                    self.path[p[:n]] = p if n == len(p) else self.path[p[:n - 1]]
        long = [p for p in model.ids if len(p) > 1]
        self.cut = self._cut(long)

    def _cut(self, long: list[str]) -> re.Pattern:
        """Pattern of the words: texts are cut only where no piece reaches across."""
        if any(MARK in p.lstrip(MARK) for p in long):
            return re.compile(r"(?s).+")
        inside = set(chain.from_iterable(long))
        alone = "".join(re.escape(c) for c in "\n\t\x00" if c not in inside)  # these stand by themselves
        return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merge rule: best score first, leftmost of equal ones."""
        rank, symbols = self.rank, list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = rank.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return known

    def pieces_of(self, word: str) -> list[str]:
        """Pieces of a text without white-space borders inside (characters without a piece stand alone)."""
        compatible = self._compatible
        longest, reach, depth = self.path, self.reach, self.automaton.longest_prefix
        failed = bytearray(len(word) // 8 + 1)
        out: list[str] = []
        at, size = 0, len(word)
        ahead = word[:reach]
        piece = longest[ahead[:depth(ahead)]] or word[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                if at == size:
                    return out
                ahead = word[at:at + reach]
                piece = longest[ahead[:depth(ahead)]] or word[at]
                continue
            nearer = self._shorter(piece)
            while nearer is None:
                # Nothing fits here after any layout that ends at this place with out[-1].
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                nearer = self._shorter(piece)
            piece = nearer

    def _shorter(self, piece: str) -> str | None:
        nearer = self.shorter.get(piece)
        return piece[0] if nearer is None and len(piece) > 1 else nearer

    def _word(self, word: str) -> bytes:
        ids = self.id_bytes
        made = b"".join([ids.get(p) or self.model.as_bytes(p) for p in self.pieces_of(word)])
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = made
        return made

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.model.dummy_prefix:
            text = MARK + text
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in self.cut.findall(text)])


class Decoder:
    """Texts of id lists, with byte runs put together and broken ones replaced byte by byte."""

    def __init__(self, model: Model):
        self.model = model
        surface = []
        for p, kind in zip(model.pieces, model.types):
            if kind == BYTE:
                surface.append(bytes([int(p[3:5], 16)]))
            elif kind == CONTROL:
                surface.append(b"")
            elif kind == UNKNOWN:
                surface.append(model.unknown_surface.encode())
            else:
                surface.append(p.replace(MARK, " ").encode())
        self.surface = pa.array(surface, pa.binary())
        kinds = np.array(model.types)
        self.control = kinds == CONTROL
        # A leading space of the first visible piece is the one that encoding has put there.
        self.spaced = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.types)])

    def decode(self, lists: pa.ListArray) -> list[str]:
        offsets = lists.offsets
        ids = lists.values
        if len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(self.surface)):
            raise ValueError("id outside the vocabulary")
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, self.surface.take(ids)), b"").to_pylist()
        flat, at = ids.to_numpy(zero_copy_only=False), offsets.to_numpy(zero_copy_only=False)
        out = []
        # A control piece between two bytes of a character parts them.
        broken = self.control[flat]
        seen = np.concatenate([[0], np.cumsum(broken)])
        inner = seen[at[1:]] > seen[at[:-1]]
        for k, raw in enumerate(joined):
            begin, end = at[k], at[k + 1]
            if inner[k]:
                raw = self._between_controls(flat[begin:end])
            while begin < end and self.control[flat[begin]]:
                begin += 1
            if self.model.dummy_prefix and begin < end and self.spaced[flat[begin]]:
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_each_byte_replaced(raw))
        return out

    def _between_controls(self, ids: np.ndarray) -> bytes:
        parts, run = [], []
        for i in [*ids.tolist(), None]:
            if i is None or self.control[i]:
                parts.append(_each_byte_replaced(b"".join(run)))
                run = []
            else:
                run.append(self.surface[i].as_py())
        return "".join(parts).encode()


def _each_byte_replaced(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that is part of no valid character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


def encoder(data: bytes) -> Encoder:
    return common.cached_in_task(("encoder", hash(data)), lambda: Encoder(Model(data)))


def decoder(data: bytes) -> Decoder:
    return common.cached_in_task(("decoder", hash(data)), lambda: Decoder(Model(data)))


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           keep=None) -> DataFrame:
    """Append ``ids`` (array of int): the ids of each whole text, without begin or end ids.

    With ``decoded``, the ids are decoded again in the same pass and the texts
    appended under that name.
    """
    data = common.vocabulary_bytes(model_path)

    def task():
        enc, dec = encoder(data), decoder(data) if decoded else None

        def batch(col):
            made = [enc.encode(t) for t in common.texts(col)]
            offsets = np.zeros(len(made) + 1, "int32")
            np.cumsum([len(b) // 4 for b in made], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(made))])
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            return [lists, pa.array(dec.decode(lists), pa.string())] if dec else [lists]

        return batch

    fields = [StructField(ids, ArrayType(IntegerType()))]
    return common.map_columns(df, [text], fields + [StructField(decoded, StringType())] * bool(decoded), task, keep)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", keep=None) -> DataFrame:
    """Append ``text``: what each list of ids stands for. An id outside the vocabulary raises."""
    data = common.vocabulary_bytes(model_path)

    def task():
        dec = decoder(data)

        def batch(col):
            lists = pa.array([x or [] for x in col.to_pylist()], col.type) if col.null_count else col
            if len(lists) and lists.offset:
                lists = pa.concat_arrays([lists])
            return [pa.array(dec.decode(lists), pa.string())]

        return batch

    return common.map_columns(df, [ids], [StructField(text, StringType())], task, keep)
