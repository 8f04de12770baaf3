"""Quality rules: plain counts of a text, and how well a public vocabulary fits it (tokeniser fertility).

Base counts reject texts that are short or mostly repeat themselves. The
verdict on the others comes from a byte-level vocabulary: characters per token,
share of tokens that are pieces of a character (byte fallback), and entropy of
the tokens in bits. Each has a band per script; a text outside of one is
rejected. Prose of any topic lies inside; runs of symbols, shouted or stammered
text and broken encodings lie outside. Entropy grows with the length of a text,
so that its floor rises with the logarithm of the number of tokens
(``entropy_floor`` sets it from labelled good texts).

Null texts are handled like empty ones (no words: rejected). Rows are judged
each by itself, so that repeated rows get equal results.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from surveylab.llm import common


@dataclass(frozen=True)
class Band:
    """Accepted values of a script: characters per token, byte-fallback share, token entropy in bits.

    ``least_entropy`` holds from ``level_tokens`` tokens on; each halving below that takes ``entropy_rise`` bits off.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    entropy_rise: float = 0.0
    level_tokens: float = 1.0

    def floor(self, n_tokens: int) -> float:
        return self.least_entropy - self.entropy_rise * max(0.0, float(np.log2(self.level_tokens / max(n_tokens, 1))))


#: By the script of most letters. Scripts that the vocabulary hardly knows take several tokens a character.
#: The Latin entropy floor is entropy_floor() of the labelled good documents of sf0.1; there are no labelled documents
#: of other scripts to set a rise from, so that theirs are level.
BANDS = {
    "latin": Band(2.10, 8.0, 0.20, 6.40, 0.30, 1200),
    "greek": Band(0.60, 6.0, 0.70, 4.0),
    "cyrillic": Band(0.60, 6.0, 0.70, 4.0),
    "semitic": Band(0.50, 6.0, 0.85, 4.0),
    "han": Band(0.30, 4.0, 0.98, 3.5),
    "other": Band(0.25, 8.0, 0.99, 3.5),
}
#: A short text needs this share of the greatest entropy that its tokens can have, if that is less than the band.
SHORT_SHARE = 0.85
#: Bits that the entropy floor lies below the lowest labelled good documents.
FLOOR_MARGIN = 0.1
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words

# The first bytes of UTF-8 characters by script, and the byte classes of the contract.
_LEADS = {"latin": range(0xC3, 0xCA), "greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD5),
          "semitic": range(0xD6, 0xDC), "han": range(0xE3, 0xEE), "other": [0xE0, 0xE1, 0xE2, 0xEF, *range(0xF0, 0xF5)]}
_SPACE = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")
_INNER = list(range(0x80, 0xC0))  # bytes inside a character

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that stand twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), "int64", len(words))
    code, span = ids[:n], len(index)
    for k in range(1, size):
        if span * len(index) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            span = len(values)
        code = code * len(index) + ids[k:n + k]
        span *= len(index)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(size):
        inside[k:n + k] |= again
    return int(inside.sum())


def base_counts(text: bytes, seen: np.ndarray) -> tuple[int, int, int, int, int]:
    """COUNTS of a UTF-8 text; ``seen`` has how often each byte stands in it."""
    words = text.split()  # at the six ASCII white-space bytes
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text) - int(seen[_INNER].sum())
    return (len(words), chars - int(seen[_SPACE].sum()), int(seen[_SYMBOLS].sum()),
            len(lines) - len(set(lines)), repeated_words(words))


def script_of(seen: np.ndarray) -> str:
    """The script of most letters, from the counts of the first bytes of characters."""
    counts = {name: int(seen[list(leads)].sum()) for name, leads in _LEADS.items()}
    counts["latin"] += int(seen[0x41:0x5B].sum() + seen[0x61:0x7B].sum())
    return max(counts, key=counts.get) if any(counts.values()) else "other"


class Vocabulary:
    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for piece, i in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.partial[i] = True

    def measure(self, text: str) -> tuple[float, float, float, int]:
        """MEASURES of a text, and its number of tokens."""
        ids = np.array(self.encoding.encode_ordinary(text), "int64")
        if not len(ids):
            return 0.0, 0.0, 0.0, 0
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        return (len(text) / len(ids), float(self.partial[ids].mean()), float(-(share * np.log2(share)).sum()),
                len(ids))


def accepted(script: str, chars: float, byte_share: float, entropy: float, n_tokens: int, bands=None) -> bool:
    b = (bands or BANDS)[script]
    # few tokens cannot have much entropy: at most the logarithm of their number
    least = min(b.floor(n_tokens), SHORT_SHARE * float(np.log2(max(n_tokens, 1))))
    return b.least_chars <= chars <= b.most_chars and byte_share <= b.most_bytes and entropy >= least


def entropy_floor(n_tokens: np.ndarray, entropy: np.ndarray, margin: float = FLOOR_MARGIN) -> tuple[float, float, float]:
    """(``least_entropy``, ``entropy_rise``, ``level_tokens``) of good texts of one script.

    The floor is level from the upper quartile of their tokens on (a few long texts set no slope, and the entropy of
    prose is bounded). Up to there it is the line over the logarithm of the tokens that lies below all of the
    texts and nearest to them on average, lowered by the margin.
    """
    level = float(np.quantile(n_tokens, 0.75))
    x = np.log2(np.minimum(n_tokens, level))
    hull: list[tuple[float, float]] = []  # lower convex hull: its edge at the mean is that line
    for p in sorted(zip(x.tolist(), entropy.tolist())):
        if hull and hull[-1][0] == p[0]:
            continue
        while len(hull) > 1 and ((hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1])
                                 <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0])):
            hull.pop()
        hull.append(p)
    k = int(np.searchsorted([h[0] for h in hull], x.mean()))
    (x0, y0), (x1, y1) = hull[max(k - 1, 0)], hull[k]
    rise = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
    return y0 + rise * (float(np.log2(level)) - x0) - margin, rise, level


def judge(df: DataFrame, vocabulary_path: str, text: str = "text", bands: dict[str, Band] | None = None,
          min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, keep=None) -> DataFrame:
    """Append COUNTS, MEASURES, ``script``, ``base_failed`` and ``kept`` of each whole text.

    Texts that the base counts reject are not measured (their measures are null).
    """
    data = common.vocabulary_bytes(vocabulary_path)

    def task():
        vocabulary = common.cached_in_task(("fertility", hash(data)), lambda: Vocabulary(data))

        def one(raw: bytes):
            seen = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
            counts = base_counts(raw, seen)
            script = script_of(seen)
            n, repeated = counts[0], counts[-1]
            if n < min_words or 100 * repeated > most_repeated * n:
                return (*counts, None, None, None, script, True, False)
            measures = vocabulary.measure(raw.decode())
            return (*counts, *measures[:3], script, False, accepted(script, *measures, bands=bands))

        def batch(col):
            made = [one(t) for t in common.text_bytes(col)]
            types = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.string(), pa.bool_(), pa.bool_()]
            return [pa.array(list(x), t) for x, t in zip(zip(*made), types)]

        return batch

    fields = [*(StructField(c, LongType()) for c in COUNTS), *(StructField(m, DoubleType()) for m in MEASURES),
              StructField("script", StringType()), StructField("base_failed", BooleanType()),
              StructField("kept", BooleanType())]
    return common.map_columns(df, [text], fields, task, keep)


def good_rows(df: DataFrame, vocabulary_path: str, text: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` whose text is kept, with their columns as they are (also if named like a result)."""
    held = [f"__q_{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*held)
    judged = judge(renamed, vocabulary_path, held[df.columns.index(text)], **settings)
    return judged.where("kept").select(*[F.col(h).alias(c) for h, c in zip(held, df.columns)])
