"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words with the white-space mark before them. The
distinct pre-tokens of a batch go into a trie, in sorted order, so that words
with a common beginning share its nodes. Each node holds the forward score of
its prefix, the best sum of piece scores that ends there, and the number of
pieces; it is computed once from the nodes above it. The count at the node
where a pre-token ends is the pre-token's. Pieces and scores are those of a
public vocabulary file; a character that no piece covers costs as many byte
pieces as it has bytes, at a score below all pieces.

Among equal scores the segmentation with fewer pieces counts. Null and empty
texts have no token. Repeated rows are counted each by itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from surveylab.llm import common
from surveylab.llm.sentencepiece_codec import MARK, Model

#: Score of a character without a piece, below the least piece score.
BELOW = 10.0
#: Pre-tokens whose counts are kept between batches, and the longest one that is.
KEPT, LONGEST_KEPT = 1 << 18, 64


class Counter:
    """Numbers of tokens of pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.reach = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - BELOW
        # Pieces by their last character, so that a node looks only at endings that exist.
        self.endings: dict[str, list[int]] = {}
        for p in scores:
            self.endings.setdefault(p[-1], []).append(len(p))
        self.endings = {c: sorted(set(x)) for c, x in self.endings.items()}
        self.known: dict[str, int] = {}

    def add(self, pretokens: set[str]) -> None:
        """Count the pre-tokens that are not known yet."""
        scores, reach, endings, unknown = self.scores, self.reach, self.endings, self.unknown
        # The trie's branch of the word at hand: score and number of pieces by depth. Sorted words
        # leave a branch for good when they turn off it, so that no other branch has to be held.
        best, number = [0.0], [0]
        before = ""
        for word in sorted(pretokens):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1:], number[shared + 1:]
            for i in range(shared, len(word)):
                c = word[i]
                top, pieces = best[i] + unknown, number[i] + len(c.encode())
                for size in endings.get(c, ()):
                    at = i + 1 - size
                    if at < 0:
                        break
                    score = scores.get(word[at:i + 1])
                    if score is not None:
                        score += best[at]
                        if score > top or score == top and number[at] + 1 < pieces:
                            top, pieces = score, number[at] + 1
                best.append(top)
                number.append(pieces)
            before = word
            self.known[word] = number[-1]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        cut = [[MARK + w for w in t.split()] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        self.add({w for words in cut for w in words if w not in known})
        out = [(len(words), sum(map(known.__getitem__, words))) for words in cut]
        for w in [w for w in known if len(w) > LONGEST_KEPT]:
            del known[w]
        return out


def piece_scores(data: bytes) -> dict[str, float]:
    """The pieces of a vocabulary file with their scores."""
    model = Model(data)
    return {p: model.scores[i] for p, i in model.ids.items()}


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", keep=None) -> DataFrame:
    """Append ``n_pretokens`` and ``n_tokens`` of each whole text."""
    data = common.vocabulary_bytes(vocabulary_path)

    def task():
        counter = common.cached_in_task(("counter", hash(data)), lambda: Counter(piece_scores(data)))

        def batch(col):
            made = counter.count(common.texts(col))
            return [pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)]

        return batch

    return common.map_columns(df, [text], [StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())],
                              task, keep)
