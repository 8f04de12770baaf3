import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from corpus import documents, empty, rows_of, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from surveylab.llm import queries, sentencepiece_codec, simple8b, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.Model(open(PIECES, "rb").read())


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = list("abcdefgh ETH  \n\t\r▁éèü漢字の한😀<>/(){};'\"0123　\x00") + ["<s>", "</s>", "<0x41>", "the", "ing"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_encoder_equals_the_library(library, model):
    enc = sentencepiece_codec.Encoder(model)
    rng = random.Random(2)
    pieces = sorted(enc.usable)
    made = odd_texts(4000) + ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(4000)]
    for t in made + ["ab" * 30000, "".join(rng.choice("abcdeth") for _ in range(50000))]:
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == library.encode(t), t[:80]


def test_backtracking_shortens_earlier_pieces(model):
    enc = sentencepiece_codec.Encoder(model)
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("abeilnorst") for _ in range(rng.randrange(1, 14)))
        assert enc.pieces_of(word) == enc._merged(word), word


def test_decoder_equals_the_library(library, model):
    import pyarrow as pa

    rng = random.Random(4)
    lists = [[rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randrange(12))]
             for _ in range(5000)]
    dec = sentencepiece_codec.Decoder(model)
    assert dec.decode(pa.array(lists, pa.list_(pa.int32()))) == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        dec.decode(pa.array([[32000]], pa.list_(pa.int32())))


def test_piece_digests_of_all_rows(spark, library):
    docs = documents(spark, clash=True)
    found = rows_of(queries.piece_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

    def plain(i, t):
        ids = library.encode(t or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())

    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert found == sorted((plain(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=key)
    assert queries.piece_digests(empty(spark)).count() == 0


def test_decode_keeps_columns_and_null_lists(spark):
    df = spark.createDataFrame([(1, [306, 13], "k"), (2, None, None), (3, [], "x")], "a int, ids array<int>, text string")
    out = {r.a: r for r in sentencepiece_codec.decode(df, PIECES, text="text").collect()}
    assert out[1].text and out[2].text == "" and out[3].text == "" and set(out[1].asDict()) == {"a", "ids", "text"}


def test_simple8b_round_trips():
    rng = random.Random(5)
    for _ in range(150):
        n, bits = rng.choice([0, 1, 5, 511, 512, 513, 1300]), rng.choice([1, 3, 7, 16, 20, 33, 60, 64])
        ids = np.array([rng.randrange(1 << rng.randrange(1, bits + 1)) for _ in range(n)], dtype="u8")
        chunk = simple8b.encode(ids)
        assert simple8b.decode(chunk).tolist() == ids.tolist()
        for b in range(-(-n // simple8b.BLOCK)):
            assert simple8b.decode_block(chunk, b).tolist() == ids[b * 512:(b + 1) * 512].tolist()
    edge = np.array([2**64 - 1, 2**60 - 1, 2**60, 2**53 + 1, 15 << 60, 0], dtype="u8")
    assert simple8b.decode(simple8b.encode(edge)).tolist() == edge.tolist()
    with pytest.raises(ValueError):
        simple8b.decode(b"x" * 64)


def test_word_ids_equal_the_library():
    t = Tokenizer.from_file(WORDS)
    data = open(WORDS, "rb").read()
    tok = simple8b.Tokens(data, simple8b.word_ranks(data))
    assert tok.ranked
    made = odd_texts(6000, 6) + ["<|endoftext|>x", "a <|startoftext|>", "don't WE'LL 's", "İſḰ \x1c \x85", "á ́b"]
    for s, ids in zip(made, tok.encode([m.encode() for m in made])):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("width", [2, 4])
def test_token_files_hold_all_documents_in_order(spark, tmp_path, width):
    t = Tokenizer.from_file(WORDS)
    docs = documents(spark, clash=True)
    path = str(tmp_path / "tokens")
    dealt, shards = simple8b.with_shards(docs, shard_bytes=20000)
    assert shards > 3 and {"source", "lang", "shard"} <= {*dealt.columns}
    ids = simple8b.token_ids(dealt, WORDS, end_id=2, keep=["shard", "place", "doc_id"], width=width)
    simple8b.write(ids, path, shards, width=width)
    got = sorted(simple8b.read(spark, path).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(ids) == docs.count()
    start = 0
    for r in got:
        flat = np.frombuffer(bytes(r.ids), "<u4")
        assert r.start == start and flat[-1] == 2
        start += len(flat)
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array(
        t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in got) == want


def test_token_files_of_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    dealt, shards = simple8b.with_shards(empty(spark))
    simple8b.write(simple8b.token_ids(dealt, WORDS, keep=["shard", "place", "doc_id"]), path, shards)
    assert simple8b.read(spark, path).count() == 0


def test_a_repeated_row_is_cut_into_shards_and_bases_are_broadcast(spark, tmp_path):
    docs = documents(spark, ["some words here"] * 3, repeats=False).withColumn("doc_id", F.lit(5).cast("long")).select(
        "doc_id", F.explode(F.array_repeat("text", 400)).alias("text"))
    dealt, shards = simple8b.with_shards(docs, shard_bytes=2000)
    sizes = [r[1] for r in dealt.groupBy("shard").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 600
    path = str(tmp_path / "hot")
    simple8b.write(simple8b.token_ids(dealt, WORDS, keep=["shard", "place", "doc_id"]), path, shards)
    got = simple8b.read(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    starts = sorted(r.start for r in got.collect())
    assert len(starts) == 1200 and len({b - a for a, b in zip(starts, starts[1:])}) == 1


def test_kept_ids_stay_right_when_the_table_turns_over():
    tok = simple8b.Tokens(open(WORDS, "rb").read())
    tok.known.most = 3000
    t = Tokenizer.from_file(WORDS)
    for s in odd_texts(300, 12) + [f"one two w{i}x three" for i in range(200)]:
        assert np.frombuffer(tok.encode([s.encode()])[0], "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    assert len(tok.known.young) + len(tok.known.old) < 60


def best_segmentation(word, counter):
    """Tokens of the best segmentation, each place computed for itself."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        top = (best[i - 1][0] + counter.unknown, best[i - 1][1] - len(word[i - 1].encode()))
        for j in range(max(0, i - counter.reach), i):
            if word[j:i] in counter.scores:
                top = max(top, (best[j][0] + counter.scores[word[j:i]], best[j][1] - 1))
        best.append(top)
    return -best[-1][1]


def test_token_counts_by_brute_force_and_by_the_library():
    scores = token_counts.piece_scores(open(PIECES, "rb").read())
    counter = token_counts.Counter(scores)
    rng = random.Random(8)
    words = {"▁" + w for t in texts() if t for w in t.split()} | {
        "".join(rng.choice("abcdethé漢😀") for _ in range(rng.randrange(1, 20))) for _ in range(1500)}
    words = {w for w in words if len(w) < 200}
    counter.add(words)
    assert {w: counter.known[w] for w in words} == {w: best_segmentation(w, counter) for w in words}
    unigram = Tokenizer(models.Unigram([("<unk>", counter.unknown), *scores.items()], 0, False))
    for w in words:
        if all(c in scores for c in w):
            assert len(unigram.encode(w).tokens) == counter.known[w], w


def test_ties_prefer_fewer_tokens():
    counter = token_counts.Counter({"a": -1.0, "b": -1.0, "ab": -2.0})
    counter.add({"ab", "aab", "c"})
    assert (counter.known["ab"], counter.known["aab"], counter.known["c"]) == (1, 2, 1)


def test_token_counts_of_all_rows(spark):
    docs = documents(spark, clash=True)
    out = token_counts.token_counts(docs, PIECES)
    assert set(out.columns) == {*docs.columns, "n_pretokens"}  # the clashing n_tokens is replaced
    counter = token_counts.Counter(token_counts.piece_scores(open(PIECES, "rb").read()))
    for r in out.select("doc_id", "text", "n_pretokens", F.col("n_tokens").alias("n")).collect():
        assert (r.n_pretokens, r.n) == counter.count([r.text or ""])[0]
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0
