"""SpotSigs, Merkle manifest and alignment against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from corpus import SCHEMA, documents, empty, rows_of, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveylab.llm import align, merkle, order, queries, spotsigs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- SpotSigs


def plain_spots(text, chain=2):
    """Signatures as tuples: an anchor and the content words after it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    found = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1:] if x not in spotsigs.ANCHORS][:chain]
        if w in spotsigs.ANCHORS and len(after) == chain:
            found.add((w, *after))
    return found or ({("whole", *words)} if words else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def prose(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "der", "la", "Río", "ship", "sails", "north", "wind", "cold", "漢字", "x1", "grün", "house"]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.mark.parametrize("part_bytes", [1, 3000, 1 << 20])
def test_edited_texts_and_likeness(spark, part_bytes):
    rows = [prose(i, i % 60) for i in range(90)] + texts(n=5)
    docs = documents(spark, rows, clash=True, repeats=False)
    got = spotsigs.compare_edited(docs, part_bytes=part_bytes).withColumn(
        "near_edited", spotsigs.likeness("spots", "edited_spots")).withColumn(
        "near_next", spotsigs.likeness("spots", "next_spots")).collect()
    plain = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in plain)
    by = {r.doc_id: r for r in got}
    for k, (d, t) in enumerate(plain):
        after = plain[(k + 1) % len(plain)][1]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert by[d].edited == edited and by[d].text == t
        own, new, other = plain_spots(t), plain_spots(edited), plain_spots(after)
        assert len(by[d].spots) == len(own)
        assert by[d].near_edited == pytest.approx(jaccard(own, new))
        assert by[d].near_next == pytest.approx(jaccard(own, other))


def test_edited_texts_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "the ship sails"), (1, "the ship sails"), (None, "of cold wind"), (2, None), (1, "other")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    got = spotsigs.compare_edited(docs, part_bytes=1).collect()
    assert len(got) == 5
    assert {r.edited for r in got if r.doc_id == 2} == {""}
    same = [r.edited for r in got if r.doc_id == 1 and r.text == "the ship sails"]
    assert len(same) == 2 and len({*same}) == 1
    # A null id is the least, so that the first document follows it.
    assert [r.edited for r in got if r.doc_id is None] == ["of col"]
    lone = spark.createDataFrame([(7, "abcd", None, None, None)], SCHEMA)
    assert [r.edited for r in spotsigs.compare_edited(lone).collect()] == ["abab"]
    assert spotsigs.compare_edited(empty(spark)).count() == 0


def test_parts_hold_ranges_of_equal_keys_once(spark):
    docs = spark.range(5000).select((F.col("id") * 7 % 5003).alias("doc_id"), F.lit("abc").alias("text"))
    dealt = order.beside_next(docs, "doc_id", "text", 3).collect()
    own = [r for r in dealt if not r.guest]
    assert sorted(r.doc_id for r in own) == sorted(r.doc_id for r in docs.collect())
    held = {}
    for r in own:
        held.setdefault(r.part, []).append(r.doc_id)
    spans = sorted((min(v), max(v)) for v in held.values())
    assert len(spans) > 64 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert len(dealt) - len(own) == len(spans)


def test_equal_texts_have_equal_fingerprints(spark):
    got = queries.spotsigs.near_duplicates(documents(spark, clash=True)).collect()
    by = {}
    docs = documents(spark).select("doc_id", spotsigs.F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    fps = {r.doc_id: r.fp for r in got if r.doc_id is not None}
    for r in docs:
        if r.doc_id is not None:
            by.setdefault(r.text, set()).add(fps[r.doc_id])
    assert all(len(v) == 1 for v in by.values())


def test_near_duplicate_classes_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = prose(100 + k, rng.randrange(30, 160)).split()
        for _ in range(rng.randrange(1, 9)):
            new = list(base)
            for _ in range(rng.randrange(0, 6)):
                new[rng.randrange(len(new))] = rng.choice(["mast", "sea", "rope", "the"])
            rows.append(" ".join(new))
    rows += [None, "", "one word", "one word", "漢字"]
    for at_least in (0.8, 0.5):
        got = spotsigs.near_duplicates(documents(spark, rows, repeats=False), at_least=at_least).collect()
        sets = [plain_spots(t) for t in rows]
        up = list(range(len(rows)))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if jaccard(sets[i], sets[j]) >= at_least:
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
        assert {r.doc_id: r.class_id for r in got} == {i: top(i) for i in range(len(rows))}
        assert len({top(i) for i in range(len(rows))}) > 5
    assert spotsigs.near_duplicates(empty(spark)).count() == 0


def test_fingerprint_plan_has_no_python(spark):
    plan = spotsigs.compare_edited(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn|ExistingRDD.*map", plan)


# ---- Merkle manifest


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(hashes, fan=16):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def ascend(tree, at, h, fan=16):
    siblings = ""
    for level in tree[:-1]:
        begin = at // fan * fan
        run, own = level[begin:begin + fan], at - begin
        siblings += "".join(run[:own] + run[own + 1:])
        h = sha("".join([*run[:own], h, *run[own + 1:]]))
        at //= fan
    return siblings, h


def plain_manifest(rows, fields, fan=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows, plainly."""
    leaf = {id(r): sha("".join(encoded(r[c]) for c in fields)) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for v in by.values():
        v.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf[id(r)]))
    trees = {s: levels([leaf[id(r)] for r in v], fan) for s, v in by.items()}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in names], fan)
    out = []
    for s, v in by.items():
        for at, r in enumerate(v):
            h = leaf[id(r)]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                low = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                h = sha("".join(encoded(low if c == "text" else r[c]) for c in fields))
            first, h = ascend(trees[s], at, h, fan)
            second, h = ascend(top, names.index(s), h, fan)
            out.append((r["doc_id"], leaf[id(r)], trees[s][-1][0], top[-1][0], sha(first + second), h, h == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_rows(df, fan=16):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.verify(df, FIELDS, "source", "doc_id", {"text": lowered}, tampered, fan).collect()
    return sorted(((r.id, bytes(r.leaf).hex(), bytes(r.subroot).hex(), bytes(r.root).hex(), sha(bytes(r.siblings).hex()),
                    bytes(r.folded).hex(), r.verified) for r in got), key=str)


@pytest.mark.parametrize("fan", [16, 2])
def test_manifest_by_brute_force(spark, fan):
    rng = random.Random(3)
    sources = ["s1"] * (270 if fan == 16 else 21) + ["s2"] * 17 + ["lone"] + [None] * 20 + [f"é{i}" for i in range(18)] + ["", "\U0001F600", "￮"]
    rows = [(rng.choice([i, 3 * i, None]) if i % 9 == 0 else i, rng.choice(["A b", None, "", "Thé X", "lower"]), None if i % 7 else "en",
             s, i if i % 5 else None) for i, s in enumerate(sources)]
    rows += rows[:3] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("node", F.lit(1)).withColumn("run", F.lit("x"))
    assert manifest_rows(df, fan) == plain_manifest([r.asDict() for r in df.collect()], FIELDS, fan)


def test_manifest_of_one_source_one_row_and_none(spark):
    for n in (1, 17):
        df = spark.createDataFrame([(i, f"T{i}", "en", None, 1) for i in range(n)], SCHEMA)
        assert manifest_rows(df) == plain_manifest([r.asDict() for r in df.collect()], FIELDS)
    assert manifest_rows(empty(spark)) == []
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_ranks_of_groups_cut_into_parts(spark):
    rows = [("a" if i % 3 else "b", i * 37 % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = order.ranked(df, "g", [F.col("v")], rows_a_part=30).collect()
    for g in "ab":
        mine = sorted((r.pos, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and {r.n for r in got if r.g == g} == {len(mine)}
        assert [v for _, v in mine] == sorted(v for k, v in rows if k == g)


# ---- Alignment


@pytest.fixture(scope="module")
def plain_align():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = align.byte_of_char()

    def one(text):
        if not text:
            return None
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                   for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(bytes_a), spans(bytes_b)
        owner = [[] for _ in raw]
        for i, (x, y) in zip(ids_a, sa):
            for k in range(x, y):
                owner[k].append((x, i))
        links = [(i, j) for j, (x, y) in zip(ids_b, sb) for _, i in sorted({t for k in range(x, y) for t in owner[k]})]
        groups, begin = [], 0
        for end in sorted({y for _, y in sa} & {y for _, y in sb}):
            groups.append(",".join(str(i) for i, (x, _) in zip(ids_a, sa) if begin <= x < end) + "|"
                          + ",".join(str(j) for j, (x, _) in zip(ids_b, sb) if begin <= x < end))
            begin = end
        return ids_a, ids_b, groups, links

    return one


ODD = ["▁x", "a ▁ b", "<s> </s> <|endoftext|> x", "  two  spaces ", "\n\n a\t b \r\n", "don't we'LL", "é漢字😀 ok", "x　 y z",
       "\x00 \x85q \x1c r", "<0x41> [UNK]", "   ", "word " * 50, "ab" * 300, "1234567 89,000.00", "é ​﻿"]


def test_alignment_of_all_rows(spark, plain_align):
    docs = documents(spark, [t if t is None or len(t) < 4000 else t[:1500] for t in texts(n=15)] + ODD, clash=True)
    rows = [(r.doc_id, plain_align(r.text)) for r in docs.select("doc_id", "text").collect()]
    counts = Counter(p for _, x in rows if x for p in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)

    def digest(doc, x):
        if not x:
            return (doc, 0, 0, 0, 0, 0, 0, "")
        return (doc, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]),
                sum(counts[p] for p in x[3]), sha(";".join(x[2])))

    got = rows_of(align.align(docs, A, B), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = sorted((digest(*r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert got == want
    assert align.align(empty(spark), A, B).count() == 0


def test_batches_give_each_text_s_tokens(plain_align):
    aligner = align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    rng = random.Random(9)
    letters = list("abcdeETH  \n\t\r▁éü漢😀<>(){}'\"0123　\x00\xa0.,!") + [" the", "'s", "ing ", "<s>"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(800)]
    made += ["", "ab" * 2100, " " * 4200 + "x"]
    plain = align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    plain.fast = None  # by the tokenizers library alone
    for t, x, y in zip(made, aligner.align(made), plain.align(made)):
        want = plain_align(t)
        assert (x is None and y is None) or (x[:3], x[4]) == (y[:3], y[4])
        assert (x is None) == (want is None), t
        if x:
            assert x[:3] == (len(want[0]), len(want[1]), len(want[2])) and x[4] == sha(";".join(want[2])), t
            assert x[3].tolist() == [i * 32000 + j for i, j in want[3]]
    assert aligner.align(["", ""]) == [None, None] and aligner.align(["▁"]) == [None] and aligner.align([]) == []


def test_chunks_of_bounded_size(spark):
    docs = documents(spark, [prose(i, 30) for i in range(60)] * 2, repeats=False).coalesce(1)
    whole = rows_of(align.align(docs, A, B), "doc_id", "n_links", "n_best", "count_sum")
    made = align.chunks(docs, A, B, most=100)  # chunks of a few texts
    counts = align.pair_counts(made, 32000)
    assert made.count() > 10 and made.select(F.sum(F.size("keys"))).first()[0] == 60
    assert counts.agg(F.sum("count")).first()[0] == sum(r[1] for r in whole)
    found = align.measures(made, counts).agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")]).first()
    assert [2 * x for x in found] == [sum(r[k] for r in whole) for k in (1, 2, 3)]
