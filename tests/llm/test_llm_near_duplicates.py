import random
import re

import numpy as np
import xxhash
from corpus import documents, empty

from pyspark.sql import functions as F

from surveylab.llm import simhash
from surveylab.llm.components import connected


def plain_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, bits):
    """{id: least id} of the links between ids' fingerprints."""
    values = sorted(set(fps.values()))
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                up[top(b)] = top(a)
    least = {}
    for i, v in fps.items():
        least[top(v)] = min(least.get(top(v), i), i)
    return {i: least[top(v)] for i, v in fps.items()}


def test_fingerprints_and_components_of_all_rows(spark):
    docs = documents(spark, clash=True, repeats=False)
    got = simhash.near_duplicates(docs).collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == plain_components(fps, 2)


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert sorted(r.component_id for r in got if r.doc_id == 0) == [0, 0]
    lone = [r for r in got if r.doc_id is None and r.fp != 0]
    assert [r.component_id for r in lone] == [None]
    kept = simhash.one_of_each(documents(spark, clash=True))
    assert kept.columns == documents(spark, clash=True).columns
    rows = kept.select("doc_id", "text").collect()
    assert len({r.text for r in rows}) == len(rows) == len({r.component_id for r in got})


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def linked(spark, values, bits, longest):
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    made = connected(simhash.links(df, bits, longest)).collect()
    roots = {r.node % 2**64: r.root % 2**64 for r in made}
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_links_by_short_and_by_crowded_lists(spark):
    rng = random.Random(9)
    values = {0, 2**64 - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    for bits in (0, 1, 2):
        comps = plain_components({v: v for v in values}, bits)
        groups = {}
        for v, c in comps.items():
            groups.setdefault(c, set()).add(v)
        want = sorted(map(sorted, groups.values()))
        assert linked(spark, values, bits, 64) == want
        assert linked(spark, values, bits, 1) == want  # every list of two counts as crowded


def test_chains_reach_the_least_node(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3), (1001, 1000)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_long_texts_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(40000))
    assert simhash.fingerprint(text.encode(), 3) % 2**64 == plain_fingerprint(text)
    assert np.int64(simhash.fingerprint(b"", 3)) == 0


def test_no_row_per_pair_in_a_crowded_group(spark):
    rng = random.Random(10)
    base = rng.getrandbits(64)
    values = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)})
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    links = simhash.links(df, 2)
    assert links.where(F.col("a") == F.col("b")).count() == 0
    assert links.count() < 65 * len(values)
    assert len(linked(spark, values, 2, 64)) == len(linked(spark, values, 2, 10**6)) == 1
