"""Registered queries of the text operators: thin digests over the operators' own outputs."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylab.llm import (align, chat, decontaminate, html_text, labels, merkle, quality_classifier, quality_rules,
                           sentencepiece_codec, simhash, simple8b, spotsigs, token_counts, toxicity)
from surveylab.llm.common import table
from surveylab.session import checkpoint_dir

#: Vocabulary files by name; the folder can be set for installations that keep them elsewhere.
VOCABULARIES = os.environ.get("SURVEYLAB_VOCABULARIES", "")


def vocabulary(name: str) -> str:
    return os.path.join(VOCABULARIES, name) if VOCABULARIES else public_tokenizers.path(name)


def piece_digests(docs: DataFrame) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded text."""
    path = vocabulary("piece_bpe_32k.model")
    both = sentencepiece_codec.encode(docs, path, decoded="decoded", keep=["doc_id"])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(*labels.sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    scored = quality_classifier.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (labels.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                                     keep=["doc_id"])


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    docs, shards = simple8b.with_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = simple8b.token_ids(docs, vocabulary("word_bpe_49k.json"), end_id=2, keep=["shard", "place", "doc_id"], width=2)
    simple8b.write(ids, path, shards, width=2)
    return simple8b.read(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the labelled documents outside of fold 2 of 4."""
    return toxicity.fit(*labels.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 4, 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", (labels.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"),
                               keep=["doc_id"])


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                        F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.compare_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint("spots").alias("fingerprint"), spotsigs.fingerprint("edited_spots").alias("edited_fingerprint"),
        spotsigs.likeness("spots", "edited_spots").alias("near_edited"),
        spotsigs.likeness("spots", "next_spots").alias("near_next"), F.size("spots").cast("long").alias("n_spots"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.verify(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source",
                          "doc_id", {"text": lowered}, tampered)
    return found.select(F.col("id").alias("doc_id"), *[merkle.as_hex(c).alias(c) for c in ("leaf", "subroot", "root")],
                        F.sha2(merkle.as_hex("siblings"), 256).alias("proof_sha256"),
                        merkle.as_hex("folded").alias("folded_root"), "verified")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository, and itself imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_token_binary": op6_token_binary,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "op11_spotsigs": op11_spotsigs,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op4_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        c AS (SELECT conv_id, list([role, text] ORDER BY turn) AS said,
                  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
                             || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), ''
                             ORDER BY turn) AS rendered
              FROM t GROUP BY conv_id),
        p AS (SELECT DISTINCT list_slice(said, 1, k) AS said
              FROM (SELECT said, unnest(range(1, len(said))) AS k FROM c)),
        g AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY said)
        SELECT conv_id, CAST(len(said) AS BIGINT) AS n_turns, n_copies, rendered
        FROM g WHERE said NOT IN (SELECT said FROM p)
    """,
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
                   array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS t
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                     FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
    """,
}
