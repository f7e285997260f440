"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    bitplanes,
    decontaminate,
    lexical,
    merkle,
    mixing,
    page_crf,
    pair_ranking,
    pseudonyms,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    toxicity,
)
from codeloom.llm.common import table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return rows.select("row.doc_id", *(c for c in rows.columns if c != "row"))


@query
def op5_pseudonyms(spark, sf_dir):
    rows = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), "key of the corpus")
    counts = (F.expr(f"cast(size(filter(found, k -> k = '{n}')) AS bigint) AS n_{n}") for n in pseudonyms.PATTERNS)
    return rows.select("row.doc_id", "text", *counts)


@query
def op7_mixing(spark, sf_dir):
    mixed = mixing.entropy_mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies"
    )


@query
def op4_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query
def op6_bit_planes(spark, sf_dir):
    import public_tokenizers

    return bitplanes.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_toxicity(spark, sf_dir):
    rows = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")


@query
def op3_simhash(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_pair_ranking(spark, sf_dir):
    rows = pair_ranking.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("row.doc_id", "held_out", "score", (F.col("score") >= pair_ranking.LEAST).cast("int").alias("predicted"))


@query
def op9_page_crf(spark, sf_dir):
    return page_crf.main_texts(table(spark, sf_dir, "pages"))


@query
def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = merkle.merkle_manifest(docs, merkle.lowered_fifth(docs))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_sharding(spark, sf_dir):
    rows = sharding.shuffled_shards(table(spark, sf_dir, "documents"))
    text = text_of("row.text")
    return rows.select(
        "row.doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
