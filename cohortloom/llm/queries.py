"""The operators on the driver tables, registered by name, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import (
    decontaminate,
    hard_negatives,
    license_scan,
    line_dedup,
    lm_score,
    mixing,
    ngram_join,
    quality,
    simhash,
    suffix_dedup,
    token_align,
    topk,
    url_filter,
)
from cohortloom.session import share_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_code(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_line_dedup", line_dedup.ORACLE)
def op1(table) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table("documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_total", "lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op5_quality_classifier")
def op5(table) -> DataFrame:
    documents = table("documents").select("doc_id", "text")
    net = quality.fit(documents, table("labels"))
    scored = quality.quality_scores(documents, net, ["doc_id"])
    return scored.select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


@query("op7_benchmark_decontamination", decontaminate.ORACLE)
def op7(table) -> DataFrame:
    return decontaminate.contained_items(table("documents"), table("benchmark"))


@query("op8_ngram_jaccard_join", ngram_join.oracle())
def op8(table) -> DataFrame:
    return ngram_join.near_duplicates(table("documents"))


@query("op6_url_filter")
def op6(table) -> DataFrame:
    return url_filter.judge_urls(table("pages").select("page_id", "url"))


@query("op9_license_scan")
def op9(table) -> DataFrame:
    return license_scan.scan_licenses(table("documents")).drop("spans")


@query("op10_exact_top_k", topk.ORACLE)
def op10(table) -> DataFrame:
    return topk.exact_top_k(table("embeddings"))


@query("op2_suffix_dedup")
def op2(table) -> DataFrame:
    return suffix_dedup.drop_repeated_strings(table("documents")).drop("kept")


@query("op3_lm_score")
def op3(table) -> DataFrame:
    return lm_score.score_texts(table("documents"))


@query("op4_mixing")
def op4(table) -> DataFrame:
    return mixing.mix_documents(table("documents"), table("labels"), keep=["doc_id", "source"])


@query("op11_hard_negatives", hard_negatives.ORACLE)
def op11(table) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table("embeddings").withColumn("label", moved))


@query("op12_simhash_near_dedup")
def op12(table) -> DataFrame:
    return simhash.near_duplicates(table("documents"))


@query("op13_token_alignment")
def op13(table) -> DataFrame:
    return token_align.align_tokens(table("documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
