"""The registered queries of the operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import (
    additive, byte_bpe, checks, hosts, language, licences, minmax, packing, periodic, quality, shards, token_files, topk, trie,
)
from fieldmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


@query("op1_line_quality", checks.LINE_QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.line_first(table(spark, sf_dir, "documents"))
    return done.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "line_chars", "kept_chars")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_places(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_licence_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op5_minmax_duplicates", checks.NEAR_DUPLICATES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op6_label_propagation_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


@query("op7_host_reputation", checks.reputation(URL_RULES))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("share", "bound")


@query("op8_ppm_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).drop("bits_per_byte")


@query("op9_histogram_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.withColumn("length", F.col("length").cast("long"))


@query("op10_histogram_top_k", checks.TOP_K)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query("op11_minimizer_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.looped(table(spark, sf_dir, "documents")))
    best = found.select("doc_id", "runs", "collapsed", periodic.greatest_exponent(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_additive_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    described = additive.described(table(spark, sf_dir, "documents"))
    model = additive.train(described, table(spark, sf_dir, "labels").where(~held_out))
    return additive.scored(described, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "weakest")


@query("op13_parentheses_trie", checks.PREFIX_TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = trie.conversations_of(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_shared_openings(convs))
