"""Registered queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import oracles, variant_sql
from gaugework.llm import bpe, imatch, jaccard_join, mixing, periodic_runs, personal_data, quality_classifier, quality_rules, secret_scan, spelling_variants, substring_dedup, suffix_dedup, toxicity

#: The vocabulary file of op10; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spans(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"), 200, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(_spans("base"), "utf-8"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _scored(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    trees = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(quality_classifier.score(docs, trees), 0.3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(toxicity.score(docs, model), 0.5)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=90)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_passages(_documents(spark, sf_dir).select("doc_id", "text"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_likeness(_documents(spark, sf_dir)).drop("next_doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = personal_data.find_personal_data(docs, personal_data.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(_spans("base"), "utf-8"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.repeat_tails(_documents(spark, sf_dir).select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    shown = F.array_join(F.transform("runs", line), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(F.encode(shown, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
    length = -F.col("m.length")
    return out.select("doc_id", "n_runs", F.col("m.start").alias("start"), length.alias("length"), F.col("m.period").alias("period"), F.floor(1000 * length / F.col("m.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.count_words(_documents(spark, sf_dir), 7, 2, spelling_variants.drop_some)
    return spelling_variants.group_variants(words)


#: SQL of the queries that SQL can express on whole tables.
SQL = oracles.SQL | {"op12_periodic_runs": variant_sql.OP12, "op13_spelling_variants": variant_sql.OP13}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_imatch": op8_imatch,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
