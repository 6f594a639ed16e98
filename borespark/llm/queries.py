"""The registered queries of this subpackage: thin bindings of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bwt, embeddings, minhash, mixing, oracles, packing, pii, rtree, rules, secrets, substring, topk, toxicity

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def source_domains(docs: DataFrame) -> DataFrame:
    """(source, domain) for the given tables, which name no domains: sources with an even number are taken as web, others with a number as books."""
    last = F.regexp_extract("source", "([0-9])$", 1).try_cast("int")
    return docs.select("source").distinct().select("source", F.when(last % 2 == 0, "web").when(last % 2 == 1, "books").otherwise("other").alias("domain"))


#: Target weights of op4 and the pipeline: half of the budget to each domain, English first; sources alike.
TARGET = mixing.Target(domains={"web": 1.0, "books": 1.0}, langs={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, share=0.9, epochs=2)


#: Target proportions of op5's windows: the hot source counts four times another; sources not named count one.
PACK_WEIGHTS = {"src0": 4}


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "documents"))


def op3_embedding_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mixing.mix(docs, TARGET, source_domains(docs)).select("doc_id", "domain", "lang", "source", "tokens", "epochs_full", "tokens_last")


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), path=tokenizer_path(), weights=PACK_WEIGHTS)


def op6_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"))


def op7_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


def op8_suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return bwt.remove_repeats(table(spark, d, "documents"))


def op9_substring(spark: SparkSession, d: str) -> DataFrame:
    return substring.remove_repeats(table(spark, d, "documents"))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii(table(spark, d, "documents"))


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every seventh id are moved on by one, as the contract has it."""
    vectors = table(spark, d, "embeddings")
    return rtree.hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    book = rules.decide(rules.ledger(table(spark, d, "documents")), rules.POLICIES[-1])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy")


def quality_rule_ablations(spark: SparkSession, d: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, d, "documents")))


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(table(spark, d, "documents"), path_a=tokenizer_path("byte_bpe_50k.json"), path_b=tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_embedding_near_dup, op4_mixing, op5_packing, op6_topk, op7_minhash, op8_suffix_array, op9_substring, op10_pii, op11_hard_negatives, op12_quality_rules, quality_rule_ablations, op13_alignment)}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
