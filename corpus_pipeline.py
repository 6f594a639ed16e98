"""A training corpus from the documents table: five stages, each one operator of the llm subpackage on all that the stage before kept.

In every stage: further columns stay (also ones named as an operator's own), rows that are repeated are rows of their own unless a stage says
otherwise, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.llm import minhash, mixing, packing, secrets, toxicity
from borespark.llm.common import join_checked, materialize
from borespark.llm.queries import source_domains, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 stay. Trained on the labelled documents that aren't held out. A null or empty text scores as
    the share of toxic rows says; a score of just 0.5 goes; without usable labels all stay."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled(docs.select("doc_id", "text"), labels))
    scored = toxicity.score(docs, model, keep=docs.columns)  # docs may have a column score of their own
    return scored.toDF(*docs.columns, "__score").where("__score < 0.5").drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 of the union) stays: that with the smallest doc_id. Texts without
    words and rows with a null doc_id stay; all rows with the id that stays stay."""
    found = minhash.near_duplicates(docs, width=5, share=80)
    gone = materialize(found.where("not kept").select("doc_id").distinct())
    return join_checked(docs, gone, ["doc_id"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [SECRET], overlapping ones one; all documents stay, null texts as null; n_chars follows where it was known."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their target weights, nine tenths of all tokens, no document more than once. Texts without
    words go, as they have no tokens; null lang and source are children of their own; ties of the seeded order go by doc_id, then text."""
    target = mixing.Target(domains={"web": 1.0, "books": 1.0}, langs={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, share=0.9, epochs=1)
    return mixing.mixed_documents(docs, target, source_domains(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, each window with the sources in the corpus's own proportions. A null text is its end token alone."""
    return packing.pack(docs, path=tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("secret_scans", mask_secrets), ("mixing", mix_sources), ("packing", pack_windows)]

#: The toxicity score and the tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
