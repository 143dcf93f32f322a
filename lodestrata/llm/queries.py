"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import collocations, compaction, decontaminate, embedding_dedup, licences, line_dedup, lm_scoring, mixing, ngram_join, secrets, sql, suffix_dedup, token_counts, toxicity
from lodestrata.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped mix of all documents by source."""
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized = Scratch(spark, "op2").keep(sized, "sized")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger: the base rules first, then, against what that run left, the added ones."""
    versions = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    scratch = Scratch(spark, "op10")
    _, entries = secrets.scan(versions)
    ledger = scratch.keep(entries, "base")
    # Every blob has met the base rules, so this run scans with the added rules only and joins the findings of both.
    paths, entries = secrets.scan(versions, ledger, secrets.RULE_VERSIONS)
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op5_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark window covers."""
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op5").keep)
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat, exactly or nearly, an earlier line."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, Scratch(spark, "op7").keep)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    labels = _table(spark, sf_dir, "labels").filter(remainder != 2)
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "rejected")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of a label."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def _held_out_fifth(ids):
    """Which of an Arrow column of ids the language model does not learn from."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 5 == 1 for x in ids.to_pylist()], bool)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the suffix tree and under the unigram base."""
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op8"), _held_out_fifth)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a document with a smaller id."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks written as many small files, then compacted; one row a final file."""
    folder, tables = Scratch(spark, "op11").path, Scratch(spark, "op11-tables")  # nothing but the clicks in the folder
    return compaction.compact_clicks(spark, _table(spark, sf_dir, "clicks"), f"{folder}/clicks", tables.keep)


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and spans of licence templates in every document."""
    return licences.scan_licences(_table(spark, sf_dir, "documents")).drop("spans")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES = {
    "op11_compaction": op11_compaction,
    "op12_licence_scan": op12_licence_scan,
    "op13_collocations": op13_collocations,
    "op8_lm_scores": op8_lm_scores,
    "op9_repeated_passages": op9_repeated_passages,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op1_embedding_dedup": op1_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op3_toxicity": op3_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op5_benchmark_overlap": op5_benchmark_overlap,
    "op2_source_mix": op2_source_mix,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES = {
    "op1_embedding_dedup": sql.OP1_SQL,
    "op2_source_mix": sql.OP2_SQL,
    "op4_ngram_jaccard": sql.OP4_SQL,
    "op5_benchmark_overlap": sql.OP5_SQL,
    "op7_line_dedup": sql.OP7_SQL,
    "op9_repeated_passages": sql.OP9_SQL,
    "op10_secret_scan": sql.OP10_SQL,
    "op13_collocations": sql.OP13_SQL,
}
