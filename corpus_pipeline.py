"""A corpus from documents: toxicity, line dedup, near duplicates, benchmark windows, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from lodestrata.llm.columns import Aside
from lodestrata.llm.scratch import Scratch

# Every stage hides the columns that it does not read behind private names, so a column of any name passes through.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject at the threshold of their language.

    A null or empty text has a score as well; repeated rows are judged each; without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2
    aside = Aside(docs, ("doc_id", "text", "lang"))
    model = toxicity.fit(aside.df, labels.filter(learned).select("doc_id", F.col("toxic").alias("label")))
    return aside.back(toxicity.score(aside.df, model).filter(~F.col("rejected")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; one that consists of such lines goes.

    Null and empty texts stay as they are; ``n_chars``, where there is such a column, follows the text.
    """
    aside = Aside(docs, ("doc_id", "text", "n_chars"))
    done = line_dedup.dedup_lines(aside.df, Scratch(spark, "lines").keep)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept_text", r"\s", "")) != "")
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast(dict(aside.df.dtypes).get("n_chars", "long")) if "n_chars" in done.columns else None}
    return aside.back(done.filter(left).withColumns({k: v for k, v in changed.items() if k in aside.df.columns}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose shingle sets link.

    Rows are told apart by id and text: of rows that share an id only those whose text is a copy go, and rows
    that repeat both are one document, of which the row with the least other columns stays. Of equal ids the
    least hash of id and text stays; a row without an id gives way to one that has an id. Null and empty texts
    are no copies of one another.
    """
    scratch = Scratch(spark, "ngrams")
    aside = Aside(docs, ("doc_id", "text"))
    keyed = aside.df.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = ngram_join.similar_documents(keyed.select(F.col("_row").alias("doc_id"), "text"), scratch)
    groups = found.groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("group"), F.count("*").alias("n"))
    ids = keyed.groupBy("_row").agg(F.min("doc_id").alias("id"))
    rows = scratch.keep(groups.join(ids, "_row").select("_row", "group", "n", F.struct(F.col("id").isNull().alias("none"), "id", "_row").alias("at")), "rows")
    first = rows.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    copies = rows.join(first, "group").filter(F.col("at") != F.col("first")).select("_row")
    copies = scratch.keep(copies, "copies")
    repeated = rows.filter("n > 1").select("_row").join(copies.hint("shuffle_hash"), "_row", "left_anti")
    repeated = scratch.keep(repeated, "repeated")
    every = [c for c in keyed.columns if c != "_row"]
    single = keyed.join(copies.union(repeated).hint("shuffle_hash"), "_row", "left_anti").select(*every)
    whole = F.struct(*every)
    one = keyed.join(repeated.hint("shuffle_hash"), "_row", "left_semi").groupBy("_row").agg(F.min_by(whole, F.to_json(whole)).alias("d"))
    return aside.back(single.unionByName(one.select("d.*")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    aside = Aside(docs, ("doc_id", "text"))
    found = decontaminate.decontaminate(aside.df, items, Scratch(spark, "windows").keep)
    return aside.back(found.filter(F.size("hit") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words.

    Adds size, source_size, target, taken and repeats, which replace columns of those names.
    """
    kept = [c for c in docs.columns if c.lower() != "size"]
    sized = docs.select(*[f"`{c}`" for c in kept], mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).filter(F.col("repeats") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
]

ORACLE_SQL = None  # the classifier cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
