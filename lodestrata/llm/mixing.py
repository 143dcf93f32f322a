"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources get a share of the total in proportion to their weights. A source whose share would pass
``max_epochs`` times its size is clamped there and its excess goes to the others, again by weight,
until none is above. Clamping in the order of cap / weight makes this one pass over the sources: with
the sources sorted by that ratio, those clamped are a prefix.

A document is then taken a whole number of times, and once more if a seeded hash of its id falls into
the source's last, fractional epoch. The cut is found on sizes summed by (source, hash bucket), so the
words taken are within half a bucket (1/4096 of a source, or one document) of the target, reruns agree,
and no source is ever sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.columns import Aside

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
BUCKETS = 4096
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(doc_id: Column, seed: int) -> Column:
    """Seeded bucket of a document, 0 to 4095."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating, by the code points of ``source``, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) to the same rows with ``target``: shares of the summed sizes.

    One row per source goes through a single window; the texts never do. Sizes of 0 get 0.
    """
    cap = F.col("source_size") * max_epochs
    order = [(cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = sources.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("rest"),
        F.sum("weight").over(onward).alias("weights"),
    )
    clamped = left.withColumn("clamped", cap * F.col("weights") <= F.col("weight") * F.col("rest"))
    # The first source that is not clamped has the most weights after it; it holds what is left to share.
    free = F.max(F.when(~F.col("clamped"), F.struct("weights", "rest"))).over(all_rows)
    shared = (F.col("weight") * free["rest"]).cast("double") / free["weights"]
    target = F.when(F.col("clamped"), cap.cast("double")).otherwise(shared)
    return clamped.select("source", "source_size", "weight", target.alias("target"))


def mix(sized: DataFrame, weights=cyclic_weights, max_epochs: int = MAX_EPOCHS, seed: int = 20) -> DataFrame:
    """Decide how often each row of ``sized`` (doc_id, source, size, ...) is taken.

    Adds source_size, target, taken (words) and ``repeats`` (how often the document is taken). Rows with
    equal ids fall into the same bucket; a null id counts as an empty one; a null source is a source.
    An empty table gives an empty table; the length of a text matters by its size only. Other columns of
    ``sized`` pass through whatever their names; the four added names replace columns of the table.
    ``sized`` is read three times: pass a stored table.
    """
    aside = Aside(sized, ("doc_id", "source", "size"), ("source_size", "target", "taken", "repeats"))
    sized = aside.df
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = totals.count() <= BROADCAST_SOURCES
    targets = water_fill(weights(totals), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("_whole"))
    targets = targets.withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))

    by_bucket = sized.groupBy(F.col("source").alias("_src"), bucket(F.col("doc_id"), seed).alias("_bucket")).agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = by_bucket.withColumn("_middle", F.sum("_words").over(running) - F.col("_words") / 2)
    cut = (
        middle.join(F.broadcast(targets) if few else targets, F.col("_src").eqNullSafe(F.col("_source")))
        .groupBy("_source", "source_size", "target", "_whole")
        .agg(F.max(F.when(F.col("_middle") <= F.col("_part"), F.col("_bucket"))).alias("_cut"))
    )
    cut = F.broadcast(cut) if few else cut
    once_more = (bucket(F.col("doc_id"), seed) <= F.col("_cut")) & (F.col("_whole") < max_epochs)
    repeats = F.col("_whole") + F.coalesce(once_more, F.lit(False)).cast("long")
    joined = sized.join(cut, F.col("source").eqNullSafe(F.col("_source")))
    return aside.back(joined, {"source_size": "source_size", "target": "target", "taken": repeats * F.col("size"), "repeats": repeats})

