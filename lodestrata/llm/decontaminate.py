"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window). A window
is a set of three-word shingles at fixed offsets; a document contains it only if it contains all of them,
so one shingle is a sufficient prefix, and the rarest over all documents is chosen. Document shingles are
joined with those prefix shingles only; the offset places the window, the bounds 0 <= start and
start + length <= words drop what cannot fit, and the rest is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.columns import Aside
from lodestrata.llm.text import ascii_lower, let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BROADCAST_TOKENS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "), " ", -1), "")


def _shingles(ws: Column, width: int) -> Column:
    """A hash for each run of ``width`` words, by position."""
    many = F.size(ws) - (width - 1)
    at = F.sequence(F.lit(0), many - 1)
    # The hash only proposes windows; the words decide.
    return F.when(many > 0, F.transform(at, lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(width))))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(win_id, win, width, item_ids): the distinct windows of all items."""
    split = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1))))
    cut = split.select("item_id", "ws", starts.alias("at")).select("item_id", F.slice("ws", F.col("at"), window).alias("win"))
    known = cut.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    return known.select(F.xxhash64("win").alias("win_id"), "win", F.least(F.size("win"), F.lit(SHINGLE)).alias("width"), "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, keep, window: int = WINDOW) -> DataFrame:
    """Words of ``docs`` (doc_id, text) that lie in a window of ``items`` (item_id, text).

    ``keep`` stores small tables (windows and token counts). Adds to each row of ``docs`` n_words, ``hit``
    (sorted word positions inside windows) and ``item_ids`` (sorted). Null and empty texts have no words, very
    long ones are taken whole; repeated rows and ids are answered row by row; null item texts have no window;
    empty tables give empty results or no hits. Other columns pass through whatever their names; the three
    added names replace columns of the table.
    """
    aside = Aside(docs, ("doc_id", "text"), ("n_words", "hit", "item_ids"))
    docs = aside.df.withColumn("_key", F.xxhash64("doc_id", "text"))
    windows = keep(_windows(items.select("item_id", "text"), window), "windows")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most SHINGLE of them

    def of_windows(width: int) -> DataFrame:
        return windows.filter(F.col("width") == width).select("win_id", F.size("win").alias("length"), F.posexplode(_shingles(F.col("win"), width)).alias("offset", "token")).withColumn("width", F.lit(width))

    def of_docs(width: int) -> DataFrame:
        ws = docs.select("_key", words(F.col("text")).alias("ws"))
        return ws.select("_key", F.size("ws").alias("n_words"), F.posexplode(_shingles(F.col("ws"), width)).alias("pos", "token"))

    candidates = None
    for width in widths:
        tokens = keep(of_windows(width), f"tokens{width}")
        distinct = tokens.select("token").distinct()
        small = tokens.count() <= BROADCAST_TOKENS
        bounded = F.broadcast if small else (lambda df: df)
        counts = keep(of_docs(width).join(bounded(distinct), "token").groupBy("token").agg(F.count("*").alias("df")), f"counts{width}")
        rarest = tokens.join(counts, "token").groupBy("win_id", "length").agg(F.min(F.struct("df", "token", "offset")).alias("m"), F.count("*").alias("n"))
        # A window one of whose shingles occurs nowhere has no match.
        prefix = rarest.filter(F.col("n") == F.greatest(F.col("length") - (width - 1), F.lit(1))).select("win_id", "length", F.col("m.token").alias("token"), F.col("m.offset").alias("offset"))
        start = F.col("pos") - F.col("offset")
        near = of_docs(width).join(bounded(prefix), "token").filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        near = near.select("_key", "win_id", start.alias("start"))
        candidates = near if candidates is None else candidates.unionByName(near)

    nothing = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<string>)")
    if candidates is None:
        return aside.back(docs, {"n_words": F.size(words(F.col("text"))).cast("long"), "hit": nothing[0], "item_ids": nothing[1]})
    by_doc = candidates.join(windows.select("win_id", "win", "item_ids"), "win_id").groupBy("_key").agg(F.collect_set(F.struct("start", "win", "item_ids")).alias("_near"))

    def judged(ws: Column) -> Column:
        found = F.filter("_near", lambda c: F.slice(ws, c["start"] + 1, F.size(c["win"])) == c["win"])
        hit = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(f, lambda c: F.sequence(c["start"], c["start"] + F.size(c["win"]) - 1)))))
        ids = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(f, lambda c: c["item_ids"]))))
        none = F.struct(F.size(ws).cast("long").alias("n_words"), nothing[0].alias("hit"), nothing[1].alias("item_ids"))
        return F.when(F.col("_near").isNull(), none).otherwise(let(found, lambda f: F.struct(F.size(ws).cast("long").alias("n_words"), hit(f).alias("hit"), ids(f).alias("item_ids"))))

    joined = docs.join(by_doc.hint("shuffle_hash"), "_key", "left").select(*docs.columns, let(words(F.col("text")), judged).alias("_r"))
    return aside.back(joined, {n: f"_r.{n}" for n in ("n_words", "hit", "item_ids")})
