"""Phrase collocations by vertical positional inverted lists.

Texts are dealt to blocks, and a block holds the inverted lists of its own texts: for every phrase the
ascending positions at which it begins. A list of phrases of k words is extended by merging its positions
with the postings of the adjacent word, narrowed to places where the shifted phrase of k words is frequent
too, for no other extension can be frequent. The length of a list is the exact frequency in its block, and
the sum over blocks decides which phrases of k + 1 words are frequent; only those numbers travel back.
Blocks ask about their phrases in packed arrays, one row for each block and range of phrases, and a range
answers in the order asked; there are as many ranges as the corpus has millions of words.

A block's lists are held together: positions in order, next to each the number of its phrase. Phrases are
told apart by exact numbers (number of the shorter phrase, number of the last word), never by hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch

BLOCK_BYTES = 8_000_000  # bytes of text in one block; a piece is never cut
RANGE_WORDS = 1_000_000  # words of the corpus for each range of pairs
LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a candidate
COVERED = (80, 100)  # a candidate goes if a longer one has this share of its occurrences
TOP = 2000  # rows a language
SCALE = 2_000_000
BUCKETS = 64  # a language's candidates are ranked in this many parts first

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_table = bytearray(range(256))
_table[65:91] = range(97, 123)
for _c in _SEPARATORS:
    _table[_c] = ord(".")
_table[9] = 32
_TABLE = bytes(_table)

_STATE = [("words", "binary"), ("glob", "binary"), ("pos", "binary"), ("cand", "binary")]
#: What a block sends: its words once; later, for each range of pairs, the pairs of (number of a phrase, number of the next word) and how often.
_WORDS = [("blk", "long"), ("lang", "string"), ("no", "int"), ("word", "string"), ("n", "long"), *_STATE]
_PAIRS = [("blk", "long"), ("lang", "string"), ("rng", "int"), ("begin", "long"), ("first", "binary"), ("last", "binary"), ("count", "binary"), *_STATE]
#: What a range says: the frequent pairs with new numbers, and to each block the numbers in the order in which it asked.
_FOUND = [("prefix", "long"), ("end", "long"), ("a", "long"), ("number", "long"), ("b", "long"), ("begin", "long"), ("numbers", "binary")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _ddl(fields) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _schema(fields) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields])


def _rows(fields, size: int, /, **columns) -> pa.RecordBatch:
    """Rows of an exchange; columns that are not given are null."""
    schema = _schema(fields)
    made = [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, schema, strict=True)], schema=schema)


def _pack(array: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of numbers repeat."""
    array = np.ascontiguousarray(array)
    return zlib.compress(array.view(np.uint8).reshape(len(array), -1).T.tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _parts(text: bytes, size: int):
    """A text in parts of about a block, cut where pieces end only. Letters are lowered, separators are dots."""
    text, at = text.translate(_TABLE), 0
    while len(text) - at > size:
        cut = text.rfind(b".", at, at + size)
        cut = cut if cut >= 0 else text.find(b".", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def _block(blk: int, lang: str, texts: list[bytes]):
    """The word rows of a block, and its words in order by their numbers in the block (-1 between pieces)."""
    tokens = b".".join(texts).replace(b".", b" . ").split()
    if not tokens:
        return
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    found, known = np.asarray(coded.indices), coded.dictionary
    dot = known.index(pa.scalar(b".", pa.binary())).as_py()
    counts = np.bincount(found, minlength=len(known))
    keep = np.flatnonzero(np.arange(len(known)) != dot)
    number = np.full(len(known), -1, np.int32)
    number[keep] = np.arange(len(keep))
    yield _rows(_WORDS, 1, blk=[blk], lang=[lang], words=[_pack(number[found])])
    for lo in range(0, len(keep), 50_000):
        part = keep[lo : lo + 50_000]
        words = known.take(pa.array(part)).cast(pa.string())
        yield _rows(_WORDS, len(part), blk=np.full(len(part), blk), lang=pa.array([lang] * len(part)), no=np.arange(lo, lo + len(part), dtype=np.int32), word=words, n=counts[part])


def _in_blocks(size: int):
    """Blocks of one language and about ``size`` bytes each. What waits in all languages together is bounded: the largest goes first."""

    def run(batches):
        begin, made, wait, held = TaskContext.get().partitionId() << 32, 0, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                for part in _parts(text or b"", size):
                    wait.setdefault(lang, []).append(part)
                    held[lang] = held.get(lang, 0) + len(part) + 1
                    while held and (held[lang] >= size or sum(held.values()) >= 2 * size):
                        full = max(held, key=held.get)
                        yield from _block(begin + made, full, wait.pop(full))
                        held.pop(full)
                        held.setdefault(lang, 0)
                        made += 1
        for lang, texts in wait.items():
            yield from _block(begin + made, lang, texts)
            made += 1

    return run


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ascending positions ``a`` are among the ascending positions ``b``."""
    at = np.searchsorted(b, a)
    return (at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(len(a), bool)


def _range_of(first: np.ndarray, last: np.ndarray, ranges: int) -> np.ndarray:
    """Where a pair of numbers is counted."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(ranges)).astype(np.int32)


def _numbers(k: int, answers: pa.Table, size: int) -> np.ndarray:
    """Numbers of a block's candidates by their numbers in the block, -1 for those that are not frequent."""
    number = np.full(size, -1, np.int64)
    if k == 1:
        number[answers["local"].to_numpy()] = answers["number"].to_numpy()
    else:
        for begin, packed in zip(answers["begin"].to_pylist(), answers["numbers"].to_pylist(), strict=True):
            told = _unpack(packed, np.int64)
            number[begin : begin + len(told)] = told
    return number


def _extended(k: int, ranges: int):
    """Lists of k words and the numbers of the frequent phrases among them to lists of k + 1 words, and what they ask."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], _schema(_PAIRS))
        if not state.num_rows or not answers.num_rows:
            return none
        blk, lang = state["blk"][0].as_py(), state["lang"][0].as_py()
        words = _unpack(state["words"][0].as_py(), np.int32)
        if k == 1:
            pos, cand = np.arange(len(words), dtype=np.int64), words
        else:
            pos, cand = np.cumsum(_unpack(state["pos"][0].as_py(), np.int32).astype(np.int64)), _unpack(state["cand"][0].as_py(), np.int32)
        number = _numbers(k, answers, int(cand.max(initial=0)) + 1)
        held = (cand >= 0) & (number[cand] >= 0)
        pos, cand = pos[held], cand[held]
        if k == 1:  # words that are not frequent leave all lists
            glob = number
            words = np.where((words >= 0) & (number[words] >= 0), words, -1).astype(np.int32)
        else:
            glob = _unpack(state["glob"][0].as_py(), np.int64)
        grown = _meet(pos + 1, pos)
        pos, begin = pos[grown], cand[grown]
        if not len(pos):
            return none
        # A list for each pair; its length is the frequency in this block.
        pair, where, count = np.unique(begin.astype(np.int64) * len(glob) + words[pos + k], return_inverse=True, return_counts=True)
        first, last = number[pair // len(glob)], glob[pair % len(glob)]
        rng = _range_of(first, last, ranges)
        order = np.lexsort((last, first, rng))
        place = np.empty(len(pair), np.int32)
        place[order] = np.arange(len(pair))
        first, last, count, rng = first[order], last[order], count[order], rng[order]
        heads = np.r_[0, np.flatnonzero(np.diff(rng)) + 1]
        cuts = list(zip(heads.tolist(), [*heads[1:].tolist(), len(rng)], strict=True))
        out = [_rows(
            _PAIRS, len(cuts), blk=np.full(len(cuts), blk), rng=rng[heads], begin=heads,
            first=[_pack(np.diff(first[lo:hi], prepend=0)) for lo, hi in cuts], last=[_pack(last[lo:hi]) for lo, hi in cuts], count=[_pack(count[lo:hi].astype(np.int32)) for lo, hi in cuts],
        )]
        if k + 1 < LONGEST:
            step = np.diff(pos, prepend=0).astype(np.int32)
            out.append(_rows(_PAIRS, 1, blk=[blk], lang=[lang], words=[_pack(words)], glob=[_pack(glob)], pos=[_pack(step)], cand=[_pack(place[where])]))
        return pa.Table.from_batches(out)

    return run


def _counted(least: int):
    """The frequent pairs of a range with their frequencies and numbers, and the answers to the blocks."""

    def run(asked: pa.Table) -> pa.Table:
        packed = {n: asked[n].to_pylist() for n in ("blk", "begin", "first", "last", "count")}
        first = [np.cumsum(_unpack(x, np.int64)) for x in packed["first"]]
        sizes = [len(x) for x in first]
        first = np.concatenate(first)
        last = np.concatenate([_unpack(x, np.int64) for x in packed["last"]])
        count = np.concatenate([_unpack(x, np.int32) for x in packed["count"]]).astype(np.int64)
        order = np.lexsort((last, first))
        new = np.r_[True, (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)]
        heads = np.flatnonzero(new)
        total = np.add.reduceat(count[order], heads)
        enough = total >= least
        number = np.where(enough, (int(asked["rng"][0].as_py()) << 40) + np.cumsum(enough), -1)
        told = np.empty(len(first), np.int64)
        told[order] = number[np.cumsum(new) - 1]
        at = order[heads[enough]]
        out = [_rows(_FOUND, len(at), prefix=first[at], end=last[at], a=total[enough], number=number[enough])]
        edges = np.r_[0, np.cumsum(sizes)]
        back = [k for k in range(len(sizes)) if (told[edges[k] : edges[k + 1]] >= 0).any()]
        out.append(_rows(_FOUND, len(back), b=[packed["blk"][k] for k in back], begin=[packed["begin"][k] for k in back], numbers=[_pack(told[edges[k] : edges[k + 1]]) for k in back]))
        return pa.Table.from_batches(out)

    return run


def _frequent_phrases(docs: DataFrame, scratch: Scratch, least: int, longest: int, block_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """For each length the table (lang, phrase, a) of the frequent phrases, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter(F.octet_length("text") > 0)
    rows = scratch.keep(texts.mapInArrow(_in_blocks(block_bytes), _ddl(_WORDS)), "rows1")
    words = rows.filter(F.col("word").isNotNull())
    totals = scratch.keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranges = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    frequent = scratch.keep(frequent.select("lang", F.col("word").alias("phrase"), "a", F.monotonically_increasing_id().alias("number")), "frequent1")
    named = frequent.select("lang", F.col("phrase").alias("word"), "number")
    answers = words.join(named, ["lang", "word"]).select(F.col("blk").alias("b"), F.col("no").alias("local"), "number")
    found = [frequent]
    for k in range(1, longest):
        state = rows.filter(F.col("words").isNotNull()).select("blk", "lang", *[n for n, _ in _STATE])
        rows = scratch.keep(state.groupBy("blk").cogroup(answers.groupBy("b")).applyInArrow(_extended(k, ranges), _ddl(_PAIRS)), f"rows{k + 1}")
        scratch.drop(f"rows{k}")
        asked = rows.filter(F.col("rng").isNotNull()).select("rng", "blk", "begin", "first", "last", "count")
        told = scratch.keep(asked.groupBy("rng").applyInArrow(_counted(least), _ddl(_FOUND)), f"told{k + 1}")
        pairs = told.filter(F.col("prefix").isNotNull())
        shorter = found[-1].select(F.col("number").alias("prefix"), "lang", F.col("phrase").alias("head"))
        word = found[0].select(F.col("number").alias("end"), F.col("phrase").alias("tail"))
        joined = pairs.select("prefix", "end", "a", "number").join(shorter, "prefix").join(word, "end")
        found.append(scratch.keep(joined.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a", "number"), f"frequent{k + 1}"))
        answers = told.filter(F.col("b").isNotNull()).select("b", "begin", "numbers")
    return [f.select("lang", "phrase", "a") for f in found], totals


def _wide(count: Column) -> Column:
    """A count for products that may pass 64 bits."""
    return count.cast("decimal(20,0)")


def _scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score): every phrase of two and more words with its lowest-scoring cut."""
    cuts = None
    for size, phrases in enumerate(found[1:], 2):
        for k in range(1, size):
            cut = phrases.select("lang", "phrase", "a", F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("first"), F.substring_index("phrase", " ", k - size).alias("rest"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
    every = found[0]
    for f in found[1:-1]:
        every = every.unionByName(f)
    left = every.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # The quotient is at most SCALE / 2; it is exact, for both sides are decimals without places.
    met = met.withColumn("num", _wide(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)")).withColumn("den", _wide(F.col("l")) + _wide(F.col("r")))
    met = met.select("lang", "phrase", "a", F.struct(F.expr("num div den").alias("score"), "k", "l", "r").alias("cut"))
    least = met.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _subsumed(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): the most frequent longer candidate around each contiguous part of a candidate."""
    parts = None
    for size, phrases in enumerate(found[2:], 3):
        for width in range(2, size):
            for at in range(size - width + 1):
                inner = F.substring_index(F.substring_index("phrase", " ", at + width), " ", -width)
                part = phrases.select("lang", inner.alias("phrase"), "a")
                parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, scratch: Scratch, top: int = TOP, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A null text has no words and a null language is ``und``. Texts are taken whole, a very long one in parts
    cut between pieces; repeated rows count each time. An empty table, or one without a phrase that occurs
    ``least`` times, gives no row. Ties of score and frequency are ordered by the bytes of the phrase. Columns
    besides lang and text are not read, whatever their names.
    """
    found, totals = _frequent_phrases(docs.select("lang", "text"), scratch, least, LONGEST, block_bytes)
    scored = _scored(found).join(_subsumed(found), ["lang", "phrase"], "left")
    gone = F.coalesce(_wide(F.col("most")) * COVERED[1] >= _wide(F.col("a")) * COVERED[0], F.lit(False))
    scored = scratch.keep(scored.filter(~gone).drop("most"), "scored")
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()
    # A part of a language first, so that no task ranks all of a language: what is left is bounded.
    part = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    begun = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = begun.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
