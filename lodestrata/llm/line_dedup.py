"""Line dedup by a segment-partition edit join (DataFrame functions only).

A line goes if it, or a line within ``edits`` edits of it, occurred earlier (in a document with a smaller
id, or further up in the same one). Lines are compared trimmed of blanks. Lines of under ``exact_chars``
characters always stay; those of under ``near_chars`` go only for exact repeats.

Two lines within k edits share one of the k + 1 segments of the shorter, at a place that their lengths
bound. The distinct lines are indexed by their segments, and every distinct line probes the substrings
that multi-match-aware selection leaves for lines of its own length and up to k shorter or longer.

Only the existence of an earlier line counts, so a probe does not meet all lines of a signature: each
signature proposes its earliest line, and a line that is near it is settled. A line that is not settled
meets what else its signatures hold: the lines of one chunk, or, where a signature holds several chunks, chunk
against chunk with their texts, so that no row is made for a pair. Lengths and letter parities (an edit flips two at
most) leave the pairs that are worth a comparison. Candidates are verified by banded bit-parallel edit distance, bit arithmetic over a band of 2k + 1 cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.columns import Aside
from lodestrata.llm.text import let

EDITS = 2
EXACT_CHARS = 16
NEAR_CHARS = 40
BROADCAST_IDS = 200_000
CHUNK = 64  # lines of one signature that travel in one row
TASK_PAIRS = 4000  # pairs that one task verifies
BLOCKS = 8  # pairs of chunks that one task compares
PART = 8  # characters of the parts that are looked up before two lines are compared
PARITIES = "etaoinshrdlucmfwypvbgkjqxz0123456789 .,"  # characters whose counts' last bits are compared


def lines_of(text: Column) -> Column:
    """The lines of a text; null has none."""
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def segments(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(shorter, number, move) of a line's own segments."""
    return [(0, number, 0) for number in range(edits + 1)]


def probes_of(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(shorter, number, move) of the substrings that may equal a segment of a line ``shorter`` characters shorter.

    A negative ``shorter`` stands for a longer line. Segment i (0-based) of a line of length l - d can lie only
    where the edits before it are at most i and those after it at most k - i: its start moves by -i .. i, and by
    d - (k - i) .. d + (k - i).
    """
    return [
        (shorter, number, move)
        for shorter in range(-edits, edits + 1)
        for number in range(edits + 1)
        for move in range(max(-number, shorter - (edits - number)), min(number, shorter + (edits - number)) + 1)
    ]


def signatures(lines: DataFrame, places: list[tuple[int, int, int]], edits: int = EDITS) -> DataFrame:
    """(line_id, own, ord, sig) of the given places of lines (line_id, line, chars, ord); ``own``: a segment of the line itself.

    A row for each place and one small expression over it: one expression for all places would be a method
    too large to be compiled. Segments are even parts, the longer ones last.
    """
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("shorter", "number", "move"), p, strict=True)]) for p in places])
    spread = lines.select("line_id", "line", "chars", "ord", F.explode(rows).alias("p"))
    own = (F.col("p.shorter") == 0) & (F.col("p.move") == 0)
    spread = spread.select("line_id", "line", "chars", "ord", own.alias("own"), "p.number", "p.move", (F.col("chars") - F.col("p.shorter")).alias("other"))
    parts = edits + 1
    short, first_long = F.expr(f"cast(other div {parts} as int)"), F.lit(parts) - F.col("other") % parts
    at = short * F.col("number") + F.greatest(F.col("number") - first_long, F.lit(0)) + F.col("move")
    placed = spread.select("line_id", "line", "chars", "ord", "own", "number", "other", at.alias("at"), (short + (F.col("number") >= first_long).cast("int")).alias("size"))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("chars"))
    return placed.filter(fits).select("line_id", "own", "ord", F.xxhash64("other", "number", F.substring("line", F.col("at") + 1, F.col("size"))).alias("sig"))


def banded_distance(left: Column, right: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else a larger number.

    The band of 2k + 1 cells around the diagonal is one machine word: bit b of step j stands for position
    j - k + b of ``left``. Both must have more than ``edits`` characters. The value followed along the lowest
    diagonal never falls there and ends at most 2k above the distance, so beyond 3k nothing more is computed.
    """
    band = 2 * edits + 1
    every = (1 << band) - 1
    top = 1 << (band - 1)
    a, b = F.split(left, ""), F.split(right, "")
    n_left, n_right = F.length(left), F.length(right)

    def step(chars: Column):
        def run(s: Column, j: Column) -> Column:
            return F.when(s["d"] > 3 * edits, s).otherwise(going(s, j))

        def going(s: Column, j: Column) -> Column:
            c = j["c"]
            at = j["j"]
            same = None
            for bit in range(band):
                place = at - edits + bit
                hit = F.when((place >= 0) & (F.get(chars, F.greatest(place, F.lit(0))) == c), F.lit(1 << bit)).otherwise(F.lit(0))
                same = hit if same is None else same + hit
            inverse = lambda x: F.lit(every).bitwiseXOR(x)

            def after_d0(d0: Column) -> Column:
                hp = s["vn"].bitwiseOR(inverse(d0.bitwiseOR(s["vp"])))
                hn = d0.bitwiseAND(s["vp"])
                diagonal = s["d"] + (d0.bitwiseAND(F.lit(top)) == 0).cast("int")
                below = s["d"] + (hp.bitwiseAND(s["h"]) != 0).cast("int") - (hn.bitwiseAND(s["h"]) != 0).cast("int")
                inside = at < n_left - edits
                right1 = F.shiftright(d0, 1)
                return F.struct(
                    hn.bitwiseOR(inverse(right1.bitwiseOR(hp))).alias("vp"), hp.bitwiseAND(right1).alias("vn"),
                    F.when(inside, diagonal).otherwise(below).alias("d"), F.when(inside, s["h"]).otherwise(F.shiftright(s["h"], 1)).alias("h"),
                )

            def with_same(x: Column) -> Column:
                carry = x.bitwiseAND(s["vp"]) + s["vp"]
                d0 = carry.bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(every))
                return F.get(F.transform(F.array(d0), after_d0), F.lit(0))

            return F.get(F.transform(F.array(same), with_same), F.lit(0))

        return run

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(1 << (band - 2)).alias("h"))
    ends = F.get(
        F.transform(F.array(a), lambda chars: F.aggregate(F.transform(b, lambda c, j: F.struct(c.alias("c"), j.alias("j"))), start, step(chars), lambda s: s["d"])),
        F.lit(0),
    )
    return F.when(F.abs(n_left - n_right) > edits, F.lit(edits + 1)).otherwise(ends)


def _common(a: Column, b: Column, limit: Column, from_end: bool) -> Column:
    """Characters that two strings share at one end, at most ``limit``, by halving steps."""
    part = (lambda x, n: F.right(x, n)) if from_end else (lambda x, n: F.substring(x, F.lit(1), n))
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= limit) & (part(a, n + step) == part(b, n + step)), n + step).otherwise(n))


def _parts_missing(left: Column, right: Column, edits: int) -> Column:
    """How many short parts of ``left`` do not occur in ``right`` within ``edits`` places: each needs an edit of its own."""
    found = lambda i: F.contains(F.substring(right, F.greatest(i * PART + 1 - edits, F.lit(1)), F.lit(PART + 2 * edits)), F.substring(left, i * PART + 1, F.lit(PART)))
    return F.size(F.filter(F.sequence(F.lit(0), F.floor((F.length(left) - 1) / PART).cast("int")), lambda i: ~found(i)))


def within(left: Column, right: Column, edits: int = EDITS) -> Column:
    """Whether two lines are within ``edits``, by the banded distance of what lies between their common ends.

    A few common characters stay on both sides, so that what is left is longer than the band needs. Lines that
    miss more than ``edits`` of one another's short parts are not compared further.
    """
    stay = edits + 1
    shorter = F.least(F.length(left), F.length(right))
    front = lambda n: F.greatest(n - stay, F.lit(0))
    middle = lambda x, cut: F.substring(x, cut["f"] + 1, F.length(x) - cut["f"] - cut["b"])
    ends = let(_common(left, right, shorter, False), lambda n: F.struct(front(n).alias("f"), front(_common(left, right, shorter - front(n), True)).alias("b")))
    pieces = let(ends, lambda cut: F.struct(middle(left, cut).alias("l"), middle(right, cut).alias("r")))
    near = let(pieces, lambda m: banded_distance(m["l"], m["r"], edits) <= edits)
    far = (F.abs(F.length(left) - F.length(right)) > edits) | (_parts_missing(left, right, edits) > edits)
    return F.when(far, F.lit(False)).otherwise(near)


def parities(line: Column) -> Column:
    """The last bits of the counts of some characters; one edit flips two of them at most."""
    out = None
    for bit, c in enumerate(PARITIES):
        odd = F.shiftleft(((F.length(line) - F.length(F.replace(line, F.lit(c)))) % 2).cast("long"), bit)
        out = odd if out is None else out.bitwiseOR(odd)
    return out


def _verified(pairs: DataFrame, lines: DataFrame, keep, name: str, edits: int) -> DataFrame:
    """(line_id, check) of the later line of each pair (a, b) of ids whose lines are within ``edits``."""
    ids = keep(pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct(), f"ids-{name}")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    texts = keep(lines.select("line_id", "check", "line", "first").join(ids, "line_id", "left_semi"), f"texts-{name}")
    left = texts.select(F.col("line_id").alias("a"), F.struct("line_id", "check", "line", "first").alias("l"))
    right = texts.select(F.col("line_id").alias("b"), F.struct("line_id", "check", "line", "first").alias("r"))
    # Dealt by their number: a pair is a small row, but its comparison is not small.
    both = pairs.join(left, "a").join(right, "b").repartition(1 + pairs.count() // TASK_PAIRS, "a", "b")
    late = F.when(F.col("l.first") < F.col("r.first"), F.col("r")).otherwise(F.col("l"))
    judged = both.select(within(F.col("r.line"), F.col("l.line"), edits).alias("near"), late.alias("late"))
    judged = keep(judged.select("near", "late.line_id", "late.check"), f"judged-{name}")
    return judged.filter("near").select("line_id", "check").distinct()


def _late_in_blocks(open_lines: DataFrame, held: DataFrame, lines: DataFrame, keep, blocks: int, edits: int) -> DataFrame:
    """(line_id, check) of the open lines (sig, line_id, chunk) that have an earlier line within ``edits`` among the held ones.

    Both sides travel in chunks with their texts, so a signature of n lines is (n / CHUNK)^2 rows, each compared where it is:
    no row is made for a pair. Only earlier lines of fitting lengths and parities are compared, and the first that is near ends it.
    """
    ids = held.select("line_id").union(open_lines.select("line_id")).distinct()
    full = lines.select("line_id", "check", "line", "first", "chars").join(ids, "line_id", "left_semi").withColumn("odd", parities(F.col("line")))
    full = keep(full, "crowded-lines")
    one = F.struct("line_id", "check", "line", "first", "chars", "odd")
    grouped = lambda df, name: df.join(full, "line_id").groupBy("sig", F.col("chunk").alias(f"{name}_chunk")).agg(F.collect_list(one).alias(name))
    met = keep(grouped(open_lines, "mine"), "crowded-open").join(keep(grouped(held, "others"), "crowded-held"), "sig")
    met = met.repartition(1 + blocks // BLOCKS, "sig", "mine_chunk", "others_chunk")

    def near(x: Column, m: Column) -> Column:
        flips = F.bit_count(m["odd"].bitwiseXOR(x["odd"]))
        fits = (m["first"] < x["first"]) & (F.abs(m["chars"] - x["chars"]) <= edits) & (flips <= 2 * edits)
        return F.when(fits, within(x["line"], m["line"], edits)).otherwise(F.lit(False))

    late = met.select(F.explode(F.filter("mine", lambda x: F.exists("others", lambda m: near(x, m)))).alias("x"))
    return keep(late.select("x.line_id", "x.check").distinct(), "crowded-late")


def near_lines(distinct: DataFrame, keep, edits: int = EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(line_id, check) of the distinct lines that have an earlier line within ``edits``.

    ``distinct`` has ``line``, ``chars``, ``line_id``, ``check``, ``first`` (a sortable position) and ``ord`` (a number
    that ascends with it, ties allowed).
    """
    long = distinct.filter(F.col("chars") >= near_chars)
    index = signatures(long, segments(edits), edits)
    # The earliest line of each signature, and how many it holds: one row a signature, however hot.
    pivots = index.groupBy("sig").agg(F.min_by("line_id", "ord").alias("pivot"), F.count("*").alias("n"))
    probes = signatures(long, probes_of(edits), edits).select("line_id", "own", "sig")
    hits = probes.join(pivots.hint("shuffle_hash"), "sig").filter(F.col("pivot") != F.col("line_id"))
    others = F.col("n") - 1 - F.col("own").cast("int")
    hits = keep(hits.select("line_id", "pivot", "sig", "n", (others > 0).alias("more")), "hits")
    a, b = F.least("line_id", "pivot"), F.greatest("line_id", "pivot")
    pairs = keep(hits.select(a.alias("a"), b.alias("b")).distinct(), "pairs")
    late = _verified(pairs, long, keep, "pivots", edits)

    unsettled = hits.filter("more").select("line_id", "sig", "n").distinct().join(late.select("line_id").hint("shuffle_hash"), "line_id", "left_anti")
    unsettled = keep(unsettled, "open")
    chunks = unsettled.groupBy("sig").agg(F.ceil(F.max("n") / CHUNK).cast("int").alias("chunks"))
    chunks = keep(chunks, "chunks")
    # Signatures of several chunks are crowded: there the lines travel along and are compared where they meet.
    blocks = chunks.filter("chunks > 1").agg(F.sum(F.col("chunks").cast("long") * F.col("chunks"))).first()[0] or 0
    chunks = F.broadcast(chunks) if chunks.count() <= BROADCAST_IDS else chunks.hint("shuffle_hash")
    placed = lambda df: df.join(chunks, "sig").select("sig", "line_id", F.pmod("line_id", "chunks").alias("chunk"), (F.col("chunks") > 1).alias("crowded"))
    held = keep(placed(index), "held")
    if blocks:
        late = late.unionByName(_late_in_blocks(placed(unsettled).filter("crowded"), held.filter("crowded"), long, keep, blocks, edits))
        unsettled, held = placed(unsettled).filter("not crowded"), held.filter("not crowded")
    ids = keep(held.select("line_id").union(unsettled.select("line_id")).distinct(), "ids-rest")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    marks = long.join(ids, "line_id", "left_semi").select("line_id", "chars", parities(F.col("line")).alias("odd"))
    marks = keep(marks, "marks")
    rows = held.join(marks, "line_id").groupBy("sig", "chunk").agg(F.collect_list(F.struct("line_id", "chars", "odd")).alias("lines"))
    rows = keep(rows, "rows")

    def worth(m: Column) -> Column:
        flips = F.bit_count(m["odd"].bitwiseXOR(F.col("odd")))
        return (m["line_id"] != F.col("line_id")) & (F.abs(m["chars"] - F.col("chars")) <= edits) & (flips <= 2 * edits)

    met = unsettled.select("line_id", "sig").join(marks, "line_id").join(rows, "sig").select("line_id", F.filter("lines", worth).alias("lines")).filter(F.size("lines") > 0)
    met = met.select("line_id", F.explode("lines.line_id").alias("other"))
    a, b = F.least("line_id", "other"), F.greatest("line_id", "other")
    rest = keep(met.select(a.alias("a"), b.alias("b")).distinct(), "rest")
    return late.unionByName(_verified(rest, long, keep, "rest", edits)).distinct()


def repeated_lines(docs: DataFrame, keep, edits: int = EDITS, exact_chars: int = EXACT_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(_key, gone): for each document that loses lines, the sorted numbers of those lines.

    ``docs`` has ``_key``, ``doc_id`` and ``text``.
    """
    key = _key(F.col("l"))
    lines = docs.select("_key", "doc_id", F.posexplode(lines_of(F.col("text"))).alias("no", "l")).select("_key", F.struct("doc_id", "_key", "no").alias("at"), key.alias("line"))
    lines = lines.filter(F.length("line") >= exact_chars)
    # Two hashes tell lines apart where their texts do not travel.
    ids = F.xxhash64("line").alias("line_id"), F.xxhash64(F.lit(1), F.col("line")).alias("check")
    number = F.col("first.doc_id").cast("long") if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") else F.lit(0)
    distinct = lines.groupBy("line").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    distinct = distinct.select("line", "first", "n", *ids, F.length("line").alias("chars"), F.coalesce(number, F.lit(-(1 << 63))).cast("long").alias("ord"))
    distinct = keep(distinct, "distinct")
    near = near_lines(distinct, keep, edits, max(near_chars, exact_chars)).withColumn("near", F.lit(True))
    suspects = distinct.select("line_id", "check", "first", "n").join(near, ["line_id", "check"], "left").filter((F.col("n") > 1) | F.col("near"))
    suspects = keep(suspects.select("line_id", "check", "first", F.coalesce("near", F.lit(False)).alias("near")), "suspects")
    placed = lines.select("_key", "at", *ids)
    gone = placed.join(suspects, ["line_id", "check"]).filter(F.col("near") | (F.col("at") > F.col("first")))
    return gone.groupBy("_key").agg(F.array_sort(F.collect_set("at.no")).alias("gone"))


def dedup_lines(docs: DataFrame, keep, edits: int = EDITS, exact_chars: int = EXACT_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """Add ``n_lines``, ``n_removed`` and ``kept_text`` (the remaining lines) to the rows of ``docs`` (doc_id, text, ...).

    ``keep`` stores tables between steps. A null text has 0 lines and stays null; an empty one has one line,
    which stays. Rows with equal ids are ordered by a hash of id and text, a null id comes first; rows that
    repeat id and text both are one document, which keeps its first lines. Very long texts and lines are taken
    whole. Other columns pass through whatever their names; the three added names replace columns of the table.
    """
    aside = Aside(docs, ("doc_id", "text"), ("n_lines", "n_removed", "kept_text"))
    docs = aside.df.withColumn("_key", F.xxhash64("doc_id", "text"))
    gone = repeated_lines(docs.select("_key", "doc_id", "text"), keep, edits, exact_chars, near_chars)
    joined = docs.join(gone.hint("shuffle_hash"), "_key", "left")

    def left(lines: Column) -> Column:
        """The lines between those that go: as many slices as lines that go, and one."""
        begin = lambda g: F.when(g == 0, F.lit(0)).otherwise(F.get("gone", g - 1) + 1)
        end = lambda g: F.coalesce(F.get("gone", g), F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda g: F.slice(lines, begin(g) + 1, end(g) - begin(g)))), "\n")

    lines = lines_of(F.col("text"))
    return aside.back(
        joined,
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            "n_removed": F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long"),
            "kept_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, left)),
        },
    )
