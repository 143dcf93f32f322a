"""N-gram Jaccard join with set-relation skipping.

Documents become sets of hashed five-word shingles. Sets that share 80 of 100 of their union share a
shingle among the first n - ceil(0.8 n) + 1 of each in any common order; the order here is by rarity,
estimated in a counting sketch of fixed size, so that lists stay short. A list of the index holds the sets
that have a shingle in that prefix, sorted by size; its blocks are skipped when their sizes or positions
cannot reach the overlap.

Sets related to one another are not compared again and again: first each list proposes neighbours at a few
distances, which links nearly all of a group of near copies; a few rounds propose some members of each
component to the others; then only pairs from different components are proposed, so no link between
components is missed and no group's pairs are enumerated. When a set's
overlaps are computed, those of the highly similar set before it are taken over and corrected by the few
shingles in which the two differ.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import mixed, shingle_sets

PERCENT = 80
SKETCH_BITS = 22  # the sketch is one byte a counter: 4 MB at most, whatever the corpus
CHUNK = 1 << 14
STRIDES = (1, 2, 5)
CELLS = 128  # cells of the counts that bound an overlap before sets are sent
BLOCK = 64
FEW = 3  # members of a component that a list proposes in a round
ROUNDS = 1
SETS = 1536  # sets of a block in the last comparison: a set is sent once to each block that holds candidates of it


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection of sets of n and m with 100 * intersection >= PERCENT * union."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def fingerprint(h: np.ndarray) -> int:
    """Hash of a set; 0 is the empty set."""
    if not len(h):
        return 0
    total = int(mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) * 2 + 1
    return int(np.array(total & 0xFFFFFFFFFFFFFFFF, np.uint64).view(np.int64)) or 1


def cell_counts(h: np.ndarray) -> bytes:
    """How many members of a set fall into each cell of hash space, a byte each; nothing where a byte is too small."""
    counts = np.bincount((h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def within_reach(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose cell counts allow the overlap: no cell shares more than its smaller count."""
    left = classes.select(F.col("fp").alias("a"), F.col("cells").alias("ca"))
    right = classes.select(F.col("fp").alias("b"), F.col("cells").alias("cb"))

    def run(batches):
        for batch in batches:
            ca, cb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.array([not x or not y for x, y in zip(ca, cb, strict=True)], bool)
            known = np.flatnonzero(~ok)
            if len(known):
                x, y = (np.frombuffer(b"".join(c[k] for k in known), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in (ca, cb))
                ok[known] = np.minimum(x, y).sum(1) >= overlap_needed(x.sum(1), y.sum(1))
            yield _batch(["a", "b"], batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long")


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def signatures(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """For each row its id, set size and fingerprint; besides, each task's part of the counting sketch."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "fp", "cells", "chunk", "part"]
        for batch in batches:
            sizes, prints, cells, seen = [], [], [], [np.zeros(0, np.uint64)]
            for h in shingle_sets(batch.column(1)):
                sizes.append(len(h))
                prints.append(fingerprint(h))
                cells.append(cell_counts(h))
                seen.append(h >> np.uint64(64 - bits))
            place, times = np.unique(np.concatenate(seen), return_counts=True)
            counts[place.astype(np.int64)] += times.astype(np.uint32)
            none = [None] * len(sizes)
            yield _batch(names, batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(cells, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary()))
        parts = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
        none = [None] * len(parts)
        yield _batch(names, *[pa.array(none, pa.int64())] * 3, pa.array(none, pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp long, cells binary, chunk int, part binary")


def rarity(parts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Rank of each counter, one byte: a quarter of a doubling a step. Fixed in size, so it may reach the driver."""

    def add(table):
        total = np.zeros(CHUNK, np.float64)
        for part in table.column("part"):
            total += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        ranks = np.minimum(4 * np.log2(1 + total), 255).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([ranks.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.uint8).reshape(-1, CHUNK)
    for r in parts.select("chunk", "part").groupBy("chunk").applyInArrow(add, "chunk int, part binary").collect():
        out[r.chunk] = np.frombuffer(r.part, np.uint8)
    return out.reshape(-1)


def by_rarity(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the common order, rarest first."""
    bits = len(ranks).bit_length() - 1
    return h[np.argsort(ranks[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")]


def prefixes(docs: DataFrame, ranks) -> DataFrame:
    """Index entries (token, fp, n, pos). A task passes over sets that it has seen before."""

    def run(batches):
        seen = set()
        for batch in batches:
            tokens, prints, sizes, places = [], [], [], []
            for h in shingle_sets(batch.column(0)):
                fp = fingerprint(h)
                if fp in seen or not len(h):
                    continue
                seen.add(fp)
                k = prefix_length(len(h))
                tokens.append(by_rarity(h, ranks.value)[:k])
                prints.append(np.full(k, fp, np.int64))
                sizes.append(np.full(k, len(h), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                yield _batch(["token", "fp", "n", "pos"], *(pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], prints, sizes, places)))

    return docs.select("text").mapInArrow(run, "token long, fp long, n int, pos int")


def _possible(n1, p1, n2, p2) -> np.ndarray:
    """Whether the sizes, and the positions of the shared shingle, allow the overlap."""
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return most >= overlap_needed(n1, n2)


class _Lists:
    """Cuts batches sorted by token, size and fingerprint into whole lists."""

    def __init__(self, batches, names):
        self.batches, self.names = batches, names

    def __iter__(self):
        parts = []  # pieces that end in a list which may go on
        for batch in self.batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(self.names))]
            token = now[0]
            if not len(token):
                continue
            if parts and token[-1] == parts[-1][0][-1]:
                parts.append(now)  # one list, still: joined once, when it ends
                continue
            cut = int(np.searchsorted(token, token[-1]))
            if parts or cut:
                yield self.distinct(self.joined([*parts, [x[:cut] for x in now]]))
            parts = [[x[cut:] for x in now]]
        if parts:
            yield self.distinct(self.joined(parts))

    @staticmethod
    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    @staticmethod
    def distinct(columns):
        """Without the entries of a set that several tasks have seen."""
        token, fp = columns[0], columns[1]
        new = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
        return [x[new] for x in columns]


def neighbours(entries: DataFrame) -> DataFrame:
    """From whole lists: pairs (a, b) at the strides, and the entries of lists that the strides do not exhaust."""

    def run(batches):
        names = ["a", "b", "token", "n", "pos"]
        for token, fp, n, pos in _Lists(batches, ("token", "fp", "n", "pos")):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            found = []
            for stride in STRIDES:
                i = np.flatnonzero(token[stride:] == token[:-stride])
                j = i + stride
                ok = _possible(n[i], pos[i], n[j], pos[j])
                found.append(np.stack([np.minimum(fp[i], fp[j])[ok], np.maximum(fp[i], fp[j])[ok]]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            if pairs.shape[1]:
                none = pa.nulls(pairs.shape[1])
                yield _batch(names, pa.array(pairs[0]), pa.array(pairs[1]), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()))
            _, place, size = np.unique(token, return_inverse=True, return_counts=True)
            long = size[place] > 3
            if long.any():
                none = pa.nulls(int(long.sum()), pa.int64())
                yield _batch(names, pa.array(fp[long]), none, pa.array(token[long]), pa.array(n[long].astype(np.int32)), pa.array(pos[long].astype(np.int32)))

    return entries.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(run, "a long, b long, token long, n int, pos int")


def bridges(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) that may join components: from each list a few members of each, at strides over the components."""

    def run(batches):
        for token, fp, n, pos, comp in _Lists(batches, ("token", "fp", "n", "pos", "comp")):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            by = mixed(fp.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF))
            order = np.lexsort((by, mixed(comp.view(np.uint64) + np.uint64(turn)), token))
            token, fp, n, pos, comp = (x[order] for x in (token, fp, n, pos, comp))
            new = np.r_[True, (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])]
            rank = np.arange(len(token)) - np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            few = rank < FEW
            token, fp, n, pos, comp = (x[few] for x in (token, fp, n, pos, comp))
            found = []
            for stride in range(1, 2 * FEW + 8):
                i = np.flatnonzero((token[stride:] == token[:-stride]) & (comp[stride:] != comp[:-stride]))
                j = i + stride
                ok = _possible(n[i], pos[i], n[j], pos[j])
                found.append(np.stack([np.minimum(fp[i], fp[j])[ok], np.maximum(fp[i], fp[j])[ok]]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            if pairs.shape[1]:
                yield _batch(["a", "b"], pa.array(pairs[0]), pa.array(pairs[1]))

    return entries.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(run, "a long, b long")


def across(entries: DataFrame) -> DataFrame:
    """Candidates (z, xs) of different components from lists (token, fp, n, pos, comp), by blocks of positions.

    A set's candidates in a list are one row, whatever their number; z is the one whose component is smaller.
    """

    def run(batches):
        for token, fp, n, pos, comp in _Lists(batches, ("token", "fp", "n", "pos", "comp")):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            found: dict[int, list] = {}
            for lo, hi in zip(begins, np.r_[begins[1:], len(token)], strict=True):
                if (comp[lo:hi] == comp[lo]).all():
                    continue
                for a in range(lo, hi, BLOCK):
                    ra = slice(a, min(a + BLOCK, hi))
                    for b in range(a, hi, BLOCK):
                        rb = slice(b, min(b + BLOCK, hi))
                        # sizes ascend: beyond this block no set is small enough
                        if PERCENT * n[b] > 100 * n[ra].max():
                            break
                        top = min(pos[ra].max(), pos[rb].max()) + min((n[ra] - pos[ra]).max(), (n[rb] - pos[rb]).max())
                        if top < overlap_needed(n[ra].min(), n[rb].min()):
                            continue  # no position in these blocks leaves enough
                        ok = _possible(n[ra][:, None], pos[ra][:, None], n[rb][None], pos[rb][None])
                        for side, left, right in ((ok & (comp[ra][:, None] < comp[rb][None]), ra, rb), (ok.T & (comp[rb][:, None] < comp[ra][None]), rb, ra)):
                            for k in np.flatnonzero(side.any(axis=1)):
                                found.setdefault(int(fp[left][k]), []).append(fp[right][side[k]])
            if found:
                yield _batch(["z", "xs"], pa.array(list(found), pa.int64()), pa.array([np.unique(np.concatenate(x)) for x in found.values()], pa.list_(pa.int64())))

    return entries.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(run, "z long, xs array<long>")


def named_in(candidates: DataFrame) -> DataFrame:
    """The ids (fp) that candidates (z, xs) name, each once a batch: pairs are never rows."""

    def run(batches):
        for batch in batches:
            ids = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()]))
            yield _batch(["fp"], pa.array(ids, pa.int64()))

    return candidates.select("z", "xs").mapInArrow(run, "fp long").distinct()


def _block_of(fp: np.ndarray, count: int) -> np.ndarray:
    return (mixed(fp.view(np.uint64)) % np.uint64(count)).astype(np.int32)


def _visits(candidates: DataFrame, count: int) -> DataFrame:
    """(blk, z, xs): each z visits the blocks that hold candidates of it, once each."""

    def run(batches):
        for batch in batches:
            blk, z, xs = [], [], []
            for own, many in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                many = many.values.to_numpy()
                where = _block_of(many, count)
                for k in np.unique(where):
                    blk.append(int(k))
                    z.append(own)
                    xs.append(many[where == k])
            yield _batch(["blk", "z", "xs"], pa.array(blk, pa.int32()), pa.array(z, pa.int64()), pa.array(xs, pa.list_(pa.int64())))

    return candidates.select("z", "xs").mapInArrow(run, "blk int, z long, xs array<long>")


def _placed(rows: DataFrame, count: int) -> DataFrame:
    """(blk, x, hx) of (fp, data)."""

    def run(batches):
        for batch in batches:
            yield _batch(["blk", "x", "hx"], pa.array(_block_of(batch.column(0).to_numpy(), count), pa.int32()), *batch.columns)

    return rows.mapInArrow(run, "blk int, x long, hx binary")


def reachable_across(candidates: DataFrame, cells: DataFrame, count: int) -> DataFrame:
    """Candidates (z, xs) without those whose cell counts cannot reach the overlap; ``cells`` (fp, cells) of all that are named."""

    def judge(left, right):
        ids = right.column("x").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        known = [right.column("hx")[int(k)].as_py() for k in order]
        full = np.array([len(c) == CELLS for c in known], bool)
        counts = np.frombuffer(b"".join(c if len(c) == CELLS else bytes(CELLS) for c in known), np.uint8).reshape(-1, CELLS).astype(np.int64)
        sizes = counts.sum(1)
        z, kept = [], []
        for own, xs, cz in zip(left.column("z").to_pylist(), left.column("xs"), left.column("cz").to_pylist(), strict=True):
            many = xs.values.to_numpy()
            at = np.searchsorted(ids, many)
            if len(cz) == CELLS:
                mine = np.frombuffer(cz, np.uint8).astype(np.int64)
                ok = ~full[at] | (np.minimum(counts[at], mine).sum(1) >= overlap_needed(sizes[at], mine.sum()))
                many = many[ok]
            if len(many):
                z.append(own)
                kept.append(many)
        return pa.table({"z": pa.array(z, pa.int64()), "xs": pa.array(kept, pa.list_(pa.int64()))})

    dealt = _visits(candidates, count).join(cells.select(F.col("fp").alias("z"), F.col("cells").alias("cz")), "z")
    return dealt.groupBy("blk").cogroup(_placed(cells.select("fp", "cells"), count).groupBy("blk")).applyInArrow(judge, "z long, xs array<long>")


def linked_across(candidates: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Links (a, b) among candidates (z, xs): sets are dealt to ``count`` blocks of some hundred, and each z visits
    the blocks that hold candidates of it, once each. Pairs are never rows."""

    def judge(left, right):
        ids = right.column("x").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        own = [np.frombuffer(h, np.uint64) for h in right.column("hx").to_pylist()]
        own = [own[k] for k in order]
        sizes = np.array([len(h) for h in own], np.int64)
        owner = np.repeat(np.arange(len(own)), sizes)
        known, place = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_inverse=True)
        a, b = [], []
        for z, xs, hz in zip(left.column("z").to_pylist(), left.column("xs"), left.column("hz").to_pylist(), strict=True):
            target = np.frombuffer(hz, np.uint64)
            at = np.searchsorted(ids, xs.values.to_numpy())
            if len(at) > 16:  # many candidates share their shingles: each is looked up once for all of them
                spot = np.minimum(np.searchsorted(target, known), len(target) - 1)
                common = np.bincount(owner, (target[spot] == known)[place], len(own)).astype(np.int64)[at]
            else:
                common = np.array(_overlaps(target, [own[k] for k in at]))
            ok = 100 * common >= PERCENT * (len(target) + sizes[at] - common)
            a += [z] * int(ok.sum())
            b += ids[at[ok]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = _visits(candidates, count).join(sets.select(F.col("fp").alias("z"), F.col("h").alias("hz")), "z")
    return dealt.groupBy("blk").cogroup(_placed(sets.select("fp", "h"), count).groupBy("blk")).applyInArrow(judge, "a long, b long")


def _overlaps(target: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """|target & x| for each x; a set much like the one before takes over its answer and corrects it."""

    def inside(x):
        if not len(x) or not len(target):
            return 0
        at = np.minimum(np.searchsorted(target, x), len(target) - 1)
        return int((target[at] == x).sum())

    out, before = [], None
    for x in others:
        if before is not None and abs(len(x) - len(before)) * 8 < len(x):
            both = np.concatenate([before, x])
            order = np.argsort(both, kind="stable")
            ranked = both[order]
            twice = np.r_[ranked[1:] == ranked[:-1], False]
            single = ~(twice | np.r_[False, twice[:-1]])
            lone, fresh = ranked[single], order[single] >= len(before)
            if len(lone) * 4 < len(x):
                out.append(out[-1] - inside(lone[~fresh]) + inside(lone[fresh]))
                before = x
                continue
        out.append(inside(x))
        before = x
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. ``sets`` has (fp, h); each side's set is sent to its pairs."""
    left = sets.select(F.col("fp").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("fp").alias("b"), F.col("h").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ha, hb = batch.column(2), batch.column(3)
            ok = np.zeros(len(a), bool)
            begins = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
            for lo, hi in zip(begins, np.r_[begins[1:], len(b)].astype(int), strict=True):
                target = np.frombuffer(hb[int(lo)].as_py(), np.uint64)
                others = [np.frombuffer(ha[k].as_py(), np.uint64) for k in range(lo, hi)]
                common = np.array(_overlaps(target, others))
                union = len(target) + np.array([len(x) for x in others]) - common
                ok[lo:hi] = 100 * common >= PERCENT * union
            yield _batch(["a", "b"], pa.array(a[ok]), pa.array(b[ok]))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """(fp, h) of the sets whose holders (doc_id, fp) are given."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            prints = pa.array([fingerprint(h) for h in sets], pa.int64())
            yield _batch(["fp", "want", "h"], prints, batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary()))

    ids = holders.select("doc_id", F.col("fp").alias("want")).hint("shuffle_hash")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("want", "text")
    return found.mapInArrow(run, "fp long, want long, h binary").filter("fp = want").select("fp", "h").dropDuplicates(["fp"])


def similar_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Link ``docs`` (doc_id, text) by shingle sets: doc_id, n_shingles, component_id for each row.

    Texts that are null or have no word have the empty set and link with nothing; equal sets link; rows that
    repeat an id count as rows; a row without an id links only through an equal set; an empty
    table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    done = scratch.keep(signatures(docs), "signatures")
    ranks = spark.sparkContext.broadcast(rarity(done.filter("chunk is not null")))
    rows = done.filter("chunk is null").select("doc_id", "n", "fp", "cells")
    classes = scratch.keep(rows.filter("fp != 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("cells").alias("cells")), "classes")
    near = scratch.keep(neighbours(prefixes(docs, ranks)), "near")
    pairs = scratch.keep(near.filter("b is not null").select("a", "b").distinct(), "pairs1")
    long = near.filter("b is null").select("token", F.col("a").alias("fp"), "n", "pos")

    def link(todo: DataFrame, name: str) -> DataFrame:
        todo = scratch.keep(within_reach(todo, classes), f"reach-{name}")
        wanted = todo.select(F.col("a").alias("fp")).union(todo.select(F.col("b").alias("fp"))).distinct()
        holders = scratch.keep(classes.drop("cells").join(wanted, "fp", "left_semi"), f"holders-{name}")
        sets = scratch.keep(_sets(docs, holders), f"sets-{name}")
        links = scratch.keep(verified(todo, sets), f"links-{name}")
        scratch.drop(f"sets-{name}")
        return links

    def labelled(named: DataFrame) -> DataFrame:
        return long.join(named, long["fp"] == named["id"], "left").select("token", "fp", "n", "pos", F.coalesce("root", "fp").alias("comp"))

    links, tested = link(pairs, "1"), pairs
    named = connected_components(links, scratch, "first")
    for turn in range(ROUNDS):
        more = scratch.keep(bridges(labelled(named), turn).distinct().join(tested, ["a", "b"], "left_anti"), f"bridge{turn}")
        fresh = link(more, f"bridge{turn}")
        tested = tested.unionByName(more)
        if not fresh.limit(1).count():
            break
        links = links.unionByName(fresh)
        named = connected_components(links, scratch, f"bridged{turn}")
    rest = across(labelled(named)).groupBy("z").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("xs"))
    rest = scratch.keep(rest, "rest")
    cells = scratch.keep(classes.select("fp", "cells").join(named_in(rest), "fp", "left_semi"), "cells-rest")
    many = cells.count()
    if many:  # counts by cell turn most candidates away before any set is sent
        rest = scratch.keep(reachable_across(rest, cells, 1 + many // SETS), "reach-rest")
    holders = scratch.keep(classes.drop("cells").join(named_in(rest), "fp", "left_semi"), "holders-rest")
    many = holders.count()
    if many:
        sets = scratch.keep(_sets(docs, holders), "sets-rest")
        links = links.unionByName(scratch.keep(linked_across(rest, sets, 1 + many // SETS), "links-rest"))
        named = connected_components(links, scratch, "last")
    rooted = classes.drop("cells").join(named.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.keep(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    answer = scratch.keep(rooted.join(least, "root").select("fp", "least"), "answer")
    out = rows.drop("cells").join(answer, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
