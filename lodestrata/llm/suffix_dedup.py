"""Repeated passages by sorted suffixes: front-coded runs, exchanged and merged with known prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Not every suffix needs to be sorted. In each string of LENGTH bytes the 16-byte piece with the least hash is
an anchor, so equal strings hold equal anchors at equal places. Blocks of documents first ask, by hash,
which of their anchors occur in more than one document; only suffixes at those are sorted. Each block
sorts its suffixes (50 bytes from the anchor, then the 34 before it, nearest first; equal ones once, with
their smallest document), front-codes the run and sends it in pieces by key range. A range merges its runs
with a loser tree that compares only beyond the common prefixes it knows, and the common prefix lengths of
the merged order tell which strings are equal. For each suffix a bit for each string around its anchor goes
back to the block: whether a document smaller than the suffix's own holds it. The block marks the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.blocks import block_count, cut, in_blocks, pack, range_bits, raw, squeezed, unsqueezed
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import mixed

LENGTH = 50
GRAM = 16
SHIFTS = LENGTH - GRAM + 1  # places of an anchor in a string
LEFT = LENGTH - GRAM
WIDTH = LENGTH + LEFT + 2  # of a suffix row
CHUNK = 1 << 16  # strings hashed at a time: their arrays stay in the processor's cache
NOBODY = np.iinfo(np.int64).max
SAMPLE = 32  # suffixes of a block from which the key ranges are chosen

ASK = "rng int, blk int, keys binary, own binary, sample binary"
ANSWER = "rng int, blk int, many binary"
RUN = "rng int, blk int, common binary, tails binary, docs binary"
HITS = "rng int, blk int, strings binary"


def _numbers(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte: the upper ones are nearly all zero and compress."""
    return squeezed(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _from_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueezed(data, np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


def _flags(x: np.ndarray) -> bytes:
    return squeezed(np.packbits(x))


def _from_flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(unsqueezed(data, np.uint8), count=count).astype(bool)


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of ``width``; one value for each window that fits."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie end to end: the least of each string's 16-byte pieces."""
    n = len(flat)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n, bool)  # where a string begins that does not reach into the next text
    for k in range(1, LENGTH):
        whole[starts[1:][starts[1:] >= k] - k] = False
    places, hashes = [], []
    pad = np.zeros(SHIFTS - 1, np.uint64)
    for at in range(0, n - LENGTH + 1, CHUNK):
        part = flat[at : at + CHUNK + LENGTH - 1]
        v = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)).astype(np.uint64)
        h = mixed(v[:-8] * np.uint64(0x9E3779B97F4A7C15) + mixed(v[8:]))
        least = _extreme(h, SHIFTS, np.minimum) * whole[at : at + len(part) - LENGTH + 1]
        chosen = np.flatnonzero(_extreme(np.concatenate([pad, least, pad]), SHIFTS, np.maximum) == h)
        places.append(chosen + at)
        hashes.append(h[chosen])
    places, keep = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[keep]


class Block:
    """One block's documents and their bytes end to end; by id, then text, so that each step sees the same places."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").combine_chunks(), table.column("text").cast(pa.large_binary()).combine_chunks()
        order = pc.sort_indices(pa.table({"id": ids, "text": texts}), [("id", "ascending"), ("text", "ascending")])
        self.null_ids = ids.take(order)
        self.ids = self.null_ids.fill_null(NOBODY).to_numpy()
        texts = texts.fill_null(b"").take(order)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.starts = ends - ends[0]
        self.flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


class Anchors:
    """The anchors of a block, by hash: places, documents' ids, and the distinct hashes."""

    def __init__(self, block: Block):
        self.block = block
        place, hashes = anchors(block.flat, block.starts)
        doc = np.repeat(np.arange(len(block.ids)), np.diff(np.searchsorted(place, block.starts)))
        order = np.argsort(hashes)
        self.place, self.doc, hashes = place[order], doc[order], hashes[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.keys = hashes[self.first]
        self.key = np.cumsum(new) - 1

    def several(self) -> np.ndarray:
        """Which hashes occur under several ids of this block."""
        ids = self.block.ids[self.doc]
        return np.minimum.reduceat(ids, self.first) != np.maximum.reduceat(ids, self.first) if len(ids) else np.zeros(0, bool)

    def suffixes(self, repeated: np.ndarray):
        """(rows, least, times, places, above) of the suffixes at the anchors with a repeated hash.

        ``rows``: distinct sorted suffixes, the 50 bytes from the anchor, the 34 before it in reverse, and how many of
        both are real; ``least``: their least documents; ``times``: how many places have the row.
        ``places``: these, row by row; ``above``: whether their document is a larger one than the row's least.
        """
        at, doc = self.place[repeated[self.key]], self.doc[repeated[self.key]]
        if not len(at):
            return np.zeros((0, WIDTH), np.uint8), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
        block = self.block
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(LEFT, np.uint8), block.flat, np.zeros(LENGTH, np.uint8)]), LEFT + LENGTH)[at]
        right, left = np.minimum(block.starts[doc + 1] - at, LENGTH), np.minimum(at - block.starts[doc], LEFT)
        rows = np.empty((len(at), WIDTH), np.uint8)
        rows[:, :LENGTH], rows[:, LENGTH:-2] = around[:, LEFT:], around[:, LEFT - 1 :: -1]
        rows[:, -2], rows[:, -1] = right, left
        for part, real, full in ((rows[:, :LENGTH], right, LENGTH), (rows[:, LENGTH:-2], left, LEFT)):
            short = np.flatnonzero(real < full)
            part[short] *= np.arange(full) < real[short, None]
        del around
        order = np.argsort(rows.view(f"S{WIDTH}")[:, 0])
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        ids = block.ids[doc[order]]
        least, times = np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(rows)])
        return rows[first], least, times, at[order], ids > np.repeat(least, times)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; the first has 0."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]


def front_coded(rows: np.ndarray, coded=pack) -> tuple[bytes, bytes]:
    """A sorted run as common prefix lengths and what follows them."""
    common = common_prefixes(rows)
    tails = rows[np.arange(rows.shape[1])[None] >= common[:, None]]
    return coded(common.astype(np.uint8)), coded(tails)


def decoded(common: np.ndarray, tails: bytes, width: int) -> list[bytes]:
    out, before, at = [], b"", 0
    for k in common.tolist():
        size = width - k
        before = before[:k] + tails[at : at + size]
        out.append(before)
        at += size
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (strings, prefix lengths): the run and place of each output, and its prefix length.

    A node of the loser tree holds a run's head and its common prefix with the last output that passed there.
    Of two heads with different lengths the longer is smaller, and the loser's length stays right; only equal
    lengths compare characters, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads = [0] * len(runs)
    key = [strings[0] if strings else b"" for strings, _ in runs] + [b""] * (size - len(runs))
    # a run that is at its end has a negative length, each its own: it loses, and is never compared
    known = [0 if k < len(runs) and runs[k][0] else -1 - k for k in range(size)]
    losers = [-1] * size

    def rise(run: int) -> int:
        """Play from the run's leaf up: the winner, or -1 where the run waits for its first opponent."""
        x, k, node = key[run], known[run], (run + size) >> 1
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = run
                return -1
            length = known[other]
            if length > k:
                losers[node] = run
                run, x, k = other, key[other], length
            elif length == k:
                y = key[other]
                if x == y:
                    known[other] = len(x)
                else:
                    j = k
                    while x[j : j + 8] == y[j : j + 8]:
                        j += 8
                    if x[j : j + 4] == y[j : j + 4]:
                        j += 4
                    if x[j : j + 2] == y[j : j + 2]:
                        j += 2
                    if x[j : j + 1] == y[j : j + 1]:
                        j += 1
                    if x[j : j + 1] < y[j : j + 1]:
                        known[other] = j
                    else:
                        known[run] = j
                        losers[node] = run
                        run, x = other, y
            node >>= 1
        return run

    champion = 0
    for k in range(size):
        champion = rise(k)
    out_run, out_place, out_common = [], [], []
    while known[champion] >= 0:
        at = heads[champion]
        out_run.append(champion)
        out_place.append(at)
        out_common.append(known[champion])
        heads[champion] = at = at + 1
        strings, common = runs[champion]
        if at < len(strings):
            key[champion], known[champion] = strings[at], common[at]
        else:
            known[champion] = -1 - champion
        champion = rise(champion)
    return out_run, out_place, out_common


def _fits(rows: np.ndarray) -> np.ndarray:
    """For each suffix, a bit for each shift whose string lies within the text."""
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    return ((1 << (left + 1)) - 1) & -(1 << (LENGTH - np.minimum(right, LENGTH)))


def least_documents(rows: np.ndarray, common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each shift a and each merged suffix, the least document that holds the string starting a bytes before the anchor."""
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    out = np.full((SHIFTS, len(rows)), NOBODY)
    before = np.zeros(len(rows), np.uint64)
    for a in range(SHIFTS):
        if a:
            before = before * np.uint64(0xD1342543DE82EF95) + rows[:, LENGTH + a - 1] + np.uint64(1)
        fits = np.flatnonzero((left >= a) & (right >= LENGTH - a))
        if not len(fits):
            continue
        same_right = np.cumsum(common < LENGTH - a).astype(np.uint64)
        group = mixed(same_right * np.uint64(0x9E3779B97F4A7C15) + mixed(before))[fits]
        order = np.argsort(group)
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[a, fits[order]] = np.repeat(np.minimum.reduceat(docs[fits[order]], first), np.diff(np.r_[first, len(fits)]))
    return out


def repeated_strings(rows: np.ndarray, common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each merged suffix, a bit for each shift whose string a document smaller than its own holds, too."""
    new = common < WIDTH
    first = np.flatnonzero(new)
    row = np.cumsum(new) - 1
    rows, common, least = rows[first], common[first], np.minimum.reduceat(docs, first)
    out = np.where(least[row] < docs, _fits(rows)[row], 0)
    # an anchor with one suffix has no other string; the suffixes of the rest are compared shift by shift
    head = common < GRAM
    crowd = ~(head & np.r_[head[1:], True])
    some = np.flatnonzero(crowd[row])
    if len(some):
        place = (np.cumsum(crowd) - 1)[row[some]]
        for a, found in enumerate(least_documents(rows[crowd], common[crowd], least[crowd])):
            out[some] |= (found[place] < docs[some]).astype(np.int64) << a
    return out


def _several(table: pa.Table) -> pa.Table:
    """One range of hashes: which occur in several documents."""
    rows = table.select(["rng", "blk", "keys", "own"]).to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = times > 1
    np.logical_or.at(several, place, np.concatenate([_from_flags(r["own"], len(k)) for r, k in zip(rows, keys, strict=True)]))
    got = several[place]
    ends = np.cumsum([len(k) for k in keys])
    many = [_flags(got[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)]
    return pa.table({"rng": pa.array([r["rng"] for r in rows], pa.int32()), "blk": pa.array([r["blk"] for r in rows], pa.int32()), "many": pa.array(many, pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """One key range: merge the blocks' runs and tell each suffix which of its strings repeat."""
    rows = table.to_pylist()
    runs = []
    for r in rows:
        common = unsqueezed(r["common"], np.uint8)
        runs.append((decoded(common, unsqueezed(r["tails"], np.uint8).tobytes(), WIDTH), common.tolist()))
    docs = [_from_numbers(r["docs"]) for r in rows]
    sizes = np.r_[0, np.cumsum([len(d) for d in docs])]
    run, place, common = merge_runs(runs)
    merged = np.frombuffer(b"".join([runs[a][0][b] for a, b in zip(run, place, strict=True)]), np.uint8).reshape(-1, WIDTH)
    position = sizes[np.array(run, np.int64)] + np.array(place, np.int64)
    strings = np.empty(len(merged), np.int64)
    strings[position] = repeated_strings(merged, np.array(common), np.concatenate(docs)[position])
    out = [_numbers(strings[sizes[k] : sizes[k + 1]]) for k in range(len(rows))]
    return pa.table({"rng": pa.array([r["rng"] for r in rows], pa.int32()), "blk": pa.array([r["blk"] for r in rows], pa.int32()), "strings": pa.array(out, pa.binary())})


def _bits(table: pa.Table, block_keys: np.ndarray, bits: int) -> np.ndarray:
    """The block's answers, in the order of its keys."""
    edges = cut(block_keys, bits)
    out = np.zeros(len(block_keys), bool)
    for r in table.select(["rng", "many"]).to_pylist():
        if r["many"] is not None:
            lo, hi = edges[r["rng"]], edges[r["rng"] + 1]
            out[lo:hi] = _from_flags(r["many"], int(hi - lo))
    return out


def _begins(block: Block, got: pa.Table, bits: int) -> np.ndarray:
    """For each byte of the block, whether a string begins there that a smaller document holds."""
    found = Anchors(block)
    rows, _, times, places, above = found.suffixes(_bits(got, found.keys, bits))
    told = sorted((r["rng"], r["strings"]) for r in got.select(["rng", "strings"]).to_pylist() if r["strings"] is not None)
    strings = np.concatenate([np.zeros(0, np.int64), *[_from_numbers(x) for _, x in told]])
    # where the row's least document is smaller than the place's, it holds all strings of the place
    strings = np.where(above, np.repeat(_fits(rows), times), np.repeat(strings, times))
    begins = np.zeros(len(block.flat), bool)
    for a in range(SHIFTS):
        begins[places[strings >> a & 1 == 1] - a] = True
    return begins


def _range_of(rows: np.ndarray, splitters: list[bytes]) -> np.ndarray:
    """Where each key range begins in sorted rows, and the end; equal anchors stay together."""
    heads = np.ascontiguousarray(rows[:, :GRAM]).view(">u8").astype(np.uint64)
    edges = [0]
    for s in splitters:
        a, b = (int.from_bytes(s[:8], "big"), int.from_bytes(s[8:16], "big"))
        lo, hi = np.searchsorted(heads[:, 0], np.uint64(a)), np.searchsorted(heads[:, 0], np.uint64(a), "right")
        edges.append(int(lo + np.searchsorted(heads[lo:hi, 1], np.uint64(b))))
    return np.array([*edges, len(rows)])


def remove_repeats(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """Remove repeated bytes from ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``with_text`` adds ``spans`` (start and end of each removed run) and ``kept`` (the other bytes). A null
    text is empty; texts of under 50 bytes lose nothing; rows with the same id never remove from one another;
    a null id counts as larger than all others; an empty table gives an empty table; other columns are ignored.
    """
    count = block_count(docs)
    bits = range_bits(count)
    parts = in_blocks(docs, count)

    def ask(table):
        block = Block(table)
        blk = table.column("blk")[0].as_py()
        found = Anchors(block)
        keys, own = found.keys, found.several()
        edges = cut(keys, bits)
        picked = found.place[np.linspace(0, len(found.place) - 1, SAMPLE).astype(np.int64)] if len(found.place) else []
        sample = b"".join(block.flat[p : p + GRAM].tobytes() for p in picked)
        out = {"rng": [], "blk": [], "keys": [], "own": [], "sample": []}
        for r in range(len(edges) - 1):
            lo, hi = edges[r], edges[r + 1]
            for k, v in zip(out, (r, blk, raw(keys[lo:hi]), _flags(own[lo:hi]), sample if r == 0 else b""), strict=True):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.int32() if k in ("rng", "blk") else pa.binary()) for k, v in out.items()})

    asked = scratch.keep(parts.groupBy("blk").applyInArrow(ask, ASK), "asked")
    # Some bytes of every block, to choose the key ranges; then only so many splitters are kept.
    pieces = sorted(s.sample[i : i + GRAM] for s in asked.filter("rng = 0").select("sample").toLocalIterator() for i in range(0, len(s.sample), GRAM))
    ranges = 1 << bits
    splitters = sorted({pieces[k * len(pieces) // ranges] for k in range(1, ranges)}) if pieces else []
    many = scratch.keep(asked.drop("sample").groupBy("rng").applyInArrow(_several, ANSWER), "many")
    scratch.drop("asked")

    def send(table, got):
        out = {"rng": [], "blk": [], "common": [], "tails": [], "docs": []}
        if table.num_rows:
            found = Anchors(Block(table))
            rows, least, *_ = found.suffixes(_bits(got, found.keys, bits))
            edges = _range_of(rows, splitters)
            for r in range(len(edges) - 1):
                own = slice(edges[r], edges[r + 1])
                if edges[r] < edges[r + 1]:
                    for k, v in zip(out, (r, table.column("blk")[0].as_py(), *front_coded(rows[own], squeezed), _numbers(least[own])), strict=True):
                        out[k].append(v)
        return pa.table({k: pa.array(v, pa.int32() if k in ("rng", "blk") else pa.binary()) for k, v in out.items()})

    runs = parts.groupBy("blk").cogroup(many.groupBy("blk")).applyInArrow(send, RUN)
    hits = scratch.keep(runs.groupBy("rng").applyInArrow(_merge, HITS), "hits")
    answers = many.withColumn("strings", F.lit(None).cast("binary")).unionByName(hits.withColumn("many", F.lit(None).cast("binary")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long, end:long>>, kept binary" if with_text else "")

    def finish(table, got):
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"spans": [], "kept": []} if with_text else {})
        if table.num_rows:
            block = Block(table)
            n, starts = len(block.flat), block.starts
            # a byte goes if a repeated string begins there or at one of the 49 bytes before it
            times = np.zeros(n + 1, np.int64)
            np.cumsum(_begins(block, got, bits), out=times[1:])
            gone = times[1:] > 0
            gone[LENGTH:] = times[LENGTH + 1 :] > times[1 : max(1, n - LENGTH + 1)]
            np.cumsum(gone, out=times[1:])
            removed = np.diff(times[starts])
            kept_starts = starts - np.r_[0, np.cumsum(removed)]
            kept = memoryview(block.flat[~gone])
            edge = np.zeros(n + 1, bool)
            edge[starts] = True
            first = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
            last = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1
            cuts = np.searchsorted(first, starts)
            for k, (doc_id, size, lost, spans) in enumerate(zip(block.null_ids.to_pylist(), np.diff(starts).tolist(), removed.tolist(), np.diff(cuts).tolist(), strict=True)):
                text = kept[kept_starts[k] : kept_starts[k + 1]]
                row = [doc_id, size, lost, spans, hashlib.sha256(text).hexdigest()]
                if with_text:
                    own = slice(cuts[k], cuts[k + 1])
                    row += [[{"start": x, "end": y} for x, y in zip((first[own] - starts[k]).tolist(), (last[own] - starts[k]).tolist(), strict=True)], text.tobytes()]
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return parts.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(finish, schema)
