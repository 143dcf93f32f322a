"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of 0 to ``depth`` words (the longest one is a parameter of the model, as in the tree of
Ron, Singer and Tishby). A context is retained if it was seen ``least`` times in training and if its smoothed
next-word distribution diverges from that of the context one word shorter. A retained state gives
(n(w) + t * parent(w)) / (n + t) with t its distinct next words, so every state is a distribution; the root
is the add-a-half unigram. Each word is scored by the longest retained suffix of what precedes it; a text
begins with one start symbol, which contexts may contain.

The tree grows level by level. Documents are tokenised once and kept as numbered words in blocks. At each
level a block sends its distinct (context, next word) counts to the range of the context's hash, where counts
are added and the divergence is tested, and takes the answers up. A word leaves the search, its probability
final, as soon as no longer context can be retained for it: too rare, or followed by one word only with
so high a probability that no divergence can be left. Nothing of the tree passes through the driver but
the numbers of tokens and words. Words are told apart by 64-bit hashes, then by exact numbers; contexts by
64-bit hashes of those numbers. The parent's probability travels as a 32-bit float.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.blocks import block_count, cut, in_blocks, range_bits, raw, squeezed, unsqueezed
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import batch_words, mixed

DEPTH = 4  # words of the longest context
LEAST = 2  # training occurrences that a context needs
DIVERGENCE = 0.05  # nats
CHARS = 6_000_000  # bytes of text of a block
END = np.uint64(0x9D5C3A1B7F2E4C61)
START = np.uint64(0)  # the number of the start symbol; words are numbered from 1
STATE = "blk int, ids binary, nulls binary, held binary, sizes binary, kept_sizes binary, known binary, base binary, score binary, words binary, names binary, counts binary, open binary, p binary"
ASK = "rng int, blk int, ctx binary, lens binary, sym binary, counts binary, par binary"
ANSWER = "rng int, blk int, counts binary, ctx_n binary, marks binary, names binary, tokens long, kinds long, top long"
RETAINED, CLOSED = 1, 2


def _names(schema: str) -> list[str]:
    return [k.split()[0] for k in schema.split(", ")]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_names(schema))
    return pa.table({n: pa.array(c, kinds[k.split()[1]]) for n, c, k in zip(_names(schema), columns, schema.split(", "), strict=True)})


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, as many bytes as the largest one has: the upper ones are nearly all zero and compress."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        planes[k] = x >> x.dtype.type(8 * k) if k else x
    return bytes([width]) + squeezed(planes)


def _from_planes(data: bytes) -> np.ndarray:
    planes = unsqueezed(data[1:], np.uint8).reshape(data[0], -1)
    kind = np.uint32 if len(planes) <= 4 else np.uint64
    out = planes[0].astype(kind)
    for k in range(1, len(planes)):
        out |= planes[k].astype(kind) << kind(8 * k)
    return out


def _counts(data: bytes) -> np.ndarray:
    return _from_planes(data).astype(np.int64)


def _ascending(x: np.ndarray) -> bytes:
    """Sorted hashes as differences: the upper bytes are zero where many hashes share a range."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _real(x: np.ndarray) -> bytes:
    return _planes(x.astype("<f4").view("<u4"))


def _from_real(data: bytes) -> np.ndarray:
    return _from_planes(data).astype("<u4").view("<f4")


def _sorted_order(x: np.ndarray) -> np.ndarray:
    """An order that sorts unsigned values: their leading bits are sorted with the places packed behind them."""
    n = len(x)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    room = np.uint64(64) - bits
    drop = np.uint64(max(0, int(x.max(initial=0)).bit_length() - int(room)))
    packed = ((x >> drop) << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if drop:  # values that differ in the bits left out: the few runs that are not in order yet
        head, y = packed >> bits, x[order]
        done = -1
        for k in np.flatnonzero(y[1:] < y[:-1]).tolist():
            if k > done:
                lo, done = np.searchsorted(head, head[k]), np.searchsorted(head, head[k], "right")
                order[lo:done] = order[lo:done][np.argsort(y[lo:done], kind="stable")]
    return order


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    x = x.astype(np.uint64, copy=False)
    order = _sorted_order(x)
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    place = np.empty(len(y), np.int64)
    place[order] = np.cumsum(new) - 1
    return y[new], place


class Grams:
    """Distinct (context, next word) pairs of the open words of a block at one level, in order of the context's hash."""

    def __init__(self, words: np.ndarray, names: np.ndarray, starts: np.ndarray, at: np.ndarray, level: int):
        own = mixed(np.r_[names.astype(np.uint64), START] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))  # by word, START last
        before = lambda back: np.where(at - back < starts, len(names), words[np.maximum(at - back, 0)])
        if level == 1:  # contexts are words, so only these are put in order
            order = np.argsort(own)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            known, where = np.r_[names.astype(np.uint64), START][order], rank[before(1)]
            self.order = own[order]
        else:
            h = np.full(len(at), level, np.uint64)
            for back in range(1, level + 1):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[before(back)])
            known, where = _ranked(h)
            self.order = known
        room = np.int64(len(names).bit_length())
        pairs, self.place = _ranked((where << room) | words[at])
        pairs = pairs.view(np.int64)
        pair_ctx, self.word = pairs >> room, pairs & ((np.int64(1) << room) - 1)
        lens = np.bincount(pair_ctx, minlength=len(known))
        used = lens > 0
        self.ctx, self.order, self.lens = known[used], self.order[used], lens[used]  # words by number, longer contexts by hash
        self.pair_ctx = (np.cumsum(used) - 1)[pair_ctx]


class Block:
    """What is kept of one block: its documents, its words by number, and the words still open with their probabilities."""

    def __init__(self, row: dict):
        self.blk = row["blk"]
        self.held, self.sizes = np.frombuffer(row["held"], bool), np.frombuffer(row["kept_sizes"], np.int64)
        self.words = _counts(row["words"])
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first = np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        self.row = row

    def counts(self) -> np.ndarray:
        return _counts(self.row["counts"])

    def names(self) -> np.ndarray:
        return _from_planes(self.row["names"]).astype(np.uint64)

    def open(self, roots) -> tuple[np.ndarray, np.ndarray]:
        """The open words and their probabilities; before level 1 ``roots(counts)`` of each word."""
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.row["open"], np.uint8), count=len(self.words)))
        if self.row["counts"]:
            return at, roots(self.counts())[self.words[at]]
        return at, _from_real(self.row["p"]).astype(np.float64)

    def grams(self, at: np.ndarray, level: int) -> Grams:
        return Grams(self.words, self.names(), self.first[at], at, level)


def _tokenised(table: pa.Table, train_of) -> pa.Table:
    """The state of a block before anything is asked: names are word hashes, counts those of its own training words."""
    ids = table.column("doc_id").combine_chunks()
    order = pa.array(np.argsort(ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), kind="stable"))
    table, ids = table.take(order), ids.take(order)
    hashes, sizes = batch_words(table.column("text"))
    sym = np.full(len(hashes) + len(sizes), END)
    sym[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = hashes
    sizes = sizes + 1
    train = train_of(ids)
    names, words = _ranked(sym)
    own = np.bincount(words, np.repeat(train, sizes), len(names)).astype(np.int64)
    row = (
        table.column("blk")[0].as_py(), raw(ids.fill_null(0).to_numpy(zero_copy_only=False)), raw(ids.is_null().to_numpy(zero_copy_only=False)), raw(~train), raw(sizes.astype(np.int64)),
        raw(sizes.astype(np.int64)), b"", b"", b"", _planes(words), raw(names), _planes(own), b"", b"",
    )
    return _table(STATE, [row])


def _roots(totals: tuple[int, int]):
    """Add-a-half unigram probabilities by count, in 32 bits like all that travel."""
    return lambda count: ((count + 0.5) / (totals[0] + 0.5 * (totals[1] + 1))).astype(np.float32).astype(np.float64)


def _asked(block: Block, level: int, bits: int, totals: tuple[int, int]) -> list[tuple]:
    """The questions of a block for each range."""
    out = []
    if level == 0:
        names, counts = np.frombuffer(block.row["names"], np.uint64), block.counts()  # hashes, still
        edges = cut(names, bits)
        for r in range(len(edges) - 1):
            c = slice(edges[r], edges[r + 1])
            if edges[r] < edges[r + 1]:
                out.append((r, block.blk, raw(names[c]), b"", b"", _planes(counts[c]), b""))
        return out
    at, p = block.open(_roots(totals))
    if not len(at):
        return out
    grams = block.grams(at, level)
    sym = block.names()[grams.word]
    counts = np.bincount(grams.place, ~block.held[block.doc[at]], len(sym)).astype(np.int64)
    if level == 1:  # the parent's probabilities follow from the words' counts
        roots, parents = block.counts()[grams.word], _planes
    else:
        roots, parents = np.zeros(len(sym), np.float32), _real
        roots[grams.place] = p
    contexts = _planes if level == 1 else _ascending
    edges = cut(grams.order, bits)
    pairs = np.r_[0, np.cumsum(grams.lens)][edges]
    for r in range(len(edges) - 1):
        c, q = slice(edges[r], edges[r + 1]), slice(pairs[r], pairs[r + 1])
        if edges[r] < edges[r + 1]:
            out.append((r, block.blk, contexts(grams.ctx[c]), _planes(grams.lens[c]), _planes(sym[q]), _planes(counts[q]), parents(roots[q])))
    return out


def divergence(p_new: np.ndarray, p_old: np.ndarray) -> np.ndarray:
    return p_new * np.log(np.maximum(p_new, 1e-300) / np.maximum(p_old, 1e-300))


def _tested(total, own, parent, many: int, least: int, nats: float):
    """For each context its occurrences, and whether it is retained or closed. ``own``: the context of each pair."""
    n, t = np.bincount(own, total, many), np.bincount(own, total > 0, many)
    seen = total > 0
    after = (total + t[own] * parent) / np.maximum(n + t, 1)[own]
    gain = np.bincount(own[seen], divergence(after, parent)[seen], many)
    rest = np.maximum(1 - np.bincount(own[seen], parent[seen], many), 0)
    share = t / np.maximum(n + t, 1)  # what is left for unseen words is this part of the parent's rest
    gain += share * rest * np.log(np.maximum(share, 1e-300))
    retained = (n >= least) & (gain >= nats)
    # A context with one next word has only such extensions, none more frequent. The divergence that they could have:
    only = np.bincount(own[seen], np.where(retained[own], after, parent)[seen], many)
    sure = (n + only) / (n + 1)
    most = divergence(sure, only) + divergence(1 - sure, 1 - only)
    closed = (n < least) | ((t == 1) & (most < nats))
    return n.astype(np.int64), t.astype(np.int64), retained, closed


def _answered(table: pa.Table, level: int, bits: int, least: int, nats: float, totals: tuple[int, int]) -> pa.Table:
    """One range of one level: add what the blocks counted, test contexts, answer each block in the order asked."""
    rows = table.to_pylist()
    read = np.frombuffer if level == 0 else _from_planes if level == 1 else _from_ascending
    ctxs = [read(r["ctx"], np.uint64) if level == 0 else read(r["ctx"]) for r in rows]
    counts = [_counts(r["counts"]) for r in rows]
    known, place = _ranked(np.concatenate(ctxs))
    out, at_pair, at_ctx = [], 0, 0
    if level == 0:
        total = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
        rng = np.uint64(rows[0]["rng"])
        names = np.empty(len(known), np.uint64)  # exact numbers, dealt in turn among ranges, the most frequent words first
        names[np.argsort(-total, kind="stable")] = np.arange(len(known), dtype=np.uint64) * np.uint64(1 << bits) + rng + np.uint64(1)
        stats = (int(total.sum()), int((total > 0).sum()), int(names.max(initial=np.uint64(0))))
        for k, r in enumerate(rows):
            mine = place[at_ctx : at_ctx + len(ctxs[k])]
            out.append((r["rng"], r["blk"], _planes(total[mine]), b"", b"", _planes(names[mine]), *(stats if k == 0 else (0, 0, 0))))
            at_ctx += len(ctxs[k])
        return _table(ANSWER, out)
    lens = [_counts(r["lens"]) for r in rows]
    pair_ctx = np.repeat(place, np.concatenate(lens))
    sym = np.concatenate([_from_planes(r["sym"]) for r in rows])
    many = np.uint64(int(sym.max(initial=0)) + 1)
    if int(many) * len(known) >= 1 << 64:
        named, sym = _ranked(sym)
        sym, many = sym.astype(np.uint64), np.uint64(len(named))
    pairs, of = _ranked(pair_ctx.astype(np.uint64) * many + sym)
    total = np.bincount(of, np.concatenate(counts), len(pairs))
    own = (pairs // many).astype(np.int64)
    parent = np.zeros(len(pairs))
    parent[of] = np.concatenate([_roots(totals)(_counts(r["par"])) if level == 1 else _from_real(r["par"]) for r in rows])
    n, t, retained, closed = _tested(total, own, parent, len(known), least, nats)
    marks = (retained * RETAINED + closed * CLOSED).astype(np.uint8)
    total = total.astype(np.int64)
    for k, r in enumerate(rows):
        mine = place[at_ctx : at_ctx + len(ctxs[k])]
        out.append((r["rng"], r["blk"], _planes(total[of[at_pair : at_pair + len(counts[k])]]), _planes(n[mine]), _planes(marks[mine]), _planes(t[mine]), 0, 0, 0))
        at_pair += len(counts[k])
        at_ctx += len(ctxs[k])
    return _table(ANSWER, out)


def _taken_up(block: Block, answers: pa.Table, level: int, totals: tuple[int, int], depth: int, least: int) -> tuple:
    """The state of a block after a level's answers."""
    got = sorted(answers.to_pylist(), key=lambda r: r["rng"])
    joined = lambda name, f: np.concatenate([f(r[name]) for r in got] or [np.zeros(0, np.int64)])
    row = dict(block.row)
    many, docs = len(block.words), len(block.sizes)
    n_all, v_all = totals
    names = None
    if level == 0:
        count, names = joined("counts", _counts), joined("names", _from_planes).astype(np.uint64)
        order = np.argsort(names)  # from now on words are in the order of their numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names, count, block.words = names[order], count[order], rank[block.words]
        at = np.arange(many)
        base = np.log10((count + 0.5) / (n_all + 0.5 * (v_all + 1)))[block.words]
        row["base"] = raw(np.bincount(block.doc, base, docs))
        row["known"] = raw(np.bincount(block.doc, (count > 0)[block.words], docs).astype(np.int64))
        score = np.zeros(docs)
        going = at == block.first
        going[1:] |= (count >= least)[block.words[:-1]]
    else:
        at, p = block.open(_roots(totals))
        score = np.frombuffer(row["score"]).copy()
        going = np.zeros(0, bool)
        if len(at):
            grams = block.grams(at, level)
            count, n, t = joined("counts", _counts), joined("ctx_n", _counts), joined("names", _counts)
            marks = joined("marks", _counts)
            parent = np.empty(len(count))  # by pair, which the places of a pair share
            parent[grams.place] = p
            ctx = grams.pair_ctx
            parent = np.where((marks & RETAINED)[ctx] > 0, (count + t[ctx] * parent) / np.maximum(n + t, 1)[ctx], parent)
            p = parent[grams.place]
            # The next context ends in the word before, so it occurs as often as that word after its own context.
            before = np.ones(many + 1, bool)
            before[at] = (count >= least)[grams.place]
            going = ((marks & CLOSED) == 0)[ctx][grams.place] & before[at - 1] & (at - level >= block.first[at])
    if level == depth:
        going = np.zeros(len(at), bool)
    done, left = at[~going], at[going]
    score = score + np.bincount(block.doc[done], np.log10(p[~going]) if level else base[~going], docs)
    bits = np.zeros(many, bool)
    bits[left] = True
    # Only the words that contexts of open words can reach are kept, and of the names only theirs.
    near = bits.copy()
    for back in range(1, min(depth, many - 1) + 1):
        near[:-back] |= bits[back:] & (block.doc[back:] == block.doc[:-back])
    words = block.words[near]
    used = np.zeros(len(names) if level == 0 else len(names := block.names()), bool)
    used[words] = True
    row |= {
        "score": raw(score), "open": raw(np.packbits(bits[near])), "kept_sizes": raw(np.bincount(block.doc[near], minlength=docs).astype(np.int64)),
        "words": _planes((np.cumsum(used) - 1)[words]), "names": _planes(names[used]), "counts": b"" if level else _planes(count[used]),
        "p": _real(p[going]) if level else b"",
    }
    return tuple(row[k] for k in _names(STATE))


def score_documents(docs: DataFrame, scratch: Scratch, held_out, depth: int = DEPTH, least: int = LEAST, nats: float = DIVERGENCE) -> DataFrame:
    """Score all ``docs`` (doc_id, text), learning from those for which ``held_out(ids)`` is false.

    ``held_out`` maps an Arrow column of ids to a Boolean numpy array. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score and score for each row. A null or empty text is one END; a very long one
    is taken whole, in one block; repeated rows are scored (and learned) each; a null id counts as one more id;
    an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    count = block_count(docs, CHARS)
    bits = max(0, range_bits(count) - 1)  # a range is asked by one to two blocks' worth, which is less than what a block holds
    train_of = lambda ids: ~held_out(ids)

    def asked(state: DataFrame, level: int, totals) -> DataFrame:
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _table(ASK, _asked(Block(row), level, bits, totals)).to_batches()

        return state.mapInArrow(run, ASK)

    def answer(level: int, totals):
        return lambda table: _answered(table, level, bits, least, nats, totals)

    def taker(level: int, totals):
        def run(table, got):
            return _table(STATE, [_taken_up(Block(row), got, level, totals, depth, least) for row in table.to_pylist()])

        return run

    state = scratch.keep(in_blocks(docs, count).groupBy("blk").applyInArrow(lambda table: _tokenised(table, train_of), STATE), "tokens")
    old, totals = "tokens", (0, 0)
    for level in range(depth + 1):
        answers = scratch.keep(asked(state, level, totals).groupBy("rng").applyInArrow(answer(level, totals), ANSWER), f"answers{level}")
        if not level:
            sums = answers.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
            totals = (sums.n or 0, sums.v or 0)
        elif not answers.limit(1).count():
            break  # no word is open: all scores are final
        state = scratch.keep(state.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(taker(level, totals), STATE), f"state{level}")
        scratch.drop(old)
        scratch.drop(f"answers{level}")
        old = f"state{level}"

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["nulls"], bool))
                n = np.frombuffer(r["sizes"], np.int64)
                columns = [ids, pa.array(np.frombuffer(r["held"], bool)), pa.array(n), pa.array(np.frombuffer(r["known"], np.int64)), pa.array(np.full(len(n), totals[0], np.int64)), pa.array(np.frombuffer(r["base"])), pa.array(np.frombuffer(r["score"]))]
                yield pa.RecordBatch.from_arrays(columns, names=_names(schema))

    final = state.select("ids", "nulls", "held", "sizes", "known", "base", "score")
    return final.mapInArrow(finish, schema)
