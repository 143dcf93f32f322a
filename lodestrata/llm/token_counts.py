"""Token counts of a BPE piece model by rank-synchronous merging of ragged arrays.

Spaces become U+2581 and one is put before the text. No piece of such a model has U+2581 after another
character, so a text falls into pre-tokens (a run of U+2581 and what follows it) that are merged apart
from each other. The distinct pre-tokens of a batch that are not known yet are held as one flat array of
symbols with row offsets; in each round every row applies its best pair (lowest rank, leftmost), until no
row has a pair. What survives is counted: a character without a piece counts its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NO_RANK = np.iinfo(np.int64).max
LONG = 256  # characters; longer pre-tokens are merged with a heap
CACHE = 400_000
NORMAL, USER_DEFINED = 1, 4


class PieceMerger:
    """Counts the pieces that a piece model gives a text."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not plain:
            raise ValueError("only BPE models with byte fallback and plain normalisation are supported")
        pieces = [(p.piece, p.score) for p in proto.pieces if p.type == NORMAL]
        if any(p.type == USER_DEFINED for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("pieces that span words are not supported")
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        # Equal scores have equal ranks; among them the leftmost pair goes first.
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        pairs = {}
        for piece, score in pieces:
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[score], self.ids[piece])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        self.known: dict[str, int] = {}

    def _start(self, token: str) -> tuple[list[int], int]:
        """Symbols of a pre-token (-1: no piece) and the bytes of characters without a piece."""
        got = [self.ids.get(c, -1) for c in token]
        return got, sum(len(c.encode("utf-8", "surrogatepass")) for c, i in zip(token, got, strict=True) if i < 0)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the pairs, or -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, -1)

    def merge_batch(self, tokens: list[str]) -> list[int]:
        """Surviving symbols of each pre-token."""
        counts = [0] * len(tokens)
        rows, flat, lengths = [], [], []
        for k, token in enumerate(tokens):
            symbols, loose = self._start(token)
            counts[k] = loose - sum(i < 0 for i in symbols)
            if len(symbols) > LONG:
                counts[k] += self._merge_long(symbols)
            else:
                rows.append(k)
                flat += symbols
                lengths.append(len(symbols))
        for k, n in zip(rows, self._merge_ragged(np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)), strict=True):
            counts[k] += int(n)
        return counts

    def _merge_ragged(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rounds over all rows at once; rows without a pair leave."""
        result = lengths.copy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        while len(symbols) > 1:
            pair = self._rank(symbols[:-1], symbols[1:])
            pair[row[:-1] != row[1:]] = -1
            # rank, then place: the least of a row is its leftmost best pair
            value = np.where(pair >= 0, self.ranks[pair] * len(symbols) + np.arange(len(pair)), NO_RANK)
            begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.r_[value, NO_RANK], begins)
            live = best != NO_RANK
            if not live.any():
                break
            place = (best[live] % len(symbols)).astype(np.int64)
            symbols[place] = self.merged[pair[place]]
            result[row[place]] -= 1
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            ends = np.r_[begins[1:], len(symbols)]
            if not live.all():
                keep &= np.repeat(live, ends - begins)
            symbols, row = symbols[keep], row[keep]
        return result

    def _merge_long(self, symbols: list[int]) -> int:
        """The same merges for one long pre-token, by a heap over a linked list."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (p := self.pairs.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (p[0], i, symbols[i], symbols[j], p[1]))

        for i in range(n - 1):
            offer(i)
        gone, left = [False] * n, n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = new, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin and end tokens; an empty text has none."""
        split = [PRE_TOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = {p for s in split for p in s}.difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > CACHE:
                self.known.clear()
                fresh = {p for s in split for p in s}
            todo = sorted(fresh)
            for at in range(0, len(todo), 50_000):
                part = todo[at : at + 50_000]
                self.known.update(zip(part, self.merge_batch(part), strict=True))
        known = self.known
        return [sum(map(known.__getitem__, s)) for s in split]


_MERGERS: dict[str, PieceMerger] = {}


def merger(model_file: str) -> PieceMerger:
    """One merger for each Python worker and model."""
    if model_file not in _MERGERS:
        _MERGERS[model_file] = PieceMerger(model_file)
    return _MERGERS[model_file]


def _batches(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``model_file`` is a path that every worker has (a file of an installed package). A null text is empty
    and has 0 tokens; other columns are ignored; repeated rows are counted each; an empty table gives an
    empty table.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        tool = merger(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens: list[int] = []
            for a, b in _batches(texts):
                tokens += tool.count(texts[a:b])
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
