"""Documents in blocks of bounded size, and arrays exchanged between blocks and hash ranges.

A block asks about its sorted distinct hashes. The questions are cut by the hashes' leading bits into
ranges; a range sees what all blocks ask of it and answers each in the order asked. Both sides move
compressed arrays, one row for each block and range, so a value costs a few bytes and no row of its own,
and equal values of one block have met before anything is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 12_000_000
BLOCK_ROWS = 4096
_ZSTD = pa.Codec("zstd", compression_level=1)


def block_count(docs: DataFrame, chars: int | None = None) -> int:
    """Blocks for about ``chars`` (``BLOCK_CHARS``) bytes or ``BLOCK_ROWS`` rows each, whichever are more."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return 1 + max((total or 0) // min(chars or BLOCK_CHARS, BLOCK_CHARS), rows // BLOCK_ROWS)


def in_blocks(docs: DataFrame, count: int) -> DataFrame:
    """(blk, doc_id, text), dealt by a hash of id and text, so that rows without an id do not share a block."""
    blk = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(count)).cast("int")
    return docs.select(blk.alias("blk"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def range_bits(count: int) -> int:
    """Leading bits that give about as many ranges as blocks, so that a range stays as small as a block."""
    return max(0, count - 1).bit_length()


def cut(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, edges), len(sorted_hashes)].astype(np.int64)


def pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def raw(array: np.ndarray) -> bytes:
    """Bytes of an array of hashes: they do not compress, and trying costs time."""
    return np.ascontiguousarray(array).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def squeezed(array: np.ndarray) -> bytes:
    """Like ``pack``, by zstd: smaller, in a fifth of the time; a short array stays as it is."""
    data = np.ascontiguousarray(array)
    if data.nbytes < 128:
        return bytes(4) + data.tobytes()
    return data.nbytes.to_bytes(4, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    size, data = int.from_bytes(data[:4], "little"), memoryview(data)[4:]
    return np.frombuffer(_ZSTD.decompress(data, size) if size else data, dtype)
