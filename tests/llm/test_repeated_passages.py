"""op9: what its steps send and compare, places that stay the same between steps, and texts beyond a chunk."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from common import SCHEMA
from lodestrata.llm import suffix_dedup as sd
from lodestrata.llm.scratch import Scratch


class Sliced(bytes):
    """Bytes that count how often a piece of them is taken."""

    taken = 0

    def __getitem__(self, at):
        Sliced.taken += 1
        return bytes.__getitem__(self, at)


def table(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})


def marked(rows):
    """By brute force, the removed bytes of (id, text) rows."""
    first, out = {}, []
    for d, t in sorted(rows):
        b = t.encode()
        mask = bytearray(len(b))
        for i in range(len(b) - sd.LENGTH + 1):
            if first.setdefault(b[i : i + sd.LENGTH], d) < d:
                mask[i : i + sd.LENGTH] = b"\1" * sd.LENGTH
        out.append((d, len(b), sum(mask), hashlib.sha256(bytes(x for x, y in zip(b, mask, strict=True) if not y)).hexdigest()))
    return out


def test_equal_suffixes_are_not_compared_piece_by_piece():
    rng = random.Random(4)
    rows = sorted(bytes(rng.choice(b"abc") for _ in range(sd.WIDTH)) for _ in range(200))
    common = sd.common_prefixes(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, sd.WIDTH)).tolist()
    Sliced.taken = 0
    _, _, got = sd.merge_runs([([Sliced(r) for r in rows], common) for _ in range(8)])
    assert got.count(sd.WIDTH) == 7 * 200
    assert Sliced.taken < 200  # with pieces of 8 bytes: over 30,000


def test_a_bit_for_each_string_goes_back(spark):
    """A suffix gets at most 8 bytes back, not a number for each of 35 strings."""
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(2000))) for k in range(40)]
    rows += [(100 + k, rows[k][1][:1000] + rows[(k + 1) % 40][1][1000:]) for k in range(40)]
    scratch = Scratch(spark, "op9-test")
    got = sd.remove_repeats(spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA), scratch).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == marked(rows)
    hits = spark.read.parquet(f"{scratch.path}/hits").collect()
    suffixes = sum(len(sd._from_numbers(r.strings)) for r in hits)
    assert suffixes > 1000
    assert sum(len(r.strings) for r in hits) < 8 * suffixes


@pytest.mark.parametrize("size", [0, 1, 49, 50, 51, 300])
def test_bits_tell_what_smaller_documents_hold(size):
    rng = random.Random(size)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(0, size)))) for k in range(30)]
    rows += [(50 + k, rows[k][1][k:] + rows[k + 1][1]) for k in range(20)] + [(40, rows[3][1]), (3, rows[4][1])]
    block = sd.Block(table(rows))
    found = sd.Anchors(block)
    suffixes, least, times, places, above = found.suffixes(np.ones(len(found.keys), bool))
    assert times.sum() == len(places) == len(above) == len(found.place)
    if not len(suffixes):
        return
    strings, fits = np.repeat(sd.repeated_strings(suffixes, sd.common_prefixes(suffixes), least), times), np.repeat(sd._fits(suffixes), times)
    first, want, held, flat = {}, set(), {}, block.flat.tobytes()
    for k, d in enumerate(block.ids.tolist()):
        for i in range(int(block.starts[k]), int(block.starts[k + 1]) - sd.LENGTH + 1):
            held[i] = first.setdefault(flat[i : i + sd.LENGTH], d) < d
    got = {}
    for p, s in zip(places.tolist(), np.where(above, fits, strings).tolist(), strict=True):
        for a in range(sd.SHIFTS):
            if s >> a & 1:
                want.add(p - a)
    for p, s in zip(places.tolist(), fits.tolist(), strict=True):
        got |= {p - a: p for a in range(sd.SHIFTS) if s >> a & 1}
    assert set(got) == set(held)  # each string of each text is around an anchor
    assert want == {i for i, is_held in held.items() if is_held}


def test_places_do_not_depend_on_the_order_of_rows():
    rows = [(7, "b" * 70), (7, "a" * 60), (None, "d"), (None, "c"), (7, ""), (1, "zé"), (7, None), (None, None)]
    want = sd.Block(table(rows))
    for seed in range(20):
        random.Random(seed).shuffle(rows)
        got = sd.Block(table(rows))
        assert got.flat.tobytes() == want.flat.tobytes() == "zé".encode() + b"a" * 60 + b"b" * 70 + b"cd"
        assert np.array_equal(got.starts[np.diff(got.starts, append=0) != 0], want.starts[np.diff(want.starts, append=0) != 0])
        assert np.array_equal(got.ids, want.ids)


def test_chunks_change_no_anchor(monkeypatch):
    rng = np.random.default_rng(3)
    flat = rng.integers(97, 101, 5000).astype(np.uint8)
    starts = np.r_[0, np.sort(rng.integers(0, 5000, 40)), 5000, 5000]
    want = sd.anchors(flat, starts)
    for chunk in (1, 7, 64, 1000):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        got = sd.anchors(flat, starts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_text_beyond_a_chunk(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(2 * sd.CHUNK + 500))
    rows = [(5, long), (9, "x" + long[sd.CHUNK - 40 : sd.CHUNK + 40] + "y"), (11, long[-120:]), (12, long[:49])]
    got = sd.remove_repeats(spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA), Scratch(spark, "op9-test")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == marked(rows)
