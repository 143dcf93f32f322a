"""SHA-256 that stops and goes on elsewhere: its state is a few bytes, so a long text is hashed by one task after the other."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import struct
from functools import cache

import pyarrow as pa

INITIAL = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
STATE = struct.Struct(">8IQ")  # the chaining value and the number of bytes; the bytes of an unfinished block follow


class _Context(ctypes.Structure):
    """SHA256_CTX of OpenSSL, a public structure."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_ubyte * 64), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _openssl():
    """The library that hashlib itself uses, else the one of the system, else None."""
    for place in (lambda: _hashlib.__file__, lambda: ctypes.util.find_library("crypto")):
        try:
            update = ctypes.CDLL(place()).SHA256_Update
        except (OSError, TypeError, AttributeError):
            continue
        update.argtypes, update.restype = [ctypes.POINTER(_Context), ctypes.c_void_p, ctypes.c_size_t], ctypes.c_int
        return update
    return None


def _roots(power: float, n: int) -> list[int]:
    primes = [p for p in range(2, 320) if all(p % q for q in range(2, p))][:n]
    out = []
    for p in primes:
        low, high = 0, p << 32  # floor(p ** (1 / power) * 2 ** 32), exactly
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**power <= p << (32 * power) else (low, mid - 1)
        out.append(low & 0xFFFFFFFF)
    return out


ROUNDS = _roots(3, 64)


def _compress(h: tuple, block: bytes) -> tuple:
    """One block in plain Python, for a Python without OpenSSL: right, but some thousand times slower."""
    turn = lambda x, k: (x >> k | x << (32 - k)) & 0xFFFFFFFF
    w = list(struct.unpack(">16I", block))
    for k in range(16, 64):
        a, b = w[k - 15], w[k - 2]
        w.append((w[k - 16] + w[k - 7] + (turn(a, 7) ^ turn(a, 18) ^ a >> 3) + (turn(b, 17) ^ turn(b, 19) ^ b >> 10)) & 0xFFFFFFFF)
    a, b, c, d, e, f, g, i = h
    for k in range(64):
        one = i + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + ROUNDS[k] + w[k]
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, i = (one + two) & 0xFFFFFFFF, a, b, c, (d + one) & 0xFFFFFFFF, e, f, g
    return tuple((x + y) & 0xFFFFFFFF for x, y in zip(h, (a, b, c, d, e, f, g, i), strict=True))


class Sha256:
    """``Sha256(state)`` goes on where another one's ``state()`` was taken."""

    def __init__(self, state: bytes | None = None):
        *h, self.size = STATE.unpack_from(state) if state else (*INITIAL, 0)
        self.h, self.tail = tuple(h), state[STATE.size :] if state else b""

    def update(self, data: pa.Buffer | bytes) -> None:
        data = pa.py_buffer(data)
        if not data.size:
            return
        update = _openssl()
        if update:
            bits = 8 * self.size
            at = _Context((ctypes.c_uint32 * 8)(*self.h), (ctypes.c_uint32 * 2)(bits & 0xFFFFFFFF, bits >> 32 & 0xFFFFFFFF), (ctypes.c_ubyte * 64)(*self.tail), len(self.tail), 32)
            update(ctypes.byref(at), data.address, data.size)
            self.h, self.tail = tuple(at.h), bytes(at.data)[: at.num]
        else:
            whole = self.tail + data.to_pybytes()
            for k in range(0, len(whole) - 63, 64):
                self.h = _compress(self.h, whole[k : k + 64])
            self.tail = whole[len(whole) // 64 * 64 :]
        self.size += data.size

    def state(self) -> bytes:
        return STATE.pack(*self.h, self.size) + self.tail

    def hexdigest(self) -> str:
        last = Sha256(self.state())
        last.update(b"\x80" + b"\0" * ((55 - self.size) % 64) + struct.pack(">Q", 8 * self.size))
        return struct.pack(">8I", *last.h).hex()
