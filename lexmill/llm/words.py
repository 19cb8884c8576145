"""Words of many texts at once, as 64-bit hashes, by array arithmetic on their UTF-8 bytes.

A word is a maximal run of bytes other than space and \\t..\\r, after A-Z are lower-cased; a byte of 0x80 or
more always belongs to a word, so the byte view and the code-point view agree.  A word's hash is a polynomial
over random 64-bit values of its bytes, modulo 2**64, then mixed; two different words of one corpus of a
billion distinct words collide with a chance below 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64))
_VALUE = BYTE_VALUE.copy()
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)


class _Powers:
    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            step = U64(pow(self.base, len(self.held), 1 << 64))
            self.held = np.concatenate([self.held, self.held * step])
        return self.held


_UP, _DOWN = _Powers(_P), _Powers(_P_INV)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """Hash of each run data[start:end] of bytes; values: what each byte counts as."""
    if len(starts) == 0:
        return np.empty(0, U64)
    total = np.cumsum(values[data] * _UP.upto(len(data))[: len(data)], dtype=U64)
    before = np.where(starts > 0, total[starts - 1], U64(0))
    return mix((total[ends - 1] - before) * _DOWN.upto(len(data))[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    hashed = run_hashes(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, begins))
    return hashed, counts


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width successive words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), U64)
    for j in range(width if n > 0 else 0):
        out = mix(out ^ hashes[j : j + n])
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about most bytes of text at a time (one text at least), null as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    while at < batch.num_rows:
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        part = batch.slice(at, upto - at)
        raw = texts.slice(at, upto - at).cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        yield part, [t or b"" for t in raw.to_pylist()]
        at = upto


import pyarrow.compute  # noqa: E402  registers pa.compute
