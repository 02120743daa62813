"""Array-at-a-time word splitting and hashing for Arrow string columns.

A word is a maximal run of bytes of a stated class.  All classes used here keep every byte
from 0x80 up inside words, so working on UTF-8 bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_W = np.uint64(0xC2B2AE3D27D4EB4F)
_INV = {int(x): np.uint64(pow(int(x), -1, 1 << 64)) for x in (_B, _W)}
_powers: dict[int, np.ndarray] = {}

#: Every byte but ASCII white space (0x20, 0x09 to 0x0D).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk up to a bound."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``size`` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = buffer_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), raw[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


def spans(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word."""
    w = inside[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True  # words never cross a text's edge
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = w[:-1]
    before &= ~cut[:-1]
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = w[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1 + seed)) * _power(_B, len(raw)), out=total[1:])
    back = _power(_INV[int(_B)], len(raw) + 1)[starts]
    return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64) * _W)


def hash_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` consecutive word hashes that start at each index but the last n-1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_W, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _power(_INV[int(_W)], len(h))[: len(h) - n + 1])


def windows_inside(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the window of ``n`` words at each start index of :func:`hash_windows` stays in one text."""
    count = int(first[-1])
    if count < n:
        return np.zeros(0, bool)
    ok = np.ones(count, bool)
    sizes = np.diff(first)
    last = np.repeat(first[1:], sizes)
    return (np.arange(count) + n <= last)[: count - n + 1] & ok[: count - n + 1]


def hash_ranges(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges from index a up to b."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_W, len(h)), out=total[1:])
    return mix((total[b] - total[a]) * _power(_INV[int(_W)], len(h) + 1)[a] + (b - a).astype(np.uint64) * _B)


def join_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """One string per text: its kept words joined by one space."""
    kept = np.flatnonzero(keep)
    size = ends[kept] - starts[kept] + 1  # each with the space after it
    count = np.concatenate(([0], np.cumsum(keep)))[first]
    last = count[1:][np.diff(count) > 0] - 1  # the last kept word of each text has no space after it
    size[last] -= 1
    to = np.concatenate(([0], np.cumsum(size)))
    src = np.repeat(starts[kept] - to[:-1], size) + np.arange(to[-1])
    out = np.concatenate((raw, [np.uint8(0x20)]))[src]
    space = np.ones(len(kept), bool)
    space[last] = False
    out[to[1:][space] - 1] = 0x20
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(to[count].astype(np.int64).tobytes()), pa.py_buffer(out.astype(np.uint8).tobytes())).cast(pa.string())
