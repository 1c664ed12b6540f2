"""Words of many texts at once, as byte positions and 64-bit hashes in flat numpy arrays."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: All bytes but the space and 0x09 to 0x0D.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and the start of each plus the end."""
    closed = pc.binary_join_element_wise(
        pc.fill_null(texts.cast(pa.large_string()), ""),
        pa.scalar("", pa.large_string()),
        pa.scalar("\n", pa.large_string()),
    )
    if isinstance(closed, pa.ChunkedArray):
        closed = closed.combine_chunks()
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[
        closed.offset : closed.offset + len(closed) + 1
    ]
    data = closed.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << bits
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _PRIME, _INVERSE
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans(raw: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `member` bytes. `raw` ends with another byte."""
    inside = np.empty(len(raw) + 1, np.int8)
    inside[0] = 0
    inside[1:] = member[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span of bytes."""
    up, down = _powers(max(21, int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_letters()[raw] * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Position in `starts` at which each text's spans begin, and at the end their number."""
    return np.searchsorted(starts, bounds)


def words(texts: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII capitals folded) of all texts, and where each text's begin."""
    raw, bounds = flat(texts)
    raw = LOWER[raw]
    starts, ends = spans(raw, member)
    return span_hashes(raw, starts, ends), per_text(starts, bounds)
