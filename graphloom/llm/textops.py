"""Words and shingles as 64-bit hashes, computed over whole byte buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at a time, so that memory doesn't follow the length of a text.
PIECE = 1 << 20
#: ASCII letters in lower case; 0x09-0x0D become 0x20.
LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every other ASCII byte that is no letter or digit becomes 0x20.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


#: Rows of an Arrow batch whose texts are unpacked together.
ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of ROWS at most."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser after splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U) * U(_STEP))
_SALT = mix(np.arange(1, 65, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, PIECE + (1 << 16))
        for k, base in (("p", _STEP), ("i", pow(_STEP, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers["p"], _powers["i"]


def words(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs without 0x20 in ``b``."""
    a = np.frombuffer(b, np.uint8)
    edge = np.diff(np.concatenate(([0], (a != 32).view(np.int8), [0])).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = _power(len(a))
    c = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[a] * p[: len(a)])))
    return s, e, mix((c[e] - c[s]) * inv[s] + (e - s).astype(U))


def pieces(b: bytes) -> Iterator[bytes]:
    """``b`` in parts of about PIECE bytes that end at a space."""
    at = 0
    while len(b) - at > PIECE:
        to = b.find(b" ", at + PIECE)
        if to < 0:
            break
        yield b[at:to]
        at = to
    yield b[at:]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about PIECE bytes in all, each with the index of its first."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def shingles(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words.

    Words are split at 0x20 and 0x09-0x0D, with A-Z lowered. A shorter text has its whole
    sequence as one; a null or blank text has none.
    """
    norm = [(t or b"").translate(LOWER) for t in texts]
    for _, part in chunks(norm):
        if len(part) == 1 and len(part[0]) > PIECE:
            h = np.concatenate([words(x)[2] for x in pieces(part[0])])
            counts = np.array([len(h)])
        else:
            s, _, h = words(b" ".join(part))
            ends = np.cumsum([len(t) + 1 for t in part])
            counts = np.diff(np.concatenate(([0], np.searchsorted(s, ends))))
        run = np.zeros(max(0, len(h) - k + 1), U)
        for j in range(k):
            run += h[j : j + len(run)] * _SALT[j]
        run, at = mix(run), 0
        for n in counts:
            if n >= k:
                yield np.unique(run[at : at + n - k + 1])
            elif n:
                yield mix(np.sum(h[at : at + n] * _SALT[:n], keepdims=True, dtype=U) + U(0x5851F42D4C957F2D * int(n) % (1 << 64)))
            else:
                yield np.zeros(0, U)
            at += n
