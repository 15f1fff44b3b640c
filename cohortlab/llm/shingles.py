"""Words and word shingles as sorted 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_h64 = xxhash.xxh64_intdigest
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def word_list(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes split and lower-case by ASCII rules, as the word pattern does."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_h64, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    size = min(k, len(words))
    n = len(words) - size + 1
    out = _mixed(h[:n] + np.uint64(size))
    for i in range(1, size):
        out = _mixed(out + h[i : i + n])
    return np.unique(out)


def signed_halves(text: bytes) -> tuple[int, int]:
    """128 bits of a text, as two signed numbers."""
    digest = xxhash.xxh128_intdigest(text)
    high, low = digest >> 64, digest & (1 << 64) - 1
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def text_key(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the word sequence, as two signed numbers."""
    return signed_halves(b" ".join(words))


def binary(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of rows that follow each other with the same ``key``, across batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(start, end - start)
            if held and held[-1].column(key)[-1].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
