"""Word runs (shingles) of whole batches of texts as 64-bit hashes, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BATCH_BYTES = 16 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about ``limit`` bytes of text, so that memory does not grow with the texts' length."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for at, end in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(at, end - at)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * _BASE
    return x ^ (x >> np.uint64(32))


_WORD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD[_c] = 1
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
_POWERS = np.array([pow(int(_BASE), k, 1 << 64) for k in range(4096)], np.uint64)


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS[:n]
    more = [int(_POWERS[-1])]
    for _ in range(n - len(_POWERS)):
        more.append(more[-1] * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return np.concatenate([_POWERS, np.array(more[1:], np.uint64)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of a-z, 0-9, _) of lower-cased texts, and the row that it is in.

    Null and empty texts have no words. A word's hash is a polynomial over its bytes, so the work is
    a few passes over the batch's bytes whatever the number of rows.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[raw]
    # A separator before every row, so that no word goes on into the next text.
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero((inside[:] == 1) & (edge[:-1] | np.concatenate([[True], inside[:-1] == 0])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero((inside == 1) & (edge[1:] | np.concatenate([inside[1:] == 0, [True]]))) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTE[raw[at]] * _powers(int(lengths.max()))[place]
    hashes = _mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows


def run_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``width`` successive words of each row: (hash, row), sorted by row, then hash."""
    words, rows = word_hashes(texts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(rows[:n] == rows[width - 1 :])
    value = np.zeros(len(whole), np.uint64)
    for k in range(width):
        value = _mixed(value * _BASE + words[whole + k])
    rows = rows[whole]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(rows[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[new], rows[new]
