"""Compressed bitmaps over key ranges of 32,768 codes.

A bitmap is packed like a container of a compressed bitmap: codes as 16-bit numbers while they are few,
plain bits otherwise. Bitmaps are packed where the codes are, before any exchange; parts of one range
from several tasks are only put together (OR) where the result is needed. ``and_not`` yields codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BITS = 15
RANGE = 1 << RANGE_BITS
#: From this number of codes on, plain bits (4 KB) are smaller than 16-bit codes.
DENSE_FROM = RANGE // 16


def range_of(code: Column) -> Column:
    return F.shiftright(code, RANGE_BITS)


def pack(positions: np.ndarray) -> bytes:
    """The packed bitmap of distinct sorted positions in a range."""
    if len(positions) < DENSE_FROM:
        return b"A" + positions.astype("<u2").tobytes()
    bits = np.zeros(RANGE, bool)
    bits[positions] = True
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def _pack_runs(groups: int):
    """Rows (groups ..., code), sorted, to rows (groups ..., key_range, bits), one for each run of equal groups and range in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code = batch.column(groups).to_numpy()
            new = np.ones(len(code), bool)
            new[1:] = np.diff(code >> RANGE_BITS) != 0
            for c in batch.columns[:groups]:
                values = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= np.diff(values) != 0
            at = np.flatnonzero(new)
            parts = [pack(np.unique(code[x:y]) & (RANGE - 1)) for x, y in zip(at, [*at[1:], len(code)])]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns[:groups]), pa.array(code[at] >> RANGE_BITS), pa.array(parts, pa.binary())], [*batch.schema.names[:groups], "key_range", "bits"]
            )

    return run


def bitmaps(codes: DataFrame, *groups: str) -> DataFrame:
    """(groups ..., key_range, bits): per group (strings) and range the list of its packed parts."""
    sorted_codes = codes.select(*groups, "code").sortWithinPartitions(*groups, "code")
    schema = "".join(f"{g} string, " for g in groups) + "key_range bigint, bits binary"
    return sorted_codes.mapInArrow(_pack_runs(len(groups)), schema).groupBy(*groups, "key_range").agg(F.collect_list("bits").alias("bits"))


def unpack(parts: list[bytes] | None) -> np.ndarray:
    """Booleans for the whole range, from all parts of its bitmap."""
    out = np.zeros(RANGE, bool)
    for packed in parts or []:
        if packed[:1] == b"B":
            found = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little")
            out[: len(found)] |= found.astype(bool)
        else:
            out[np.frombuffer(packed, "<u2", offset=1)] = True
    return out


def and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows (ref_field, period, key_range, refs, parents) to rows (ref_field, period, code)."""
    for batch in batches:
        fields, periods, codes = [], [], []
        rows = batch.to_pydict()
        for field, period, at, refs, parents in zip(*(rows[c] for c in ("ref_field", "period", "key_range", "refs", "parents"))):
            left = np.flatnonzero(unpack(refs) & ~unpack(parents)).astype(np.int64) + (at << RANGE_BITS)
            codes.append(left)
            fields += [field] * len(left)
            periods += [period] * len(left)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(periods, pa.string()), pa.array(code)], ["ref_field", "period", "code"])
