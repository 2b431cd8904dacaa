"""Token ids in patched frame-of-reference blocks.

A document's ids are cut into blocks of 128. A block stores its minimum, the
bit width that a percentile of its differences needs, the low bits of all
differences, and an exception list (position, whole difference) for those that
need more. ``block_starts`` indexes the byte at which each block begins, so a
slice of the ids is read without the rest.

Block: minimum (4 bytes, little endian), width (1), exceptions (1), packed
bits, positions (1 each), differences (4 each).

Defined results: a null text has null columns; an empty one no blocks; a null
``doc_id`` stays null; repeated rows are written each time; other columns are
ignored; an empty table gives no rows; very long texts are encoded whole; ties
don't arise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from . import _shared, _text, bpe

SIZE = 128
PERCENTILE = 0.9
HEAD = 6
SLICE_BYTES = 8 << 20
PACKED = "doc_id bigint, n_tokens int, block_starts array<int>, payload binary"


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1]


def pack(flat: np.ndarray, ends: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start of each block in them, blocks before each list (n + 1), bytes before each list (n + 1)."""
    sizes = np.diff(ends)
    per = -(-sizes // SIZE)
    first = np.r_[0, np.cumsum(per)]
    n = int(first[-1])
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), first, np.zeros(len(ends), np.int64)
    block_list = np.repeat(np.arange(len(sizes)), per)
    inside = np.arange(n) - first[block_list]
    begin = ends[block_list] + inside * SIZE
    count = np.minimum(SIZE, sizes[block_list] - inside * SIZE)
    place = begin[:, None] + np.arange(SIZE)
    valid = np.arange(SIZE) < count[:, None]
    values = np.where(valid, flat[np.minimum(place, len(flat) - 1)], np.iinfo(np.int32).max)
    low = values.min(1)
    gap = np.where(valid, values - low[:, None], np.iinfo(np.int32).max)
    ranked = np.sort(gap, 1)
    gap[~valid] = 0
    width = _widths(ranked[np.arange(n), np.maximum(np.ceil(count * percentile).astype(np.int64), 1) - 1]).astype(np.int64)
    over = gap >= (np.int64(1) << width)[:, None]
    exceptions = over.sum(1)
    body = -(-count * width // 8)
    size = HEAD + body + 5 * exceptions
    start = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4], out[at + 5] = width, exceptions
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for some in np.array_split(rows, -(-len(rows) // 4096)):
            bits = (gap[some, :, None] >> np.arange(w, dtype=np.int32)).astype(np.uint8) & 1
            packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            keep = np.arange(packed.shape[1]) < body[some, None]
            out[(at[some, None] + HEAD + np.arange(packed.shape[1]))[keep]] = packed[keep]
    row, column = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.r_[0, np.cumsum(exceptions)][row]
        tail = at[row] + HEAD + body[row]
        out[tail + nth] = column
        out[(tail + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = gap[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, at - start[first[block_list]], first, start[first]


def unpack_block(payload: bytes, start: int, count: int) -> np.ndarray:
    """The ids of the block that begins at a byte."""
    data = np.frombuffer(payload, np.uint8)
    low, width, exceptions = int(data[start : start + 4].view("<u4")[0]), int(data[start + 4]), int(data[start + 5])
    body = -(-count * width // 8)
    at = start + HEAD
    bits = np.unpackbits(data[at : at + body], bitorder="little")[: count * width].reshape(count, width).astype(np.int64)
    gap = bits @ (1 << np.arange(width, dtype=np.int64)) if width else np.zeros(count, np.int64)
    at += body
    where = data[at : at + exceptions]
    gap[where] = np.frombuffer(data[at + exceptions : at + 5 * exceptions].tobytes(), "<u4")
    return (gap + low).astype(np.int32)


def unpack(payload: bytes, starts: list[int], n: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids from ``begin`` to ``end``, reading only the blocks that hold them."""
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.int32)
    some = range(begin // SIZE, -(-end // SIZE))
    return np.concatenate([unpack_block(payload, starts[k], min(SIZE, n - k * SIZE)) for k in some])[begin - some[0] * SIZE : end - some[0] * SIZE]


def _packed(doc_id: pa.Array, flat: np.ndarray, ends: np.ndarray, null: np.ndarray, percentile: float) -> pa.RecordBatch:
    data, starts, first, at = pack(flat, ends, percentile)
    payload = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    payload = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), payload).cast(pa.binary())
    return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(ends).astype(np.int32), mask=null), bpe.id_lists(starts, first, null), payload], ["doc_id", "n_tokens", "block_starts", "payload"])


def write_ids(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, percentile: float = PERCENTILE) -> DataFrame:
    """Encode texts and pack their ids in one pass without a shuffle."""
    _shared.require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            whole = _text.plain(batch.column("text"))
            for first, last in bpe.slices(whole, SLICE_BYTES):
                flat, ends = bpe.encode_local(whole.slice(first, last - first), vocabulary, known)
                null = batch.column("text").slice(first, last - first).is_null().to_numpy(zero_copy_only=False)
                yield _packed(batch.column("doc_id").slice(first, last - first), flat, ends, null, percentile)
            _shared.release()

    return rows.mapInArrow(packed, PACKED)


def pack_ids(tokens: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """Pack a table of (doc_id, token_ids); ids are non-negative, null elements are an error."""
    _shared.require(tokens, "doc_id", "token_ids")
    rows = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(np.where(null, 0, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))].astype(np.int64)
            yield _packed(batch.column("doc_id"), ids.flatten().to_numpy(zero_copy_only=True), ends, null, percentile)

    return rows.mapInArrow(packed, PACKED)


def read_ids(packed: DataFrame) -> DataFrame:
    """(doc_id, token_ids) again."""
    _shared.require(packed, "doc_id", "n_tokens", "block_starts", "payload")
    rows = packed.select("doc_id", "n_tokens", "block_starts", "payload")

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, payload = (batch.column(name).to_pylist() for name in ("n_tokens", "block_starts", "payload"))
            lists = [None if k is None else unpack(p, s, k).tolist() for k, s, p in zip(n, starts, payload, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return rows.mapInArrow(ids, "doc_id bigint, token_ids array<int>")
