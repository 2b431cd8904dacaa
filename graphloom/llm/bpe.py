"""Byte-level BPE over a distinct-word table.

Plan of ``encode``: one pass splits texts into words and numbers the distinct
words of each block of documents; the (block, number, word) rows are shuffled
by the word's hash, packed by bucket, so that each distinct word of the corpus
meets the tokenizer once; its ids go back to the blocks that use it and are
placed by position. Only distinct words per block and packed word numbers are
shuffled, never texts. Buckets follow the size of the input and are streamed:
a task holds the distinct words of its bucket and one batch.

``decode`` joins ids to pieces by index: the id-to-piece table has the fixed
size of the vocabulary. ``encode(back=True)`` decodes the ids of a block where
they are placed: a ``decode`` behind it needs a second Python worker a task.

Defined results: a null text has null ids; an empty text has an empty list; a
repeated row is encoded each time; a null ``doc_id`` stays null; other columns
are ignored; an empty table gives an empty result; no ties arise. Texts are
encoded whole; long ones are read in blocks that end between pieces.
The input is read twice and must come in the same order (a file scan); a
checksum over places and words stops the run if it doesn't. Pass
``stored=False`` for anything else and it is first written to the shared folder.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import _shared, _text

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 10 << 20
#: Bytes of input for each bucket of words.
BUCKET_BYTES = 64 << 20
TOKENS = "doc_id bigint, token_ids array<int>, n_tokens int"


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> pa.Array:
    """The id-to-piece table; unused ids are empty."""
    table = ranks(vocabulary)
    by_id = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        by_id[rank] = piece
    return pa.array(by_id, pa.large_binary())


def slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    _, offsets = _text.raw(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (most frequent first), the number of each word in the texts, words per text."""
    words, sizes = [], np.zeros(len(column), np.int64)
    for data, starts, owners in _text.blocks(column, cut=_text.piece_cut):
        at = _text.piece_starts(data, starts)
        np.add.at(sizes, owners, np.diff(np.searchsorted(at, starts)))
        offsets = np.append(at, len(data)).astype(np.int32)
        words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    if not sizes.sum():
        return pa.array([], pa.binary()), np.zeros(0, np.int64), sizes
    coded = pa.chunked_array(words, pa.binary()).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    number = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(number, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[number], sizes


@lru_cache(maxsize=2)
def _piece_sizes(vocabulary: str) -> np.ndarray:
    return pyarrow.compute.binary_length(pieces(vocabulary)).to_numpy()


def encode_words(words: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and n + 1 offsets of an array of words, each of them one piece to the pattern.

    Words that begin with a blank stay pieces when they are joined, so they go
    to the tokenizer together; the sizes of the pieces of the ids tell where
    each of them ends.
    """
    n = len(words)
    words = words.cast(pa.large_binary())
    data, ends = _text.raw(words)
    first, size = ends[:-1], np.diff(ends)
    after = np.minimum(first + 1, max(0, len(data) - 1))
    joined = np.zeros(n, bool)
    if n:
        small = (size > 1) & (data[np.minimum(first, len(data) - 1)] == 32)
        joined[small] = _text.first_kinds(data, after[small]) != 0
    one = encoding(vocabulary).encode_ordinary
    counts, flat = np.zeros(n, np.int64), []
    places = []
    at = np.flatnonzero(joined)
    for a in range(0, len(at), 50_000):
        some = at[a : a + 50_000]
        ids = np.array(one(b"".join(words.take(pa.array(some)).to_pylist()).decode()), np.int32)
        upto = np.cumsum(_piece_sizes(vocabulary)[ids])
        want = np.cumsum(size[some])
        last = np.searchsorted(upto, want)
        if (upto[last] != want).any():
            raise RuntimeError("a piece crosses a word")
        counts[some] = np.diff(np.r_[-1, last])
        flat.append(ids)
        places.append(some)
    rest = np.flatnonzero(~joined)
    lists = [one(word.decode()) for word in words.take(pa.array(rest)).to_pylist()]
    counts[rest] = [len(x) for x in lists]
    flat.append(np.fromiter((x for ids in lists for x in ids), np.int32, int(counts[rest].sum())))
    places.append(rest)
    order = np.concatenate(places)
    offsets = np.r_[0, np.cumsum(counts)]
    grouped = np.concatenate(flat)
    out = np.empty(len(grouped), np.int32)
    out[np.repeat(offsets[order] - np.r_[0, np.cumsum(counts[order])[:-1]], counts[order]) + np.arange(len(grouped))] = grouped
    return out, offsets


def expand(number: np.ndarray, sizes: np.ndarray, ids: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts and n + 1 offsets of the texts in them, from numbered words and the ids of each word."""
    each = np.diff(offsets).astype(np.int32)
    end = np.zeros(len(number) + 1, np.int64)
    np.cumsum(each[number], out=end[1:])
    flat = np.empty(int(end[-1]), np.int32)
    for a in range(0, len(number), step):
        some = number[a : a + step]
        length, low = each[some], end[a]
        high = end[min(a + step, len(number))]
        flat[low:high] = ids[np.repeat(offsets[some] - (end[a : a + len(some)] - low), length) + np.arange(high - low)]
    return flat, end[np.r_[0, np.cumsum(sizes)]]


def id_lists(flat: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=pa.array(null))


def encode_local(column: pa.Array, vocabulary: str, known: dict[bytes, list[int]], keep: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch by itself; ``known`` saves words between batches, up to ``keep`` of them."""
    words, number, sizes = numbered(column)
    listed = words.to_pylist()
    ids = [known.get(word) for word in listed]
    fresh = [i for i, got in enumerate(ids) if got is None]
    flat, at = encode_words(words.take(pa.array(fresh, pa.int64())), vocabulary)
    for i, a, b in zip(fresh, at[:-1].tolist(), at[1:].tolist(), strict=True):
        ids[i] = got = flat[a:b].tolist()
        if len(known) < keep:
            known[listed[i]] = got
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return expand(number, sizes, np.fromiter((x for one in ids for x in one), np.int32, int(offsets[-1])), offsets)


def _pack(number: np.ndarray) -> bytes:
    low = number.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return _zip(np.ascontiguousarray(low).tobytes())


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def _hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return _text.span_hashes(data, ends[:-1] - ends[0], ends[1:] - ends[0])


def _checksum(hashes: np.ndarray, at: np.ndarray) -> int:
    """Tells which words stand at which places; sums of parts add up to that of the whole."""
    return int((hashes * (2 * at.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))


def _spread(words: pa.Array, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(bucket, places, words) of an array of distinct words, by their hash."""
    if not len(words):
        return
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b], words.take(pa.array(order[a:b]))


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _packed_words(words: pa.Array) -> tuple[bytes, bytes, int]:
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2].to_pybytes()[ends[0] : ends[-1]]
    return _pack(np.diff(ends)), _zip(data), len(data)


_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("at", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("n_bytes", pa.int64()), ("check", pa.int64())])
_NUMBERS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("mark", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("check", pa.int64()), ("numbers", pa.binary())])
_IDS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("at", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("check", pa.int64())])


def _numbered_blocks(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed word numbers of each block, or with ``buckets`` its distinct words by bucket."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        whole = _text.plain(batch.column("text"))
        for first, last in slices(whole):
            column, block = whole.slice(first, last - first), part << 24 | k
            k += 1
            words, number, sizes = numbered(column)
            hashes = _hashes(words)
            rows = batch.slice(first, last - first)
            if buckets:
                out = []
                for bucket, at, some in _spread(words, hashes, buckets):
                    lengths, data, n_bytes = _packed_words(some)
                    out.append({"bucket": bucket, "block": block, "n": len(at), "at": _pack(at), "sizes": lengths, "words": data, "n_bytes": n_bytes, "check": _checksum(hashes[at], at)})
                yield pa.RecordBatch.from_pylist(out, _WORDS)
            else:
                sizes[rows.column("text").is_null().to_numpy(zero_copy_only=False)] = -1
                one = {"block": block, "doc_id": rows.column("doc_id").to_pylist(), "mark": rows.column("mark").to_pylist(), "place": rows.column("place").to_pylist(), "sizes": sizes.tolist(), "n_words": len(number), "n_distinct": len(words), "check": _checksum(hashes, np.arange(len(words))), "numbers": _pack(number)}
                yield pa.RecordBatch.from_pylist([one], _NUMBERS)
            del words, number
            _shared.release()


_ORDER = "the input was read in another order the second time; encode it with stored=False"


def buckets_for(docs: DataFrame, least: int) -> int:
    """One bucket for every ``BUCKET_BYTES`` of input, ``least`` or more."""
    size = str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(1 << 16, int(size) // BUCKET_BYTES))


def texts_of(ids: pa.ListArray, vocabulary: str) -> pa.Array:
    """The text of each list of ids; null for null, the replacement sign for bytes that aren't UTF-8."""
    joined = pieces(vocabulary).take(ids.flatten())
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    sizes = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = ends[np.r_[0, np.cumsum(sizes)]]
    at = at - at[0] if not len(joined) else at
    data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
    whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at)), data])
    try:
        text = whole.cast(pa.large_string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
    return pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.large_string()), text).cast(pa.string())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, stored: bool = True, place: str | None = None, back: bool = False) -> DataFrame:
    """(doc_id, token_ids, n_tokens, mark, place) of each document; mark is xxhash64 of the text, place a bigint column that is passed on.

    With ``back`` there is a column ``decoded`` as ``decode`` makes it.
    """
    _shared.require(docs, "doc_id", "text", *([place] if place else []))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(place) if place else F.lit(None)).cast("bigint").alias("place"))
    if not stored:
        rows = _shared.stored(rows, "texts")
    rows = rows.withColumn("mark", F.xxhash64("text"))

    buckets = buckets_for(rows, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered_blocks(batches, buckets)

    def numbers_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered_blocks(batches, 0)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the words of one bucket, each distinct word encoded once."""
        known: dict[bytes, int] = {}
        ids, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500).to_pylist()
                lengths = [_unpack(r["sizes"], r["n"]) for r in rows]
                data = b"".join(pa.decompress(r["words"], r["n_bytes"], codec="zstd", asbytes=True) for r in rows)
                ends = np.r_[0, np.cumsum(np.concatenate(lengths))]
                coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
                words = coded.dictionary.to_pylist()
                fresh = [i for i, word in enumerate(words) if word not in known]
                known.update({words[i]: k for k, i in enumerate(fresh, len(known))})
                more, placed = encode_words(coded.dictionary.take(pa.array(fresh, pa.int64())), vocabulary)
                ids, offsets = np.r_[ids, more], np.r_[offsets, placed[1:] + offsets[-1]]
                number = np.array([known[w] for w in words], np.int64)[coded.indices.to_numpy()]
                out, at = [], 0
                for r in rows:
                    flat, placed = expand(number[at : at + r["n"]], np.ones(r["n"], np.int64), ids, offsets)
                    at += r["n"]
                    out.append({"block": r["block"], "n": r["n"], "at": r["at"], "lengths": _pack(np.diff(placed)), "ids": _pack(flat), "n_ids": len(flat), "check": r["check"]})
                yield pa.RecordBatch.from_pylist(out, _IDS)
        del known
        _shared.release()

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        if left.num_rows != 1:
            raise RuntimeError(_ORDER)
        (one,) = left.to_pylist()
        if sum(r["n"] for r in rows) != one["n_distinct"] or (sum(r["check"] for r in rows) - one["check"]) % (1 << 64):
            raise RuntimeError(_ORDER)
        length = np.zeros(one["n_distinct"], np.int64)
        ats = [_unpack(r["at"], r["n"]) for r in rows]
        lengths = [_unpack(r["lengths"], r["n"]) for r in rows]
        for at, n in zip(ats, lengths, strict=True):
            length[at] = n
        offsets = np.r_[0, np.cumsum(length)]
        ids = np.empty(int(offsets[-1]), np.int32)
        for r, at, n in zip(rows, ats, lengths, strict=True):
            end = np.cumsum(n)
            ids[np.repeat(offsets[at] - (end - n), n) + np.arange(r["n_ids"])] = _unpack(r["ids"], r["n_ids"])
        sizes = np.array(one["sizes"], np.int64)
        flat, ends = expand(_unpack(one["numbers"], one["n_words"]), np.maximum(sizes, 0), ids, offsets)
        null = sizes < 0
        out = {"doc_id": pa.array(one["doc_id"], pa.int64()), "token_ids": id_lists(flat, ends, null), "n_tokens": pa.array(np.diff(ends).astype(np.int32), mask=null), "mark": pa.array(one["mark"], pa.int64()), "place": pa.array(one["place"], pa.int64())}
        del rows, one, ats, lengths, length, offsets, ids, flat
        _shared.release()
        if back:
            out["decoded"] = texts_of(out["token_ids"], vocabulary)
            _shared.release()
        return pa.table(out)

    words = rows.mapInArrow(words_of, "bucket int, block bigint, n int, at binary, sizes binary, words binary, n_bytes bigint, check bigint")
    numbers = rows.mapInArrow(numbers_of, "block bigint, doc_id array<bigint>, mark array<bigint>, place array<bigint>, sizes array<int>, n_words bigint, n_distinct bigint, check bigint, numbers binary")
    ids = words.groupBy("bucket").applyInArrow(ids_of, "block bigint, n int, at binary, lengths binary, ids binary, n_ids bigint, check bigint")
    return numbers.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(placed, TOKENS + ", mark bigint, place bigint" + ", decoded string" * back)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The input and a column ``decoded``; null ids give null, bytes that aren't UTF-8 give the replacement sign.

    An id outside the vocabulary is an error. A column named ``decoded`` is replaced.
    """
    _shared.require(tokens, "token_ids")
    rows = tokens.drop("decoded")

    def text_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts_of(batch.column("token_ids"), vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])
            del text
            _shared.release()

    return rows.mapInArrow(text_of, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
