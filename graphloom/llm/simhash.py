"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints have 128 bits, from the distinct long words and word pairs of the
whole text, each with one vote. Candidate search spreads over ``tables``: each
takes a seeded order of the bits, turns the reordered fingerprint into its Gray
rank, and shuffles by the first ``prefix`` bits of the rank, so that a task
sees runs of fingerprints in Gray order. Over each run a hierarchical index is
built: ``FAN`` neighbours in Gray order share a node that holds the bits on
which they all agree (a mask and a pattern); a parent has what its children
share, a child only what is new to it. A search goes down from the roots, adds
up the differences found in the masks, and drops a whole group as soon as the
sum exceeds the radius. At the leaves the sum is the exact distance.

Every fingerprint is a query; nothing caps partners or candidates. Two
fingerprints at distance d meet in a table with the probability that none of
its prefix bits differs; the number of tables is set for ``recall`` at the
radius itself, and nearer pairs are found more surely. Runs grow with the
number of fingerprints, as the index prunes inside them: the prefix gets one
more bit for eight times the fingerprints, and so tables stay few (31 up to
370,000 fingerprints, 80 at 500 million).

A prefix that many share (a third of all texts may be copies of one another)
is split: its fingerprints are spread over shards, and each pair of shards is
a block of its own. Such prefixes are found by a sample of the fingerprints.

Pairs never leave a task. A task gives for each fingerprint the smallest one
of its component in the run, and the number of documents linked to it by pairs
that no earlier table holds, so that each pair is counted once. Groups are the
connected components; the document with the smallest doc_id stays.

Defined results: a null text is never a copy and always stays; texts without
words are copies only if their bytes are equal, so empty texts form one group;
repeated rows (same doc_id and text) are copies of which one stays; rows that
share a doc_id but not the text are told apart; a null doc_id comes after all
others in ties; very long texts are read in parts (a word of over a megabyte is
several) and vote as a whole; an empty
table gives no rows. Other columns pass through ``keep``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from . import _shared, _text, components

BITS = 128
RADIUS = 24
RECALL = 0.9
LEAST_PREFIX = 12
#: Fingerprints that share a prefix before it is split, and the share of fingerprints (one in so many) that finds such prefixes.
HOT = 50_000
SAMPLED = 64
#: At most so many prefixes are called hot, so that their list is small enough to be sent to every task.
MOST_HOT = 100_000
FAN = 8
LONG = 5
SEED = 11
FRONTIER = 1 << 20
CHUNK = 1 << 17


def _vote(of: np.ndarray, code: np.ndarray, votes: np.ndarray, weight: np.ndarray) -> None:
    """Add the votes of distinct (text, 40-bit code), sorted by text."""
    for a in range(0, len(of), CHUNK):  # small enough for the cache
        some, owner = code[a : a + CHUNK], of[a : a + CHUNK]
        bits = np.unpackbits(np.stack([_text.mix(some + np.uint64(1)), _text.mix(some ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8), axis=1)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, len(owner)])
        runs = -(-size // 255)  # at most 255 ones are added in a byte
        run = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.r_[0, np.cumsum(runs)[:-1]], runs))
        eight = np.add.reduceat(bits.view(np.uint64), run, axis=0).view(np.uint8)
        total = np.add.reduceat(eight, np.r_[0, np.cumsum(runs)[:-1]], axis=0, dtype=np.int32)
        np.add.at(votes, owner[first], total)
        np.add.at(weight, owner[first], size)


def fingerprints(text: pa.Array, block: int = _text.BLOCK) -> np.ndarray:
    """(n, 16) bytes, the fingerprint of each text."""
    votes = np.zeros((len(text), BITS), np.int32)
    weight = np.zeros(len(text), np.int64)
    column = _text.plain(text, lower=True)
    _, offsets = _text.raw(column)
    long_text = np.diff(offsets) > block  # read in parts; their codes wait until all are seen
    waiting: dict[int, np.ndarray] = {}
    last: tuple[int, np.uint64] | None = None
    low = np.uint64((1 << 40) - 1)
    for data, starts, owners in _text.blocks(column, block):
        begin, end, part = _text.word_spans(data, starts)
        if not len(begin):
            continue
        word, owner = _text.span_hashes(data, begin, end), owners[part]
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        long = np.flatnonzero(end - begin >= LONG)
        of = np.r_[owner[long], owner[pair]]
        code = np.r_[word[long], _text.mix(word[pair] * np.uint64(31) + word[pair + 1])]
        if last is not None and last[0] == owner[0]:  # the pair across two parts of a text
            of, code = np.r_[owner[0], of], np.r_[_text.mix(np.array([last[1]]) * np.uint64(31) + word[:1]), code]
        last = int(owner[-1]), word[-1]
        key = np.sort(of.astype(np.uint64) << np.uint64(40) | code >> np.uint64(24))  # much faster than np.unique
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        of, code = (key >> np.uint64(40)).astype(np.int64), key & low
        for i in np.unique(owners[long_text[owners]]).tolist():
            mine = of == i
            waiting[i] = np.union1d(waiting.get(i, np.zeros(0, np.uint64)), code[mine])
            of, code = of[~mine], code[~mine]
        _vote(of, code, votes, weight)
    for i, code in waiting.items():
        _vote(np.full(len(code), i), code, votes, weight)
    out = np.packbits(2 * votes > weight[:, None], axis=1)
    for i in np.flatnonzero(weight == 0).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(column[i].as_py().encode(), digest_size=16).digest(), np.uint8)
    return out


@F.arrow_udf(BinaryType())
def _fingerprint(text: pa.Array) -> pa.Array:
    flat = fingerprints(text)
    _shared.release()
    whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(text), [None, pa.py_buffer(np.ascontiguousarray(flat))]) if len(text) else pa.array([], pa.binary(16))
    return pa.compute.if_else(text.is_null(), pa.scalar(None, pa.binary()), whole.cast(pa.binary()))


def bit_orders(tables: int, prefix: int, seed: int = SEED) -> np.ndarray:
    """A seeded order of the bits for each table; successive tables take disjoint prefixes of one shuffle."""
    rng = np.random.default_rng(seed)
    orders = []
    while len(orders) < tables:
        shuffled = rng.permutation(BITS)
        orders += [np.roll(shuffled, -prefix * i) for i in range(BITS // prefix)]
    return np.array(orders[:tables])


def tables_for(radius: int, prefix: int, recall: float) -> int:
    """How many tables give the recall at the radius: pairs at distance d share a table's prefix with probability C(128 - d, prefix) / C(128, prefix)."""
    meet = math.comb(BITS - radius, prefix) / math.comb(BITS, prefix)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def prefix_for(n: int) -> int:
    """Bits of the prefix for n distinct fingerprints."""
    return LEAST_PREFIX + max(0, round((math.log2(max(n, 2)) - 17) / 3))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Bits of the place in Gray order of rows of bits, highest first."""
    return np.bitwise_xor.accumulate(bits, axis=1)


def _words(packed: np.ndarray) -> np.ndarray:
    """(n, 2) big-endian words of (n, 16) bytes."""
    return np.ascontiguousarray(packed).view(">u8").astype(np.uint64)


def _apart(x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    diff = x ^ y
    if mask is not None:
        diff &= mask
    return np.bitwise_count(diff).sum(1, dtype=np.int64)


def search(group: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of one group within the radius, and their distance.

    ``group`` is sorted, and ``codes`` (n, 2) are in Gray order inside each
    group. All groups are indexed at once: level by level, ``FAN`` nodes of a
    group get a parent, until each group has one root.
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    first = np.r_[True, group[1:] != group[:-1]]
    of = np.cumsum(first) - 1
    levels = [{"all": codes, "any": codes, "end": np.arange(1, n + 1), "kids": None}]
    while len(of) > of[-1] + 1:
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        inside = np.arange(len(of)) - at[of]
        begin = np.flatnonzero(inside % FAN == 0)
        low = levels[-1]
        levels.append({"all": np.bitwise_and.reduceat(low["all"], begin, axis=0), "any": np.bitwise_or.reduceat(low["any"], begin, axis=0), "end": low["end"][np.r_[begin[1:], len(of)] - 1], "kids": (begin, np.diff(np.r_[begin, len(of)]))})
        of = of[begin]
    for level in levels:
        level["mask"] = ~(level["all"] ^ level["any"])
    root = np.cumsum(first) - 1
    found = []
    work = [(len(levels) - 1, a, None, None) for a in range(0, n, FRONTIER // 8)]
    while work:
        depth, query, node, sum_ = work.pop()
        if node is None:
            query = np.arange(query, min(query + FRONTIER // 8, n))
            node = root[query]
            top = levels[depth]
            sum_ = _apart(codes[query], top["all"][node], top["mask"][node])
            ok = (sum_ <= radius) & (top["end"][node] > query + 1)
            query, node, sum_ = query[ok], node[ok], sum_[ok]
        while depth and len(query):
            if len(query) > FRONTIER // FAN:
                half = len(query) // 2
                work.append((depth, query[half:], node[half:], sum_[half:]))
                query, node, sum_ = query[:half], node[:half], sum_[:half]
                continue
            upper, lower = levels[depth], levels[depth - 1]
            begin, kids = upper["kids"]
            many = kids[node]
            end = np.cumsum(many)
            child = np.repeat(begin[node] - (end - many), many) + np.arange(end[-1])
            up = np.repeat(node, many)
            query, sum_ = np.repeat(query, many), np.repeat(sum_, many)
            later = lower["end"][child] > query + 1
            child, up, query, sum_ = child[later], up[later], query[later], sum_[later]
            sum_ = sum_ + _apart(codes[query], lower["all"][child], lower["mask"][child] & ~upper["mask"][up])
            ok = sum_ <= radius
            query, node, sum_ = query[ok], child[ok], sum_[ok]
            depth -= 1
        if len(query):
            found.append((query, node, sum_))
    if not found:
        return none, none, none
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = j > i
    return i[ok], j[ok], d[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ranks(bits: np.ndarray, orders: np.ndarray, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, Gray rank) of fingerprints in each table; the key names the table and the first bits of the rank."""
    for t, order in enumerate(orders):
        rank = np.packbits(gray_rank(bits[:, order]), axis=1)
        head = np.zeros(len(rank), np.int64)
        for i in range(-(-prefix // 8)):
            head = head << 8 | rank[:, i]
        head >>= -prefix % 8
        yield (t << prefix) + head, rank


def _bits(prints: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, 16), axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _hot(prints: DataFrame, n: int, orders: np.ndarray, prefix: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that about ``hot`` fingerprints share and the number of their shards, by a sample: ``MOST_HOT`` at most, as ``hot`` grows with the rows."""
    if n <= hot:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = max(hot, n * len(orders) // MOST_HOT)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for key, _ in _ranks(_bits(batch.column("print")), orders, prefix):
                    name, count = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(count)], ["key", "n"])

    share = min(SAMPLED, max(1, hot // 50))
    some = prints.where(F.pmod(F.xxhash64("print"), F.lit(share)) == 0).select("print").mapInArrow(keys, "key bigint, n bigint")
    found = some.groupBy("key").agg((F.sum("n") * share).alias("n")).where(F.col("n") > hot).toPandas().sort_values("key")
    return found.key.to_numpy(np.int64), -(-found.n.to_numpy(np.int64) // hot) + 1


def _spread(prints: DataFrame, orders: np.ndarray, prefix: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, block, rank, weight) of every fingerprint in every table; in a hot key once for each block of two shards that has it."""
    shared = prints.sparkSession.sparkContext.broadcast(hot)

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shards = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = batch.column("weight").to_numpy()
            for key, rank in _ranks(_bits(batch.column("print")), orders, prefix):
                block, row = np.zeros(len(key), np.int32), np.arange(len(key))
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    many = np.where(names[at] == key, shards[at], 1)
                    row = np.repeat(row, many)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    own = _shard(rank[row], many[row])
                    block = np.where(many[row] > 1, (np.minimum(own, other) << 15 | np.maximum(own, other)) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(block), _binary(rank[row]), pa.array(weight[row])], ["key", "block", "rank", "weight"])

    return prints.select("print", "weight").mapInArrow(ranked, "key bigint, block int, rank binary, weight bigint").repartition("key", "block").sortWithinPartitions("key", "block", "rank")


def _shard(rank: np.ndarray, shards: np.ndarray) -> np.ndarray:
    words = _words(rank)
    return (_text.mix(words[:, 0] ^ _text.mix(words[:, 1])) % np.maximum(shards, 1).astype(np.uint64)).astype(np.int64)


def _from_rank(key: np.ndarray, rank: np.ndarray, orders: np.ndarray, prefix: int) -> np.ndarray:
    """Fingerprints (n, 16) of ranks (n, 16)."""
    bits = np.unpackbits(rank, axis=1)
    bits[:, 1:] ^= bits[:, :-1].copy()
    out = np.empty_like(bits)
    np.put_along_axis(out, orders[key >> prefix], bits, axis=1)
    return np.packbits(out, axis=1)


def _earlier(orders: np.ndarray, prefix: int) -> list[np.ndarray]:
    """For each table, masks (in its own order of bits) of the prefixes of the tables before it."""
    out = []
    for t, order in enumerate(orders):
        heads = np.zeros((t, BITS), np.uint8)
        for e in range(t):
            heads[e] = np.isin(order, orders[e][:prefix])
        out.append(_words(np.packbits(heads, axis=1)) if t else np.zeros((0, 2), np.uint64))
    return out


def _matched(prints: DataFrame, n: int, radius: int, prefix: int, recall: float, seed: int, stars: bool, hot: int = HOT) -> DataFrame:
    """With ``stars`` (a, b, links): a fingerprint, the first of its component in a run, and its newly linked documents; else its pairs."""
    tables = tables_for(radius, prefix, recall)
    orders = bit_orders(tables, prefix, seed)
    names, shards = heavy = _hot(prints, n, orders, prefix, hot)
    masks = _earlier(orders, prefix)

    def matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key: np.ndarray, block: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = _words(rank)
            codes = words ^ np.stack([words[:, 0] >> np.uint64(1), words[:, 1] >> np.uint64(1) | words[:, 0] << np.uint64(63)], 1)
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            i, j, d = search(group, codes, radius)
            if (block > 0).any():  # pairs inside a shard belong to the block of that shard alone
                at = np.minimum(np.searchsorted(names, key), max(0, len(names) - 1))
                own = _shard(rank, shards[at])
                low, high = (block - 1) >> 15, (block - 1) & 0x7FFF
                cross = (block[i] == 0) | (low[i] == high[i]) | (own[i] != own[j])
                i, j, d = i[cross], j[cross], d[cross]
            table = key[i] >> prefix
            new = np.ones(len(i), bool)
            for t in np.unique(table).tolist():
                at = np.flatnonzero(table == t)
                diff = codes[i[at]] ^ codes[j[at]]
                for mask in masks[t]:
                    new[at] &= ((diff[:, 0] & mask[0]) | (diff[:, 1] & mask[1])) != 0
            if stars:
                links = np.bincount(i[new], weight[j[new]], len(key)) + np.bincount(j[new], weight[i[new]], len(key))
                label = _roots(len(key), i, j)
                i = np.flatnonzero((label != np.arange(len(key))) | (links > 0))
                j, d = label[i], links[i]
            else:
                i, j, d = i[new], j[new], d[new]
            for a in range(0, len(i), 200_000):
                x, y = i[a : a + 200_000], j[a : a + 200_000]
                sides = [_binary(_from_rank(key[s], rank[s], orders, prefix)) for s in (x, y)]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(d[a : a + 200_000].astype(np.int64))], ["a", "b", "links"])

        held: list[tuple[np.ndarray, ...]] = []
        size, enough = 0, 100_000
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = np.frombuffer(b"".join(batch.column("rank").to_pylist()), np.uint8).reshape(-1, 16)
            held.append((batch.column("key").to_numpy(), batch.column("block").to_numpy(), rank, batch.column("weight").to_numpy()))
            size += batch.num_rows
            if size < enough:
                continue
            key, block, rank, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            goes_on = (key == key[-1]) & (block == block[-1])  # the last group may have more rows
            whole = len(key) - int(goes_on.sum())
            if whole:
                yield from pairs(key[:whole], block[:whole], rank[:whole], weight[:whole])
            held, size = [(key[whole:], block[whole:], rank[whole:], weight[whole:])], len(key) - whole
            enough = max(100_000, 2 * size)
        if size:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
        _shared.release()

    return _spread(prints, orders, prefix, heavy).mapInArrow(matches, "a binary, b binary, links bigint")


def near_pairs(prints: DataFrame, radius: int = RADIUS, prefix: int | None = None, recall: float = RECALL, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(a, b, distance) of distinct fingerprints in ``print`` within the radius, a < b; each pair once."""
    distinct = _shared.cut(prints.where(F.col("print").isNotNull()).groupBy("print").agg(F.count("*").alias("weight")))
    n = distinct.count()
    found = _matched(distinct, n, radius, prefix or prefix_for(n), recall, seed, False, hot)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("links").cast("int").alias("distance"))


def _grouped(docs: DataFrame, radius: int, prefix: int | None, recall: float, seed: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, print) of every row, and (doc_id, mark, group_id, group_mark, links) of those with a text."""
    _shared.require(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    rows = _shared.cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), _fingerprint.asNondeterministic()(text).alias("print")))
    prints = _shared.cut(rows.where(F.col("print").isNotNull()).groupBy("print").agg(F.count("*").alias("weight")))
    n = prints.count()
    found = _shared.cut(_matched(prints, n, radius, prefix or prefix_for(n), recall, seed, True, hot))
    groups_ = components.components(found.select("a", "b")).select(F.col("node").alias("print"), "component")
    links = found.groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("links"))
    of = prints.join(groups_, "print", "left").join(links, "print", "left")
    of = of.select("print", F.coalesce("component", "print").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    known = rows.where(F.col("print").isNotNull()).join(of, "print").select("doc_id", "mark", "component", "links")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    stays = known.groupBy("component").agg(first).select("component", F.col("first.doc_id").alias("group_id"), F.col("first.mark").alias("group_mark"))
    return rows, known.join(stays, "component").select("doc_id", "mark", "group_id", "group_mark", "links")


def groups(docs: DataFrame, radius: int = RADIUS, prefix: int | None = None, recall: float = RECALL, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(doc_id, group_id, kept, links) of every row: group_id is the doc_id that stays, links the number of other rows within the radius; null and 0 for null texts."""
    rows, known = _grouped(docs, radius, prefix, recall, seed, hot)
    kept = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("mark") == F.col("group_mark"))
    apart = rows.where(F.col("print").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("group_id"), F.lit(True).alias("kept"), F.lit(0).cast("bigint").alias("links"))
    return known.select("doc_id", "group_id", kept.alias("kept"), "links").unionByName(apart)


def keep(docs: DataFrame, radius: int = RADIUS, prefix: int | None = None, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One document of each group, with all its columns."""
    rows, known = _grouped(docs, radius, prefix, recall, seed)
    known = _shared.cut(known)
    same = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("mark") == F.col("group_mark"))
    gone = known.where(~same).select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    text = F.col("text").cast("string")
    marked = F.xxhash64(text)
    left = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone_id"]) & text.isNotNull() & (marked == gone["_gone_mark"]), "left_anti")
    if known.where(same).groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        return left
    names = docs.columns
    order = "_row"
    while order in names:
        order += "_"
    null = left.where(F.col("text").isNull())
    whole = left.where(F.col("text").isNotNull()).withColumn(order, F.xxhash64(text))
    return whole.dropDuplicates(["doc_id", order]).drop(order).unionByName(null)
