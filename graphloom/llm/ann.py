"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has ``hashes`` functions floor((a.x + b) / width) with Gaussian a. A
query visits, besides its own bucket, perturbed buckets in the order of their
estimated success probability: for a neighbour at distance r the projection
moves by a normal of deviation r, which gives each perturbation of each
function a probability, and a bucket their product. Probing stops when the
visited probabilities reach what each table owes to the recall target, so no
number of probes is set. Exact distances of queries and members are computed
bucket by bucket; the candidates of all tables are merged and the k nearest
kept.

r is measured: the 0.9 quantile of the distance to the k-th neighbour over
``SAMPLE`` queries (smallest hashes of the id), each against all rows. The
width is a multiple of r. The number of functions is the one with the least
estimated cost: probes, and the share of all rows that a sample finds in the
probed buckets, times the number of rows; so it grows with the rows.
A round settles the queries that got k neighbours within its r, as their
probes were enough; the others are asked again in tables for the r of their
own, measured over a sample of them. When ``EXACT`` or fewer are left, or after
``ROUNDS`` rounds, the rest are compared with all rows.

Buckets are hashed to ``cells`` of about ``CHUNK`` members. A row goes once per
table to a cell; a query goes once to each cell that holds a bucket of its, with
the list of those buckets, and leaves at most k candidates there, so no probe
carries a vector of its own. Vectors travel as single precision. Buckets with
over ``CHUNK`` members are split over several cells, and every query of such a
bucket goes to all of them. Perturbations beyond ``REACH`` cells are left out:
at a width of 2 r they have a chance of less than 1e-9.

Defined results: rows whose id or embedding is null, or whose embedding is
empty, not finite or of another length than most, are left out; rows that
repeat an id count once (the nearest); a row isn't its own neighbour; equal
distances (rounded to 6 places) rank by id; with fewer than k other rows, all
of them are returned; an empty table gives no rows. Other columns are ignored.
Texts don't occur. ``queries`` has the columns of ``vectors``; null ids and
vectors in it are left out in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _shared

K = 10
TABLES = 2
RECALL = 0.96
WIDTH = 2.0
SAMPLE = 128
SEEN = 4096  # rows that estimate how full the probed buckets are
CHUNK = 50_000
REACH = 3
EXACT = 1000
ROUNDS = 6
SEED = 5
PROBE_COST = 100  # a probe costs as much as the distances to so many members
MOST_PROBES = 5_000
#: At most so many buckets are called hot, so that their list is small enough to be sent to every task.
HOT = 20_000


@dataclass(frozen=True)
class Plan:
    direction: np.ndarray  # tables x hashes x dimensions
    shift: np.ndarray  # tables x hashes
    width: float
    radius: float
    share: float  # success probability that each table owes


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz and Stegun 7.1.26; error under 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


def project(x: np.ndarray, plan: Plan, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each hash function, and the place inside it in [0, 1)."""
    value = (x @ plan.direction[table].T + plan.shift[table]) / plan.width
    cell = np.floor(value)
    return cell.astype(np.int64), value - cell


def probes(inside: np.ndarray, plan: Plan, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query of each probe, perturbation of each probe): best first, until the share is reached.

    The best perturbations of the first functions extended by one more
    function contain the best of all, so a beam as wide as the number of
    probes is exact; it is doubled for the queries that need more.
    """
    share = plan.share if share is None else share
    n, m = inside.shape
    steps = np.arange(-REACH, REACH + 1)
    ratio = plan.width / max(plan.radius, 1e-9)
    chance = _cdf((steps + 1 - inside[:, :, None]) * ratio) - _cdf((steps - inside[:, :, None]) * ratio)
    todo, beam = np.arange(n), 32
    queries, moves = [], []
    while len(todo):
        p, move = np.ones((len(todo), 1)), np.zeros((len(todo), 1, 0), np.int8)
        for h in range(m):
            p = (p[:, :, None] * chance[todo, h][:, None, :]).reshape(len(todo), -1)
            move = np.concatenate([np.repeat(move, len(steps), axis=1), np.tile(steps.astype(np.int8), move.shape[1])[None, :, None].repeat(len(todo), 0)], 2)
            if p.shape[1] > beam:
                best = np.argpartition(-p, beam - 1, axis=1)[:, :beam]
                p, move = np.take_along_axis(p, best, 1), np.take_along_axis(move, best[:, :, None], 1)
        order = np.argsort(-p, axis=1, kind="stable")
        p, move = np.take_along_axis(p, order, 1), np.take_along_axis(move, order[:, :, None], 1)
        total = np.cumsum(p, 1)
        need = (total < share).sum(1) + 1
        whole = (need <= p.shape[1]) | (p.shape[1] < beam) | (beam >= len(steps) ** m)
        done = np.flatnonzero(whole)
        need = np.minimum(need, p.shape[1])[done]
        queries.append(np.repeat(todo[done], need))
        column = np.arange(int(need.sum())) - np.repeat(np.cumsum(need) - need, need)
        moves.append(move[np.repeat(done, need), column])
        todo, beam = todo[~whole], beam * 4
    return np.concatenate(queries) if queries else np.zeros(0, np.int64), np.concatenate(moves) if moves else np.zeros((0, m), np.int8)


def _bucket(cell: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of each bucket."""
    name = np.full(len(cell), np.uint64(table + 1))
    for h in range(cell.shape[1]):
        name = (name ^ cell[:, h].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks."""
    return np.maximum((left * left).sum(1)[:, None] + (right * right).sum(1) - 2 * left @ right.T, 0)


def radius_of(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> float:
    """The 0.9 quantile of the distance of some queries (bounded by ``SAMPLE``) to their k-th neighbour among all rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best = np.full((len(x), k), np.inf)
        for batch in batches:
            y, other = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for a in range(0, len(y), 4096):
                d = _pairs(x, y[a : a + 4096])
                d[ids[:, None] == other[a : a + 4096]] = np.inf
                best = np.sort(np.concatenate([best, d], 1), 1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), k)), pa.array(best.ravel())], ["q", "d"])

    rows = vectors.mapInArrow(nearest, "q bigint, d double").where(F.col("d") < float("inf"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    far = rows.withColumn("n", nth).where(F.col("n") <= k).groupBy("q").agg(F.max("d").alias("d")).toPandas().d  # SAMPLE rows
    return math.sqrt(float(np.quantile(far, 0.9))) if len(far) else 1.0


def plan_for(vectors: DataFrame, n: int, dimensions: int, k: int = K, tables: int = TABLES, recall: float = RECALL, seed: int = SEED, asked: DataFrame | None = None) -> Plan:
    """Measure the radius over sampled queries (of ``asked``, or of all) against all rows, and choose width and functions."""
    some = lambda frame, most: frame.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    sample = some(vectors if asked is None else asked, SAMPLE)
    ids, x = sample.column("vec_id").to_numpy(), _matrix(sample.column("embedding").combine_chunks())
    radius = radius_of(vectors, ids, x, k)
    rng = np.random.default_rng(seed)
    width = max(WIDTH * radius, 1e-6)
    share = 1 - (1 - recall) ** (1 / tables)
    most = max(1, round(math.log2(max(n, 2) / 16)))
    direction, shift = rng.normal(size=(tables, most, dimensions)), rng.uniform(0, width, (tables, most))
    seen = _matrix(some(vectors, SEEN).column("embedding").combine_chunks())
    best, least = None, math.inf
    for hashes in range(1, most + 1):
        plan = Plan(direction[:, :hashes], shift[:, :hashes], width, radius, share)
        visits, held = _load(x[:32], seen, plan)
        cost = tables * (PROBE_COST * visits + held * n)
        if cost < least:
            best, least = plan, cost
        if visits > MOST_PROBES or cost > 3 * least:
            break
    return best


def _load(x: np.ndarray, seen: np.ndarray, plan: Plan) -> tuple[float, float]:
    """Mean number of probes of a query in a table, and the share of all rows in the probed buckets."""
    cell, inside = project(x, plan, 0)
    query, move = probes(inside, plan)
    names, counts = np.unique(_bucket(project(seen, plan, 0)[0], 0), return_counts=True)
    probed = _bucket(cell[query] + move, 0)
    at = np.minimum(np.searchsorted(names, probed), len(names) - 1)
    held = counts[at][names[at] == probed].sum()
    return len(query) / max(1, len(x)), held / max(1, len(x)) / max(1, len(seen))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.array(list(x.astype(np.float32))) if len(x) else pa.array([], pa.list_(pa.float32()))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _cell(bucket: np.ndarray, part: np.ndarray, cells: int) -> np.ndarray:
    x = (bucket.view(np.uint64) ^ part.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * _MIX
    return ((x ^ x >> np.uint64(31)) % np.uint64(cells)).astype(np.int32)


def _hot(rows: DataFrame, plan: Plan, tables: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with over ``chunk`` members and the number of their parts: ``HOT`` at most, as ``chunk`` grows with the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for t in range(tables):
                name, n = np.unique(_bucket(project(x, shared.value, t)[0], t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], ["bucket", "n"])

    counts = rows.select("embedding").mapInArrow(named, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > chunk).toPandas().sort_values("bucket")
    return found.bucket.to_numpy(np.int64), -(-found.n.to_numpy(np.int64) // chunk)


def _parts_of(bucket: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, parts = hot
    if not len(names):
        return np.ones(len(bucket), np.int64)
    at = np.minimum(np.searchsorted(names, bucket), len(names) - 1)
    return np.where(names[at] == bucket, parts[at], 1)


def _nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour, distance) of all that tie with the k nearest or are nearer; members sorted by id."""
    d = np.sqrt(_pairs(x, y)).round(6)
    d[ids[:, None] == other] = np.inf
    if d.shape[1] > k:
        least = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero((d <= least) & np.isfinite(d))
    else:
        i, j = np.nonzero(np.isfinite(d))
    return i, other[j], d[i, j]


def _least(q: np.ndarray, m: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct neighbours of each query."""
    order = np.lexsort((d, m, q))
    q, m, d = q[order], m[order], d[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (m[1:] != m[:-1])] if len(q) else np.zeros(0, bool)
    q, m, d = q[once], m[once], d[once]
    order = np.lexsort((m, d, q))
    q, m, d = q[order], m[order], d[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    kept = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return q[kept], m[kept], d[kept]


FOUND = "vec_id bigint, neighbour_id bigint, distance double"


def _found(q: np.ndarray, m: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"vec_id": pa.array(q, pa.int64()), "neighbour_id": pa.array(m, pa.int64()), "distance": pa.array(d, pa.float64())})


def _probed(rows: DataFrame, n: int, asked: DataFrame, plan: Plan, tables: int, k: int, chunk: int) -> DataFrame:
    """Candidates from the probed buckets: at most k for a query and cell."""
    chunk = max(chunk, n * tables // HOT)
    cells = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // chunk))
    shared = rows.sparkSession.sparkContext.broadcast((plan, _hot(rows, plan, tables, chunk)))

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hot = shared.value
        for batch in batches:
            x, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for t in range(tables):
                bucket = _bucket(project(x, plan, t)[0], t)
                part = (ids.view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % _parts_of(bucket, hot)
                yield pa.RecordBatch.from_arrays([pa.array(_cell(bucket, part, cells)), pa.array(bucket), pa.array(ids), _vectors(x)], ["cell", "bucket", "vec_id", "embedding"])

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hot = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for a in range(0, len(x), 500):
                query, name = [], []
                for t in range(tables):
                    cell, inside = project(x[a : a + 500], plan, t)
                    of, move = probes(inside, plan)
                    query.append(of)
                    name.append(_bucket(cell[of] + move, t))
                query, name = np.concatenate(query), np.concatenate(name)
                parts = _parts_of(name, hot)
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                query, name = np.repeat(query, parts), np.repeat(name, parts)
                cell = _cell(name, part, cells)
                order = np.lexsort((cell, query))
                query, name, cell = query[order], name[order], cell[order]
                first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (cell[1:] != cell[:-1])]) if len(query) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(query)].astype(np.int32)), pa.array(name))
                taken = batch.column("vec_id").slice(a, 500).take(pa.array(query[first]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[first]), lists, taken, _vectors(x[a : a + 500][query[first]])], ["cell", "buckets", "vec_id", "embedding"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found(*[np.zeros(0)] * 3)
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("embedding").combine_chunks())
        lists = left.column("buckets").combine_chunks()
        asked_by = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        bucket, other, y = right.column("bucket").to_numpy(), right.column("vec_id").to_numpy(), _matrix(right.column("embedding").combine_chunks())
        order = np.lexsort((other, bucket))
        bucket, other, y = bucket[order], other[order], y[order]
        order = np.argsort(wanted, kind="stable")
        asked_by, wanted = asked_by[order], wanted[order]
        names, first = np.unique(bucket, return_index=True)
        edge = np.r_[first, len(bucket)]
        low, high = np.searchsorted(wanted, names), np.searchsorted(wanted, names, "right")
        out, held = [], 0
        for b in np.flatnonzero(high > low).tolist():
            inside = slice(edge[b], edge[b + 1])
            step = max(1, 4_000_000 // (edge[b + 1] - edge[b]))
            for a in range(low[b], high[b], step):
                of = asked_by[a : min(a + step, high[b])]
                i, m, d = _nearest(x[of], ids[of], y[inside], other[inside], k)
                out.append((of[i], m, d))
                held += len(i)
                if held > 4_000_000:
                    out = [_least(*(np.concatenate(z) for z in zip(*out, strict=True)), k)]
                    held = len(out[0][0])
        if not out:
            return _found(*[np.zeros(0)] * 3)
        q, m, d = _least(*(np.concatenate(z) for z in zip(*out, strict=True)), k)
        return _found(ids[q], m, d)

    held = rows.mapInArrow(members, "cell int, bucket bigint, vec_id bigint, embedding array<float>")
    visited = asked.mapInArrow(visits, "cell int, buckets array<bigint>, vec_id bigint, embedding array<float>")
    return visited.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(best, FOUND)


def _scanned(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Candidates of at most ``EXACT`` queries from a scan of all rows: k for a query and task. The queries are sent to all tasks."""
    table = asked.select("vec_id", "embedding").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((table.column("vec_id").to_numpy(), _matrix(table.column("embedding").combine_chunks())))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            y, other = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for a in range(0, len(y), 4096):
                order = np.argsort(other[a : a + 4096], kind="stable")
                i, m, d = _nearest(x, ids, y[a : a + 4096][order], other[a : a + 4096][order], k)
                kept = _least(np.r_[kept[0], i], np.r_[kept[1], m], np.r_[kept[2], d], k)
        yield from _found(ids[kept[0]] if len(ids) else kept[0], kept[1], kept[2]).to_batches()

    return rows.mapInArrow(best, FOUND)


def _every(rows: DataFrame, n: int, asked: DataFrame, n_asked: int, k: int, chunk: int) -> DataFrame:
    """Candidates from all rows, in parts, for each block of about ``EXACT`` queries."""
    blocks, parts = -(-n_asked // EXACT), -(-n // chunk)

    def numbers(most: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")))

    held = rows.withColumn("block", numbers(blocks)).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    visited = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", numbers(parts))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found(*[np.zeros(0)] * 3)
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("embedding").combine_chunks())
        other, y = right.column("vec_id").to_numpy(), _matrix(right.column("embedding").combine_chunks())
        order = np.argsort(other, kind="stable")
        other, y = other[order], y[order]
        out, step = [], max(1, 4_000_000 // len(y))
        for a in range(0, len(x), step):
            i, m, d = _nearest(x[a : a + step], ids[a : a + step], y, other, k)
            q, m, d = _least(i, m, d, k)
            out.append((ids[a : a + step][q], m, d))
        return _found(*(np.concatenate(z) for z in zip(*out, strict=True)))

    return visited.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(best, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "distance")


def _clean(vectors: DataFrame) -> DataFrame:
    _shared.require(vectors, "vec_id", "embedding")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, tables: int = TABLES, recall: float = RECALL, seed: int = SEED, chunk: int = CHUNK, exact: int = EXACT) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): up to k neighbours, among all ``vectors``, of every row of ``queries`` (by default of every row)."""
    empty = vectors.sparkSession.createDataFrame([], "vec_id bigint, neighbour_id bigint, rank int, distance double")
    rows = _clean(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    dimensions, n = sizes
    rows = rows.where(F.size("embedding") == dimensions)
    left = rows if queries is None else _clean(queries).where(F.size("embedding") == dimensions)
    out = empty
    for _ in range(ROUNDS):
        plan = plan_for(rows, n, dimensions, k, tables, recall, seed, left)
        found = _shared.cut(_ranked(_probed(rows, n, left, plan, tables, k, chunk), k))
        settled = found.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= plan.radius)).select("vec_id")
        out = out.unionByName(found.join(settled, "vec_id", "left_semi"))
        left = _shared.cut(left.join(settled, "vec_id", "left_anti"))
        n_left = left.count()
        if n_left <= exact:
            break
    if not n_left:
        return out
    return out.unionByName(_ranked(_scanned(rows, left, k) if n_left <= EXACT else _every(rows, n, left, n_left, k, chunk), k))
