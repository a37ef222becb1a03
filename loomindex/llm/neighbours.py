"""Most similar vectors for every vector, by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected by fixed Gaussian directions, so that the squared projected distance of two
vectors is their squared distance times a chi-square variable with as many degrees of freedom as there
are directions. A kd-tree splits the space of the first ``m`` directions. Each query goes through the
leaves in order of its own projected distance to them and verifies the true cosines of the rows whose
distance over all ``TESTED`` directions is small enough; it stops at the first leaf for which a vector
closer than its current k-th neighbour would, with probability ``p`` or more, have been met before:
``leaf distance**2 > chi2_m(p) * (k-th distance)**2``.

On Spark the tree has two levels above the leaves. Level one has at most ``cells`` cells a model and is
fitted on a bounded sample (``sample`` rows a model); it is the only part of the tree that is broadcast,
and its size does not depend on the data. Level two splits a cell of more rows than fit into a unit; it
is fitted per cell on a bounded sample inside Spark, and kept and joined as a table. Every row is put
into its unit. A unit that is still too large, such as one that holds many copies of a vector, is split
by hash of the id. Round one searches each query's own unit and writes the unit as one row of packed
columns; its k-th distance there bounds which other units can matter. Round two pairs units: each pair
of a unit's queries with the rows of a unit that one of them can reach is read from that table and
searched where it is read. Nothing is exchanged in round two but what it finds, so temporary files stay
linear in the vectors, however many units a query reaches.

Vectors move and are kept as they came, packed without loss (``packed``): two bytes a value where all
are decimals of a few places, four where they are single precision, else eight.

Cost: for a fixed floor of similarity a query verifies a fixed share of its model's rows, so all
queries together grow with the square of a model's rows, by a small factor. No method whose index
has a linear size avoids that for vectors without structure; see the README for figures.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.session import discard, materialize

#: Rows of a leaf inside a unit, and queries that go through the leaves together.
_LEAF, _BLOCK = 512, 32768
#: Directions of the test of single rows, and its probability.
TESTED, TESTED_P = 24, 0.99
#: Bytes of vectors in a unit at most.
UNIT_BYTES = 32 << 20
#: Kinds of packed vectors: decimals of so many places, or floats. Units in a file of the units' table, each read as a whole.
_PLACES, _SINGLE, _DOUBLE, _UNITS_A_FILE = range(7), 7, 8, 4


def chi_square_quantile(p: float, m: int) -> float:
    """Psi_m^-1(p) for even m, by bisection on the closed form."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, m // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(dimensions: int, m: int) -> np.ndarray:
    """Fixed standard normal directions for vectors of this length."""
    return np.random.default_rng(7 * dimensions + m).standard_normal((dimensions, m))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(model, dimensions, id, vectors): the different vectors of each model and id, packed; nearly always one (see ``_chosen``).

    Left out: null ids, models and vectors, lengths other than ``dimensions``, empty, all-zero and
    non-finite vectors (null elements included). Rows delivered twice count once.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = (
        F.col("symbol_id").isNotNull() & F.col("model").isNotNull() & (F.size(value) == F.col("dimensions")) & (F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0)
    )
    rows = vectors.filter(good).select("model", "dimensions", F.col("symbol_id").alias("id"), value.cast("array<double>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at in _same(batch, "dimensions"):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in (*_MODEL, "id")), packed(_matrix(part["vector"]))], [*_MODEL, "id", "vector"])

    narrow = rows.mapInArrow(pack, "model string, dimensions int, id bigint, vector binary")
    return narrow.groupBy("model", "dimensions", "id").agg(F.collect_set("vector").alias("vectors"))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _kinds(x: np.ndarray) -> np.ndarray:
    """The smallest kind for each row of a matrix that gives back its very values."""
    with np.errstate(over="ignore", invalid="ignore"):
        kinds = np.where((x.astype(np.float32) == x).all(axis=1), _SINGLE, _DOUBLE).astype(np.uint8)
        rest = np.arange(len(x))
        for places in _PLACES:
            y = x[rest]
            whole = np.rint(y * 10.0**places)
            fits = ((whole / 10.0**places == y) & (np.abs(whole) < 1 << 15)).all(axis=1)
            kinds[rest[fits]] = places
            rest = rest[~fits]
    return kinds


def _width(kinds: np.ndarray | int, dimensions: int) -> np.ndarray | int:
    """Bytes of a packed row without its kind."""
    return dimensions * np.where(kinds == _DOUBLE, 8, np.where(kinds == _SINGLE, 4, 2))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, without loss: a byte for the kind, then the values; of decimals first all low bytes, then all high ones."""
    kinds = _kinds(x)
    ends = np.concatenate([[0], np.cumsum(1 + _width(kinds, x.shape[1]))]).astype(np.int64)
    out = np.zeros(ends[-1], np.uint8)
    out[ends[:-1]] = kinds
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        if kind in _PLACES:
            whole = np.rint(x[at] * 10.0**kind).astype(np.int16)
            # The sign in the lowest bit, so that small values have a high byte of zero.
            signed = ((whole << 1) ^ (whole >> 15)).astype("<i2")
            own = signed.view(np.uint8).reshape(len(at), -1, 2).transpose(0, 2, 1).reshape(len(at), -1)
        else:
            own = np.ascontiguousarray(x[at].astype("<f4" if kind == _SINGLE else "<f8")).view(np.uint8).reshape(len(at), -1)
        out[(ends[at] + 1)[:, None] + np.arange(own.shape[1])] = own
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


def _unpacked(data: np.ndarray, starts: np.ndarray, kinds: np.ndarray, dimensions: int) -> np.ndarray:
    out = np.empty((len(kinds), dimensions))
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        for some in np.array_split(at, len(at) // 4096 + 1):
            own = data[starts[some][:, None] + np.arange(_width(int(kind), dimensions))]
            if kind in _PLACES:
                signed = own[:, :dimensions].astype(np.uint16) | (own[:, dimensions:].astype(np.uint16) << 8)
                out[some] = ((signed >> 1) ^ -(signed & 1)).view(np.int16) / 10.0**kind
            else:
                out[some] = own.view("<f4" if kind == _SINGLE else "<f8")
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """The matrix that ``packed`` was given."""
    parts = [_unpacked(data, starts, data[starts - 1], dimensions) for data, starts, _ in _payloads(column)]
    return np.concatenate(parts) if parts else np.zeros((0, dimensions))


def _payloads(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start of each row's values, end of each row) of packed vectors."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            yield np.frombuffer(chunk.buffers()[2], np.uint8), ends[:-1] + 1, ends[1:]


def _block(column: pa.Array | pa.ChunkedArray) -> tuple[bytes, bytes]:
    """(kinds, values) of packed vectors, each as one value."""
    kinds, values = [], []
    for data, starts, ends in _payloads(column):
        keep = np.zeros(len(data), bool)
        keep[starts[0] - 1 : ends[-1]] = True
        keep[starts - 1] = False
        kinds.append(data[starts - 1].tobytes())
        values.append(data[keep].tobytes())
    return b"".join(kinds), b"".join(values)


def _from_block(kinds: pa.Scalar, values: pa.Scalar, dimensions: int, rows: slice = slice(None)) -> np.ndarray:
    kinds = np.frombuffer(kinds.as_buffer(), np.uint8)
    widths = _width(kinds, dimensions)
    return _unpacked(np.frombuffer(values.as_buffer(), np.uint8), (np.cumsum(widths) - widths)[rows], kinds[rows], dimensions)


def _chosen(column: pa.Array, dimensions: int) -> pa.Array:
    """One packed vector a row: of different ones of one id and model, the smallest in array order."""
    lists, values = np.diff(column.offsets.to_numpy()), column.flatten()
    if (lists == 1).all():
        return values
    starts = np.cumsum(lists) - lists
    for i in np.flatnonzero(lists > 1):
        some = unpacked(values.slice(starts[i], lists[i]), dimensions)
        starts[i] += np.lexsort(some.T[::-1])[0]
    return values.take(pa.array(starts))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Some levels of a kd-tree: nodes as (dimension, cut, left, right), leaves as numbers below zero."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.leaves = 0
        self.root = self._build(points, leaves)

    def _build(self, points: np.ndarray, leaves: int) -> int:
        wide = int(np.argmax(points.var(axis=0))) if len(points) else 0
        cut = float(np.median(points[:, wide])) if len(points) else 0.0
        left = points[:, wide] <= cut if len(points) else np.zeros(0, bool)
        if leaves <= 1 or left.all() or not left.any():
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append((wide, cut, 0, 0))
        a, b = self._build(points[left], leaves // 2), self._build(points[~left], leaves - leaves // 2)
        self.nodes[at] = (wide, cut, a, b)
        return at

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            wide, cut, a, b = self.nodes[node]
            left = points[rows, wide] <= cut
            stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves whose squared distance to the row's point is at most its ``reach``; parts of the tree out of reach are not entered."""
        rows, leaves = [], []
        stack = [(self.root, np.arange(len(points)), np.zeros(points.shape))]
        while stack:
            node, at, apart = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            wide, cut, a, b = self.nodes[node]
            beyond = np.square(points[at, wide] - cut)
            left = points[at, wide] <= cut
            for child, inside in ((a, left), (b, ~left)):
                there = apart.copy()
                there[:, wide] = np.where(inside, there[:, wide], np.maximum(there[:, wide], beyond))
                near = there.sum(axis=1) <= reach[at]
                stack.append((child, at[near], there[near]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def local_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the kd-tree leaves of a unit, at most _LEAF rows each."""
    stack, out = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= _LEAF:
            out.append(rows)
            continue
        wide = int(np.argmax(points[rows].var(axis=0)))
        order = rows[np.argpartition(points[rows, wide], len(rows) // 2)]
        stack += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, m) to boxes (b, m): (n, b)."""
    out = np.zeros((len(points), len(low)), points.dtype)
    for j in range(points.shape[1]):
        x = points[:, j : j + 1]
        out += np.square(np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0))
    return out


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few true values; eight are looked at together."""
    flat, width = found.ravel(), found.shape[1]
    if len(flat) % 8:
        at = np.flatnonzero(flat)
    else:
        some = np.flatnonzero(flat.view(np.uint64))
        eight = (some[:, None] * 8 + np.arange(8)).ravel()
        at = eight[flat[eight]]
    return at // width, at % width


def _reach(limit: float, known: np.ndarray) -> np.ndarray:
    """Squared projected distance up to which a vector with at least the cosine ``known`` is to be expected."""
    return limit * (2 - 2 * np.minimum(known, 1)) + 1e-4


def search(query: np.ndarray, query_ids: np.ndarray, known: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, limit: float, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, cosine) that may be among the k best of each query.

    ``known`` is the k-th best cosine so far (or the floor). ``limit`` is chi2_m(p). Only cosines of at
    least what is known are given. All vectors are unit vectors.
    """
    if not len(data) or not len(query):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a = directions(data.shape[1], TESTED)
    near, far = (query @ a).astype(np.float32), (data @ a).astype(np.float32)
    leaves = local_leaves(far[:, :m])
    low, high = np.stack([far[x, :m].min(axis=0) for x in leaves]), np.stack([far[x, :m].max(axis=0) for x in leaves])
    # Two more columns, so that one product gives (reach - squared distance) / 2.
    near_norm = np.square(near).sum(axis=1)
    near = np.column_stack([near, np.ones(len(near), np.float32), np.zeros(len(near), np.float32)])
    turned = [np.ascontiguousarray(np.column_stack([far[x], -np.square(far[x]).sum(axis=1) / 2, np.ones(len(x))]).T.astype(np.float32)) for x in leaves]
    sharp = chi_square_quantile(TESTED_P, TESTED)
    rows, columns, values = [], [], []
    for start in range(0, len(query), _BLOCK):
        block = slice(start, start + _BLOCK)
        distance = box_distance(near[block, :m], low, high)
        order = np.argsort(distance, axis=1)
        least, norm = known[block].copy(), near_norm[block]
        best = np.full((len(least), k), -2.0)
        going = np.arange(len(least))
        for turn in range(len(leaves)):
            # The stopping test: no later leaf of a query is nearer than this one.
            going = going[distance[going, order[going, turn]] <= _reach(limit, least[going])]
            if not len(going):
                break
            going = going[np.argsort(order[going, turn], kind="stable")]
            now = order[going, turn]
            ends = np.flatnonzero(np.diff(now, append=-1)) + 1
            for at, end in zip([0, *ends[:-1]], ends):
                leaf, mine = now[at], going[at:end]
                # The rows whose squared distance over all directions is at most the reach.
                spot = near[start + mine]
                spot[:, -1] = (_reach(sharp, least[mine]) - norm[mine]) / 2
                i, j = _places(spot @ turned[leaf] >= 0)
                if not len(i):
                    continue
                q, d = mine[i], leaves[leaf][j]
                exact = np.concatenate([np.einsum("ij,ij->i", query[start + q[x : x + _BLOCK]], data[d[x : x + _BLOCK]]) for x in range(0, len(q), _BLOCK)])
                exact = np.round(exact, 6)
                keep = (exact >= least[q]) & (query_ids[start + q] != ids[d])
                q, d, exact = q[keep], d[keep], exact[keep]
                if not len(q):
                    continue
                rows.append(start + q)
                columns.append(d)
                values.append(exact)
                sort = np.lexsort((-exact, q))
                q, exact = q[sort], exact[sort]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                touched = np.unique(q)
                fresh = np.full((len(touched), k), -2.0)
                top = rank < k
                fresh[np.searchsorted(touched, q[top]), rank[top]] = exact[top]
                both = -np.sort(-np.concatenate([best[touched], fresh], axis=1), axis=1)[:, :k]
                best[touched] = both
                least[touched] = np.maximum(least[touched], both[:, -1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _best(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each row: larger cosine first, then smaller id."""
    order = np.lexsort((ids, -values, rows))
    r = rows[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return order[rank < k]


_FOUND = "model string, dimensions int, query_id bigint, id bigint, cosine double"


def _found(query_ids: np.ndarray, ids: np.ndarray, found: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, query id, id, cosine) of the k best of each query."""
    q, d, value = found
    take = _best(q, ids[d], value, k)
    return q[take], query_ids[q[take]], ids[d[take]], value[take]


def _same(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of each distinct combination of a few columns."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch[c].to_pylist() for c in names))):
        groups.setdefault(key, []).append(i)
    for key, at in groups.items():
        yield key, np.array(at)


_MODEL = ["model", "dimensions"]
_UNIT = [*_MODEL, "cell", "sub", "part"]
_ROWS = ["ids", "kinds", "vectors"]


class Neighbours:
    """The k most similar vectors of the same model and length.

    ``vectors``: symbol_id, model, dimensions, embedding; other columns are ignored. An empty table
    gives no row; a model with one vector gives none either. ``floor``: least cosine that is wanted.
    ``load``: queries of a unit that are dealt out together.
    """

    def __init__(self, vectors: DataFrame, k: int = 5, floor: float = -1.0, m: int = 8, p: float = 0.9, unit_size: int = 32768, sample: int = 20000, cells: int = 256, load: int = 32768):
        self.k, self.floor, self.m, self.limit, self.load = k, floor, m, chi_square_quantile(p, m), load
        rows = materialize(usable_vectors(vectors), "vectors", tidy=True, compression="zstd")
        fitting = F.least(F.lit(unit_size), F.greatest(F.lit(256), F.lit(UNIT_BYTES // 8) / F.col("dimensions"))).cast("int")
        self._trees = rows.sparkSession.sparkContext.broadcast(self._level_one(rows, unit_size, sample, cells))
        trees = self._trees

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, at in _same(batch, *_MODEL):
                    part = batch.take(pa.array(at))
                    vector = _chosen(part["vectors"], key[1])
                    spot = _unit_rows(unpacked(vector, key[1])) @ directions(key[1], TESTED)[:, :m]
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in (*_MODEL, "id")), vector, pa.array(trees.value[key].assign(spot))], [*_MODEL, "id", "vector", "cell"])

        placed = rows.mapInArrow(place, "model string, dimensions int, id bigint, vector binary, cell bigint")
        held = materialize(placed.groupBy(*_MODEL, "cell").agg(F.count("*").alias("rows")), "cells", tidy=True)
        self._subtrees, index = self._level_two(placed, held, fitting, sample)
        if index is not None:
            discard(rows)
        # Of a unit whose rows no cut separates, parts by hash.
        sizes = held.withColumn("sub", F.lit(0).cast("bigint")) if index is None else index.groupBy(*_MODEL, "cell", "sub").agg(F.count("*").alias("rows"))
        self._parts = materialize(sizes.withColumn("parts", F.ceil(F.col("rows") / fitting).cast("int")).select(*_MODEL, "cell", "sub", "parts"), "parts", tidy=True)
        split, parts = self._parts.filter("parts > 1"), F.coalesce("parts", F.lit(1))
        index = placed.withColumn("sub", F.lit(0).cast("bigint")) if index is None else index
        self._index = index.join(split, [*_MODEL, "cell", "sub"], "left").select(*_MODEL, "cell", "sub", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "vector")

    def _level_one(self, rows: DataFrame, unit_size: int, sample: int, cells: int) -> dict[tuple, Tree]:
        """A tree of at most ``cells`` leaves for each model, from a bounded sample."""
        counts = {(r.model, r.dimensions): r.n for r in rows.groupBy(*_MODEL).agg(F.count("*").alias("n")).collect()}  # one row a model
        shares = [(model, dimensions, int(min(1.0, sample / n) * (1 << 20)) + 1) for (model, dimensions), n in counts.items()]
        if not shares:
            return {}
        few = F.broadcast(rows.sparkSession.createDataFrame(shares, "model string, dimensions int, share int"))  # one row a model
        taken = rows.join(few, _MODEL).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share")).select(*_MODEL, "vectors").toArrow()
        points = {key: np.zeros((0, self.m)) for key in counts}
        for batch in taken.combine_chunks().to_batches():
            for key, at in _same(batch, *_MODEL):
                x = unpacked(_chosen(batch["vectors"].take(pa.array(at)), key[1]), key[1])
                points[key] = np.concatenate([points[key], _unit_rows(x) @ directions(key[1], TESTED)[:, : self.m]])
        return {key: Tree(points[key], min(cells, math.ceil(n / min(unit_size, max(256, UNIT_BYTES // 8 // key[1]))))) for key, n in counts.items()}

    def _level_two(self, placed: DataFrame, held: DataFrame, fitting: Column, sample: int) -> tuple[DataFrame, DataFrame | None]:
        """(model, dimensions, cell, tree) of cells that are split further, and the rows with their place ``sub`` in their cell; no rows where no cell is."""
        group, m = [*_MODEL, "cell"], self.m
        large = held.withColumn("leaves", F.ceil(F.col("rows") / fitting).cast("int")).filter("leaves > 1")
        kinds = "model string, dimensions int, cell bigint, tree binary"
        if large.isEmpty():
            return placed.sparkSession.createDataFrame([], kinds), None

        def spots(column: pa.Array, dimensions: int) -> np.ndarray:
            return _unit_rows(unpacked(column, dimensions)) @ directions(dimensions, TESTED)[:, :m]

        def fit(table: pa.Table) -> pa.Table:
            tree = Tree(spots(table["vector"], table["dimensions"][0].as_py()), table["leaves"][0].as_py())
            return pa.table({"model": table["model"][:1], "dimensions": table["dimensions"][:1], "cell": table["cell"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        share = F.pmod(F.xxhash64("id"), F.col("rows")) < F.lit(sample)
        seen = placed.join(large, group).filter(share).select(*group, "vector", "leaves")
        trees = materialize(seen.groupBy(*group).applyInArrow(fit, kinds), "subtrees", tidy=True)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (_, dimensions, _), at in _same(batch, *group):
                    part = batch.take(pa.array(at))
                    tree = part["tree"][0].as_py()
                    sub = pickle.loads(tree).assign(spots(part["vector"], dimensions)) if tree else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in (*group, "id", "vector")), pa.array(sub)], [*group, "id", "vector", "sub"])

        within = placed.join(trees, group, "left").select(*group, "id", "vector", "tree")
        return trees, materialize(within.mapInArrow(assign, "model string, dimensions int, cell bigint, id bigint, vector binary, sub bigint"), "assigned", tidy=True, compression="zstd")

    def _units(self, wanted: Column) -> DataFrame:
        """Round one: a row for each unit with its rows, its queries with their k-th cosine there and the cells they can reach, and what they found.

        Where all rows are queries, ``asked_`` columns are null."""
        k, floor, limit, m, trees = self.k, self.floor, self.limit, self.m, self._trees
        pairs = pa.list_(pa.struct([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())]))

        def own(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            key = (table["model"][0].as_py(), table["dimensions"][0].as_py())
            x, ids = _unit_rows(unpacked(table["vector"], key[1])), table["id"].to_numpy()
            asked = np.flatnonzero(table["asked"].to_numpy())
            query, query_ids = x[asked], ids[asked]
            q, *found = _found(query_ids, ids, search(query, query_ids, np.full(len(asked), floor), x, ids, k, limit, m), k)
            kth = np.full(len(asked), np.inf)
            np.minimum.at(kth, q, found[2])
            kth = np.where(np.bincount(q, minlength=len(asked)) >= k, kth, floor)
            spot = query @ directions(key[1], TESTED)[:, :m]
            cells = np.unique(trees.value[key].within(spot, _reach(limit, kth))[1])
            few = len(asked) < len(ids)
            asked_rows = (query_ids.tobytes(), *_block(table["vector"].take(pa.array(asked)))) if few else (None,) * 3
            found = pa.StructArray.from_arrays([pa.array(query_ids[q]), *map(pa.array, found[1:])], fields=list(pairs.value_type))
            columns = {c: pa.array([v], pa.binary()) for c, v in zip([*_ROWS, *(f"asked_{c}" for c in _ROWS), "kth"], (ids.tobytes(), *_block(table["vector"]), *asked_rows, kth.tobytes()))}
            return pa.table({c: table[c][:1] for c in _UNIT} | columns | {"queries": pa.array([len(asked)], pa.int32()), "cells": pa.array([cells.tolist()], pa.list_(pa.int64())), "found": pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)})

        blobs = ", ".join(f"{c} binary" for c in [*_ROWS, *(f"asked_{c}" for c in _ROWS), "kth"])
        schema = f"model string, dimensions int, cell bigint, sub bigint, part int, {blobs}, queries int, cells array<bigint>, found array<struct<query_id: bigint, id: bigint, cosine: double>>"
        marked = self._index.withColumn("asked", F.coalesce(wanted, F.lit(False)))
        return materialize(marked.groupBy(*_UNIT).applyInArrow(own, schema), "own-unit", tidy=True, compression="zstd", maxRecordsPerFile=_UNITS_A_FILE)

    def search(self, queries: Column | None = None) -> DataFrame:
        """(model, query_id, id, cosine, rank) of the k best, for all rows or those that ``queries`` (a Column on id) selects."""
        k, limit, m, load = self.k, self.limit, self.m, self.load
        units = self._units(queries if queries is not None else F.lit(True))
        first = units.select(*_MODEL, F.explode("found").alias("pair")).select(*_MODEL, "pair.query_id", "pair.id", "pair.cosine")
        mine = [F.coalesce(f"asked_{c}", c).alias(f"own_{c}") for c in _ROWS]
        asked = units.filter("queries > 0").select(*(F.col(c).alias(f"own_{c}") for c in _UNIT), *mine, "kth", "cells", F.explode(F.sequence(F.lit(0), F.ceil(F.col("queries") / F.lit(load)).cast("int") - 1)).alias("turn"))
        same = lambda names: [F.col(f"own_{c}") == F.col(c) for c in names]
        met = reduce(and_, [*same(_MODEL), F.array_contains("cells", F.col("cell")), ~reduce(and_, same(_UNIT[2:]))])
        # Each pair of units is read where it is searched; an exchange would copy a unit once for every unit that reaches it.
        pairs = asked.join(units.select(*_UNIT, *_ROWS).hint("shuffle_replicate_nl"), met)

        def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, query, query_ids, kth = None, None, None, None
            for batch in batches:
                for i in range(len(batch)):
                    at = lambda c: batch[c][i]  # noqa: B023, E731
                    key = tuple(at(c).as_py() for c in (*(f"own_{c}" for c in _UNIT), "turn"))
                    model, dimensions = key[:2]
                    if key != last:
                        turn = slice(key[-1] * load, (key[-1] + 1) * load)
                        query_ids, kth = (np.frombuffer(at(c).as_buffer(), kind)[turn].copy() for c, kind in (("own_ids", np.int64), ("kth", np.float64)))
                        query, last = _unit_rows(_from_block(at("own_kinds"), at("own_vectors"), dimensions, turn)), key
                    x, ids = _unit_rows(_from_block(at("kinds"), at("vectors"), dimensions)), np.frombuffer(at("ids").as_buffer(), np.int64)
                    # Queries that reach the unit at all.
                    a = directions(dimensions, TESTED)[:, :m]
                    spot = x @ a
                    near = np.flatnonzero(box_distance(query @ a, spot.min(axis=0)[None], spot.max(axis=0)[None])[:, 0] <= _reach(limit, kth))
                    _, *found = _found(query_ids[near], ids, search(query[near], query_ids[near], kth[near], x, ids, k, limit, m), k)
                    n = len(found[0])
                    yield pa.RecordBatch.from_arrays([pa.array([model] * n, pa.string()), pa.array([dimensions] * n, pa.int32()), *map(pa.array, found)], [*_MODEL, "query_id", "id", "cosine"])

        second = pairs.mapInArrow(other, _FOUND)
        order = Window.partitionBy(*_MODEL, "query_id").orderBy(F.desc("cosine"), "id")
        ranked = first.union(second).withColumn("rank", F.row_number().over(order))
        return ranked.filter(F.col("rank") <= k).select("model", "query_id", "id", "cosine", "rank")
