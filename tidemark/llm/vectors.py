"""Operators 1 and 10: near-duplicate vectors, and approximate nearest neighbours.

A vector takes part if it is not null or empty, holds no null and no value that is not finite, and is not zero. Vectors
are compared with those of their own length only. Identical vectors are one class from the start, so copies never meet
each other: their number is a weight, and their smallest ids stand for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocked, components, forest, hash_share, partitions, runs, staged

#: How many values of vectors a tile, or a driver's sample, holds at most: 64 or 128 MB of 32-bit floats.
SAMPLE_VALUES, TILE_VALUES = 1 << 24, 1 << 25
#: How many cells a vector visits on average at most, its home included; where borders are near to all there are fewer cells.
MOST_VISITS = 4


def usable(embedding: Column) -> Column:
    """Whether a vector takes part; never null."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def lengths_of(vectors: DataFrame) -> list[tuple[int, int]]:
    """(length, number of vectors) of vectors that take part, the most frequent length first."""
    per = vectors.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    return [(r["length"], r["n"]) for r in per.orderBy(F.desc("n"), "length").collect()]


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest_centroid(x: np.ndarray, c: np.ndarray, spherical: bool, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the centroid that is nearest, and how near: block by block, so that memory stays bounded."""
    home, near = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    less = 0 if spherical else (c * c).sum(1)
    for at in range(0, len(x), at_once):
        some = (x[at : at + at_once] @ c.T) * (1 if spherical else 2) - less
        home[at : at + at_once] = some.argmax(1)
        near[at : at + at_once] = some.max(1)
    return home, near


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from a fixed seed; an empty cell takes the row that is farthest from its centroid."""
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        home, near = _nearest_centroid(x, c, spherical)
        n = np.bincount(home, minlength=len(c))
        order = np.argsort(home, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


# Near duplicates


def _visited(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each unit vector, then the rows and the cells of their visits): home, and later cells whose border is within `reach`."""
    near = x @ centroids.T
    home = near.argmax(1)
    lag = near[np.arange(len(home)), home][:, None] - near
    between = np.sqrt(np.maximum(0, 2 - 2 * centroids[home] @ centroids.T)) * reach + 1e-7
    return home, *np.nonzero((lag <= between) & (np.arange(len(centroids)) >= home[:, None]))


def _visits(x: np.ndarray, centroids: np.ndarray, reach: float, tests: int = 2048) -> float:
    """How many cells some unit vectors visit on average."""
    some = x[np.random.default_rng(13).permutation(len(x))[:tests]]
    return sum(len(_visited(some[at : at + 256], centroids, reach)[1]) for at in range(0, len(some), 256)) / max(1, len(some))


def fitted(x: np.ndarray, cells: int, reach: float, most: float = MOST_VISITS) -> np.ndarray:
    """Centroids of up to `cells` cells of unit vectors: as many as leave a vector `most` visits on average.

    At a low threshold borders are within reach of all vectors, and a vector would be sent to half of the cells, however
    many there are. Fewer and larger cells, cut into tiles, compare no more than all pairs, and copies stay few.
    """
    while True:
        centroids = unit(kmeans(x.astype(np.float32), cells, 8, True))
        if cells == 1 or _visits(x, centroids, reach) <= most:
            return centroids
        cells = max(1, cells // 2 if cells <= 16 else cells // 4)


def _to_cells(centroids: np.ndarray, reach: float) -> Callable:
    """Deals each vector to its nearest centroid's cell, its home, and to each later cell whose border is within `reach`.

    Of two vectors that link over a border the one with the earlier home visits the other's, so each pair meets once.
    Vectors of another length than the centroids' have one cell.
    """
    length = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            other = batch.filter(pa.array(sizes != length))
            if other.num_rows:
                yield pa.RecordBatch.from_arrays([*other.columns, pa.array(np.zeros(other.num_rows, np.int32)), pa.array(np.ones(other.num_rows, bool))], [*other.schema.names, "cell", "at_home"])
            batch = batch.filter(pa.array(sizes == length))
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                home, row, cell = _visited(unit(matrix(some.column("embedding"), length)), centroids, reach)
                for k in range(0, len(row), 8192):
                    r, c = row[k : k + 8192], cell[k : k + 8192]
                    out = some.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(c, pa.int32()), pa.array(home[r] == c)], [*out.schema.names, "cell", "at_home"])

    return run


VECTOR_LINK = "u_rep bigint, u_key bigint, v_rep bigint, v_key bigint, n bigint"


def linked_in_blocks(x: np.ndarray, rows: np.ndarray, others: np.ndarray, home: np.ndarray, weight: np.ndarray, threshold: float, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row of x, root of each): cosines of rows with others, block by block, of which one at least is at home.

    If rows are the others, each pair of them counts once. Blocks go into counts and a forest, and no pair is kept.
    """
    same, n, root = rows is others, np.zeros(len(x), np.int64), np.arange(len(x))
    every = np.arange(len(x))
    for at in range(0, len(rows), at_once):
        a = rows[at : at + at_once]
        left = unit(x[a])
        for to in range(at if same else 0, len(others), 4 * at_once):
            b = others[to : to + 4 * at_once]
            linked = left @ unit(x[b]).T >= threshold
            linked &= home[a][:, None] | home[b]
            if same and to < at + len(a):
                linked &= b > a[:, None]
            if linked.any():
                n[a] += linked @ weight[b]
                n[b] += weight[a] @ linked
                i, j = np.nonzero(linked)
                root = forest(len(x), np.concatenate([every, a[i]]), np.concatenate([root, b[j]]))
    return n, root


def _compare(threshold: float) -> Callable:
    """Links within each tile: for each vector how many it has, and a spanning forest of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["label_key", "length", "cell", "tile_a", "tile_b"]):
            x = matrix(tile.column("embedding"), int(tile.column("length")[0].as_py()))
            ids = np.stack([tile.column("rep").to_numpy(), tile.column("key").to_numpy()])
            home, weight, block = (tile.column(c).to_numpy() for c in ("at_home", "weight", "block"))
            a, b = int(tile.column("tile_a")[0].as_py()), int(tile.column("tile_b")[0].as_py())
            rows = np.flatnonzero(block == a)
            n, root = linked_in_blocks(x, rows, rows if a == b else np.flatnonzero(block == b), home, weight, threshold)
            counted, edge = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
            u = ids[:, np.concatenate([counted, edge])]
            v = ids[:, np.concatenate([counted, root[edge]])]
            m = np.concatenate([n[counted], np.zeros(len(edge), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*u, *v, m)], [f.split()[0] for f in VECTOR_LINK.split(", ")])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 16384, tile_rows: int = 65536, sample_rows: int = 65536, max_cells: int = 4096) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Two vectors of the same label and length link if their cosine in double precision is at least `threshold`. Spherical
    k-means, fitted on a sample of the most frequent length of at most about sample_rows vectors (fewer if they are very
    long) and 16 for each cell, cuts the unit vectors into cells of about cell_rows, max_cells at most, and into fewer if
    vectors would visit more than MOST_VISITS of them. A vector is
    compared in its home cell with all that live there and with all that live so close to its border that they could link
    across it, so no link is lost. A cell is one task's, which multiplies it block by block; a cell of more than
    tile_rows is compared in tiles. component_id is the smallest vec_id that links lead to; that one represents its group.

    A row whose vector takes no part, or whose label or vec_id is null, links with nothing and represents itself. Rows
    that repeat a vec_id are vectors of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Two hashes name a label and vector from here on, so that vectors are not shuffled to be recognised again.
    named = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label_key"), part.alias("part"), F.xxhash64("label", "embedding").alias("key"), F.xxhash64(F.lit("vector"), "label", "embedding").alias("key2"))
    classes = named.where("part").groupBy("label_key", "key", "key2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumn("length", F.size("embedding")), "vector-classes")
    length, n_classes = ([*lengths_of(classes), (0, 0)])[0]
    cells = max(1, min(max_cells, math.ceil(n_classes / cell_rows)))
    fit = min(sample_rows, SAMPLE_VALUES // max(1, length), max(16_384, 16 * cells))
    keyed = classes.select("label_key", "length", "rep", "key", "weight", "embedding")
    if cells > 1:
        sample = classes.where((F.col("length") == length) & hash_share(n_classes, fit, "rep", "key")).select("embedding").toArrow()
        reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        centroids = fitted(unit(matrix(sample.column(0), length)), cells, reach)
        embedding = f"embedding {classes.schema['embedding'].dataType.simpleString()}"
        schema = f"label_key string, length int, rep bigint, key bigint, weight bigint, {embedding}, cell int, at_home boolean"
        dealt = keyed.mapInArrow(_to_cells(centroids, reach), schema)
    else:
        dealt = keyed.select("*", F.lit(0).alias("cell"), F.lit(True).alias("at_home"))
    group = ["label_key", "length", "cell"]
    # One row for each label, length and cell.
    sizes = dealt.groupBy(*group).agg(F.count("*").alias("in_cell"))
    most = F.greatest(F.lit(256), F.least(F.lit(tile_rows), F.expr(f"{TILE_VALUES} div length"))) if tile_rows >= 256 else F.lit(tile_rows)
    tiles = blocked(dealt.join(sizes, group), "cell", "key", "in_cell", most).drop("in_cell")
    keys = [*group, "tile_a", "tile_b"]
    links = staged(tiles.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), VECTOR_LINK), "vector-links")
    # A class is named by its smallest vec_id and a hash of what it holds, as a vec_id may have several vectors.
    u, v = (F.struct(F.col(f"{side}_rep").alias("rep"), F.col(f"{side}_key").alias("key")).alias(side) for side in "uv")
    counts = links.where("n > 0").groupBy(F.col("u_rep").alias("rep"), F.col("u_key").alias("key")).agg(F.sum("n").alias("to_others"))
    groups = components(links.where("n = 0").select(u, v)).select("node.*", F.col("component.rep").alias("component"))
    told = classes.select("rep", "key", "key2", "weight").join(counts, ["rep", "key"], "left").join(groups, ["rep", "key"], "left").select(
        "key", "key2", (F.coalesce("to_others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    both = named.where("part").select("vec_id", "key", "key2").join(told, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    alone = named.where("NOT part").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return both.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# Nearest neighbours


class Index:
    """Coarse centroids, and for each of the sub-spaces of the residuals a code book of up to 256 words."""

    def __init__(self, x: np.ndarray, cells: int, subspaces: int, rounds: int = 8):
        x = x.astype(np.float32)
        self.coarse = kmeans(x, cells, rounds, False)
        self.cuts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        x = x[:16_384]  # a sample for code books
        rest = x - self.coarse[self.home(x)]
        self.words = [kmeans(np.ascontiguousarray(rest[:, c]), 256, rounds, False) for c in self.cuts]

    def away(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the coarse centroids, less the square of x."""
        return (self.coarse * self.coarse).sum(1) - 2 * x @ self.coarse.T

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.away(x).argmin(1)

    def codes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[home]
        return np.stack([((w * w).sum(1) - 2 * rest[:, c] @ w.T).argmin(1) for w, c in zip(self.words, self.cuts, strict=True)], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances in double precision from rows to what their cells and codes stand for."""
        rest = x.astype(np.float64) - self.coarse[home]
        total = np.zeros(len(x))
        for j, (w, c) in enumerate(zip(self.words, self.cuts, strict=True)):
            gap = rest[:, c] - w[codes[:, j]]
            total += (gap * gap).sum(1)
        return np.sqrt(total)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """For each query and sub-space, squared distances from its residual to the words: (queries, sub-spaces, 256).

        They are summed from differences in double precision, so that a small one is as exact as a large one.
        """
        rest = q.astype(np.float64) - self.coarse[cell]
        out = np.full((len(q), len(self.words), 256), np.inf)
        for j, (w, c) in enumerate(zip(self.words, self.cuts, strict=True)):
            gap = rest[:, None, c] - w
            out[:, j, : len(w)] = (gap * gap).sum(2)
        return out


def probes_needed(index: Index, x: np.ndarray, k: int, recall: float, tests: int = 256) -> int:
    """In how many cells, nearest first, a share `recall` of the k nearest rows of x to some rows of x are."""
    x = x.astype(np.float32)
    q = x[np.random.default_rng(11).permutation(len(x))[:tests]]
    near = np.argsort((x * x).sum(1) - 2 * q @ x.T, axis=1, kind="stable")[:, 1 : k + 1]
    if not near.size:
        return len(index.coarse)
    order = np.argsort(np.argsort(index.away(q), axis=1), axis=1)
    rank = np.take_along_axis(order, index.home(x)[near], axis=1) + 1
    return int(np.quantile(rank, recall, method="higher"))


TILED = "cell int, key bigint, id bigint, vector binary, codes binary, error double"
TILED_NAMES = [c.split()[0] for c in TILED.split(", ")]


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _encode(index: Index, length: int, dtype: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"), length).astype(dtype)
                home = index.home(x.astype(np.float32))
                codes = index.codes(x.astype(np.float32), home)
                own = [pa.array(home, pa.int32()), batch.column("key"), batch.column("id"), _bytes(x), _bytes(codes), pa.array(index.errors(x, home, codes))]
                yield pa.RecordBatch.from_arrays(own, TILED_NAMES)

    return run


def _probe(index: Index, length: int, probes: int, dtype: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("embedding"), length).astype(dtype)
                near = np.argsort(index.away(q.astype(np.float32)), axis=1, kind="stable")[:, :probes]
                n, packed = batch.num_rows, _bytes(q)
                for j in range(near.shape[1]):
                    own = [pa.array(near[:, j], pa.int32()), batch.column("key"), batch.column("id"), packed, pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64())]
                    yield pa.RecordBatch.from_arrays(own, TILED_NAMES)

    return run


def _nearest_of(q: np.ndarray, key: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The `keep` nearest rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, score, q))
    q = q[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    order, q = order[rank < keep], q[rank < keep]
    return q, key[order], ids[order], score[order]


def _distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Distances in double precision of the pairs (i, j) of columns of q and x, dimension by dimension in their order."""
    out = np.zeros(len(i))
    for at in range(0, len(i), at_once):
        a, b, total = i[at : at + at_once], j[at : at + at_once], out[at : at + at_once]
        for own, other in zip(q, x, strict=True):
            gap = own[a] - other[b]
            total += gap * gap
    return np.sqrt(out)


def _candidates(index: Index, cell: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, keep: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of pairs among which are the `keep` nearest rows of each query, and all that tie with them.

    The `first` nearest codes by table distance are ranked exactly. A row is no nearer than its table distance less the
    error of its code, so each row whose bound is not above the exact distance in place `keep` is ranked as well.
    """
    table = index.tables(q, cell)
    away = np.sqrt(sum(table[:, j, codes[:, j]] for j in range(codes.shape[1])))
    by_query, by_row = np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(x.T, np.float64)
    n = len(x)
    limit = np.full(len(q), np.inf)
    if n > keep:
        some = np.argpartition(away, min(max(first, keep), n) - 1, axis=1)[:, : max(first, keep)]
        exact = _distances(by_query, by_row, np.repeat(np.arange(len(q)), some.shape[1]), some.ravel()).reshape(some.shape)
        limit = np.partition(exact, keep - 1, axis=1)[:, keep - 1]
    # What rounding can take off a bound.
    slack = 1e-12 * (np.linalg.norm(by_query, axis=0) + np.linalg.norm(index.coarse[cell].astype(np.float64)))
    i, j = np.nonzero(~(away * (1 - 1e-12) - error * (1 + 1e-12) - slack[:, None] > limit[:, None]))
    exact = _distances(by_query, by_row, i, j)
    inside = ~(exact > limit[i])
    return i[inside], j[inside], exact[inside]


def _scan(index: Index, length: int, keep: int, first: int, dtype: type, most_held: int = 1_000_000) -> Callable:
    """Each query's `keep` nearest rows by exact distance, over the tiles of a task, ties to the smaller id.

    Tiles' results are merged while they fit into most_held rows; what is full goes out, and is merged again by query.
    """
    names = ["q", "key", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return _nearest_of(*(np.concatenate(x) for x in zip(*held, strict=True)), keep)

        for tile in runs(batches, ["cell", "row_block", "query_block"]):
            asks = np.asarray(tile.column("codes").is_null())
            if not asks.any() or asks.all():
                continue
            cell = int(tile.column("cell")[0].as_py())
            keys, ids = tile.column("key").to_numpy(), tile.column("id").to_numpy()[~asks]
            data = np.frombuffer(b"".join(tile.column("vector").to_pylist()), dtype).reshape(-1, length)
            codes = np.frombuffer(b"".join(tile.column("codes").drop_null().to_pylist()), np.uint8).reshape(len(ids), -1)
            error = tile.column("error").drop_null().to_numpy()
            q, x, asked, of = data[asks], data[~asks], keys[asks], keys[~asks]
            for at in range(0, len(q), 64):
                i, j, score = _candidates(index, cell, q[at : at + 64], x, codes, error, keep, first)
                held.append(_nearest_of(asked[at : at + 64][i], of[j], ids[j], score, keep))
            if sum(len(x[0]) for x in held) > most_held:
                held = [merged()]
                if len(held[0][0]) > most_held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names)

    return run


def _search(asking: DataFrame, classes: DataFrame, index: Index, length: int, probes: int, keep: int, rerank: int, tile_rows: int, tile_queries: int) -> DataFrame:
    """(q, score, vec_id) of the `keep` nearest rows, copies included, that the `probes` nearest cells hold to each query class."""
    spark = classes.sparkSession
    dtype = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    held = classes.select("key", "id", "embedding").mapInArrow(_encode(index, length, dtype), TILED)
    asks = asking.select("key", "id", "embedding").mapInArrow(_probe(index, length, probes, dtype), TILED)
    # One row for each cell of the index.
    per = held.groupBy("cell").agg(F.count("*").alias("n_rows")).join(asks.groupBy("cell").agg(F.count("*").alias("n_queries")), "cell")
    per = per.select("cell", F.ceil(F.col("n_rows") / tile_rows).cast("int").alias("row_blocks"), F.ceil(F.col("n_queries") / tile_queries).cast("int").alias("query_blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    held = held.join(F.broadcast(per), "cell").select(*TILED_NAMES, own("row_blocks").alias("row_block"), spread("query_blocks").alias("query_block"))
    asks = asks.join(F.broadcast(per), "cell").select(*TILED_NAMES, spread("row_blocks").alias("row_block"), own("query_blocks").alias("query_block"))
    keys = ["cell", "row_block", "query_block"]
    tiles = held.unionAll(asks).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    near = tiles.mapInArrow(_scan(index, length, keep, rerank, dtype), "q bigint, key bigint, id bigint, score double")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= keep).select("q", "key", "score")
    exact = near.join(classes.select("key", "members"), "key").select("q", "score", F.explode("members").alias("vec_id"))
    return exact.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= keep).drop("n")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, rerank: int = 192, subspaces: int = 16, sample_rows: int = 65536, max_cells: int = 8192, recall: float = 0.98, tile_rows: int = 8192, tile_queries: int = 512) -> DataFrame:
    """One row (query_id, rank, vec_id, score) for each of the k nearest vectors found to each row where `queries` holds.

    An inverted file over coarse centroids, about the root of the number of vectors but max_cells at most, holds every
    vector as product-quantised residual; it is fitted on a sample of 8,192 vectors, or 8 for each cell if that is more,
    sample_rows at most (fewer if they are very long). A query reads as many cells as, in that sample, hold a share
    `recall` of the true neighbours. In a tile its `rerank` nearest codes by distance tables are ranked by exact distance
    in double precision, and then every code whose table distance less its own error is not above the k-th exact one; so
    none that was read is missed. A query whose cells held fewer than k other vectors reads all cells. Ties go to the
    smaller vec_id. Vectors are neighbours of those of their own length, which have an index for each length.

    Identical vectors are indexed once, with the k + 1 smallest ids (no query can return more of them), and identical
    queries search once. A crowded cell is scanned in tiles. Vectors that take no part and rows without vec_id are
    neither queries nor candidates; an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("asked", F.coalesce(queries, F.lit(False))).select("vec_id", "embedding", "asked")
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for length, _ in lengths_of(rows):
        own = rows.where(F.size("embedding") == length)
        out = out.unionAll(_nearest_of_length(own, length, k, rerank, subspaces, sample_rows, max_cells, recall, tile_rows, tile_queries))
    return out


def _nearest_of_length(rows: DataFrame, length: int, k: int, rerank: int, subspaces: int, sample_rows: int, max_cells: int, recall: float, tile_rows: int, tile_queries: int) -> DataFrame:
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = rows.select("vec_id", "embedding").withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    # Written numbers name the classes, as a vec_id may have several vectors.
    key = F.monotonically_increasing_id().alias("key")
    classes = staged(firsts.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members")).select("*", key), "index-classes")
    asking = staged(rows.where("asked").groupBy("embedding").agg(F.min("vec_id").alias("id")).select("*", key), "query-classes")
    n_classes, n_members = classes.agg(F.count("*"), F.sum(F.size("members"))).first()
    cells = max(1, min(max_cells, round(math.sqrt(n_classes))))
    fit = min(sample_rows, max(8192, 8 * cells), max(256, SAMPLE_VALUES // length))
    x = matrix(classes.where(hash_share(n_classes, fit, "id", "key")).select("embedding").toArrow().column(0), length)
    index = Index(x, cells, subspaces)
    probes = min(len(index.coarse), probes_needed(index, x, k, recall) + 1)

    search = lambda some, n: staged(_search(some, classes, index, length, n, k + 1, rerank, tile_rows, tile_queries), "neighbours")
    best = search(asking, probes)
    if probes < len(index.coarse):
        got = best.groupBy(F.col("q").alias("key")).agg(F.count("*").alias("got"))
        short = staged(asking.join(got, "key", "left").where(F.coalesce("got", F.lit(0)) < min(k + 1, n_members)).drop("got"), "short-queries")
        if short.limit(1).count():
            best = best.join(short.select(F.col("key").alias("q")), "q", "left_anti").unionByName(search(short, len(index.coarse)))
    askers = rows.where("asked").select(F.col("vec_id").alias("query_id"), "embedding").join(asking, "embedding").select("query_id", F.col("key").alias("q"))
    found = askers.join(best, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
