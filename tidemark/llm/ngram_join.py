"""Operator 2: Jaccard similarity join on word n-grams by MinHash banding.

Documents with the same set of n-grams are one class. Classes that share a band and whose one-byte sketches agree well
enough are candidates; linked candidates form clusters, and each cluster's whole texts meet once to be verified on their
full n-gram sets. Buckets and clusters of any size are compared in tiles, and what leaves a tile is a count for each
document and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, components, forest, giving_back, held_by_worker, partitions, runs, staged, whole_row

MOST_WORDS = 200_000


def bands_for(threshold: float, recall: float, most_hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): the most rows for which pairs at the threshold share a band with probability `recall` or more."""
    for rows in range(10, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("most_hashes is too small for this recall")


def least_agreement(threshold: float, hashes: int) -> int:
    """How many of the hashes agree at least for pairs at the threshold, but for one in a billion (six deviations)."""
    return max(1, math.floor(hashes * threshold - 6 * math.sqrt(hashes * threshold * (1 - threshold))))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < MOST_WORDS:
            self[word] = value
        return value


def _word_hashes() -> _WordHashes:
    return held_by_worker("word hashes", _WordHashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's lower-cased words; fewer than n words are one n-gram."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**31, hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, hashes, np.uint32)


def minhashes(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at : at + 1024, None] * a + b).min(0), out=out)
    return out


SIGNED = "doc_id bigint, text_hash bigint, n_bytes bigint, set_key binary, bands array<bigint>, sketch binary"


def _sign(n: int, bands: int, rows: int) -> Callable:
    a, b = _constants(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            where, keys, cut, sketches = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                own = shingles(text.as_py(), n)
                if len(own):
                    least = minhashes(own, a, b)
                    by = least.reshape(bands, rows).astype(np.uint64)
                    key = turn
                    for j in range(rows):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + by[:, j])
                    where.append(i)
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    cut.append(key.view(np.int64))
                    sketches.append(mixed(least.astype(np.uint64)).astype(np.uint8).tobytes())
            if where:
                some = batch.take(pa.array(where))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(cut) + 1, bands, dtype=np.int32)), pa.array(np.concatenate(cut)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "text_hash", "n_bytes")), pa.array(keys, pa.binary()), listed, pa.array(sketches, pa.binary())], [x.split()[0] for x in SIGNED.split(", ")])

    return run


EDGE = "u_doc bigint, u_hash bigint, v_doc bigint, v_hash bigint, n bigint"


def _edges(doc: np.ndarray, text: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc[u]), pa.array(text[u]), pa.array(doc[v]), pa.array(text[v]), pa.array(n, pa.int64())], ["u_doc", "u_hash", "v_doc", "v_hash", "n"])


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of a tile's two blocks, and whether they are the same one."""
    a, b = tile.column("tile_a")[0].as_py(), tile.column("tile_b")[0].as_py()
    block = tile.column("block").to_numpy()
    left = np.flatnonzero(block == a)
    return left, (left if a == b else np.flatnonzero(block == b)), a == b


def _spanning(size: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = forest(size, i, j)
    own = np.flatnonzero(root != np.arange(size))
    return own, root[own]


def _candidates(agreement: int) -> Callable:
    """Of each tile of a bucket, a spanning forest of the pairs whose sketches agree in `agreement` bytes at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for tile in runs(batches, ["h", "tile_a", "tile_b"]):
            left, right, same = _sides(tile)
            if len(left) == 0 or len(right) == 0 or same and len(left) < 2:
                continue
            sketches = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), np.uint8).reshape(tile.num_rows, -1)
            agree = np.zeros((len(left), len(right)), np.int16)
            for k in range(sketches.shape[1]):
                agree += sketches[left, k][:, None] == sketches[right, k]
            i, j = np.nonzero(agree >= agreement)
            i, j = left[i], right[j]
            u, v = _spanning(tile.num_rows, i[i != j], j[i != j])
            if len(u):
                ids = np.stack([tile.column("doc_id").to_numpy(), tile.column("text_hash").to_numpy()])
                us.append(ids[:, u])
                vs.append(ids[:, v])
            if len(us) > 2000:
                yield _joined(us, vs)
                us, vs = [], []
        if us:
            yield _joined(us, vs)

    return run


def _joined(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    (a, b), (c, d) = np.concatenate(us, 1), np.concatenate(vs, 1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, c, d)] + [pa.array(np.zeros(len(a), np.int64))], ["u_doc", "u_hash", "v_doc", "v_hash", "n"])


def common_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of `sets` has in common with each of `others`."""
    values, which = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(x) for x in (*sets, *others)])
    shared = np.bincount(which, minlength=len(values)) > 1
    column = (np.cumsum(shared) - 1)[which[shared[which]]]
    owner = owner[shared[which]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(others)), np.float32)
    width = max(64, 4_000_000 // (len(sets) + len(others)))
    for at in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, [at, at + width])
        grid = np.zeros((len(sets) + len(others), min(width, int(shared.sum()) - at)), np.float32)
        grid[owner[a:z], column[a:z] - at] = 1
        out += grid[: len(sets)] @ grid[len(sets) :].T
    return np.rint(out).astype(np.int64)


def _verify(n: int, threshold: float) -> Callable:
    """Links within each tile of a cluster: how many each class has, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["cluster_doc", "cluster_hash", "tile_a", "tile_b"]):
            left, right, same = _sides(tile)
            if len(left) == 0 or len(right) == 0 or same and len(left) < 2:
                continue
            sets = [shingles(x.as_py(), n) for x in tile.column("text")]  # one text at a time as a Python string
            size, weight = np.array([len(x) for x in sets]), tile.column("copies").to_numpy()
            both = common_counts([sets[i] for i in left], [sets[j] for j in right])
            linked = both >= threshold * (size[left][:, None] + size[right] - both) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            counts = np.zeros(tile.num_rows, np.int64)
            counts[left] += linked @ weight[right]
            if not same:
                counts[right] += weight[left] @ linked
            i, j = np.nonzero(linked)
            u, v = _spanning(tile.num_rows, left[i], right[j])
            some = np.flatnonzero(counts)
            yield _edges(tile.column("doc_id").to_numpy(), tile.column("text_hash").to_numpy(), np.concatenate([some, u]), np.concatenate([some, v]), np.concatenate([counts[some], np.zeros(len(u), np.int64)]))

    return run


def similar_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99999, bucket_rows: int = 512, cluster_rows: int = 1024, cluster_bytes: int = 8_000_000) -> DataFrame:
    """One row (doc_id, text_hash, class_id, n_links) for each row of docs (doc_id, text).

    Two documents link if the Jaccard similarity of their sets of n-grams of words (lower-cased, separated by white
    space) is at least `threshold`. n_links is the number of other documents that a document links with, copies included;
    class_id is the smallest doc_id that links lead to. Bands and rows follow from the threshold and the recall wanted.

    A null or wordless text, and a row without doc_id, links with nothing. A text of fewer than n words is one n-gram.
    Rows that repeat a doc_id are compared each for itself. An empty table gives an empty result; other columns are not
    read and may have any names.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    bands, rows = bands_for(threshold, recall)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = staged(texts.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("n_bytes", F.octet_length("text").cast("bigint")).mapInArrow(giving_back(_sign(n, bands, rows)), SIGNED), "signatures")
    node = F.struct("doc_id", "text_hash")
    classes = signed.groupBy("set_key").agg(F.min(node).alias("node"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "text-classes")

    in_bands = classes.select(F.explode("bands").alias("h"), "node")
    crowded = in_bands.groupBy("h").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    met = in_bands.join(crowded, "h").join(classes.select("node", "sketch"), "node").select("h", "in_bucket", "node.*", "sketch")
    keys = ["h", "tile_a", "tile_b"]
    tiles = blocked(met, "h", "doc_id", "in_bucket", bucket_rows).drop("in_bucket")
    pairs = tiles.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(giving_back(_candidates(least_agreement(threshold, bands * rows))), EDGE)
    edge = [F.struct(F.col("u_doc").alias("doc_id"), F.col("u_hash").alias("text_hash")).alias("u"), F.struct(F.col("v_doc").alias("doc_id"), F.col("v_hash").alias("text_hash")).alias("v")]
    clusters = staged(components(pairs.select(*edge)), "clusters")

    # A cluster has so many blocks that a block's texts are about cluster_rows and cluster_bytes at most.
    members = clusters.join(classes.select("node", "copies", "n_bytes"), "node")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(cluster_rows)), F.ceil(F.sum("n_bytes") / F.lit(cluster_bytes))).alias("blocks"))
    members = members.join(sizes, "component").select("node.*", "copies", "blocks", F.col("component.doc_id").alias("cluster_doc"), F.col("component.text_hash").alias("cluster_hash"))
    members = texts.join(members, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    keys = ["cluster_doc", "cluster_hash", "tile_a", "tile_b"]
    tiles = blocked(members, "cluster_doc", "text_hash", "blocks", 1).drop("blocks")
    links = staged(tiles.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(giving_back(_verify(n, threshold)), EDGE), "links")

    counts = links.where("n > 0").select(edge[0].alias("node"), "n").groupBy("node").agg(F.sum("n").alias("to_others"))
    groups = components(links.where("n = 0").select(*edge)).select("node", "component")
    told = classes.select("set_key", "node", "copies").join(counts, "node", "left").join(groups, "node", "left").select(
        "set_key", F.coalesce("component.doc_id", "node.doc_id").alias("class_id"), (F.coalesce("to_others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    known = signed.select("doc_id", "text_hash", "set_key").join(told, "set_key").select("doc_id", "text_hash", "class_id", "n_links")
    wordless = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")), F.lit("")) == ""
    alone = texts.where(F.col("doc_id").isNull() | wordless).select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return known.unionAll(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those documents that link, directly or through others, to one with a smaller doc_id."""
    found = similar_documents(docs, **options).where("class_id < doc_id").select(F.col("doc_id").alias("gone_doc"), F.col("text_hash").alias("gone_hash")).distinct()
    own = docs.select(whole_row(docs))
    own = own.join(found, (F.col("row.doc_id") == F.col("gone_doc")) & (F.xxhash64("row.text") == F.col("gone_hash")), "left_anti")
    return own.select("row.*")


def one_row_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs of each group of rows that link, directly or through others: that with the smallest doc_id.

    Rows are told apart by their written numbers. So rows that repeat a doc_id, or have none, are members of groups like
    others; null comes after all ids, and of equal ids the smaller text hash, then the smaller row number, stays.
    """
    rows = staged(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("row_id")), "numbered")
    found = similar_documents(rows.select(F.col("row_id").alias("doc_id"), "row.text"), **options).where("n_links > 0")
    place = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", F.xxhash64("row.text").alias("hash"), "row_id")
    members = staged(rows.select("row_id", place.alias("place")).join(found.select(F.col("doc_id").alias("row_id"), "class_id"), "row_id"), "group-members")
    gone = members.join(members.groupBy("class_id").agg(F.min("place").alias("stays")), "class_id").where("row_id <> stays.row_id").select("row_id")
    return rows.join(gone, "row_id", "left_anti").select("row.*")
