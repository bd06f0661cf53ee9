"""Operator 11: a Merkle manifest of a dataset, and proofs that are checked leaf by leaf.

Documents are leaves, and every source has a tree of its own, whose root is a leaf of the top tree. Trees are worked by
supersteps over RDDs of messages. On the way up each node sends its digest to its parent, and a parent that has all its
children hashes them and sends on. On the way down each node passes its children the path of siblings that leads from
them to the root. A group is one node's children, `fan_out` at most, whatever a source holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, staged

FAN_OUT = 16
#: The number of the tree over the sources' roots; sources' trees are numbered from 0.
TOP = -1
#: A node of a level: its tree, its place in the level, how many nodes the level has, and its children's digests in order.
NODE = "tree bigint, place bigint, width bigint, children array<binary>"
#: What stands in a tree's last node's place: the digest that the tree comes to.
ROOT = "tree bigint, digest binary"
#: What a node knows of what is above it: the sibling path from it to the root, and the root of its source.
PATH = "tree bigint, place bigint, path binary, subroot binary"


def part(value: Column) -> Column:
    """A value as it goes into a leaf: `-` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(part, (doc_id, source, lang, n_chars, text))), 256))


def lower_case(text: Column) -> Column:
    """The change that stands for tampering: A-Z alone become a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranged(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written, sorted along `order` in ranges of about one size, with `block` (the range) and `at` (the place in it)."""
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return staged(placed.withColumn("block", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(2**33 - 1))), name)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `number`, 0 to n - 1 along `order`.

    A range's first number is the sum of the ranges before it; there are spark.sql.shuffle.partitions of them, however
    many rows there are.
    """
    placed, before = ranged(rows, order, name), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "block").withColumn("number", F.col("base") + F.col("at")).drop("base", "at", "block")


def hashed(digests: Iterable[bytes]) -> bytes:
    """A node's digest; digests go in as hex text."""
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


def packed(place: int, siblings: list[bytes]) -> bytes:
    """A step of a path: where the node stands among its parent's children, how many siblings it has, and they."""
    return bytes((place, len(siblings))) + b"".join(siblings)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[i : i + 32] for i in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its sibling path come to."""
    for place, siblings in steps(path):
        digest = hashed([*siblings[:place], digest, *siblings[place:]])
    return digest


def _frame(spark: SparkSession, rows: RDD, ddl: str, name: str) -> DataFrame:
    """rows as a written table: what later supersteps read, and where a lost executor's work starts again."""
    return staged(spark.createDataFrame(rows, ddl, verifySchema=False), name)


def _sent(row: tuple) -> tuple:
    """A node's message to its parent: (tree, place of the parent), (own place, own digest, width of the level)."""
    tree, place, width, digest = row
    return (tree, place // FAN_OUT), [(place, digest, width)]


def _node(message: tuple) -> tuple:
    """A parent from its children's messages; all of them are there, as a superstep ends when all are sent."""
    (tree, place), children = message
    return tree, place, -(-children[0][2] // FAN_OUT), [bytes(x) for _, x, _ in sorted(children)]


def _joined(a: list, b: list) -> list:
    return a + b


def climbed(spark: SparkSession, leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of the trees over leaves (tree, place, width, digest), `most` being the width of the widest tree.

    levels[i] holds the nodes at height i + 1 as NODE, roots has ROOT of each tree; a tree of one leaf has it as its root.
    Each superstep sends the nodes of a level to their parents and ends with their table. Messages of one parent are put
    together before the shuffle, so that most of it is one row for each parent.
    """
    levels, n = [], partitions(spark)
    roots = leaves.where("width = 1").select("tree", "digest")
    nodes = leaves.where("width > 1").select("tree", "place", "width", "digest").rdd
    while most > 1:
        most = -(-most // FAN_OUT)
        # A level has a sixteenth of the nodes below it.
        n = max(1, min(n, most))
        parents = nodes.map(_sent).reduceByKey(_joined, n).map(_node)
        level = _frame(spark, parents, NODE, f"level-{len(levels) + 1}")
        levels.append(level)
        own = level.rdd.map(lambda x: (x[0], x[1], x[2], hashed(map(bytes, x[3]))))
        roots = roots.unionAll(spark.createDataFrame(own.filter(lambda x: x[2] == 1).map(lambda x: (x[0], x[3])), ROOT, verifySchema=False))
        nodes = own.filter(lambda x: x[2] > 1)
    return levels, staged(roots, "roots")


def _to_children(both: tuple) -> Iterator[tuple]:
    """Messages of a node that has its path: each child's place and path."""
    (tree, place), (nodes, paths) = both
    for children in nodes:
        for path, subroot in paths:
            for i in range(len(children)):
                yield (tree, place * FAN_OUT + i), (packed(i, [bytes(x) for x in children[:i] + children[i + 1 :]]) + bytes(path), subroot)


def descended(spark: SparkSession, levels: list[DataFrame], starts: DataFrame, to: int) -> DataFrame:
    """PATH of every node at the height `to`, 0 being the leaves, from starts (height, PATH) at the trees' roots.

    Supersteps go the other way: each node sends its children their paths, and trees of fewer levels join in at the
    height of their roots. A tree that is not as high as `to` comes back as it started.
    """
    at = lambda height: starts.where(F.col("height") == height).drop("height")
    now, n = at(len(levels)), partitions(spark)
    for height in range(len(levels), to, -1):
        nodes = levels[height - 1].rdd.map(lambda x: ((x[0], x[1]), x[3]))
        told = now.rdd.map(lambda x: ((x[0], x[1]), (bytes(x[2]), bytes(x[3]))))
        sent = nodes.cogroup(told, n).flatMap(_to_children).map(lambda x: (*x[0], *x[1]))
        now = staged(spark.createDataFrame(sent, PATH, verifySchema=False).unionAll(at(height - 1)), f"paths-{height - 1}")
    for height in range(min(to, len(levels))):
        now = now.unionAll(at(height))
    return now


def height_of(width: Column) -> Column:
    """Levels above the leaves: how often a width is divided by the fan-out, rounded up, until one node is left."""
    out, most = F.lit(0), 1
    for _ in range(16):
        out, most = out + (width > most).cast("int"), most * FAN_OUT
    return out


CHECKED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verified(group: tuple, root: bytes) -> Iterator[tuple]:
    """Rows of CHECKED of the leaves of one parent, which know each other and their parent's path."""
    leaves, above = group[1]
    run = sorted(leaves)
    digests = [bytes(x[1]) for x in run]
    for path, subroot in above:
        for i, (_, digest, changed, doc_id, width) in enumerate(run):
            own = (packed(i, digests[:i] + digests[i + 1 :]) if width > 1 else b"") + path
            proof = hashed(x for _, siblings in steps(own) for x in siblings)
            end = folded(bytes(changed or digest), own)
            yield doc_id, digest.hex(), subroot.hex(), root.hex(), proof.hex(), end.hex(), end == root


def leaves_of(docs: DataFrame, tampered: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves, sources): leaves (tree, place, width, digest, changed, doc_id) and sources (tree, width).

    `changed` is what the digest is after tampering, null where there is none. Texts are read once, for the two digests;
    what is sorted and numbered after that are rows of digests. A range has few sources or all of one, so the table that
    leads from (range, source) to a leaf's place has not many more rows than ranges and sources together.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.when(tampered & F.col("text").isNotNull(), leaf_digest(*columns[:4], lower_case(columns[4])))
    rows = staged(docs.select("doc_id", "source", leaf_digest(*columns).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("row")), "digests")
    placed = ranged(rows, ["source", "doc_id", "digest", "row"], "placed").drop("row")
    own = Window.partitionBy("source")
    per = placed.groupBy("block", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    per = per.withColumn("width", F.sum("n").over(own)).withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tree = numbered(rows.select("source").distinct(), ["source"], "sources").select(F.col("source").alias("tree_source"), F.col("number").alias("tree"))
    per = staged(per.join(tree, F.col("source").eqNullSafe(F.col("tree_source"))).select("tree", "width", F.col("block").alias("of_block"), F.col("source").alias("of_source"), (F.col("before") - F.col("first")).alias("shift")), "places")
    found = placed.join(per, (F.col("block") == F.col("of_block")) & F.col("source").eqNullSafe(F.col("of_source")))
    leaves = staged(found.select("tree", (F.col("at") + F.col("shift")).alias("place"), "width", "digest", "changed", "doc_id"), "leaves")
    return leaves, per.select("tree", "width").distinct()


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest's digests for each document, and whether its proof still leads to the root after tampering.

    Returns CHECKED for each row of docs (doc_id, source, lang, n_chars, text; other columns are not read). `tampered` is
    a condition over docs; where it holds, the text's capitals are made small before the leaf is folded with the untampered
    siblings. Where it is null nothing is tampered with. A null in any of the five columns is `-` in the leaf; null
    sources are one source, the first. Rows that share a doc_id or have none (these first) stand in the order of their
    digests, and repeated rows are leaves of their own. A source of one document is its own root, and a table of one
    document has no siblings, so its proof is the hash of nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    leaves, sources = leaves_of(docs, tampered)
    # Two numbers: the width of the widest tree, and how many trees there are.
    most, count = sources.agg(F.max("width"), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], CHECKED)
    levels, subroots = climbed(spark, leaves, most)
    tops = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(count).alias("width"), "digest")
    top_levels, top = climbed(spark, tops, count)
    root = bytes(top.first()["digest"])
    height = lambda width: next(k for k in range(64) if FAN_OUT**k >= width)
    first = spark.createDataFrame([(height(count), TOP, 0, b"", b"")], f"height int, {PATH}")
    above = descended(spark, top_levels, first, 0).select(F.col("place").alias("tree"), "path")
    starts = sources.join(subroots, "tree").join(above, "tree").select(height_of(F.col("width")).alias("height"), "tree", F.lit(0).cast("bigint").alias("place"), "path", F.col("digest").alias("subroot"))
    paths = descended(spark, levels, staged(starts, "starts"), 1)
    told = paths.rdd.map(lambda x: ((x[0], x[1]), (bytes(x[2]), bytes(x[3]))))
    runs = leaves.rdd.map(lambda x: ((x[0], x[1] // FAN_OUT), (x[1], x[3], x[4], x[5], x[2])))
    return spark.createDataFrame(runs.cogroup(told, partitions(spark)).flatMap(lambda g: _verified(g, root)), CHECKED, verifySchema=False)


def manifest_sql(most_levels: int = 8) -> str:
    """The query op11_merkle_manifest in DuckDB SQL: a step for each of the levels that a source or the top can have."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1))) AS BIGINT[])), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS changed FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d)),
u0 AS (SELECT doc_id, leaf, changed, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
a0 AS (SELECT tree, place, leaf AS digest FROM u0)"""]

    def climb(a: str, tree: str) -> str:
        # A level of one node is the root; it goes up as it is.
        for k in range(most_levels):
            now = f"{a}{k}"
            steps.append(f"""{a}{k + 1} AS (SELECT {tree}, place // 16 AS place, CASE WHEN any_value(width) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS width FROM {now}) GROUP BY {tree}, place // 16)""")
        return f"{a}{most_levels}"

    def siblings(a: str, k: int, tree: str) -> str:
        """For each node of a level: what stands before and after it among its siblings."""
        run = f"PARTITION BY {tree}, place // 16 ORDER BY place"
        return f"(SELECT {tree}, place, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {tree}) AS width FROM {a}{k})"

    end = climb("a", "tree")
    steps.append(f"b0 AS (SELECT 0 AS tree, tree AS place, digest FROM {end})")
    top = climb("b", "tree")
    now, fold = "p0", "CASE WHEN x.width = 1 THEN f ELSE sha256(x.l || f || x.r) END AS f"
    steps.append("p0 AS (SELECT doc_id, leaf, tree, place, tree AS place_top, changed AS f, '' AS proof FROM u0)")
    for k in range(2 * most_levels):
        a, level = ("a", k) if k < most_levels else ("b", k - most_levels)
        place, join = ("place", "x.tree = p.tree AND x.place = p.place") if a == "a" else ("place_top", "x.place = p.place_top")
        other = "place_top" if a == "a" else "place"
        steps.append(f"p{k + 1} AS (SELECT doc_id, leaf, p.tree, p.{place} // 16 AS {place}, {other if other != 'place' else 'p.place'}, {fold}, proof || x.l || x.r AS proof FROM p{k} p JOIN {siblings(a, level, 'tree')} x ON {join})")
        now = f"p{k + 1}"
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, e.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.digest AS verified FROM {now} p JOIN {end} e ON e.tree = p.tree, {top} t"""
