"""Near-duplicate vectors, nearest neighbours and chat repair against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import WORDS
from tidemark.llm import chat, common, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell int, rep int, weight int, u int, n int"


def table(spark, seed=1, n=220):
    """Clusters, exact copies, near copies, and vectors, labels and ids that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[60:90] = x[rng.integers(0, 5, 30)] + rng.normal(size=(30, 8)) * 0.05
    x[90:110] = x[rng.integers(0, 3, 20)]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2) if i < 200 else None) for i in range(n)]
    bad = [None, [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], []]
    rows += [(310, [2.0, 4.0], 1), (311, [1.0, 2.0], 1), (312, [1.0, 2.1], 0)]  # vectors of another length
    rows += [(300 + i, v, 1) for i, v in enumerate(bad)] + [(None, rows[0][1], 0), rows[7], rows[7]]
    return [(*r, 1, 2, 3, 4, 5) for r in rows]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, threshold):
    part = [i for i, r in enumerate(rows) if good(r[1]) and r[2] is not None and r[0] is not None]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in part}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(part, 2):
        if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return [(r[0], links[i], None if r[0] is None else min(least[find(i)]), r[0] is None or r[0] == min(least[find(i)])) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("cell", "tile"), [(16384, 1024), (20, 1024), (20, 5)])
def test_near_duplicates(spark, cell, tile):
    rows = table(spark)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98, cell_rows=cell, tile_rows=tile).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_links(rows, 0.98), key=repr)
    assert sum(r["n_links"] for r in got) > 50


def test_vectors_visit_few_cells_at_a_low_threshold(spark):
    rng = np.random.default_rng(5)
    x = vectors.unit(rng.normal(size=(3000, 64)))
    reach = math.sqrt(2 - 2 * 0.3)
    plain = vectors.unit(vectors.kmeans(x.astype(np.float32), 64, 8, True))
    assert vectors._visits(x, plain, reach) > 20
    found = vectors.fitted(x, 64, reach)
    assert 1 <= vectors._visits(x, found, reach) <= vectors.MOST_VISITS
    near = np.repeat(x[:64], 20, axis=0) + rng.normal(size=(1280, 64)) * 0.001
    assert len(vectors.fitted(vectors.unit(near), 64, math.sqrt(2 - 2 * 0.98))) == 64  # groups far apart keep their cells
    rows = table(spark)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.3, cell_rows=5, tile_rows=40).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_links(rows, 0.3), key=repr)


@pytest.mark.parametrize("tile", [8192, 10])
def test_nearest(spark, tile):
    rows = table(spark, 2, 400)
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10, tile_rows=tile, tile_queries=3).collect()
    part = [(r[0], np.array(r[1])) for r in rows if good(r[1]) and len(r[1]) == 8 and r[0] is not None]
    hits = total = 0
    for q, x in part:
        if q % 20 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), v) for v, y in part if v != q)[:10]
            own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [k for k, *_ in own] == list(range(1, 11))
            truth = {v: float(np.sqrt(((x - y) ** 2).sum())) for v, y in part}
            assert all(abs(truth[v] - s) < 1e-9 for _, v, s in own)
            assert [(round(s, 9), v) for _, v, s in own] == sorted((round(s, 9), v) for _, v, s in own)
            hits += len({v for _, v in near} & {v for _, v, _ in own})
            total += 10
    assert hits / total >= 0.9


def recalls(spark, group, spread, seed=3, others=1500, asked=40, **options):
    """Recall of queries among near copies and among other vectors, against brute force."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(group + others, 32)).astype(np.float32)
    x[:group] = x[0] + rng.normal(size=(group, 32)).astype(np.float32) * np.float32(spread)
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist(), 0, 1, 2, 3, 4, 5) for i, v in zip(ids, x, strict=True)]
    wanted = [*range(asked), *range(group, group + asked)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin([int(ids[i]) for i in wanted]), **options).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in wanted:
        away = ((x.astype(np.float64) - x[i]) ** 2).sum(1)
        away[i] = np.inf
        hits.append(len({int(ids[j]) for j in np.argsort(away, kind="stable")[:10]} & got[int(ids[i])]) / 10)
    return np.mean(hits[:asked]), np.mean(hits[asked:])


@pytest.mark.parametrize("spread", [0.1, 0.003])
def test_neighbours_among_many_near_copies(spark, spread):
    # Every cell is read, so nothing but the ranking could miss a neighbour.
    assert recalls(spark, 600, spread, others=3000, asked=20, recall=1.0, max_cells=4, sample_rows=600, subspaces=2) == (1, 1)


def test_queries_of_thin_cells_read_all_cells(spark):
    """The two cells that a query reads hold fewer vectors than are wanted, so it reads all cells."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 4)), 500 + rng.normal(size=(3, 4)), 560 + rng.normal(size=(3, 4))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1, 2, 3, 4, 5) for i, v in enumerate(x)]
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") >= 600, k=100, recall=0.01).collect()
    for q in range(600, 606):
        away = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        away[q] = np.inf
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(away, kind="stable")[:100].tolist()


def test_neighbours_of_each_length(spark):
    rows = [(i, [float(i), 1.0], 0, 1, 2, 3, 4, 5) for i in range(20)] + [(100 + i, [float(i), 1.0, 2.0], 0, 1, 2, 3, 4, 5) for i in range(5)]
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 11))
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [101, 102, 103, 104]


def test_cells_meet_each_linked_pair_once():
    rng = np.random.default_rng(6)
    x = vectors.unit(rng.normal(size=(900, 6)))
    home, weight = rng.random(900) < 0.7, rng.integers(1, 4, 900)
    linked = (x @ x.T >= 0.9) & (home[:, None] | home)
    rows = np.arange(900)
    same, root = vectors.linked_in_blocks(x.astype(np.float32), rows, rows, home, weight, 0.9, at_once=64)
    np.fill_diagonal(linked, False)
    assert (same == linked @ weight).all()
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(linked), strict=True)) and len(set(root)) > 1


def test_all_candidates_if_there_are_fewer(spark):
    rows = [(i, [float(i), 1.0], 0, 1, 2, 3, 4, 5) for i in range(6)]
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i, i, float(i)) for i in range(1, 6)]


def test_many_copies_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0], 0, 1, 2, 3, 4, 5) for i in range(300)] + [(1000, [5.0, 5.0], 0, 1, 2, 3, 4, 5)]
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 11))
    assert [r["vec_id"] for r in got if r["query_id"] == 200] == list(range(10))


def test_vectors_that_share_an_id(spark):
    rows = [(i, [*v, *[0.0] * 6], label, 1, 2, 3, 4, 5) for i, v, label in [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 0), (3, [1.0, 0.05], 0), (4, [0.02, 1.0], 0), (5, [0.0, 2.0], 1)]]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_links(rows, 0.98), key=repr)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(none).count() == 0
    assert vectors.nearest(none, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {a: find(a) for a in {x for e in edges if e[0] != e[1] for x in e}}


def legal(roles):
    if roles and roles[0] == "system":
        roles = roles[1:]
        if not roles:
            return False
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def brute_cost(roles):
    """The least cost over every way to relabel, merge and insert up to three turns in a place."""
    best = math.inf
    for given in itertools.product(chat.ROLES, repeat=len(roles)):
        relabel = sum(0 if g == r else chat.RELABEL if r in chat.ROLES else chat.NAME for g, r in zip(given, roles, strict=True))
        for merges in itertools.product([False, True], repeat=max(0, len(roles) - 1)):
            if any(m and given[i] != given[i + 1] for i, m in enumerate(merges)):
                continue
            turns = [g for i, g in enumerate(given) if not i or not merges[i - 1]]
            cost = relabel + chat.MERGE * sum(merges)
            if cost >= best:
                continue
            for n in range(4):
                if cost + chat.INSERT * n >= best:
                    break
                for at in itertools.combinations_with_replacement(range(len(turns) + 1), n):
                    for own in itertools.product(chat.ROLES, repeat=n):
                        out = []
                        for i in range(len(turns) + 1):
                            out += [r for r, a in zip(own, at, strict=True) if a == i] + turns[i : i + 1]
                        if legal(out):
                            best = min(best, cost + chat.INSERT * n)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_repair_costs_least(n):
    for roles in itertools.product([*chat.ROLES, None], repeat=n):
        cost, steps, closing = chat.repair(roles)
        assert cost == brute_cost(roles), roles
        out = []
        for role, merged, path in steps:
            out += path
            if not merged:
                out.append(role)
        assert legal(out + list(closing))


def test_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, cost string, rendered int"
    rows = [
        (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yo", "x", 1),
        (2, 0, "user", "a", "x", 1), (2, 1, " User", "b", "x", 1), (2, 2, "ASSISTANT", None, "x", 1), (2, 2, "ASSISTANT", None, "x", 1),
        (3, 0, "assistant", "only <|im_end|>", "x", 1), (4, None, None, None, None, None), (None, 1, "user", "alone", "x", 1), (None, 2, "bot", "also", "x", 1), (5, 0, "system", "s", "x", 1),
    ]
    got = {r["rendered"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 7
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[turn("user", "hi") + turn("assistant", "yo")]["cost"] == 0
    assert got[turn("user", "a\n\nb") + turn("assistant", "")]["n_merged"] == 1
    assert got[turn("user", "") + turn("assistant", "only < |im_end|>")]["n_inserted"] == 1
    assert got[turn("system", "s") + turn("user", "")]["conv_id"] == 5
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_long_conversation():
    roles = tuple(random.Random(1).choice(["user", "assistant"]) for _ in range(3000))
    cost, steps, _ = chat.repair(roles)
    assert cost == sum(a == b for a, b in zip(roles, roles[1:], strict=False)) * chat.MERGE + (roles[0] == "assistant") * chat.INSERT
    assert len(steps) == 3000 and WORDS
