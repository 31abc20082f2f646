import random

import numpy as np
import pytest

from mediaquarry.llm import _vectors, kdtree, partitions
from mediaquarry.llm._vectors import Best


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string")


def odd(rng):
    """Vectors with ties, repeated rows and all kinds of rows that take no part."""
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], 0, "r") for i in range(300)]
    rows += [(i, rows[7][1], 0, "r") for i in range(300, 360)]
    rows += [rows[50], rows[50], (400, None, 0, "r"), (450, [1.0, None] + [0.0] * 4, 0, "r"), (500, [float("nan")] * 6, 0, "r"), (550, [float("inf")] * 6, 0, "r"), (None, [1.0] * 6, 0, "r"), (600, [0.0] * 6, 0, "r")]
    rows += [(i, [1.0, -0.5], 0, "r") for i in range(650, 656)] + [(700, [2.0], 0, "r"), (750, [], 0, "r")]
    return rows


def usable(rows, nonzero):
    found = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and (any(v) or not nonzero):
            found[i] = np.array(v, float)
    return found


def test_products_as_brute_force(spark):
    rows = odd(np.random.default_rng(1))
    df = table(spark, rows).repartition(3)
    got = {}
    for r in kdtree.top_products(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    have = {i: [int(x) for x in np.floor(256 * v)] for i, v in usable(rows, False).items()}
    for q, v in have.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in have.items() if i != q and len(w) == len(v))[:5]
            assert sorted(got.pop(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got


def exact(rows, k, step):
    """The best k by exact score for each query whose id ``step`` divides."""
    have = {i: [int(np.floor(256 * x)) for x in v] for i, v, *_ in rows}
    out = {}
    for q in (i for i in have if i % step == 0):
        best = sorted((-sum(a * b for a, b in zip(have[q], w, strict=True)), i) for i, w in have.items() if i != q)[:k]
        for n, (s, i) in enumerate(best):
            out[q, n + 1] = i, max(-((1 << 63) - 1), min((1 << 63) - 1, -s))
    return out


@pytest.mark.parametrize("sizes", [(3e7, 1e9, 2.5), (1e38, 1.0, 1e-3), (1e18, 1e17)])
def test_large_components_are_exact(spark, sizes):
    """Ranks go by the exact score even where it has more than 64 bits."""
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.choice(sizes) * rng.uniform(-1, 1))) for _ in range(4)], 0, "") for i in range(60)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_products(table(spark, rows), table(spark, rows).filter("vec_id % 10 = 0"), 5).collect()}
    assert got == exact(rows, 5, 10)


def test_one_large_component_in_a_full_block(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(8192, 8)).astype(np.float32)
    points[4000, 3] = 1e9
    rows = [(i, p.tolist(), 0, "") for i, p in enumerate(points)]
    df = table(spark, rows).coalesce(1)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_products(df, df.filter("vec_id % 1000 = 0"), 5).collect()}
    assert got == exact(rows, 5, 1000)


def test_overflow(spark):
    """Components of 1e308: distances stay in order, and what has no finite 256-fold is in no product."""
    rows = [(0, [1e308, 1.0]), (1, [-1e308, 1.0]), (2, [1e308, 3.0]), (3, [2.0, 2.0]), (4, [3.0, 2.0]), (5, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(partitions.nearest_neighbours(df, df.filter("vec_id = 0"), 10).collect(), key=lambda r: r["rank"])]
    assert got == [(2, 2.0), (3, 1e308), (4, 1e308), (5, pytest.approx(1e308)), (1, np.inf)]
    got = [(r.vec_id, r.score) for r in sorted(kdtree.top_products(df, df.filter("vec_id = 5"), 3).collect(), key=lambda r: r["rank"])]
    assert got == [(4, (1 << 63) - 1), (3, (1 << 63) - 1)]


def test_two_vectors_under_one_id(spark):
    rows = [(0, [1.0, 5.0], 0, ""), (0, [1.0, 2.0], 0, ""), (1, [3.0, 0.0], 0, ""), (1, [3.0, 9.0], 0, ""), (2, [1.0, 1.0], 0, "")]
    df, one = table(spark, rows), table(spark, [rows[1], rows[2], rows[4]])
    for found in (kdtree.top_products, partitions.nearest_neighbours):
        assert sorted(map(tuple, found(df, df, 5).collect())) == sorted(map(tuple, found(one, one, 5).collect()))


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    points, queries = np.floor(rng.normal(size=(500, 5)) * 100), np.floor(rng.normal(size=(20, 5)) * 100)
    tree = kdtree.KdTree.build(np.arange(500), points, leaf=8)
    leaves, bounds = tree.bounds(queries, np.full(20, -np.inf))
    spans = [tree.nodes[x, 2:] for x in leaves]
    assert sorted(np.concatenate([tree.ids[a:z] for a, z in spans]).tolist()) == list(range(500))
    assert (tree.points == points[tree.ids]).all()
    for k, (a, z) in enumerate(spans):
        assert (bounds[:, k] >= (queries @ tree.points[a:z].T).max(axis=1)).all()
    pruned = tree.bounds(queries, np.full(20, 20_000.0))[1]
    assert pruned.shape[1] < len(leaves) or np.isinf(pruned).any()


def test_best_keeps_ties_with_small_ids():
    best = Best(2, 2, float)
    best.add(np.array([0, 0, 1]), np.array([1.0, 1.0, 5.0]), np.array([9, 3, 1]))
    best.add(np.array([0, 0]), np.array([1.0, 2.0]), np.array([4, 1]))
    assert list(zip(best.query, best.key, best.id, strict=True)) == [(0, 1.0, 3), (0, 1.0, 4), (1, 5.0, 1)]
    assert best.kth.tolist() == [1.0, np.inf]


def test_neighbours_in_one_partition_are_exact(spark, monkeypatch):
    monkeypatch.setattr(partitions, "SMALL", 10_000)
    rows = odd(np.random.default_rng(3))
    df = table(spark, rows)
    got = {}
    for r in partitions.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    have = usable(rows, True)
    for q, v in have.items():
        if q % 50 == 0:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in have.items() if i != q and len(w) == len(v))[:10]
            assert sorted(got.pop(q, [])) == [(n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert not got


@pytest.mark.parametrize("large", [partitions.LARGE, 100])
def test_recall_with_partitions(spark, large):
    """Clustered vectors, with a third of all rows equal: several partitions, few probed, recall of 0.9 at least.

    Also with partitions that are parted again.
    """
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    points = (centres[rng.integers(12, size=4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    points[rng.random(4000) < 0.33] = points[0]
    df = table(spark, [(i, p.tolist(), 0, "") for i, p in enumerate(points)]).cache()
    index = partitions.fit_index(partitions.usable(df, True), large=large)
    assert 1 <= index[16].probes < index[16].parts and (index[16].parts > 20) == (large < 1000)
    rows = partitions.usable(df, True)
    sizes = [r["count"] for r in partitions.assigned(rows, index).groupBy("part").count().collect()]
    assert sum(sizes) == 4000
    x = points.astype(float)
    hit = 0
    found = partitions.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), 10, cell=500, large=large).collect()
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = {r.vec_id: r.score for r in found if r.query_id == q}
        assert len(mine) == 10 and all(mine[i] == pytest.approx(d[i], abs=1e-12) for i in mine)
        hit += len(mine.keys() & set(np.lexsort((np.arange(4000), d))[:10].tolist()))
    assert hit >= 0.9 * 400


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_a_whole_table(spark, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = partitions.op3_learned_partitions(spark, folder).collect()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({r.vec_id for r in found if r.query_id == ids[q]} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hit >= 0.9 * total


def test_partitions_are_balanced():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1000, 8))
    graph = partitions.nearest(points, points, 10, own=True)
    part = partitions.balanced(points, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(partitions.SLACK * 125)
    chance = rng.integers(8, size=1000)
    assert (part[graph] == part[:, None]).mean() > 2 * (chance[graph] == chance[:, None]).mean()


def test_empty_tables(spark):
    df = table(spark, []).limit(0)
    assert kdtree.top_products(df, df, 5).collect() == [] == partitions.nearest_neighbours(df, df, 10).collect()


def test_several_blocks_and_cells_of_queries(spark, monkeypatch):
    rows = odd(np.random.default_rng(8))
    df = table(spark, rows)
    many, few = df.filter("vec_id % 10 = 0"), df.filter("vec_id % 50 = 0")
    want = {tuple(r) for r in kdtree.top_products(df, few, 4).collect()}
    monkeypatch.setattr(kdtree, "QUERY_ROWS", 7)
    monkeypatch.setattr(kdtree, "TURN", 2)
    blocks = kdtree.query_blocks(_vectors.usable(many, False))
    assert blocks.count() > 4 and {r.size for r in blocks.collect()} == {2, 6, 1, 0}
    assert {r for r in map(tuple, kdtree.top_products(df, many, 4).collect()) if r[0] % 50 == 0} == want
    monkeypatch.setattr(partitions, "SMALL", 10_000)
    want = {tuple(r) for r in partitions.nearest_neighbours(df, few, 4).collect()}
    assert {r for r in map(tuple, partitions.nearest_neighbours(df, many, 4, cell=20).collect()) if r[0] % 50 == 0} == want


def test_repeated_ids_are_settled_without_the_others(spark, capsys):
    """Of several vectors under an id the least counts; vectors with an id of their own don't enter an aggregate."""
    df = table(spark, [(1, [2.0, 1.0], 0, ""), (1, [1.0, 9.0], 0, ""), (2, [0.5, 0.5], 0, ""), (3, [0.0, 0.0], 0, ""), (1, [2.0, 1.0], 0, ""), (None, [1.0, 1.0], 0, "")])
    found = _vectors.usable(df, False)
    assert sorted((r.vec_id, r.embedding) for r in found.collect()) == [(1, [1.0, 9.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0])]
    found.explain()
    first, second = capsys.readouterr().out.split("Union")[1].split("LeftSemi")
    assert "LeftAnti" in first and "Aggregate" not in first.split("LeftAnti")[1].split("SortAggregate")[0]
