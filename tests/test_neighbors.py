import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprep.models import dbscan as dbscan_module
from autoprep.models.dbscan import dbscan
from autoprep.models.iforest import isolation_forest
from autoprep.models.neighbors import knn_classify, lof
from autoprep.operators import balance as b
from autoprep.operators import knn as knn_module
from autoprep.operators.knn import knn


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, 1)


def frame(spark, x, y=None):
    return spark.createDataFrame([(i, p.tolist(), int(y[i]) if y is not None else 0) for i, p in enumerate(x)], "id bigint, x array<double>, y int")


def crowded(n=900, d=2, seed=0):
    """A third of the rows are copies of one point, another part is a tight cluster far away."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0]
    x[n // 3: n // 2] = 8 + 0.05 * rng.normal(size=(n // 2 - n // 3, d))
    return x


@pytest.mark.parametrize("block", [32, 4096])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn_module, "MIN_BLOCK_ROWS", block)
    seen = []
    pairs = knn_module._cell_pairs
    monkeypatch.setattr(knn_module, "_cell_pairs", lambda *a: seen.append((pairs(*a), len(a[2]))) or seen[-1][0])
    x = crowded()
    got = knn(frame(spark, x), frame(spark, x), "id", "x", 4).orderBy("key", "rank").collect()
    near, dist = brute(x, 4)
    assert [r["neighbor"] for r in got] == near.ravel().tolist()
    assert [r["distance"] for r in got] == pytest.approx(dist.ravel().tolist(), abs=1e-12)
    if block == 32:
        wanted, cells = seen[0]
        assert sum(map(len, wanted.values())) < cells * len(wanted)


def test_blocks_stay_few_where_bounds_prune_nothing(spark, monkeypatch):
    """Every query asks every cell: traffic is rows times blocks, so small blocks would make it grow with the square."""
    monkeypatch.setattr(knn_module, "MIN_BLOCK_ROWS", 32)
    monkeypatch.setattr(knn_module, "BLOCK_ROWS", 32)
    seen, blocks = [], knn_module._blocks
    monkeypatch.setattr(knn_module, "_blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    x = np.random.default_rng(5).normal(size=(900, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id bigint, x array<float>")
    got = knn(df, df, "id", "x", 4, vectors=True).orderBy("key", "rank").collect()
    near, dist = brute(x.astype(float), 4)
    assert [r["neighbor"] for r in got] == near.ravel().tolist()
    assert [r["distance"] for r in got] == pytest.approx(dist.ravel().tolist(), abs=1e-12)
    assert all(r["neighbor_x"] == x[r["neighbor"]].tolist() and r["x"] == x[r["key"]].tolist() for r in got)
    assert sum(dict(seen[0].values()).values()) <= 12


def test_a_task_holds_one_meeting(spark, monkeypatch):
    """However well the vectors compress, a task gets no more rows than a meeting may have."""
    monkeypatch.setattr(knn_module, "MIN_BLOCK_ROWS", 64)

    def spied(cells, d, need):
        def note(asked, base):
            import pyarrow as pa
            from pyspark import TaskContext

            columns = [[TaskContext.get().partitionId()], [-1], [float(asked.num_rows)], [0], [0]]
            return pa.table([pa.array(c) for c in columns], names=["qid", "neighbor", "distance", "tag", "neighbor_tag"]).cast(
                pa.schema([("qid", pa.int64()), ("neighbor", pa.int64()), ("distance", pa.float64()), ("tag", pa.int32()), ("neighbor_tag", pa.int32())]))

        return note

    monkeypatch.setattr(knn_module, "_best_of", spied)
    x = np.random.default_rng(6).normal(size=(900, 3))
    got = knn(frame(spark, x), frame(spark, x), "id", "x", 200).collect()
    assert len(got) > 8 and len({r["key"] for r in got}) == len(got)


def test_equal_queries_are_searched_once(monkeypatch):
    import pyarrow as pa

    seen, search = [], knn_module._search
    monkeypatch.setattr(knn_module, "_search", lambda cells, q, *a: seen.append(len(q)) or search(cells, q, *a))
    cells = knn_module._Bounded(np.zeros((1, 2)), [{"cell": 0, "n": 3, "near": 0.0, "far": 9.0}], {}, {})
    base = pa.table({"x": [[0.0, 0.0], [1.0, 0.0], [0.0, 3.0]], "cell": pa.array([0, 0, 0], pa.int32()), "ids": [[10, 11], [12], [13]], "tags": [[0, 0], [1], [0]]})
    points = [[0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [1.0, 0.0]]
    asked = pa.table({"qid": [5, 4, 3, 2, 1], "x": points, "cell": pa.array([0] * 5, pa.int32()), "dist": [1.0] * 5, "reach": [float("inf")] * 5, "tag": [7] * 5})
    got = knn_module._best_of(cells, 2, 3)(asked, base)
    found = {q: [] for q in (1, 2, 3, 4, 5)}
    for q, n, d in zip(*(got[c].to_pylist() for c in ("qid", "neighbor", "distance"))):
        found[q].append((n, round(d, 6)))
    assert found[5] == found[3] == found[2] == [(10, 1.0), (11, 1.0), (12, 1.414214)]
    assert found[4] == found[1] == [(12, 0.0), (10, 1.0), (11, 1.0)]
    assert seen == [2]


def test_knn_with_fewer_rows_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    got = knn(frame(spark, x), frame(spark, x), "id", "x", 10).collect()
    assert len(got) == 6


def work(monkeypatch, spark, x, k=10):
    """Approximate neighbours, and how many distances their search asks for."""
    asked, search = [], knn_module._probes
    monkeypatch.setattr(knn_module, "_probes", lambda *a: asked.append((search(*a), len(a[2]))) or asked[-1][0])
    df = frame(spark, x)
    found = knn(df, df, "id", "x", k, exact=False).collect()
    monkeypatch.setattr(knn_module, "_probes", search)
    probes, cells = asked[0]
    return found, len(x) * (cells + probes * len(x) / cells)


def test_approximate_neighbours(spark, monkeypatch):
    """At least nine of ten are found, every query gets its rows, and the work grows by less than the square."""
    rng, spent = np.random.default_rng(3), {}
    centres = rng.normal(size=(40, 16))
    for n in (1500, 6000):
        x = centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 16))
        found, spent[n] = work(monkeypatch, spark, x)
        near, dist = brute(x, 10)
        assert len(found) == 10 * n
        hits = sum(r["neighbor"] in near[r["key"]] for r in found)
        assert hits >= 0.9 * 10 * n
        for r in found[::97]:
            assert r["distance"] == pytest.approx(np.linalg.norm(x[r["key"]] - x[r["neighbor"]]), abs=1e-9)
    assert spent[6000] / spent[1500] < 4 ** 1.75


def test_approximate_neighbours_of_crowded_rows(spark):
    """Copies, an empty base, a single row and queries that are no base rows."""
    x = crowded()
    df = frame(spark, x)
    assert knn(df, df, "id", "x", 4, exact=False).groupBy("key").count().where("count = 4").count() == len(x)
    assert knn(df, df.limit(0), "id", "x", 4, exact=False).count() == 0
    assert knn(df.limit(0), df, "id", "x", 4, exact=False).count() == 0
    one = frame(spark, x[:1])
    assert knn(one, one, "id", "x", 4, exact=False).count() == 0
    far = frame(spark, np.full((1, 2), 1e6))
    assert knn(far, df, "id", "x", 4, exclude_self=False, exact=False).count() == 4


def test_vectors_are_attached_after_the_ranking(spark):
    """No candidate carries vectors: the ranking is written without them, and the plan left only attaches them."""
    x = crowded(600, 16)
    near = knn(frame(spark, x), frame(spark, x), "id", "x", 4, vectors=True, exact=False)
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()
    rows = near.collect()
    assert len(rows) == 2400
    assert all(r["x"] == x[r["key"]].tolist() and r["neighbor_x"] == x[r["neighbor"]].tolist() for r in rows)


def test_neighbouring_cells_share_a_block():
    """A query travels once to a block, however many of its cells it asks; no block is larger than allowed."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(100, 2))
    stats = [{"cell": c, "n": 1000 if c == 7 else 50} for c in range(100)]
    blocks = knn_module._blocks(pivots, stats, 300)
    assert set(blocks) == set(range(100)) and blocks[7][1] >= 4
    held = {}
    for c, (first, parts) in blocks.items():
        held[first] = held.get(first, 0) + stats[c]["n"] / parts
    assert max(held.values()) <= 300 and sum(p for _, p in set(blocks.values())) < 40


def test_balancing_and_outliers_by_approximate_neighbours(spark):
    x = crowded(400, 3)
    y = (np.arange(400) >= 300).astype(int)
    df = frame(spark, x, y).selectExpr("id", "x[0] as a", "x[1] as b", "x[2] as c", "y")
    grown = b.smote(df, "id", ["a", "b", "c"], "y", exact=False)
    assert grown.where("a is not null").groupBy("y").count().collect()[0]["count"] == 300
    assert grown.where("a is not null").count() == 600
    assert lof(frame(spark, x), "id", "x", 10, exact=False).count() == 400


def test_knn_vote(spark):
    x, y = np.array([[0.0], [0.1], [5.0], [5.1]]), [0, 0, 1, 1]
    df = frame(spark, x, y)
    for weights in ("uniform", "distance"):
        got = {r["key"]: r["prediction"] for r in knn_classify(df, df, "id", "x", "y", 1, weights).collect()}
        assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_lof_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(200, 3))
    x[0] = 9.0
    got = {r["key"]: r for r in lof(frame(spark, x), "id", "x", 10).collect()}
    near, dist = brute(x, 10)
    lrd = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    expected = lrd[near].mean(1) / lrd
    assert [got[i]["lof"] for i in range(200)] == pytest.approx(expected.tolist())
    assert got[0]["is_outlier"]


def clusters(x, eps, least):
    near = ((x[:, None, :] - x[None]) ** 2).sum(-1) <= eps * eps
    core, label, c = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for t in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[t] = c
                    stack.append(t)
            c += 1
    return near, core, label


@pytest.mark.parametrize("d,direct", [(2, 50_000_000), (2, 20)])
def test_dbscan_equals_brute_force(spark, monkeypatch, d, direct):
    monkeypatch.setattr(dbscan_module, "DIRECT_COMPARISONS", direct)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (60, d)), rng.uniform(-3, 5, (60, d)), np.repeat(rng.uniform(-3, 5, (1, d)), 60, 0)])
    got = np.array([r["cluster"] for r in dbscan(frame(spark, x), "id", "x", 0.4, 5).orderBy("key").collect()])
    near, core, label = clusters(x, 0.4, 5)
    assert len(set(zip(got[core], label[core]))) == len(set(label[core])) == len(set(got[core]))
    for i in np.flatnonzero(~core):
        reach = set(got[near[i] & core])
        assert got[i] in reach if reach else got[i] == -1
    assert sorted(set(got[core])) == list(range(len(set(got[core]))))


def test_isolation_forest_finds_the_far_point(spark):
    x = np.random.default_rng(5).normal(size=(400, 2))
    x[3] = 12.0
    df = frame(spark, x)
    got = isolation_forest(df, "id", "x", 40, 0.05).orderBy(F.desc("anomaly_score"), "key").collect()
    assert got[0]["key"] == 3 and sum(r["is_outlier"] for r in got) == 20
    again = isolation_forest(df.repartition(5), "id", "x", 40, 0.05).orderBy(F.desc("anomaly_score"), "key").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in again]


@pytest.fixture(scope="module")
def uneven(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b_), 0) for i, (a, b_) in enumerate(rng.normal(0, 1, (120, 2)))]
    rows += [(200 + i, float(a), float(b_), 1) for i, (a, b_) in enumerate(rng.normal(1, 0.5, (14, 2)))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, y int")


def test_smote_fills_up_inside_the_minority(uneven):
    out = b.smote(uneven, "id", ["a", "b"], "y").collect()
    made = [r for r in out if r["is_synthetic"]]
    assert len(made) == 106 and len({r["id"] for r in out}) == 240 and {r["y"] for r in made} == {1}
    real = np.array([(r["a"], r["b"]) for r in out if not r["is_synthetic"] and r["y"] == 1])
    for r in made:
        p, hit = np.array([r["a"], r["b"]]), False
        for i in range(len(real)):
            for j in range(len(real)):
                step = real[j] - real[i]
                t = ((p - real[i]) @ step) / max(step @ step, 1e-300)
                hit = hit or (-1e-9 <= t <= 1 + 1e-9 and np.abs(real[i] + t * step - p).max() < 1e-9)
        assert hit
    assert sorted(map(tuple, out)) == sorted(map(tuple, b.smote(uneven.repartition(9), "id", ["a", "b"], "y").collect()))


def test_other_samplers(uneven):
    grown = b.adasyn(uneven, "id", ["a", "b"], "y")
    made = grown.where("is_synthetic").count()
    assert abs(made - 106) <= 14
    kept = b.smote_enn(uneven, "id", ["a", "b"], "y")
    assert 0 < kept.count() < 240
    clean = b.smote_tomek(uneven, "id", ["a", "b"], "y")
    assert clean.count() < 240
    base = b.smote(uneven, "id", ["a", "b"], "y")
    x = [(r["id"], (r["a"], r["b"]), r["y"]) for r in base.collect()]
    assert b.tomek_links(base, "id", ["a", "b"], "y").count() * 2 == len(x) - clean.count()


def test_small_classes_and_passthrough(spark, uneven):
    assert b.balance(uneven, "id", ["a", "b"], "y", "class_weight") is uneven
    one = uneven.where("y = 0 or id = 200")
    with pytest.raises(ValueError, match="one row"):
        b.smote(one, "id", ["a", "b"], "y")
    with pytest.raises(ValueError):
        b.balance(uneven, "id", ["a", "b"], "y", "other")


def plain_dbscan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], label.max() + 1
            while todo:
                p = todo.pop()
                for q in np.flatnonzero(near[p] & core & (label < 0)):
                    label[q] = label[i]
                    todo.append(q)
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else -1
    return label


@pytest.mark.parametrize("d, block", [(64, 2_048), (5, 40)])
def test_dbscan_in_many_dimensions_equals_brute_force(spark, monkeypatch, d, block):
    from autoprep.models import dbscan_blocks

    monkeypatch.setattr(dbscan_blocks, "_block_rows", lambda n, d, p: block)
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(6, d)) * 3
    x = np.concatenate([c + rng.normal(size=(40, d)) * s for c, s in zip(centres, (0.1, 0.2, 0.3, 0.5, 0.6, 0.7))] + [rng.normal(size=(40, d)) * 3])
    x = np.concatenate([x, np.linspace(centres[0], centres[1], 30), x[:25], np.repeat(x[-1:], 5, 0)])
    x = x[rng.permutation(len(x))]
    eps = 0.25 * np.sqrt(d)
    got = [r["cluster"] for r in dbscan(frame(spark, x), "id", "x", eps, 5).orderBy("key").collect()]
    want = plain_dbscan(x, eps, 5)
    assert got == want.tolist() and len(set(got)) > 3 and -1 in got


def test_dbscan_in_many_dimensions_edge_cases(spark):
    rows = [(1, [0.0] * 4), (2, [0.0] * 4), (3, None), (4, [None] + [0.0] * 3), (5, [9.0] * 4)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>")
    assert {r["key"]: r["cluster"] for r in dbscan(df, "id", "x", 1.0, 2).collect()} == {1: 0, 2: 0, 3: -1, 4: -1, 5: -1}
    with pytest.raises(ValueError):
        dbscan(df, "id", "x", 0.0, 2)


def test_dbscan_blocks_meet_once_for_all_their_cells():
    """Forty cells that all may touch share a few blocks, and rows travel by blocks, not by cells."""
    from autoprep.models import dbscan_blocks

    pivots = np.random.default_rng(6).normal(size=(40, 5))
    stats = [{"cell": c, "n": 900 if c == 3 else 50, "near": 0.0, "far": 9.0} for c in range(40)]
    blocks = knn_module._blocks(pivots, stats, 400)
    wanted = dbscan_blocks._wanted(pivots, stats, 1.0)
    met = dbscan_blocks._meetings(wanted, blocks)
    ids = {first + i for first, parts in blocks.values() for i in range(parts)}
    assert wanted.all() and len(ids) < 15
    assert sorted(met) == [(a, b) for a in sorted(ids) for b in sorted(ids) if a <= b]
    apart = dbscan_blocks._wanted(pivots, [s | {"far": 0.01} for s in stats], 0.01)
    assert len(dbscan_blocks._meetings(apart, blocks)) < len(met)
