"""Similarity, ordering and clustering against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import agglomerate, balls, distances, labels, leaves, mixture, ordered, ranking, similarity
from tests import brute


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, embedding array<float>")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return {frozenset(g) for g in out.values()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(8, 12))
    m = np.concatenate([c + rng.normal(scale=0.35, size=(12, 12)) for c in centers])
    m = np.concatenate([m, m[:3], m[:1]])
    return (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32).astype(float)


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "L1", "L2", "Linf", "cosine_distance"])
def test_top_matches_both_paths(spark, points, metric):
    v = vectors(spark, points)
    kw = {"query": ("id", "embedding"), "metric": metric}
    a = similarity.top_matches(v, v, 4, **kw).orderBy("q_id", "rank").collect()
    b = similarity.top_matches(v, v, 4, broadcast_bytes=500, **kw).orderBy("q_id", "rank").collect()
    assert a == b and len(a) == 4 * len(points)
    s = -distances.scores(points, points, metric) if metric in distances.DISTANCES else distances.scores(points, points, metric)
    s = np.round(s, 6) + 0.0
    sign = 1 if metric in distances.DISTANCES else -1
    for q in range(len(points)):
        want = sorted(range(len(points)), key=lambda i: (sign * s[q, i], i))[:4]
        assert [r["id"] for r in a if r["q_id"] == q] == want


def clustered(n, spread=0.05, centers=12, dim=16):
    rng = np.random.default_rng(n)
    c = rng.normal(size=(centers, dim))
    return (c[rng.integers(0, centers, n)] + rng.normal(scale=spread, size=(n, dim))).astype(np.float32).astype(float)


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "L1", "L2", "Linf"])
def test_top_matches_skips_balls(spark, metric):
    m = clustered(1500)
    v = vectors(spark, m)
    kw = {"query": ("id", "embedding"), "metric": metric, "exclude_self": True}
    shipped = similarity.top_matches(v, v, 5, **kw).orderBy("q_id", "rank").collect()
    cells = similarity.top_matches(v, v, 5, broadcast_bytes=20_000, **kw).orderBy("q_id", "rank").collect()
    assert shipped == cells
    s = np.round(distances.scores(m, m, metric), 6) + 0.0
    np.fill_diagonal(s, -np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(len(m)), s.shape), -s), axis=-1)[:, :5]
    assert [r["id"] for r in shipped] == best.ravel().tolist()
    if metric not in ("inner_product", "Linf"):
        for limit in (similarity.BROADCAST_BYTES, 20_000):
            assert similarity.scored_pairs(v, v, 5, broadcast_bytes=limit, **kw) < 0.3 * len(m) ** 2


def test_questions_visit_a_district_once(spark):
    """Vectors without clusters ask for all cells, but a question is sent to a district at most once, in frames of bounded size."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(6000, 24))
    pivots = m[:900]
    n = np.bincount(distances.gap(m, pivots, "cosine").argmin(axis=1), minlength=900)
    cells = similarity._Cells(pivots, np.zeros(900), np.full(900, np.pi), n, similarity._districts(pivots, n, 1500, "cosine"))
    n_districts = len(set(cells.district.tolist()))
    assert 4 <= n_districts <= 8 and np.bincount(cells.district, n).max() <= 1500 + n.max()
    batch = pd.DataFrame({"q_id": np.arange(6000), "vec": list(m), "least": 0.0})
    first, second = (list(similarity._visits([batch], cells, "cosine", 5, second=x)) for x in (False, True))
    assert max(len(f) for f in second) <= n_districts * similarity.CELL_NUMBERS // 900
    both = pd.concat(first + second)
    assert len(both) == 6000 * n_districts == len(both[["q_id", "district"]].drop_duplicates())
    v = vectors(spark, m[:3000])
    want = np.argsort(-np.round(distances.scores(m[:40], m[:3000], "cosine"), 6), axis=1, kind="stable")[:, :3]
    for arrow in ("true", "false"):  # keys of both sides have one type, whatever pandas frames become
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
        got = similarity.top_matches(v, v, 3, query=("id", "embedding"), broadcast_bytes=50_000).where("q_id < 40").orderBy("q_id", "rank").collect()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
        assert [r["id"] for r in got] == want.ravel().tolist()


def test_top_matches_with_text_ids_ties_and_few_items(spark):
    rows = [(f"k{i:02}", [1.0, float(i // 10)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    for limit in (similarity.BROADCAST_BYTES, 50):
        got = similarity.top_matches(v, v, 3, query=("id", "embedding"), broadcast_bytes=limit).where("q_id = 'k25'").orderBy("rank").collect()
        assert [r["id"] for r in got] == ["k20", "k21", "k22"]
        assert similarity.top_matches(v, v.limit(2), 3, query=("id", "embedding"), broadcast_bytes=limit).count() == 80
        assert similarity.top_matches(v, v.limit(0), 3, query=("id", "embedding"), broadcast_bytes=limit).count() == 0
    assert similarity.top_matches(v.limit(0), v, 3, query=("id", "embedding")).count() == 0


@pytest.mark.parametrize("keep", ["farther", "nearer"])
def test_threshold_matches(spark, points, keep):
    v = vectors(spark, points)
    d = np.round(distances.distance(points, points, "cosine"), 6)
    hit = d > 0.3 if keep == "farther" else d <= 0.3
    for limit in (similarity.BROADCAST_BYTES, 100):
        got = similarity.threshold_matches(v, v, 0.3, keep=keep, query=("id", "embedding"), query_block=40, broadcast_bytes=limit).collect()
        assert {(r["q_id"], r["id"]) for r in got} == set(zip(*map(list, np.nonzero(hit)))) and len(got) == hit.sum()
    assert similarity.threshold_matches(v.limit(0), v, 0.3, keep=keep, query=("id", "embedding")).count() == 0


@pytest.mark.parametrize("metric,limit", [("cosine", 0.1), ("L2", 0.5), ("L1", 1.2), ("Linf", 0.2)])
def test_pairs_within(spark, points, metric, limit):
    v = vectors(spark, points)
    d = distances.distance(points, points, metric)
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if d[i, j] <= limit}
    for rows in (None, 9):
        got = similarity.pairs_within(v, limit, metric=metric, block_rows=rows).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("metric,limit", [("cosine", 0.02)])
def test_pairs_within_by_several_levels(spark, metric, limit):
    m = clustered(500)
    d = distances.distance(m, m, metric)
    np.fill_diagonal(d, np.inf)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= limit)) if i < j}
    got = similarity.pairs_within(vectors(spark, m), limit, metric=metric, block_rows=20).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    placed = balls.placements(vectors(spark, m), limit, metric=metric, block_rows=20)
    assert placed.agg(F.max("level")).first()[0] >= 2
    assert placed.where("inner").count() == placed.where("inner").select("id").distinct().count() == 500


def test_copies_do_not_grow_with_the_rows(spark):
    share = {}
    for n in (1000, 4000):
        placed = balls.placements(vectors(spark, clustered(n, centers=n // 50)), 0.01, block_rows=60)
        share[n] = placed.where("not inner").count() / n
    assert share[4000] <= 1.2 * share[1000] + 0.2 and share[4000] < 2


def test_pairs_of_near_copies_end(spark):
    m = 1 + np.random.default_rng(2).normal(scale=1e-4, size=(300, 6))
    assert similarity.pairs_within(vectors(spark, m), 0.5, block_rows=20).count() == 300 * 299 // 2


def test_pairs_added_up_by_group(spark):
    m = clustered(300)
    v = vectors(spark, m).withColumn("g", F.col("id") % 7)
    d = distances.distance(m, m, "cosine")
    want = {}
    for i, j in zip(*np.nonzero(d <= 0.4)):
        if i < j and i % 7 != j % 7:
            k = (min(i % 7, j % 7), max(i % 7, j % 7))
            n, lo, hi = want.get(k, (0, np.inf, 0))
            want[k] = (n + 1, min(lo, d[i, j]), max(hi, d[i, j]))
    got = {(r["a"], r["b"]): (r["n_edges"], r["nearest"], r["farthest"]) for r in similarity.pairs_within(v, 0.4, group="g", block_rows=25).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:]) for k in want)


@pytest.mark.parametrize("linkage", agglomerate.LINKAGES)
def test_agglomeration_equals_brute_force(spark, points, linkage):
    v = vectors(spark, points)
    found = agglomerate.cluster(v, 0.25, linkage=linkage)
    assert groups(found.labels) == brute.agglomerate(brute.cosine_matrix(points), 0.25, linkage)


def test_leaf_order_and_count(spark, points):
    v = vectors(spark, points)
    found = agglomerate.cluster(v, 0.6)
    rows = agglomerate.leaf_order(found, v).orderBy("leaf_pos").collect()
    assert [r["leaf_pos"] for r in rows] == list(range(1, len(points) + 1))
    seen = [r["cluster"] for r in rows]
    assert sum(a != b for a, b in zip(seen, seen[1:])) + 1 == len(set(seen))
    n = len(groups(found.labels))
    assert len(groups(agglomerate.cut_to_count(found, n + 3))) == n + 3


def random_tree(rng, n):
    """Merges (left, right) that make one binary tree of n leaves."""
    open_nodes, merges = list(range(n)), []
    while len(open_nodes) > 1:
        a, b = (open_nodes.pop(int(rng.integers(len(open_nodes)))) for _ in range(2))
        merges.append((a, b))
        open_nodes.append(n + len(merges) - 1)
    return merges


def all_orders(n, merges):
    orders = {i: [[i]] for i in range(n)}
    for i, (a, b) in enumerate(merges):
        orders[n + i] = [x + y for x in orders[a] for y in orders[b]] + [y + x for x in orders[a] for y in orders[b]]
    return orders[n + len(merges) - 1]


def steps(d, order):
    return sum(d[a, b] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_best_order_of_eight_leaves(seed):
    rng = np.random.default_rng(seed)
    d = distances.distance(*[rng.normal(size=(8, 3))] * 2, "L2")
    merges = random_tree(rng, 8)
    every = all_orders(8, merges)
    got = leaves.best_order(d, merges)
    assert got in every and np.isclose(steps(d, got), min(steps(d, o) for o in every))


@pytest.mark.parametrize("shape, small", [("chain", 3), ("star", 1), ("random", 4)])
def test_positions_of_any_tree(spark, shape, small):
    rng = np.random.default_rng(small)
    n = 13
    m = rng.normal(size=(n, 4))
    # Parents have smaller numbers; rounds grow upwards, so a point is absorbed after it has absorbed.
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(i))}[shape]
    merges = [(n - i, parent(i), i, 0.1) for i in range(1, n)]
    frame = spark.createDataFrame(merges, "round int, lo bigint, hi bigint, distance double")
    got = leaves.positions(vectors(spark, m), frame, "L2", small=small).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(n))
    order = [r["node"] for r in got]
    # Every side of every merge stands together.
    block = {i: {i} for i in range(n)}
    for _, lo, hi, _ in sorted(merges):
        block[lo] = block[lo] | block[hi]
        at = [order.index(x) for x in block[lo]]
        assert max(at) - min(at) + 1 == len(at)
    if small > 1:
        plain = [r["node"] for r in leaves.positions(vectors(spark, m), frame, "L2", small=1, turn_large=False).orderBy("pos").collect()]
        d = distances.distance(m, m, "L2")
        assert steps(d, order) < steps(d, plain)


@pytest.mark.parametrize("linkage, k", [("complete", 2), ("single", 3), ("average", 4)])
def test_any_number_of_clusters(spark, points, linkage, k):
    some = points[::4]
    found = agglomerate.cluster(vectors(spark, some), 0.3, linkage=linkage)
    got = groups(agglomerate.cut_to_count(found, k))
    assert len(got) == k
    # The same clusters as a merge-by-merge run that stops at k.
    assert got == brute.agglomerate(brute.cosine_matrix(some), 9.0, linkage, stop_at=k)


def test_number_of_clusters_beyond_the_points(spark, points):
    found = agglomerate.cluster(vectors(spark, points), 0.1)
    assert len(groups(agglomerate.cut_to_count(found, 1000))) == 96
    with pytest.raises(ValueError):
        agglomerate.cut_to_count(found, 0)


def test_no_pairs_and_bad_options(spark, points):
    v = vectors(spark, points[:5])
    assert len(groups(agglomerate.cluster(v, 1e-6).labels)) == 5
    with pytest.raises(ValueError):
        agglomerate.cluster(v, linkage="ward")


def test_ordered_scans_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos int, x int")
    placed = ordered.arrange(df, "k", "pos")
    out = ordered.running(placed, ["k"], sums={"s": F.col("x")}, lasts={"l": F.when(F.col("x") == 3, F.col("pos"))},
                          previous={"p": F.col("x")})
    got = {(r["k"], r["pos"]): (r["s"], r["l"], r["p"]) for r in out.collect()}
    state = {}
    for k, pos, x in sorted(rows):
        s, last, prev = state.get(k, (0, None, None))
        s, last = s + x, pos if x == 3 else last
        assert got[k, pos] == (s, last, prev)
        state[k] = (s, last, x)
    numbers = {(r["k"], r["pos"]): r["row_no"] for r in ordered.number_rows(placed, ["k"]).collect()}
    assert sorted(v for (k, _), v in numbers.items() if k == "hot") == list(range(1, 2001))


def test_concat_parts_are_whole(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(25)], "cluster int, id int, text string")
    parts = ordered.concat_parts(df, ["cluster"], ["id"], F.col("text"), "|", rows_per_part=10).orderBy("part").collect()
    assert "|".join(r["text"] for r in parts) == "|".join(f"t{i}" for i in range(25)) and len(parts) == 3


def test_summaries_of_any_cluster_size(spark):
    rows = [(1, i, f"t{i}") for i in range(70)] + [(2, i, f"u{i}") for i in range(3)] + [(3, 0, "v")]
    df = spark.createDataFrame(rows, "cluster int, id int, text string")
    seen = lambda text, most: F.concat(F.lit("<"), F.regexp_replace(text, "\n\n", " "), F.lit(">"))
    got = {r["cluster"]: r for r in labels.polish(df, seen, rows_per_part=4).collect()}
    assert got[3]["text"] == "<v>" and got[2]["text"] == "<u0 u1 u2>" and [got[c]["n_rows"] for c in (1, 2, 3)] == [70, 3, 1]
    inner = [x for x in got[1]["text"].replace("<", " ").replace(">", " ").split()]
    assert inner == [f"t{i}" for i in range(70)]


def test_budgets(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 0), (2, 1, 100), (2, 2, 0), (3, 1, 200), (3, 2, 1)],
                               "q_id int, rank int, tokens int")
    def kept(out):
        return {(r["q_id"], r["rank"]) for r in out.collect()}
    assert kept(ranking.budget_prefix(df, "tokens", 100)) == {(1, 1), (2, 1), (2, 2)}
    assert kept(ranking.budget_cap(df, "tokens", 100)) == {(1, 1), (2, 1), (3, 1)}
    assert kept(ranking.budget_inclusive(df, "tokens", 100, 10)) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}


def test_mixture_finds_blobs_on_both_paths(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(0, i, [float(a) for a in v]) for i, v in enumerate(x)], "problem bigint, node_id bigint, x array<double>")
    for local in (1000, 50):
        rows = mixture.soft_labels(df, max_components=6, local_rows=local).collect()
        sets = {}
        for r in rows:
            sets.setdefault(r["label"], set()).add(r["node_id"])
        assert {frozenset(s) for s in sets.values()} == {frozenset(range(i, i + 60)) for i in (0, 60, 120)}


@pytest.mark.parametrize("partitions", [4, 9, 200])
def test_mixture_sums_on_any_partitioning(spark, partitions):
    """Overlapping blobs: the same labels inside one task and from sums over many."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, size=(80, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3.5, 0))])
    df = spark.createDataFrame([(i % 2, i, [float(a) for a in v]) for i, v in enumerate(x)], "problem bigint, node_id bigint, x array<double>")
    one = sorted(tuple(r) for r in mixture.soft_labels(df, max_components=5, local_rows=1000).collect())
    many = sorted(tuple(r) for r in mixture.soft_labels(df.repartition(partitions), max_components=5, local_rows=10).collect())
    assert one == many and len({r[2] for r in one}) > 1


def test_projection_of_large_problems(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 6)) * np.array([5, 3, 1, 1, 1, 1])
    df = spark.createDataFrame([(i % 3, i, [float(a) for a in v]) for i, v in enumerate(m)], "problem bigint, node_id bigint, embedding array<double>")
    one = {r["node_id"]: r["x"] for r in mixture.reduce_per_problem(df, 2, 1000).collect()}
    many = {r["node_id"]: r["x"] for r in mixture.reduce_per_problem(df.repartition(7), 2, 10).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[i], many[i]) for i in one)


def test_bounded_clusters(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(c, 0.2, size=(40, 6)) for c in (np.eye(6)[0] * 3, np.eye(6)[1] * 3)] + [np.ones((30, 6))])
    df = spark.createDataFrame([(i, 100 if i else 900, [float(a) for a in v]) for i, v in enumerate(m)],
                               "node_id bigint, tokens bigint, embedding array<float>")
    out = mixture.bounded_clusters(df, max_tokens=800, dim=3, max_components=5, passes=10).join(df, "node_id")
    stats = out.groupBy("cluster").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] <= 800 or r["n"] == 1 for r in stats)
    assert out.select("node_id").distinct().count() == len(m)


def test_merge_small(spark):
    m = [[1, 0], [1, 0.1], [1, 0.05], [0, 1], [0.1, 1], [0, 1.1], [0.9, 0.2]]
    df = vectors(spark, np.array(m)).withColumn("cluster", F.expr("case when id < 3 then 1 when id < 6 then 2 else 3 end"))
    got = {r["id"]: r["cluster"] for r in labels.merge_small(df, min_size=3).collect()}
    assert got[6] == 1 and got[0] == 1 and got[3] == 2


def test_many_small_mixtures_share_a_task():
    """A bucket of problems of mixed sizes, copies among them, gets the shares that each problem gets alone."""
    import pandas as pd

    rng = np.random.default_rng(5)
    frames = []
    for problem in range(40):
        n = (1, 2, 5, 8, 9, 300)[problem % 6 if problem != 36 else 5]
        n = 8 if n == 300 and problem != 36 else n
        x = rng.normal(size=(n, 3)) * 0.1 + rng.integers(0, 3, size=(n, 1))
        x = x[rng.integers(0, n, n)] if problem % 4 == 0 else x
        frames.append(pd.DataFrame({"problem": problem, "node_id": np.arange(n), "x": list(x), "seed": rng.permutation(n)}))
    frames.append(frames[9].assign(problem=None))
    found = mixture._local_labels(pd.concat(frames[:-1]).sample(frac=1, random_state=1), 50, 20)
    nulls = mixture._local_labels(frames[-1], 50, 20)
    assert len(found) == sum(map(len, frames[:-1])) and len(nulls) == len(frames[9]) and nulls["problem"].isna().all()
    for problem, own in found.groupby("problem"):
        frame = frames[problem].sort_values(["seed", "node_id"])
        x = np.stack(frame["x"])
        alone = mixture._shares(x, mixture._fit_local(x, 50, 20))[0]
        both = own.set_index("node_id")["p"].to_dict()
        assert all(len(both[i]) == alone.shape[1] and np.allclose(both[i], p, atol=1e-6) for i, p in zip(frame["node_id"], alone))
    assert all(np.allclose(a, b) for a, b in zip(nulls["p"], found[found["problem"] == 9]["p"]))


def test_euclidean_distances_by_products(spark, monkeypatch):
    """Distances come from one product, pairs with little between them from their differences; one pivot is no loop over rows."""
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=(300, 16)), 1e4 + rng.normal(size=(20, 16)), np.zeros((2, 16))])
    b = np.concatenate([a[:40], a[300:310] + 1e-5, rng.normal(size=(30, 16))])
    for metric, norm in (("L1", 1), ("L2", 2), ("Linf", np.inf)):
        want = np.linalg.norm(a[:, None, :] - b[None, :, :], ord=norm, axis=2)
        for x, y, w in ((a, b, want), (b, a, want.T), (a, b[:1], want[:, :1]), (a[:1], b, want[:1])):
            got = -distances.scores(x, y, metric)
            assert got.shape == w.shape and np.allclose(got, w, rtol=1e-12, atol=1e-11)
    assert distances.scores(a[:0], b, "L2").shape == (0, len(b)) and distances.scores(a, b[:0], "L2").shape == (len(a), 0)
    calls, plain = [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda *args, **kw: calls.append(1) or plain(*args, **kw))
    far = rng.normal(size=(500, 64))
    for metric in ("L1", "L2", "Linf"):
        distances.gap(far, far[:1], metric)
    distances.scores(far[:250], far[250:], "L2")
    assert len(calls) <= 3


def test_pairs_of_two_blocks_leave_tile_by_tile():
    """All pairs of a dense block are never held at once."""
    n = 4 * balls.TILE
    pdf = pd.DataFrame({"side": 0, "id": np.arange(n), "vec": list(np.eye(1, 4).repeat(n, axis=0)), "gap": 0.0})
    parts = balls._pairs((0, 0, 0, 0), pdf, 0.5, "cosine", 1.0)
    sizes = [len(p) for p in parts]
    assert sum(sizes) == n * (n - 1) // 2 and len(sizes) == 4 and max(sizes) <= balls.TILE * n


def test_wide_blocks_are_scored_in_parts(monkeypatch):
    """A tile of questions meets at most WIDTH items at a time, with the same best items, ties included."""
    rng = np.random.default_rng(8)
    items = np.round(rng.normal(size=(600, 3)), 1)
    items[1::2] = items[::2]
    asked, ids = np.round(rng.normal(size=(40, 3)), 1), rng.permutation(600)
    found, widest, plain = [], [], similarity.scores
    monkeypatch.setattr(similarity, "scores", lambda q, c, m: widest.append(len(c)) or plain(q, c, m))
    for width in (600, 64):
        monkeypatch.setattr(similarity, "WIDTH", width)
        widest.clear()
        best = similarity._Best(np.arange(40), 7, True)
        similarity._search_block(best, asked, ids, items, "inner_product")
        found.append(best.frame())
        assert max(widest) <= width
    pd.testing.assert_frame_equal(*found)


def test_embedder_remembers_few_words():
    from corpusloom.functions import models
    buckets = models._Buckets(64)
    plain = {w: buckets[w] for w in map(str, range(3 * models.REMEMBERED))}
    assert len(buckets) <= models.REMEMBERED <= 1 << 16
    assert all(buckets[w] == plain[w] for w in ("0", "17", "98000"))


def spread_out(n, dim=16):
    m = np.random.default_rng(9).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_cells_that_reach_everywhere_are_not_split(spark):
    """Vectors in all directions under a wide cut: copies in other cells would spare no comparison."""
    m = spread_out(400)
    placed = balls.placements(vectors(spark, m), 0.7, block_rows=20)
    assert placed.count() == 400
    d = distances.distance(m, m, "cosine")
    assert similarity.pairs_within(vectors(spark, m), 0.7, block_rows=20).count() == (np.triu(d <= 0.7, 1)).sum()


def test_tasks_keep_a_forest_of_their_pairs(spark):
    m = np.round(np.abs(spread_out(300, 3)), 1) + 0.1  # many pairs, many of equal distance
    m = np.unique(m, axis=0)
    v, n = vectors(spark, m), len(m)
    for rows, most in ((None, n - 1), (n // 4, 9 * n)):
        kept = similarity.pairs_within(v, 3.0, metric="L2", block_rows=rows, forest=True).toPandas()
        assert n - 1 <= len(kept) <= most < n * (n - 1) // 8
        pairs = similarity.pairs_within(v, 3.0, metric="L2").toPandas()
        least = balls._forest(pairs)["distance"].to_numpy()
        assert len(least) == n - 1 and np.allclose(np.sort(balls._forest(kept)["distance"]), np.sort(least))
    # Prim's algorithm on the full matrix has the same lengths.
    d = distances.distance(m, m, "L2")
    near, want, out = d[0].copy(), [], np.arange(n) > 0
    while out.any():
        at = np.flatnonzero(out)[near[out].argmin()]
        want.append(near[at])
        out[at], near = False, np.minimum(near, d[at])
    assert np.allclose(np.sort(want), np.sort(least))


def test_average_linkage_has_no_rows_per_pair(spark, monkeypatch):
    m = spread_out(120, 6)
    monkeypatch.setattr(similarity, "pairs_within", None)
    found = agglomerate.cluster(vectors(spark, np.concatenate([m, m[:5]])), 0.6, linkage="average")
    dist = brute.cosine_matrix(np.concatenate([m, m[:5]]).astype(np.float32).astype(float))
    assert groups(found.labels) == brute.agglomerate(np.where(dist < 1e-7, 0.0, dist), 0.6, "average")


def test_average_linkage_leaves_unusable_vectors_alone(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [float("inf"), 0.0]), (None, [1.0, 0.2])]
    found = agglomerate.cluster(spark.createDataFrame(rows, "id bigint, embedding array<float>"), 0.5, linkage="average")
    assert {r["id"]: r["cluster"] for r in found.labels.where("id is not null").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_unit_vectors_take_the_length_once(spark):
    """The plan has the length in a lambda of its own, not inside that of the elements."""
    from corpusloom.functions import vectors as vx
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id int, v array<float>")
    out = df.select("id", vx.normalize_l2(F.col("v")).alias("u"))
    assert {r["id"]: r["u"] for r in out.collect()} == {1: [3 / (5 + 1e-9), 4 / (5 + 1e-9)], 2: [0.0, 0.0], 3: [], 4: None}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("array((SQRT") < plan.index(" / ")


def test_small_problems_are_dealt_out_by_size(spark):
    """Problems of one size meet, one size in several buckets; the number of tasks does not depend on bytes."""
    from corpusloom.operators import mixture
    rows = [(p, p * 1000 + i, [float(i), 1.0]) for p in range(700) for i in range((3, 40)[p % 2])]
    df = spark.createDataFrame([*rows, (None, -1, [0.0, 1.0])], "problem bigint, node_id bigint, x array<double>")
    small, large = mixture._small_and_large(df, 39)
    assert large == {p: 40 for p in range(1, 700, 2)} and small.count() == 350 * 3 + 1
    small, large = mixture._small_and_large(df, 50)
    sizes = small.groupBy("bucket", "problem").count().groupBy("bucket").agg(F.collect_set("count").alias("n"), F.count("problem").alias("problems"))
    got = {r["bucket"]: (r["n"], r["problems"]) for r in sizes.collect()}
    assert not large and got.pop(-1) == ([1], 0) and sorted(n for n, _ in got.values()) == [[3], *[[40]] * 4]
    assert sum(p for _, p in got.values()) == 700 and small.rdd.getNumPartitions() == 6


def test_stacked_problems_of_unlike_sizes_are_fitted_alone():
    """Rows of zeros that continue shorter problems leave no trace."""
    from corpusloom.operators import mixture
    rng = np.random.default_rng(8)
    n = np.array([18, 20, 20, 19])
    x = np.zeros((4, 20, 3))
    for to, size in zip(x, n):
        to[:size] = rng.normal(size=(size, 3)) * 0.05 + rng.choice([0.0, 1.0], (size, 1))
    for own, size, p in zip(x, n, mixture._fit_stacked(x, n, 50, 20)):
        alone = mixture._shares(own[:size], mixture._fit_local(own[:size], 50, 20))[0]
        assert p.shape == alone.shape and np.allclose(p, alone, atol=1e-6)
