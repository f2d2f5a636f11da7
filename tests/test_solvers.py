"""The solvers of our own: networks, support vectors, trees."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowmill.operators import learn as L
from rowmill.operators import kmeans, networks, shards, support, trees

SHAPES = ((3, 5), (5, 4), (4, 3))


def rows_of(spark, x, y):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, y double").withColumn("features", array_to_vector("x"))


# Networks


@pytest.mark.parametrize("dropout", [(), (0.4, 0.2)])
def test_network_gradient_equals_finite_differences(dropout):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(7, 3)), draw.integers(0, 3, 7)
    net = networks.Net(SHAPES, alpha=0.3, dropout=dropout)
    w = draw.normal(size=sum(a * b + b for a, b in SHAPES)) * 0.5
    mask = lambda: np.random.default_rng(5) if dropout else None
    _, grad = networks.batch_loss(x, y, w, net, mask())
    for i in range(0, len(w), 3):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (networks.batch_loss(x, y, w + s, net, mask())[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_penalty_leaves_out_the_biases():
    net = networks.Net(((2, 2),), alpha=2.0)
    x, y = np.zeros((4, 2)), np.array([0, 1, 0, 1])
    flat = np.array([3.0, 0, 0, 0, 9.0, 9.0])
    assert networks.batch_loss(x, y, flat, net)[0] == pytest.approx(np.log(2) + 2.0 / 8 * 9)


def test_training_is_the_same_on_every_run_and_over_shards(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 0] > 1)
    df = rows_of(spark, x, y)
    net = networks.Net(((2, 16), (16, 3)), dropout=(0.1,), batch=20, rate=1e-2)
    for size in (1000, 80):
        held = shards.deal(df, "features", F.col("y"), size)
        assert (held.count, held.n) == (-(-300 // size), 300)
        (one, trace), (two, again) = (networks.fit_network(held, net, 40) for _ in range(2))
        assert np.allclose(one, two) and trace == pytest.approx(again)
        right = networks.probabilities((x - held.mean) / held.std, one, net.shapes).argmax(1) == y
        assert right.mean() > 0.93 and trace[-1] < trace[0] / 2
        held.release()


def test_a_large_table_trains_on_few_long_shards(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 2))
    df = rows_of(spark, x, (x[:, 0] + x[:, 1] > 0).astype(int)).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "y")
    seen, fit = [], networks.fit_network
    monkeypatch.setattr(L, "fit_network", lambda held, *a: seen.append((held.count, held.n)) or fit(held, *a))
    given = {"hidden_layer_sizes": (8,), "batch_size": 4, "learning_rate": 0.02}
    model = L.fit(df, "neural_network_classifier", ["a", "b"], "y", given, max_jobs=6, shard_rows=5)
    assert seen == [(shards.FEW_SHARDS, 600)]
    right = model.score(df).filter(F.col("prediction").cast("double") == F.col("y")).count()
    assert right > 540 and all(np.isfinite(model.extra["losses"]))


@pytest.mark.parametrize("shapes", [SHAPES, ((3, 3),)])
def test_steps_in_place_equal_plain_ones(shapes):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(47, 3)).astype(np.float32), draw.integers(0, 3, 47)
    net = networks.Net(shapes, alpha=0.3, batch=20)
    state = [networks.initial_network(list(shapes), 3), *np.zeros((2, sum(a * b + b for a, b in shapes))), 0.0]
    quick = networks.Steps(state, net)
    total = quick.run(x, y, [1, 0, 0, 0])
    order = np.random.Generator(np.random.SFC64([1, 0, 0, 0])).permutation(47)
    want = 0.0
    for rows in (order[:20], order[20:40], order[40:]):
        loss, grad = networks.batch_loss(x[rows].astype(float), y[rows], state[0], net)
        want += loss * len(rows)
        state[3] += 1
        state[1], state[2] = 0.9 * state[1] + 0.1 * grad, 0.999 * state[2] + 0.001 * grad * grad
        rate = 1e-3 * np.sqrt(1 - 0.999 ** state[3]) / (1 - 0.9 ** state[3])
        state[0] = state[0] - rate * state[1] / (np.sqrt(state[2]) + 1e-8)
    assert total == pytest.approx(want, rel=1e-5) and quick.number == 3
    assert np.allclose(quick.w, state[0], atol=1e-5) and np.allclose(quick.first, state[1], atol=1e-5)
    # Left-out outputs, and those below 0, have neither part in the result nor in the gradient.
    if len(shapes) > 1:
        quick = networks.Steps(state, networks.Net(shapes, dropout=(0.25,) * (len(shapes) - 1), batch=4000))
        wide = np.vstack([draw.normal(size=(3, 4000)).astype(np.float32), np.ones(4000, np.float32)])
        quick.gradient(wide, draw.integers(0, 3, 4000), np.random.SFC64(2))
        assert quick.drawn[0].mean() == pytest.approx(0.75, abs=0.02)
        assert set(np.unique(quick.mask[0])) <= {np.float32(0), np.float32(4 / 3)} and not quick.out[0][:-1][quick.mask[0] == 0].any()


def test_lanes_take_every_row_in_long_runs_of_steps(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    monkeypatch.setattr(shards, "PACK_BYTES", 40)
    held = shards.deal(rows_of(spark, x, y), "features", F.col("y"), 5, few=True)
    assert (held.count, held.lanes) == (shards.FEW_SHARDS, 8) and held.rows.rdd.getNumPartitions() == 8
    # Every row once, five to a record, and a shard's records in one lane and in order.
    lanes = held.rows.withColumn("lane", F.spark_partition_id()).collect()
    assert all(r["shard"] % 8 == r["lane"] and len(r["y"]) <= 20 for r in lanes)
    for lane in range(8):
        places = [(r["shard"], r["at"]) for r in lanes if r["lane"] == lane]
        assert places == sorted(set(places))
    got = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, 2) for r in lanes])
    want = ((x - x.mean(0)) / x.std(0, ddof=1)).astype(np.float32)
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0), atol=1e-5)
    assert sum(np.frombuffer(r["y"], np.float32).sum() for r in lanes) == y.sum()
    net = networks.Net(((2, 8), (8, 2)), dropout=(0.1,), batch=5, rate=1e-2)
    (one, trace), (two, again) = (networks.fit_network(held, net, 12) for _ in range(2))
    assert np.allclose(one, two) and trace == pytest.approx(again)
    # A lane's state goes from record to record: an epoch takes as many steps as a lane has records.
    state = [one, 0 * one, 0 * one, 0.0]
    for r in networks._lanes(held, net, state, 0).collect():
        rows, steps = r["v"][0], r["v"][2] / r["v"][0]
        assert rows > 50 and steps >= rows / 5
    right = networks.probabilities((x - held.mean) / held.std, one, net.shapes).argmax(1) == y
    assert right.mean() > 0.93
    held.release()


def test_patience_counts_epochs_without_a_gain():
    patience = networks.Patience(tol=0.1)
    assert not any(patience.over(v) for v in [5.0, 4.0] + [4.0 - 0.01 * i for i in range(10)])
    assert patience.over(3.95)


def test_alpha_and_dropout_are_honoured(spark):
    draw = np.random.default_rng(3)
    rows = [(float(a), float(b), "no" if a > b else "yes") for a, b in draw.normal(size=(120, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    fit = lambda **p: L.fit(df, "neural_network_classifier", ["a", "b"], "y", {"hidden_layer_sizes": (6,), **p}, 60)
    size = {a: np.abs(fit(alpha=a).extra["weights"]).sum() for a in (1e-4, 1000.0)}
    assert size[1000.0] < size[1e-4]
    assert fit(dropout=(0.5,)).extra["weights"] != fit().extra["weights"]
    missing = fit().score(spark.createDataFrame([(None, 1.0)], "a double, b double")).first()
    assert missing["prediction"] is None


# Support vectors


def objective(z, y, w, C, epsilon):
    return 0.5 * w @ w + C * np.maximum(np.abs(z @ w - y) - epsilon, 0).sum()


@pytest.mark.parametrize("size,C", [(1000, 0.05), (1000, 1.0), (1000, 20.0), (30, 0.05), (30, 1.0)])
def test_support_vectors_reach_the_optimum(spark, size, C):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + draw.normal(size=90) * 0.5
    held = shards.deal(rows_of(spark, x, y), "features", F.col("y"), size)
    lift = lambda v: np.column_stack([v, np.ones(len(v))])
    found = support.fit_svr(held, lift, 4, (0.0, 1.0), C=C, epsilon=0.2, rounds=25, tol=1e-3)
    held.release()
    z = lift(x)
    value = objective(z, y, found.weights, C, 0.2)
    assert found.primal * C * 90 == pytest.approx(value) and found.gap >= 0
    # Few rows and a weak penalty are hard to share: the gap says how far it came.
    assert found.gap <= {(1000, 20.0): 0.1, (30, 1.0): 0.5}.get((size, C), 1e-3) * found.primal
    # No step in any direction gains more than the gap allows.
    for _ in range(300):
        step = draw.normal(size=4) * 10 ** draw.uniform(-4, -0.5)
        assert objective(z, y, found.weights + step, C, 0.2) >= value - found.gap * C * 90 - 1e-9


def hinge(z, y, w, C):
    return 0.5 * w[:-1] @ w[:-1] + C * np.maximum(1 - y * (z @ w), 0).sum()


def test_classes_by_support_vectors_reach_the_optimum_in_few_passes(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + draw.normal(size=400) * 0.4 > 0).astype(int) + (x[:, 0] > 0.8)
    held, passes, sums = shards.deal(rows_of(spark, x, y), "features", F.col("y"), 150), [], support._sums
    monkeypatch.setattr(support, "_sums", lambda *a: passes.append(1) or sums(*a))
    lift = lambda v: np.column_stack([v, np.ones(len(v))])
    found = support.fit_svc(held, lift, 4, 3, C=0.5)
    held.release()
    # The solver before took some 300 passes a class.
    assert len(found) == 3 and len(passes) <= 60
    for c, fit in enumerate(found):
        sign = np.where(y == c, 1.0, -1.0)
        value = hinge(lift(x), sign, fit.weights, 0.5)
        assert fit.primal * 0.5 * 400 == pytest.approx(value) and fit.gap <= 1e-3 * fit.primal
        for _ in range(200):
            step = draw.normal(size=4) * 10 ** draw.uniform(-4, -0.5)
            assert hinge(lift(x), sign, fit.weights + step, 0.5) >= value - fit.gap * 0.5 * 400 - 1e-9


def test_support_vectors_need_few_passes_over_many_shards(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + draw.normal(size=90) * 0.5
    held = shards.deal(rows_of(spark, x, y), "features", F.col("y"), 10)
    lift = lambda v: np.column_stack([v, np.ones(len(v))])
    found = support.fit_svr(held, lift, 4, (0.0, 1.0), C=1.0, epsilon=0.2, rounds=40)
    held.release()
    assert held.count == 9 and found.gap <= 1e-3 * found.primal


def test_support_vectors_on_a_case_solved_by_hand(spark):
    # Two points at x = -1 and 1: |w| falls until both leave the tube, so w = (1 - epsilon).
    df = spark.createDataFrame([(-1.0, -1.0), (1.0, 1.0)], "x double, y double")
    model = L.fit(df, "svm_regressor", ["x"], "y", {"kernel": "linear", "C": 100.0, "epsilon": 0.25, "tol": 1e-5})
    got = {r["x"]: r["prediction"] for r in model.score(df).collect()}
    assert got[1.0] == pytest.approx(0.75, abs=1e-3) and got[-1.0] == pytest.approx(-0.75, abs=1e-3)
    assert model.extra["gap"] <= 1e-5 * max(model.extra["objective"], 1e-3)


def test_rows_without_a_value_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None), (float("nan"), 1.0), (2.0, 4.0)], "x double, y double")
    model = L.fit(df, "svm_regressor", ["x"], "y", {"kernel": "linear", "C": 100.0, "epsilon": 0.0})
    assert model.score(df.limit(1)).first()["prediction"] == pytest.approx(2.0, abs=0.05)


# Trees


def grid(n=400, classes=3, seed=6):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)) * 4) / 4
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)
    return x, (y if classes else y + x[:, 2])


def plain_split(x, y, classes, criterion, least):
    """(feature, threshold) by trying every threshold."""

    def worth(part):
        if not classes:
            return -((part - part.mean()) ** 2).sum()
        p = np.bincount(part.astype(int), minlength=classes) / len(part)
        return -len(part) * (1 - (p * p).sum() if criterion == "gini" else -(p[p > 0] * np.log2(p[p > 0])).sum())

    found = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            if min(left.sum(), (~left).sum()) >= least:
                found.append((-round(worth(y[left]) + worth(y[~left]), 9), f, low / 2 + high / 2))
    return min(found)[1:] if found else None


def growth(classes, **other):
    return trees.Growth(**{"classes": classes, "width": 3, "max_depth": 4, **other})


def fitted(spark, x, y, made):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row long, x array<double>, y double").repartition(3)
    return trees.fit_trees(df, made)


@pytest.mark.parametrize("classes,criterion,least", [(3, "gini", 1), (3, "entropy", 7), (0, "gini", 1), (0, "gini", 9)])
def test_splits_equal_trying_every_threshold(spark, classes, criterion, least):
    x, y = grid(classes=classes)
    tables, memory = (
        fitted(spark, x, y, growth(classes, criterion=criterion, min_leaf=least, min_split=20, max_depth=3, local_bytes=b))[0]
        for b in (0, 1 << 20)
    )
    assert tables.feature == memory.feature and tables.threshold == pytest.approx(memory.threshold)
    for node in [n for n in memory.feature if n.bit_length() < 3]:
        # The rows of a node, by walking down to it.
        held = np.ones(len(x), bool)
        for depth in range(node.bit_length() - 1):
            above = node >> (node.bit_length() - 1 - depth)
            right = (node >> (node.bit_length() - 2 - depth)) & 1
            held &= (x[:, memory.feature[above]] > memory.threshold[above]) == right
        assert memory.sums[node].sum() == pytest.approx(held.sum()) if classes else memory.sums[node][0] == held.sum()
        if held.sum() >= max(20, 2 * least) and len(set(y[held])) > 1:
            want = plain_split(x[held], y[held], classes, criterion, least)
            assert (memory.feature[node], memory.threshold[node]) == pytest.approx(want if want else (-1, 0.0))
        else:
            assert memory.feature[node] == -1


@pytest.mark.parametrize("classes,criterion", [(3, "gini"), (3, "entropy"), (0, "gini")])
def test_exact_splits_count_the_values_of_few_ranges(spark, monkeypatch, classes, criterion):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(4000, 3))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 1) if classes else x[:, 0] + draw.normal(size=4000) / 4
    counted, level = [], trees._level
    monkeypatch.setattr(trees, "_level", lambda *a: counted.append(level(*a).count()) or level(*a))
    monkeypatch.setattr(trees, "RANGES", 64)
    tables, memory = (fitted(spark, x, y, growth(classes, criterion=criterion, max_depth=2, local_bytes=b))[0] for b in (0, 1 << 20))
    assert tables.feature == memory.feature and tables.threshold == pytest.approx(memory.threshold)
    # Every value of every feature was counted before: 12,000 a level.
    assert len(counted) == 2 and max(counted) < 4000


def test_min_samples_split_is_that_of_the_node(spark):
    x, y = grid()
    for least in (2, 40, 150):
        tree = fitted(spark, x, y, growth(3, max_depth=20, min_split=least))[0]
        sizes = [tree.sums[n].sum() for n, f in tree.feature.items() if f >= 0]
        assert min(sizes) >= least
    assert trees.Growth(2, 1, 5).closed(1, np.array([1.0, 0.0]))


def test_unlimited_tree_separates_all_that_can_be_told_apart(spark):
    x, y = grid()
    tree = fitted(spark, x, y, growth(3, max_depth=30))[0]
    assert (trees.average(trees.packed([tree], growth(3)), x).argmax(1) == y).all()


def test_ties_take_the_first_feature_and_lowest_threshold(spark):
    x = np.array([[0, 0, 5], [1, 1, 5], [2, 2, 5], [3, 3, 5.0]])
    y = np.array([0, 1, 0, 1])
    for size in (0, 1 << 20):
        tree = fitted(spark, x, y, growth(2, max_depth=1, local_bytes=size))[0]
        assert (tree.feature[1], tree.threshold[1]) == (0, 0.5)


def test_missing_values_go_right(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (float("nan"), "b")], "x double, y string")
    model = L.fit(df, "decision_tree_classifier", ["x"], "y", {"max_depth": 1})
    assert [r["prediction"] for r in model.score(df).collect()] == ["a", "a", "b", "b"]
    assert model.splits(spark).first()["threshold"] == 2.0


@pytest.mark.parametrize("name,target", [("random_forest_classifier", "y"), ("random_forest_regressor", "t")])
def test_forest_over_tables_and_in_memory(spark, name, target):
    x, y = grid(600)
    rows = [(*map(float, a), f"c{b}", float(b + a[2])) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y string, t double")
    base = {"n_estimators": 12, "max_depth": 6}
    for size in (6000, 1 << 20):
        model = L.fit(df, name, ["a", "b", "c"], target, {**base, "local_bytes": size, "max_bins": 16})
        again = L.fit(df, name, ["a", "b", "c"], target, {**base, "local_bytes": size, "max_bins": 16})
        assert model.extra["trees"] == again.extra["trees"]
        scored = model.score(df).select("prediction", target).collect()
        if target == "y":
            assert sum(r["prediction"] == r["y"] for r in scored) > 540
        else:
            assert np.mean([(r["prediction"] - r["t"]) ** 2 for r in scored]) < 0.25
    drawn = trees.Growth(2, 3, 5, bootstrap=True).weights(np.arange(20000), 3)
    assert drawn.mean() == pytest.approx(1, abs=0.03) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.02)


@pytest.mark.parametrize("classes", [3, 0])
def test_forest_shuffles_sums_and_packed_rows(spark, classes):
    x, y = grid(3000, classes=classes)
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row long, x array<double>, y double").repartition(2).persist()
    made = trees.Growth(classes, 3, 5, trees=4, bootstrap=True, bins=8, local_bytes=0)
    edges = trees.quantile_edges(df, 3, 8)
    root = {(t, 1): None for t in range(4)}
    grown = [trees.Tree() for _ in range(4)]
    # A record per task, tree and node, not one per batch, range and row.
    assert trees._sums(df, made, grown, list(root), edges).count() == 8
    packed = trees._packed_rows(df, made, grown, set(root)).collect()
    assert len(packed) == 8
    drawn = [made.weights(np.arange(3000), t) for t in range(4)]
    assert [sum(len(r["w"]) for r in packed if r["tree"] == t) for t in range(4)] == [(w > 0).sum() for w in drawn]
    # The root's split is the best end of a range.
    for r in trees._binned(df, made, grown, {k: made.stats(y, drawn[k[0]]).sum(0) for k in root}, edges):
        sums, best = made.stats(y, drawn[r["tree"]]), (-np.inf,)
        for f in range(3):
            for end in edges[f][:-1]:
                left = x[:, f] <= end
                worth = made.worth(sums[left].sum(0)) + made.worth(sums[~left].sum(0))
                best = max(best, (worth, -f, -end))
        assert (r["worth"], r["feature"], r["low"]) == pytest.approx((best[0], -best[1], -best[2]))
    df.unpersist()


@pytest.mark.parametrize("classes", [3, 0])
def test_forest_finishes_a_few_trees_at_a_time(spark, monkeypatch, classes):
    x, y = grid(2000, classes=classes)
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row long, x array<double>, y double").repartition(2).persist()
    made = trees.Growth(classes, 3, 5, trees=6, bootstrap=True, bins=8, local_bytes=60_000)
    edges = trees.quantile_edges(df, 3, 8)
    plain = trees.packed(trees.fit_trees(df, made, edges), made)
    turns, pack = [], trees._packed_rows

    def counted(rows, growth, grown, small):
        turns.append(small)
        return pack(rows, growth, grown, small)

    monkeypatch.setattr(trees, "_packed_rows", counted)
    # A turn of two trees, and one of less than a tree.
    for count in (2, 0):
        monkeypatch.setattr(trees, "TURN_BYTES", 1)
        monkeypatch.setattr(trees, "TURN_TREES", count)
        turns.clear()
        assert trees.packed(trees.fit_trees(df, made, edges), made) == plain
        nodes = [key for turn in turns for key in turn]
        assert len(nodes) == len(set(nodes)) and {t for t, _ in nodes} == set(range(6))
        assert len(turns) >= 3 if count else all(len(turn) == 1 for turn in turns)
    df.unpersist()


@pytest.mark.parametrize("classes,criterion", [(3, "gini"), (3, "entropy"), (0, "gini")])
def test_nodes_in_memory_sort_few_rows(monkeypatch, classes, criterion):
    draw = np.random.default_rng(11)
    x = np.column_stack([draw.normal(size=6000), draw.normal(size=6000), draw.integers(0, 9, 6000)])
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 1) if classes else x[:, 0] + draw.normal(size=6000) / 4
    w = draw.integers(1, 4, 6000)
    made = growth(classes, criterion=criterion, max_depth=4, min_leaf=5)
    sorted_ = []
    splits = trees._Part.splits

    def counted(part, growth, f, total, rows=None, before=None):
        sorted_.append(len(part.y) if rows is None else len(rows))
        return splits(part, growth, f, total, rows, before)

    monkeypatch.setattr(trees._Part, "splits", counted)
    plain = {n[0]: n for n in trees.grow(made, 0, 1, x, y, w)}
    every = sum(sorted_)
    sorted_.clear()
    monkeypatch.setattr(trees, "NARROW_ROWS", 100)
    quick = {n[0]: n for n in trees.grow(made, 0, 1, x, y, w)}
    assert quick.keys() == plain.keys() and sum(sorted_) < every / 2
    for n, found in quick.items():
        assert found[1:3] == plain[n][1:3] and found[3] == pytest.approx(plain[n][3])


def test_one_class_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1.0, "a")], "x double, y string")
    assert L.fit(one, "decision_tree_classifier", ["x"], "y").score(one).first()["prediction"] == "a"
    line = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    model = L.fit(line, "decision_tree_regressor", ["x"], "y")
    assert model.score(line).first()["prediction"] == 5.0 and model.splits(spark).count() == 0


# Clusters


def lloyd(x, centres, steps):
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def vectors(spark, x):
    df = spark.createDataFrame([([float(v) for v in a],) for a in x], "x array<double>").repartition(3)
    return kmeans.numbered(df.withColumn("features", array_to_vector("x")))


def test_steps_from_given_centres(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(200, 3))
    start = np.vstack([x[:3], [[50.0, 50.0, 50.0]]])
    found = kmeans.fit_kmeans(vectors(spark, x), 4, max_iter=5, tol=0.0, init=start)
    centres, inertia = lloyd(x, start, 5)
    # The fourth centre is never the nearest, and stays.
    assert np.allclose(found.centres, centres) and found.inertia == pytest.approx(inertia) and found.steps == 5


def test_restarts_share_passes_and_the_best_is_kept(spark):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(c, 0.1, size=(40, 2)) for c in [(0, 0), (0, 9), (9, 0), (9, 9), (4, 4)]])
    rows = vectors(spark, x)
    found = kmeans.fit_kmeans(rows, 5, restarts=6)
    assert found.inertia == min(found.inertias) and len(found.inertias) == 6
    assert found.inertia == pytest.approx(sum(((x[i : i + 40] - x[i : i + 40].mean(0)) ** 2).sum() for i in range(0, 200, 40)))
    assert np.allclose(found.centres, kmeans.fit_kmeans(rows, 5, restarts=6).centres)


def test_starting_centres_differ_while_rows_do(spark):
    x = np.array([[0.0, 0.0]] * 50 + [[1.0, 0.0], [0.0, 1.0]])
    rows = vectors(spark, x)
    drawn = kmeans.fit_kmeans(rows, 3, restarts=4, max_iter=0).centres
    assert len({tuple(c) for c in drawn}) == 3
    assert kmeans.fit_kmeans(rows, 5, restarts=2).inertia == pytest.approx(0)
    assert kmeans.fit_kmeans(vectors(spark, np.empty((0, 2))).filter("false"), 2).inertia == 0


def test_ward_equals_trying_every_pair():
    draw = np.random.default_rng(10)
    for k in (1, 2, 5, 30):
        c, n = draw.normal(size=(30, 2)), draw.integers(1, 4, 30)
        groups = [[i] for i in range(30)]
        mid, size = c.copy(), n.astype(float)
        while len(groups) > k:
            cost = {
                (i, j): size[i] * size[j] / (size[i] + size[j]) * ((mid[i] - mid[j]) ** 2).sum()
                for i in range(len(groups))
                for j in range(i)
            }
            i, j = min(cost, key=cost.get)
            mid[j] = (size[i] * mid[i] + size[j] * mid[j]) / (size[i] + size[j])
            size[j] += size[i]
            groups[j] += groups.pop(i)
            mid, size = np.delete(mid, i, 0), np.delete(size, i)
        want = {m: g for g, part in enumerate(sorted(groups, key=min)) for m in part}
        assert L._ward(c, n, k) == [want[m] for m in range(30)]


def test_rows_with_a_missing_component_have_no_cluster(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    scored = L.fit(df, "kmeans", ["a", "b"], parameters={"n_clusters": 2}).score(df).collect()
    assert scored[0]["prediction"] == scored[1]["prediction"] != scored[2]["prediction"] and scored[3]["prediction"] is None
