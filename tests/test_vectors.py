import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import vectors as V


def greedy(x, n, least, warm=None, first=0):
    """Brute force, one argmax at a time."""
    if warm is None:
        out, d = [first], np.linalg.norm(x - x[first], axis=1)
    else:
        out, d = [], np.linalg.norm(x[:, None] - warm[None], axis=2).min(1)
    d[out] = -np.inf
    while len(out) < min(n, len(x)):
        i = int(d.argmax())
        if d[i] < least:
            break
        out.append(i)
        d = np.minimum(d, np.linalg.norm(x - x[i], axis=1))
        d[out] = -np.inf
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).normal(size=(300, 4)).round(1)
    x[50:80] = x[:30]  # repeats
    return x, spark.createDataFrame([(i, v.tolist(), "ab"[i % 3 == 0]) for i, v in enumerate(x)], "id int, v array<double>, g string")


@pytest.mark.parametrize("n, least", [(1, 0.1), (40, 0.1), (400, 0.5), (299, 0.0)])
def test_farthest_points_equal_brute_force(cloud, n, least):
    x, df = cloud
    assert V.farthest_points(df, "id", "v", n, least) == greedy(x, n, least)


def test_repeats_are_picked_only_at_no_distance(spark):
    df = spark.createDataFrame([(i, [float(i // 2)]) for i in range(4)], "id int, v array<double>")
    assert V.farthest_points(df, "id", "v", 9, 0.1) == [0, 2]
    assert V.farthest_points(df, "id", "v", 9, 0.0) == [0, 2, 1, 3]


def test_warm_start_and_centre(cloud, spark):
    x, df = cloud
    warm = x[10:15] + 0.05
    chosen = spark.createDataFrame([(v.tolist(),) for v in warm], "v array<double>")
    assert V.farthest_points(df, "id", "v", 20, 0.1, selected=chosen) == greedy(x, 20, 0.1, warm)
    first = int(np.linalg.norm(x - x.mean(0), axis=1).argmin())
    assert V.centered_points(df, "id", "v", 12) == greedy(x, 12, 0.1, first=first)


def test_share_of_variance_stops(cloud):
    x, df = cloud
    ids, share = V.explained_points(df, "id", "v", 0.3)
    want = ((x[ids] - x.mean(0)) ** 2).sum() / ((x - x.mean(0)) ** 2).sum()
    assert abs(share - want) < 1e-9 and share >= 0.3 and ids == greedy(x, len(ids), 0.1)


def test_quotas():
    assert V.sqrt_quotas({"a": 100, "b": 100, "c": 2}, 10) == {"a": 4, "b": 4, "c": 2}
    assert V.sqrt_quotas({"a": 3, "z": 0}, 2) == {"a": 2} and V.sqrt_quotas({}, 4) == {} and V.sqrt_quotas({"a": 1}, 9) == {"a": 1}
    with pytest.raises(ValueError):
        V.sqrt_quotas({"a": 5, "b": 5}, 1)


def test_balanced_points_keep_quotas(cloud):
    x, df = cloud
    got = {}
    for r in V.balanced_points(df, "id", "v", "g", 30, 0.0).orderBy("g", "step").collect():
        got.setdefault(r.g, []).append(r.id)
    ids = {g: np.flatnonzero([("ab"[i % 3 == 0]) == g for i in range(len(x))]) for g in "ab"}
    quota = V.sqrt_quotas({g: len(i) for g, i in ids.items()}, 30)
    for g, mine in ids.items():
        y = x[mine]
        first = int(np.linalg.norm(y - y.mean(0), axis=1).argmin())
        assert got[g] == mine[greedy(y, quota[g], 0.0, first=first)].tolist()
    warm = df.where("g = 'a' AND id < 10")
    assert V.balanced_points(df, "id", "v", "g", 30, 0.0, selected=warm).count() == 30


def test_principal_axes_and_projection(cloud):
    x, df = cloud
    mean, variances, axes = V.principal_axes(df, "v", 2)
    assert np.allclose(variances, np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])
    got = np.array([r.p for r in V.project(df, "v", 2, "p").orderBy("id").collect()])
    assert np.allclose(got, (x - mean) @ axes.T)


def test_strategies_and_plan(cloud, spark):
    x, df = cloud
    inside = df.where("id < 100")
    ids, reverse = V.sparse_sample(df, "id", "v", 10, within=inside, components=2)
    assert reverse and len(ids) == 10 and max(ids) < 100
    assert len(V.sparse_sample(df, "id", "v", 10, strategy="element_set", group="g")[0]) == 10
    assert {r.g: r.quota for r in V.sampling_plan(df, "v", 30, "g").collect()} == V.sqrt_quotas({"a": 200, "b": 100}, 30)


def test_slots_and_reservoir(cloud):
    assert sorted(V.spread_slots(10, 10)) == list(range(10)) and len(set(V.spread_slots(100, 37))) == 37 and V.spread_slots(0, 3) == []
    df = cloud[1]
    one, two = (sorted(r.id for r in V.reservoir(d, 5, ["g"], "id", 7).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 10


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "id int, v array<double>, g string")
    assert V.farthest_points(df, "id", "v", 3) == [] and V.centered_points(df, "id", "v", 3) == [] and V.balanced_points(df, "id", "v", "g", 3).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0]), (3, [1.0])], "id int, v array<double>")
    assert V.farthest_points(df, "id", "v", 3) == [2, 3] and V.principal_axes(df, "v", 1)[1][0] == pytest.approx(0.5)
