import random

import pytest

from framelake.operators.hierarchy import all_descendants, descendants, hierarchy


def brute(parents):
    out = {}
    for k in parents:
        path, seen, status, c = [k], {k}, "tree", k
        while (p := parents[c]) not in (None, 0) and p in parents:
            if p in seen:
                status = "on_loop" if p == k else "below_loop"
                break
            path.append(p)
            seen.add(p)
            c = p
        out[k] = (status, tuple(reversed(path)) if status == "tree" else None)
    return out


@pytest.mark.parametrize("finish_rows", [0, 1000])
def test_random_forest_with_loops(spark, finish_rows):
    rng = random.Random(4)
    parents = {i: rng.choice([None, 0, 999, *range(max(1, i - 3), i)]) for i in range(1, 60)}
    parents |= {100 + i: 100 + i - 1 for i in range(1, 30)} | {100: None}  # a chain
    parents |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 205: 205, 206: 205, 207: 208, 208: 207}
    data = [(k, p, "x") for k, p in parents.items()] + [(1, parents[1], "x"), (None, 3, "x")]
    got = hierarchy(spark.createDataFrame(data, "id bigint, parent_id bigint, tree string"), finish_rows=finish_rows)
    want = brute(parents)
    rows = got.collect()
    assert {r.node_id: (r.status, tuple(r.path) if r.path is not None else None) for r in rows} == want
    inside = {k: sum(p is not None and k in p[:-1] for _, p in want.values()) for k in parents}
    for r in rows:
        if r.status == "tree":
            assert (r.depth, r.root_id, r.n_descendants) == (len(want[r.node_id][1]) - 1, want[r.node_id][1][0], inside[r.node_id])
        assert (r.n_descendants is None) == (r.status == "on_loop")
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in descendants(got).collect()}
    assert pairs == {(a, k, len(p) - 1 - i) for k, (_, p) in want.items() if p for i, a in enumerate(p[:-1])}


@pytest.mark.parametrize("finish_rows", [0, 1000])
def test_all_descendants_reach_below_loops(spark, finish_rows):
    parents = {1: None, 2: 1, 3: 2, 4: 77}  # a tree and a missing parent
    parents |= {10: 11, 11: 12, 12: 13, 13: 14, 14: 10, 20: 11, 21: 20, 22: 21, 23: 20, 30: 30, 31: 30, 32: 31}
    want = set()
    for k in parents:
        c, n, seen = k, 0, set()
        while (p := parents[c]) in parents and p not in seen:
            n += 1
            seen.add(p)
            want.add((p, k, n))
            c = p
    data = [(k, p) for k, p in parents.items()] + [(21, 20), (None, 3)]
    got = all_descendants(spark.createDataFrame(data, "id bigint, parent_id bigint"), finish_rows=finish_rows).collect()
    assert {(r.ancestor_id, r.descendant_id, r.distance) for r in got} == want and len(got) == len(want)
    assert {(20, 22, 2), (11, 22, 3), (10, 10, 5), (30, 30, 1), (30, 32, 2)} <= want


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "id bigint, parent_id bigint")).count() == 0
