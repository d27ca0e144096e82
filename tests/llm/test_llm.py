import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import leakage
from framelake.llm.clusters import audit_points, similar_groups, similarity_clusters
from framelake.llm.packing import pack, plan, token_count
from framelake.llm.quantiles import merge, percentiles, sketch
from framelake.llm.subjects import sentences, subject_shares
from framelake.llm.subset import config_key, farthest, level, quotas, varied_subsets

AUDIT = "record_id bigint, source string, composition map<string,double>, config_type string, energy_per_atom double, num_atoms int"


def similar(a, b):
    s, t = sum(a[2].values()), sum(b[2].values())
    p, q = {k: v / s for k, v in a[2].items() if v}, {k: v / t for k, v in b[2].items() if v}
    lo, hi = sorted((a[5], b[5]))
    return p.keys() == q.keys() and all(abs(p[k] - q[k]) < 0.12 - 1e-9 for k in p) and abs(a[4] - b[4]) < 0.25 - 1e-9 and hi * 3 < lo * 4


def records(seed, n):
    rng = random.Random(seed)
    centres = [({"Fe": f, "O": 1 - f}, e, a) for f in (0.2, 0.5, 0.8) for e in (-8.0, -7.7, -5.0) for a in (32, 40, 64)]
    out = []
    for i in range(n):
        c, e, a = rng.choice(centres)
        f = c["Fe"] + rng.uniform(-0.03, 0.03)
        scale = rng.choice([1, 100])
        out.append((i, "s", {"Fe": f * scale, "O": (1 - f) * scale, "H": 0.0}, "bulk", e + rng.uniform(-0.1, 0.1), a))
    return out


@pytest.mark.parametrize("max_rows", [40, 10_000])
def test_groups_equal_brute_force(spark, max_rows):
    data = records(3, 300)
    extra = [(900, "s", None, "b", -8.0, 32), (901, "s", {"Fe": 1.0}, "b", None, 32), (902, "s", {"Fe": 1.0}, "b", float("nan"), 32), (903, "s", {}, "b", -1.0, 5), (904, "s", {"Fe": 1.0}, None, 3.0, 32), (905, "s", {"Fe": 1.0}, "b", -3.0, None)]
    got = similar_groups(audit_points(spark.createDataFrame(data + extra + data[:9], AUDIT)), max_rows=max_rows)
    link = {r[0]: {s[0] for s in data if similar(r, s)} for r in data}
    want = {(min(g), r) for r, g in link.items() if len(g) >= 5 and all(link[s] == g for s in g) and r != min(g)}
    assert want and {tuple(r) for r in got.collect()} == want


def test_clusters_are_compact_and_whole(spark):
    leaves, members = similarity_clusters(audit_points(spark.createDataFrame(records(5, 120), AUDIT)))
    rows = leaves.collect()
    assert sum(r.n for r in rows) == members.count() == 120
    assert all(max(h - l for l, h in zip(r.lo, r.hi)) < 1 and len(r.typical) == min(3, r.n) for r in rows)
    assert similar_groups(audit_points(spark.createDataFrame([], AUDIT))).count() == 0


def test_percentiles_within_stated_error_and_mergeable(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(size=6000), np.repeat(1.0, 3000)])
    data = [("a" if i % 3 else None, float(x)) for i, x in enumerate(v)] + [("a", None), ("b", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    day1, day2 = df.where("x < 1.0"), df.where("x >= 1.0 OR x IS NULL")
    both = sketch(day1, "g", ["x"], 64).unionByName(sketch(day2, "g", ["x"], 64).withColumn("part", F.col("part") + 100))
    for r in percentiles(merge(both, 64, fan_in=4), ["x"], [0.05, 0.5, 0.99]).collect():
        x = np.sort([y for g, y in data if g == r.grp and y is not None and np.isfinite(y)])
        assert r.n == len(x) and r.rank_error < 0.1
        for p, got in ((0.05, r.p05), (0.5, r.p50), (0.99, r.p99)):
            lo, hi = np.searchsorted(x, got, "left") + 1, np.searchsorted(x, got, "right")
            assert lo - r.rank_error * r.n <= np.ceil(p * r.n) <= hi + r.rank_error * r.n
    assert percentiles(merge(sketch(df.where("false"), "g", ["x"])), ["x"], [0.5]).count() == 0


def test_quotas_redistribute():
    assert quotas(np.array([1, 100, 10_000]), 60, False).sum() == 60
    assert quotas(np.array([1, 2, 100]), 60, True).tolist() == [1, 2, 57]
    assert quotas(np.array([3, 4]), 99, False).tolist() == [3, 4]


def test_subsets_cover_rare_kinds(spark):
    data = [(i, "a" if i % 2 else "b", {"Fe": 1.0}, "Bulk | x", -1.0, 4) for i in range(900)] + [(1000 + i, "a", {"O": 0.5, "H": 0.5}, "md", -1.0, 4) for i in range(9)] + [(2000, "a", None, None, None, None)]
    asks = [{"params_id": 1, "n_samples": 12, "strategy": " Global", "source": None}, {"params_id": 2, "n_samples": 10**8, "strategy": "element_set", "source": "b"}, {"params_id": 3, "n_samples": 0, "strategy": "global", "source": None}, {"params_id": 4, "n_samples": None, "strategy": None, "source": "a"}, {"params_id": 5, "n_samples": 3, "strategy": "element_set", "source": None}]
    rows = varied_subsets(spark.createDataFrame(data + data[:50], AUDIT), asks).collect()
    per = {k: [r.record_id for r in rows if r.params_id == k] for k in (1, 2, 3, 4, 5)}
    assert {k: (len(v), len(set(v))) for k, v in per.items()} == {1: (12, 12), 2: (450, 450), 3: (0, 0), 4: (0, 0), 5: (3, 3)}
    assert any(1000 <= r < 2000 for r in per[1]) and 2000 in per[1] and 2000 in per[5]


def test_subsets_take_every_pattern_before_copies(spark):
    # 90 rare config types beside 3,000 records of one: each rare kind needs a slot of its own
    data = [(i, "a", {"Fe": 1.0}, "bulk", -1.0, 4) for i in range(3000)] + [(5000 + i, "a", {"Fe": 1.0}, f"rare | kind{i}", -1.0, 4) for i in range(90)]
    asks = [{"params_id": 1, "n_samples": 91, "strategy": "global", "source": None}, {"params_id": 2, "n_samples": 95, "strategy": "element_set", "source": "a"}, {"params_id": 3, "n_samples": 40, "strategy": "global", "source": None}]
    rows = varied_subsets(spark.createDataFrame(data, AUDIT).repartition(3), asks, clusters=4, chunk_rows=16).collect()
    per = {k: {r.record_id for r in rows if r.params_id == k} for k in (1, 2, 3)}
    assert {k: len(v) for k, v in per.items()} == {1: 91, 2: 95, 3: 40} and len(rows) == 226
    assert all(len([x for x in per[k] if x >= 5000]) == 90 for k in (1, 2))
    assert len([x for x in per[3] if x < 5000]) <= 1  # no copies while patterns are open


def test_level_and_farthest():
    assert level(np.array([1, 5, 100]), np.array([10, 2, 1]), 24) == (4, 2) and level(np.array([3]), np.array([2]), 99) == (3, 0)
    assert level(np.array([3]), np.array([4]), 3) == (0, 3)
    assert farthest(np.array([[0.0], [0.1], [5.0], [9.0], [0.1]]), 3).tolist()[1:] in ([3, 0], [0, 3]) and len(set(farthest(np.zeros((4, 2)), 9))) == 4


def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["w"] * int(rng.expovariate(0.05)))) for i in range(400)] + [(900, None), (901, ""), (902, "x " * 250), (903, "y!" * 50), (904, "z " * 200)]
    rows = pack(spark.createDataFrame(docs, "doc_id bigint, text string"), [("s", 100), ("l", 1000)]).collect()
    sizes = {r[0]: r[1] for r in spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", token_count(F.col("text"))).collect()}
    assert sizes[902] == 250 and sizes[900] == 0 and sizes[903] == 100
    for name, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in rows if r.container == name]
        room, per_doc = {}, {}
        for r in mine:
            room[r.bin] = room.get(r.bin, 0) + r.tokens
            per_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.tokens, r.pieces))
        assert max(room.values()) <= capacity and len(room) <= sum(sizes.values()) / capacity * 1.05 + 2
        assert {d: sum(x[2] for x in p) for d, p in per_doc.items()} == sizes
        assert all(sorted(x[0] for x in p) == list(range(p[0][3])) and (len(p) == 1) == (sizes[d] <= capacity) for d, p in per_doc.items())


def test_plan_uses_up_the_histogram():
    h = np.zeros(51, np.int64)
    h[[3, 7, 20, 25, 30, 50]] = [40, 5, 33, 12, 31, 2]
    used = np.zeros(51, np.int64)
    for combo, times in plan(h, 50):
        assert sum(combo) <= 50
        for x in combo:
            used[x] += times
    assert (used == h).all()


W = [f"word{c}{d}" for c in "abcdefgh" for d in "pqrstu"]


def test_leaks_survive_disguise_and_need_twenty_words(spark):
    shared = "This closing sentence stands in several items word for word."
    item = " ".join(W[:30]) + ". " + shared
    other = " ".join(f"other{x}" for x in W[:25]) + ". " + shared
    zh = "".join(chr(0x4E00 + 7 * i) for i in range(45)) + "。"
    edited = W[:24]
    edited[5], edited[15] = "changed", "also"
    docs = [
        (1, "start " + " ".join(W[2:23]) + " end"), (2, "x " + " ".join(W[:15]) + " y"), (3, "<p>" + "\n> ".join(edited).upper() + "</p>"),
        (4, "go " + " ".join(w[:2] + "​" + w[2:].replace("o", "о") for w in W[:22])), (5, shared), (6, None), (7, ""),
        (8, "a " + zh[3:20] + "​，" + zh[20:36] + " b"), (9, zh[:20]), (10, " ".join(w for i, w in enumerate(W[:30]) if i % 4)),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, other), (3, zh), (4, None), (5, "short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end) for r in leakage.leaks(df, items).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 1), (8, 3)}
    text, (a, b) = dict(docs)[1], got[1, 1]
    assert W[2] in text[a:b] and text[a:b].startswith("worda")
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_subjects_reach_held_out_accuracy(spark):
    rng = random.Random(6)
    kinds = {"magnetism": ["spin spiral", "local moment", "canted order", "curie point"], "software": ["unit test", "pull request", "stack trace", "plugin loader"], "batteries": ["garnet cell", "lithium path", "anode swelling", "hopping barrier"]}
    forms = ["Please check the {} for us.", "Table 3 lists the {} of each run.", "It is unclear how the {} depends on it."]
    talk = ["The reviewer put a positive spin on the story.", "Let us talk about it over coffee.", "We meet again on Tuesday."]
    docs, truth, labels = [], set(), []
    for d in range(400):
        mine = rng.sample(sorted(kinds), rng.choice([1, 1, 2]))
        body = [rng.choice(forms).format(rng.choice(kinds[k])) for k in mine for _ in range(3)] + rng.choices(talk, k=2)
        rng.shuffle(body)
        docs.append((d, "From: desk 3\n" + " ".join(body)))
        truth |= {(d, k) for k in mine}
        if d < 120:
            labels += [(d, k.upper() if d % 2 else f" {k}", "r") for k in mine if rng.random() < 0.9]
    docs += [(900, None), (901, "  "), (902, talk[0]), (903, "[09:23] step 300 1.4")]
    labels += [(1, None, "r"), (2, "nonsense", "r"), *labels[:3]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.subject) for r in subject_shares(df, spark.createDataFrame(labels, "doc_id bigint, subject string, reader string"), [(k, "") for k in kinds]).where("share >= 0.25").collect()}
    held = lambda s: {x for x in s if x[0] >= 120}
    hit = len(held(got) & held(truth))
    assert hit / len(held(truth)) > 0.95 and hit / max(1, len(held(got))) > 0.95
    assert not {x for x in got if x[0] >= 900}


def test_sentences_leave_out_noise():
    assert sentences("Subject: x\n1. The spin 3 is up. See it!\n[09:23] step 300 1.4\n<p>Ja, gut</p>") == ["the spin is up", "see it", "ja gut"]
    assert sentences(None) == [] and config_key is not None and dt


def test_clusters_are_the_same_however_nodes_are_split(spark):
    points = audit_points(spark.createDataFrame(records(11, 400), AUDIT))
    key = lambda rows: sorted((r.leaf, r.n, r.first_id, tuple(round(c, 9) for c in r.centre), tuple(r.typical)) for r in rows)
    one, two = (key(similarity_clusters(points, max_rows=m)[0].collect()) for m in (60, 100_000))
    assert one == two and len(one) > 3
