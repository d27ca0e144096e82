import datetime as dt

import numpy as np
import pytest

from framelake.operators import spikes
from framelake.operators.spikes import AUDIT_FIELDS, implausible_readings, ordinary_core, robust_components

SCHEMA = "record_id bigint, source string, `index` bigint, max_force double, energy_per_atom double, virial_norm double, recorded_at timestamp, field string"


def rows(values, source="a", start=0, field="max_force"):
    t0 = dt.datetime(2024, 1, 1)
    out = []
    for i, v in enumerate(values):
        f = dict.fromkeys(AUDIT_FIELDS, None) | {field: v}
        out.append((start + i, source, i, f["max_force"], f["energy_per_atom"], f["virial_norm"], t0 + dt.timedelta(minutes=7 * i), "clash"))
    return out


def found(spark, data, **how):
    cases, _ = implausible_readings(spark.createDataFrame(data, SCHEMA), AUDIT_FIELDS, **how)
    return {(r.record_id, r.field): r.reason for r in cases.where("reason <> 'off_profile'").collect()}


@pytest.fixture(scope="module")
def normal():
    return np.exp(np.random.default_rng(1).normal(0, 0.3, 400)).tolist()


def test_components_separate_spikes_from_low_rank():
    rng = np.random.default_rng(0)
    low = np.outer(rng.normal(size=40), rng.normal(size=24))
    m = low.copy()
    m[3, 5] += 30
    _, sparse = robust_components(m, np.ones_like(m, bool))
    assert np.unravel_index(np.abs(sparse).argmax(), sparse.shape) == (3, 5)


def test_spikes_invalid_and_level_change(spark, normal):
    v = list(normal)
    v[10], v[20], v[30], v[40] = 900.0, float("nan"), float("inf"), -1.0
    v[200:] = [x + 4 for x in v[200:]]  # a level that changed for good is ordinary
    data = rows(v) + rows(v)[5:8]
    assert found(spark, data) == {(10, "max_force"): "spike", (20, "max_force"): "invalid", (30, "max_force"): "invalid", (40, "max_force"): "invalid"}


@pytest.mark.parametrize("block_rows", [4, 7, 8192])
def test_runs_over_block_borders_skip_nulls(spark, normal, block_rows):
    v = list(normal[:60])
    v[11:17] = [0.7] * 6
    v[17] = None
    v[30:35] = [0.9] * 5  # too short
    v[50:57] = [0.8, 0.8, None, 0.8, 0.8, 0.8, 0.8 * (1 + 5e-8)]
    want = {(i, "max_force") for i in [*range(11, 17), 50, 51, 53, 54, 55, 56]}
    assert {k for k, r in found(spark, rows(v), block_rows=block_rows).items() if r == "stuck"} == want


def test_empty_null_position_and_null_source(spark, normal):
    assert found(spark, []) == {}
    data = [(r[0], None, None, *r[3:]) for r in rows([1.0] * 10)]
    assert found(spark, data) == {}


def test_small_blocks_are_judged(spark, normal):
    # records without a position, beside positioned ones and alone
    v = list(normal)
    v[150], v[399] = 900.0, 800.0
    unplaced = lambda data: [(r[0], r[1], None, *r[3:]) for r in data]
    data = rows(v)
    assert found(spark, data[:100] + unplaced(data[100:])) == {(150, "max_force"): "spike", (399, "max_force"): "spike"}
    assert found(spark, unplaced(data)) == {(150, "max_force"): "spike", (399, "max_force"): "spike"}
    # the tail block holds two readings
    assert found(spark, data, block_rows=398) == {(150, "max_force"): "spike", (399, "max_force"): "spike"}
    # positions so far apart that every block holds one reading
    sparse = [(r[0], r[1], r[2] * 10_000, *r[3:]) for r in data]
    assert found(spark, sparse) == {(150, "max_force"): "spike", (399, "max_force"): "spike"}


def test_the_low_rank_part_is_the_profile(spark, monkeypatch):
    # a daily swing of 5 to 15; a reading of 5 at an hour whose normal value is 15 is common elsewhere
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)
    hours = np.arange(24 * 40)
    v = 10 - 5 * np.cos(2 * np.pi * hours / 24) + rng.normal(0, 0.05, len(hours))
    v[24 * 20 + 12] = 5.0
    v[24 * 30 + 3] = 200.0
    data = [(int(i), "a", int(i), float(x), None, None, t0 + dt.timedelta(hours=int(i)), "x") for i, x in zip(hours, v)]
    run = lambda: implausible_readings(spark.createDataFrame(data, SCHEMA), AUDIT_FIELDS)[0].collect()
    got = run()
    off = {r.record_id: r.normal for r in got if r.reason == "off_profile"}
    assert set(off) >= {24 * 20 + 12, 24 * 30 + 3} and len(off) <= 4 and abs(off[24 * 20 + 12] - 15) < 1
    assert [(r.record_id, r.reason) for r in got if r.reason != "off_profile"] == [(24 * 30 + 3, "spike")]
    v = np.array([r[3] for r in data])
    day, hour = hours // 24, hours % 24
    assert ordinary_core(v, day, hour)[1][24 * 20 + 12]
    # without the low-rank part the reading inside the swing is lost
    monkeypatch.setattr(spikes, "robust_components", lambda m, known: (np.zeros_like(m), np.where(known, m, 0.0)))
    assert not ordinary_core(v, day, hour)[1][24 * 20 + 12]
