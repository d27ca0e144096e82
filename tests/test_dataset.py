import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import audit, catalog, energy, local_chemistry, motifs, selection

RECORDS = "structure_id bigint, formula string, natoms int, composition map<string,int>, config_type string, energy_per_atom double, max_force double, virial_norm double"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (2, "Fe10Ni6", 16, {"Fe": 10, "Ni": 6}, "bulk", -4.0, 1.0, None), (8, "Fe20Ni12", 32, {"Fe": 20, "Ni": 12}, "vacancy", -4.5, 2.0, 1.0),
        (9, "Ni16", 16, {"Ni": 16}, "bulk", float("nan"), 3.0, 2.0), (11, "Fe2", 2, {"Fe": 2}, None, -5.0, None, float("inf")), (12, "Fe", 1, {"Fe": 1}, "  ", -5.5, 9.0, 0.5),
    ]
    return spark.createDataFrame(rows, RECORDS)


def test_inventory_of_exact_compositions(records):
    got = {r.point: r for r in audit.inventory(records).collect()}
    p = got["Fe:5|Ni:3"]
    assert set(got) == {"Fe:5|Ni:3", "Ni:1", "Fe:1"} and p.ids == [2, 8] and [tuple(x) for x in p.atom_counts] == [(16, 1), (32, 1)] and [tuple(x) for x in p.config_types] == [("bulk", 1), ("vacancy", 1)]
    assert got["Fe:1"].missing_config_type == 2 and p.share == pytest.approx(0.4)


def test_targets_and_config_types(records, spark):
    out = {(r.target, r.config_type): (r.status, r.observed) for r in audit.target_support(records, "Fe", [0.625, 1.0, 0.3], least=2, config_types=["Bulk", "gas"]).collect()}
    assert out[0.625, "Bulk"] == ("thin", 1) and out[0.625, "gas"] == ("no_config_type", 0) and out[1.0, "Bulk"] == ("unjudgeable", 0) and out[0.3, "gas"] == ("no_sample", 0)
    assert {r.status for r in audit.target_support(records, "Au", [0.5]).collect()} == {"unjudgeable"}
    assert audit.target_support(records, "Fe", [0.625]).first().status == "supported"
    counts, missing, state = audit.config_types(records)
    assert [tuple(r) for r in counts.collect()] == [("bulk", 2), ("vacancy", 1)] and [r[0] for r in missing.collect()] == [11, 12] and state.first()[0] == "partial"
    assert audit.config_types(records.limit(0))[2].first()[0] == "unavailable"


def test_labels_tails_and_quantiles(records, spark):
    h = {(r.label, r.bin): r.ids for r in audit.label_histograms(records).collect()}
    assert h["max_force", 0] == [2, 8] and h["max_force", 3] == [12] and sum(len(v) for k, v in h.items() if k[0] == "energy_per_atom") == 4
    tails = {(r.label, r.structure_id) for r in audit.label_tails(records).collect()}
    assert tails == {("max_force", 12), ("energy_per_atom", 2)}
    assert audit.label_tails(records.limit(3)).count() == 0
    assert [tuple(r) for r in audit.label_coverage(records).collect()] == [("energy_per_atom", 4, 5), ("max_force", 4, 5), ("virial_norm", 3, 5)]
    x = np.concatenate([np.random.default_rng(0).lognormal(size=30_000), np.repeat(2.0, 5000), [1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for q in (0.0, 0.1, 0.5, 0.77, 0.9, 0.999, 1.0):
        assert audit.exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
    assert audit.exact_quantile(df.limit(0), "v", 0.5) is None and audit.exact_quantile(df.where("v = 2.0"), "v", 0.3) == 2.0


def test_composition_bins_and_completions(records):
    bins = {(r.element, r.bin): r.structures for r in audit.composition_bins(records).collect()}
    assert bins == {("Fe", 0): 1, ("Fe", 4): 2, ("Fe", 6): 2, ("Ni", 0): 2, ("Ni", 2): 2, ("Ni", 6): 1}
    got = {(r.kind, r.token): r.structures for r in audit.completions(records, 2, ["max_force"]).collect()}
    assert got["element", "Fe"] == 4 and got["tag", "bulk"] == 2 and got["field", "max_force"] == 4


def test_findings_and_fingerprints(records, spark):
    slices = spark.createDataFrame([("local_chemistry:radial:Fe:n:1", "local_chemistry", "evidence", "x", [3, 1]), ("local_chemistry:radial:Fe:n:2", "local_chemistry", "evidence", "y", [1, 2]), ("data_quality:empty", "data_quality", "blocker", "z", [9])], "id string, dimension string, kind string, observed string, ids array<bigint>")
    assert [(r.finding, r.slices, r.ids) for r in audit.consolidate(slices).collect()] == [("data_quality:empty", 1, [9]), ("local_chemistry:radial:Fe", 2, [1, 2, 3])]
    one = audit.fingerprint(records, "structure_id")
    assert one == audit.fingerprint(records.repartition(3), "structure_id") and one != audit.fingerprint(records.limit(4), "structure_id")
    ids = records.select("structure_id")
    assert audit.scope_fingerprint("active", 5, ids) != audit.scope_fingerprint("selected", 5, ids)


def test_cutoff_profiles():
    p = local_chemistry.parse_cutoffs("nep4 2 Fe O\ncutoff 6 5 4 3 20 20\n")
    assert p.radial == (6, 4) and p.angular == (5, 3) and p.pair("Fe", "O", "radial") == 5
    for bad in ("", "nep4 2 Fe\ncutoff 6 5 1 1", "nep4 1 Qq\ncutoff 6 5 1 1", "nep4 1 Fe\n", "nep4 1 Fe\ncutoff 5 6 1 1", "nep4 1 Fe\ncutoff 5 x 1 1", "nep4 1 Fe\ncutoff 5 4 1"):
        with pytest.raises(ValueError):
            local_chemistry.parse_cutoffs(bad)


def test_low_support_contacts_keep_distances(spark):
    rows = [(i, ["Fe", "O"], [[0.0] * 3, [1.0 + 0.1 * i, 0.0, 0.0]], None, [False] * 3) for i in range(4)] + [(9, ["Fe", "C"], [[0.0] * 3, [9.0, 0.0, 0.0]], None, [False] * 3)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>")
    profile = local_chemistry.CutoffProfile(("Fe", "O", "C"), (2.0,) * 3, (1.05,) * 3)
    got = {(r.scope, r.a, r.b): r for r in local_chemistry.pair_contacts(df, profile).collect()}
    r = got["radial", "Fe", "O"]
    assert (r.contacts, r.contact_structures, r.support) == (8, 4, "low support") and r.distance_q50 == pytest.approx(0.575) and r.near_cutoff == 0
    a = got["angular", "Fe", "O"]
    assert (a.contacts, a.distance_q50) == (2, round(1 / 1.05, 4)) and a.near_cutoff == 1.0 and got["radial", "Fe", "C"].support == "no local contact"


ATOMS = "structure_id bigint, species array<string>, energy double, config_type string"


def test_baselines_fit_apply_and_store(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        n = rng.integers(1, 6, 2)
        rows.append((i, ["Fe"] * int(n[0]) + ["O"] * int(n[1]), float(n @ ([-3.0, -1.0] if i % 2 else [-2.0, -5.0])), "bulk_1" if i % 2 else "surf"))
    df = spark.createDataFrame([*rows, (98, ["H"], None, "bulk_2"), (99, ["Fe"], -1.0, "other")], ATOMS)
    for method, tol in (("exact", 1e-6), ("evolution", 0.05)):
        b = energy.fit_baseline(df.where("structure_id < 60"), mode="zero", patterns=["bulk.*"], method=method)
        assert np.allclose(b.group_to_ref["bulk.*"], [-3, -1], atol=tol) and np.allclose(b.group_to_ref["surf"], [-2, -5], atol=tol)
    b = energy.fit_baseline(df.where("structure_id < 60"), mode="zero", patterns=["bulk.*"], method="exact")
    out = energy.apply_baseline(df, b)
    assert out.where("structure_id < 60").agg(F.max(F.abs("energy"))).first()[0] < 1e-6
    again = energy.apply_baseline(out, b).where("structure_id = 0").first()
    assert again.energy_original == rows[0][2]
    assert energy.apply_counters(out) == {"total": 62, "shifted": 60, "no_energy": 1, "no_group": 1, "no_elements": 0, "unmatched": ["other"]}
    store = energy.BaselineStore(str(tmp_path / "b"))
    store.save("first one", b)
    assert store.names() == ["first one"] and store.load("first one") == b and store.delete("first one") and not store.delete("first one") and store.names() == []
    with pytest.raises(ValueError):
        store.save("../x", b)
    with pytest.raises(ValueError):
        energy.fit_baseline(df)
    assert energy.suggest_patterns(["A001", "A002", "B1"]) == ["A00.*", "B1"] == energy.suggest_patterns(["B1", "A002", "A001"]) and energy.suggest_patterns([]) == []


def test_predictors_and_corrections(spark):
    rows = [(i, ["Fe"] * (i + 1), [[float(k), 0.0, 0.0] for k in range(i + 1)], None, [False] * 3) for i in range(6)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>")

    def factory():
        def model(chunk):
            if sum(len(r["species"]) for r in chunk) > 6:
                raise MemoryError
            return [{"energy": -float(len(r["species"]))} for r in chunk]

        return model

    assert [r.predicted_energy for r in energy.predict(df, factory, max_atoms=9).orderBy("structure_id").collect()] == [-1, -2, -3, -4, -5, -6]
    base = spark.createDataFrame([(1, -1.0, [[1.0]]), (2, -2.0, [[2.0]])], "structure_id bigint, energy double, forces array<array<double>>")
    fix = spark.createDataFrame([(1, 0.5, [[0.25]])], "structure_id bigint, energy double, forces array<array<double>>")
    assert [(r.energy, r.forces) for r in energy.add_correction(base, fix, -1).orderBy("structure_id").collect()] == [(-1.5, [[0.75]]), (-2.0, [[2.0]])]


def test_selection_and_metadata(spark):
    df = spark.createDataFrame([(i, {"a": "1", "b": "2"}) for i in range(4)], "structure_id bigint, extra map<string,string>")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "structure_id bigint")
    ids = lambda d: sorted(r[0] for r in d.collect())
    s = selection.State(df).remove(pick(3, 77)).apply(pick(0, 3, 99))
    assert ids(s.selected()) == [0] and ids(s.inverse().selected()) == [1, 2] and s.version == 1 and s.remove(pick(3)).version == 1
    t = s.delete_selected()
    assert ids(t.active().select("structure_id")) == [1, 2] and ids(t.selected()) == [] and ids(t.revoke().active().select("structure_id")) == [0, 1, 2] and t.revoke().version == 3
    with pytest.raises(ValueError):
        selection.merge(pick(1), pick(2), "xor")
    out = {r.structure_id: r.extra for r in selection.edit_metadata(df, pick(1), add={"c": "[1, 2]", "a": "7"}, rename={"b": "d"}).collect()}
    assert out[1] == {"a": "7.0", "c": "[1, 2]", "d": "2"} and out[0] == {"a": "1", "b": "2"}
    assert selection.edit_metadata(df, pick(2), remove=["a"]).where("structure_id = 2").first().extra == {"b": "2"} and selection.parse_value("x y") == "x y"
    assert selection.unique_patterns(spark.createDataFrame([([1, 2],), ([2, 1],), ([3],)], "p array<int>"), "p").count() == 2
    with pytest.raises(ValueError):
        selection.attach_rows(pick(1, 2), spark.range(3).withColumnRenamed("id", "row"), F.lit(1)).count()


def test_catalog(spark):
    projects = spark.createDataFrame([(1, "Root", None), (2, "Sub", 1), (3, "Deep", 2), (4, "Other", 0)], "id bigint, name string, parent_id bigint")
    models = spark.createDataFrame([(10, "m a", 3, "NEP", None), (11, "m b", 2, "nep ", 10), (12, "c", 4, "DP", 11)], "id bigint, name string, project_id bigint, model_type string, parent_id bigint").withColumn("notes", F.lit("")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    tags = spark.createDataFrame([(1, "Good")], "id bigint, name string")
    links = spark.createDataFrame([(10, 1)], "model_version_id bigint, tag_id bigint")
    find = lambda **k: [r.id for r in catalog.search_models(models, projects=projects, links=links, newest_first=False, **k).collect()]
    assert find(project_id=1, with_subprojects=True) == [10, 11] and find(model_type="nep") == [10, 11] and find(parent="none") == [10] and find(parent=10) == [11]
    assert find(text="M ") == [10, 11] and find(any_tags=[1]) == [10] == find(all_tags=[1]) and find(no_tags=[1], limit=1, offset=1) == [12]
    assert {r.project_id: (r.models, r.total) for r in catalog.project_counts(projects, models).collect()} == {1: (0, 2), 2: (1, 2), 3: (1, 1), 4: (1, 1)}
    assert [r.id for r in catalog.lineage(models, 12).orderBy("step").collect()] == [12, 11, 10]
    p, m, x = catalog.remove_project(projects, models, links, 2)
    assert (p.count(), m.count(), x.count()) == (2, 1, 0)
    m, x = catalog.remove_model(models, links, 10)
    assert m.where("id = 11").first().parent_id is None and x.count() == 0
    t, x = catalog.tag_models(tags, links, 11, [" good ", "New  tag", "new tag"])
    assert t.count() == 2
    assert x.where("model_version_id = 11").select("tag_id").distinct().count() == x.where("model_version_id = 11").count()
    assert catalog.remove_tag(tags, links, 1)[1].count() == 0 and catalog.modify_row(projects, 4, {"name": "New"}).where("id = 4").first().name == "New"
    with pytest.raises(catalog.CatalogError):
        catalog.add_row(projects, {"name": " root "})
    pack = {"schema_version": 1, "catalog_id": "c", "catalog_version": "2", "source": {}, "project": {"name": "Pack"}, "models": [{"id": 5, "name": "b", "model_type": "NEP", "model_path": "p", "parent_id": 6}, {"id": 6, "name": "a", "model_type": "NEP", "model_path": "p", "energy": 1}]}
    wide = models.withColumn("energy", F.lit(0.0))
    p, m, new = catalog.import_catalog(catalog.parse_catalog(json.dumps(pack)), projects.withColumn("notes", F.lit("")), wide)
    assert new == {6: 13, 5: 14} and m.where("id = 14").first().parent_id == 13 and p.count() == 5
    for change in ({"schema_version": 2}, {"models": [{"id": 1}]}, {"project": {}}, {"models": [{**pack["models"][0], "parent_id": 9}]}):
        with pytest.raises(catalog.CatalogError):
            catalog.parse_catalog(json.dumps({**pack, **change}))
    loop = {**pack, "models": [{**pack["models"][0], "parent_id": 6}, {**pack["models"][1], "parent_id": 5}]}
    with pytest.raises(catalog.CatalogError):
        catalog.import_catalog(catalog.parse_catalog(json.dumps(loop)), projects.withColumn("notes", F.lit("")), wide)


def test_motifs_and_comparisons(spark):
    rows = [(1, ["Fe", "O", "O"], [[0.0] * 3, [1.9, 0.0, 0.0], [-1.9, 0.0, 0.0]], None, [False] * 3), (2, ["Fe", "O"], [[0.0] * 3, [1.9, 0.0, 0.0]], None, [False] * 3)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>")
    sig = motifs.signatures(df, "cutoff", 2.0)
    assert {r.signature: r.n for r in motifs.histogram(sig).collect()} == {"Fe|O2": 1, "Fe|O1": 1, "O|Fe1": 3}
    e = motifs.entropy(sig).first()
    assert e.classes == 3 and e.entropy == pytest.approx(-(0.6 * math.log(0.6) + 0.4 * math.log(0.2)))
    assert {r.structure_id: r.rare for r in motifs.rare(sig, 1).collect()} == {1: 1, 2: 1}
    cov = {(r.centre, r.around): (r.observed, r.state) for r in motifs.coverage(sig, {"Fe": 0.4, "O": 0.6}, [1, 2]).collect()}
    assert cov["O", "Fe1"][0] == 3 and cov["O", "O1"] == (0, "missing") and cov["Fe", "O2"][0] == 1
    assert motifs.signatures(df, "natural", 1.2, "pair").count() == 5
    same = motifs.histogram(sig)
    assert motifs.divergence(same, same) == pytest.approx(0) and motifs.divergence(same, same.limit(0)) == pytest.approx(math.log(2))
    assert motifs.shell_overlap({"a": sig, "b": sig}).first().share == 1.0
    data = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 7), float(i % 3)], float(i % 7)) for i in range(60)], "id bigint, s string, v array<double>, y double")
    split = motifs.stratified_split(data, "s", "id", 0.2)
    assert {r.s: r.n for r in split.where("held_out").groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 6, "b": 6}
    got = motifs.inverse_distance(split.where("NOT held_out"), split.where("held_out"), "id", "v", "y", 3, block_rows=16).collect()
    assert len(got) == 12 and all(abs(r.predicted - r.actual) < 1e-6 for r in got)
    assert motifs.proportional_quotas({"a": 90, "b": 9, "c": 1}, 20) == {"a": 17, "b": 2, "c": 1}
    labels = spark.createDataFrame([("x", "x", "y"), ("x", "y", None)], "p string, q string, r string")
    assert {(r.a, r.b): (r.n, r.same) for r in motifs.agreement(labels, ["p", "q", "r"]).collect()} == {("p", "q"): (2, 1), ("p", "r"): (1, 0), ("q", "r"): (1, 0)}


def test_expression_fields(spark):
    from framelake.functions.expression import ExpressionError
    from framelake.operators import fields

    rows = [(1, ["Fe", "O"], [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 3.0]], -4.0, [[1.0, 0.0, 0.0], [0.0, -3.0, 0.0]]), (2, ["O"], None, None, None)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, lattice array<array<double>>, energy double, forces array<array<double>>")
    nan = float("nan")
    metrics = spark.createDataFrame([("Energy (eV)", 1, 0, [-3.5], [-4.0]), ("Energy (eV)", 2, 0, [1.0], [nan]), ("force", 1, 0, [1.0, 0.0, 0.0], [2.0, 0.0, 0.0]), ("force", 1, 1, [0.0, 0.0, -9.0], [0.0, 0.0, 1.0])], "dataset string, structure_id bigint, row_no int, pred array<double>, ref array<double>")
    run = lambda text: sorted(r.structure_id for r in fields.select(df, text, metrics).collect())
    assert run("volume > 11 and natoms == 2") == [1] and run("has_energy") == [1] and run("not has_forces") == [2] and run("count.Fe < 1") == [2] and run("frac.o == 0.5") == [1] and run("has.Au") == []
    assert run("energy_ev.err == 0.5") == [1] and run("energy_ev != 0") == [1, 2] and run("force.pred.norm > 8") == [1] and run("force.x == 2") == [1] and run("force.err.z >= 10") == [1]
    assert run("atomic.forces.norm > 2.5") == [1] and run("atomic.forces.y == 3") == [1] and run("energy_per_atom < 0 and c >= 3 and gamma == 90") == [1]
    for bad in ("force > 1", "force.q > 1", "has.Qq", "nothing > 1", "force.1 > 2", "natoms"):
        with pytest.raises(ExpressionError):
            run(bad)
    got = {r.token: r.structures for r in fields.completions(df, metrics).collect()}
    assert got["natoms"] == 2 and got["has_energy"] == 1 and got["has.O"] == 2 and got["energy_ev_"] == 2 or got["force"] == 1
