import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.expression import ExpressionError, compile_predicate
from framelake.operators.cells import bain_path, determinant, shear, strain
from framelake.operators.filters import Condition, FilterError, FilterSpec, Presets, combine, element_condition, index_positions, parse_elements, search, tag_groups, text_condition
from framelake.operators.vectors import farthest_points, pairwise_distances, principal_variances, sqrt_quotas

FRAMES = [("surface_relax", "Fe2O3", ["Fe", "O"]), ("bulk", "FeO", ["Fe", "O"]), ("surface_h", "FeOH", ["Fe", "O", "H"]), ("molecule", "H2O", ["H", "O"]), (None, "FeOC", ["Fe", "O", "C"])]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FRAMES)], "id int, tag string, formula string, elements array<string>")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("mode, values, want", [("contains", ["SURFACE"], [0, 2]), ("exact", ["bulk"], [1]), ("prefix", ["surf"], [0, 2]), ("suffix", ["relax"], [0]), ("regex", ["^(bulk|mol)"], [1, 3])])
def test_text_modes(frames, mode, values, want):
    assert ids(frames.where(text_condition(F.col("tag"), values, mode))) == want


def test_elements_and_combination(frames):
    e = F.col("elements")
    assert ids(frames.where(element_condition(e, **parse_elements("+Fe -H")))) == [0, 1, 4]
    assert ids(frames.where(element_condition(e, **parse_elements("Fe,O")))) == [0, 1]
    both = [element_condition(e, required=["C"]), text_condition(F.col("tag"), ["bulk"])]
    assert ids(frames.where(combine(both, "any"))) == [1, 4] and ids(frames.where(combine(both))) == []
    with pytest.raises(ValueError):
        combine([])


@pytest.mark.parametrize("text, want", [
    ("x > 1", [2]), ("not (x > 1)", [0, 1, 3]), ("x != 2", [0, 1, 3]), ("0 <= x <= 1", [0]), ("x / 0 > 5", [2, 0]), ("x == 1 || !(x < 9)", [0, 1, 3]), ("has_x AND x + 1 * 2 >= 3", [0, 2]),
    ("x / 0 - x / 0 > 5", []), ("x / 0 * 0 == x / 0 * 0", []), ("x / 0 * 0 != x", [0, 1, 2, 3]),
])
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, float("nan"))], "id int, x double")
    assert ids(df.where(compile_predicate(text, {"x": F.col("x"), "has_x": F.col("x").isNotNull()}))) == sorted(want)


@pytest.mark.parametrize("text", ["x", "1 < 2", "y > 1", "x ** 2 > 1", "f(x) > 1", "x.1 > 2", "x >"])
def test_bad_expressions(spark, text):
    with pytest.raises(ExpressionError):
        compile_predicate(text, {"x": F.lit(1.0)})


def test_index_expression(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("id"))
    assert ids(index_positions(df, ["id"], "1:6:2, -2:, 8, bad")) == [1, 3, 5, 8, 9]
    assert ids(index_positions(df, ["id"], ":3")) == [0, 1, 2]
    for text in ("-", "8:2:-3, 5:5", "::-4", "-3:", "12, -11", "a:b", "", ":", "20:", "-20:2"):
        want = set()
        for t in text.replace(",", " ").split():
            try:
                want |= set(list(range(10))[slice(*(int(p) if p else None for p in t.split(":")))]) if ":" in t else {range(10)[int(t)]}
            except (ValueError, IndexError):
                continue
        assert ids(index_positions(df, ["id"], text)) == sorted(want), text


def test_index_expression_on_wide_rows(spark):
    df = spark.range(0, 200_000, numPartitions=8).withColumn("t", F.repeat(F.lit("x"), 200))
    assert ids(index_positions(df, ["id"], "-5:, 50000,100000")) == [50000, 100000, *range(199995, 200000)]


def test_filter_specifications(frames, spark):
    cols = {"config_type": F.col("tag"), "formula": F.col("formula"), "elements": F.col("elements")}
    run = lambda *c, how="all": ids(frames.where(FilterSpec(c, how).compile(cols, {"n": F.size("elements")})))
    assert run(Condition("formula", ("feo",))) == [1] and run(Condition("formula", ("feo",), case=True)) == []
    assert run(Condition("config_type", ("SURF",)), Condition("element_excluded", ("h",))) == [0]
    assert run(Condition("element_required", ("c",)), Condition("expression", ("n < 2",)), how="any") == [4]
    assert run(Condition("config_type", ("bulk",), enabled=False), Condition("element_allowed", ("H", "O"))) == [3]
    for bad, code in ((Condition("formula", ("x",), enabled=False), "empty_condition"), (Condition("formula", (" ",)), "empty_condition"), (Condition("element_required", ("Qq",)), "unknown_element"),
                      (Condition("config_type", ("(",), "regex"), "invalid_regex"), (Condition("colour", ("x",)), "unsupported_operator"), (Condition("formula", ("x",), "like"), "unsupported_operator")):
        with pytest.raises(FilterError) as e:
            run(bad)
        assert e.value.code == code
    book = Presets()
    book.save("a", FilterSpec((Condition("formula", ("FeO",)),)))
    book.rename("a", "b")
    assert book.names() == ["b"] and book.load("b") == FilterSpec((Condition("formula", ("FeO",)),)) and book.delete("b") and not book.delete("b")
    unknown = []
    assert parse_elements("+fe, !H qq O", unknown) == {"required": ["Fe"], "excluded": ["H"], "allowed": ["O"]} and unknown == ["qq"]
    assert ids(search(frames, "^surf", tag="tag")) == [0, 2] and ids(search(frames, "(", tag="tag")) == [] and ids(search(frames, "FeO$", "formula")) == [1] and ids(search(frames, "+C", "elements")) == [4]
    assert ids(frames.where(tag_groups(F.col("tag"), []))) == [] and ids(frames.where(tag_groups(F.col("tag"), [("any", [("", False)]), ("all", [("surf", True)])]))) == [1, 3, 4]


def test_vectors(spark):
    x = np.array([[0, 0], [1, 0], [5, 0], [5, 4], [0, 0]], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    assert farthest_points(df, "id", "v", 9) == [0, 3, 2, 1]  # the repeat of the first lies below the least distance
    got = [r.variance for r in principal_variances(df, "v", 2).orderBy("component").collect()]
    assert np.allclose(got, np.linalg.eigvalsh(np.cov(x.T))[::-1])
    assert sum(sqrt_quotas({"a": 100, "b": 1, "c": 25}, 20).values()) == 20


def test_distances_of_all_pairs(spark):
    x = np.random.default_rng(5).normal(size=(23, 3))
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (99, None)], "id int, v array<float>")
    got = {(r.i, r.j): r.d for r in pairwise_distances(df, "id", "v", block_rows=5).collect()}
    assert len(got) == 24 * 24 and all((d is None) == (99 in k) for k, d in got.items())
    assert all(abs(d - np.linalg.norm(x[i] - x[j])) < 1e-5 for (i, j), d in got.items() if d is not None)


def test_cells_keep_what_they_should(spark):
    df = spark.createDataFrame([(1, [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.5, 0.0, 3.0]])], "id int, lattice array<array<double>>")
    volume = determinant(F.col("lattice")).alias("v")
    assert np.allclose([r.v for r in bain_path(df, (0.8, 1.2, 0.1)).select(volume).collect()], 12)
    assert strain(df, (-1, 1, 1), (0, 0, 1), (0, 2, 1)).count() == 9
    assert np.allclose([r.v for r in shear(df, (-5, 5, 5), (0, 0, 1), (0, 0, 1)).select(volume).collect()], 12)
